"""Short forms seen in the table: no main word is left out for the number of its rests."""

import random
from collections import defaultdict

from cratewright.llm import names

FORMS = "a string, b string"


def word(rng, n=4):
    return "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeiou") for _ in range(n))


def seen(spark, forms):
    return {(r.given, r.short) for r in names._seen_short_forms(spark.createDataFrame(sorted(forms), FORMS)).collect()}


def brute(forms):
    rests, used, n = defaultdict(set), defaultdict(int), defaultdict(int)
    for a, b in forms:
        used[b] += 1
        if len(b) > 2:
            rests[a].add(b)
    for r in rests.values():
        for x in r:
            for y in r:
                if x < y:
                    n[x, y] += min(1_000_000, 1_000_000 * (names.SEEN_WHOLE - 1) // (len(r) - 1))
    return {(x, y) for (x, y), k in n.items() if k >= 1_000_000 * max(names.SEEN, names.SEEN_PART * min(used[x], used[y]))}


def test_main_words_of_many_rests_count(spark):
    rng = random.Random(7)
    crowds = {(f"main{i}", word(rng)) for i in range(12) for _ in range(3 * names.COMMON if i == 0 else 20)}
    forms = crowds | {(f"main{i}", g) for i in range(12) for g in ("zephyrine", "tuttie")}
    assert ("tuttie", "zephyrine") in seen(spark, forms)
    assert seen(spark, forms) == brute(forms) == {("tuttie", "zephyrine")}


def test_equals_brute_force(spark):
    rng = random.Random(8)
    given = [word(rng, 2) for _ in range(30)]
    forms = {(f"main{i}", rng.choice(given)) for i in range(60) for _ in range(rng.choice([1, 2, 5, 20, 60]))} | {("main1", ""), ("main2", "k")}
    assert seen(spark, forms) == brute(forms)


def test_all_given_names_under_all_main_words_say_nothing(spark):
    rng = random.Random(9)
    given = [word(rng) for _ in range(60)]
    assert not seen(spark, {(f"main{i}", g) for i in range(40) for g in given})
