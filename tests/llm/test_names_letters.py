"""Candidates put aside by their letters: never one that scores, and most of those that only share a suffix."""

import itertools
import random

from cratewright.llm import names


def alike(spark, forms):
    pairs = list(itertools.combinations(forms, 2))
    df = spark.createDataFrame([(*x, *y) for x, y in pairs], "a1 string, b1 string, a2 string, b2 string").repartition(4)
    both = df.select("*", names._letters("a1", "b1").alias("x"), names._letters("a2", "b2").alias("y"))
    flat = both.select("a1", "b1", "a2", "b2", *(both["x"][c].alias(f"{c}1") for c in names.LETTERS), *(both["y"][c].alias(f"{c}2") for c in names.LETTERS))
    rows = flat.withColumn("ok", names._may_be_alike()).collect()
    assert len(rows) == len(pairs)
    scores = names.scores(*([r[c] for r in rows] for c in ("a1", "b1", "a2", "b2")), names.Rests())
    return [(r, s) for r, s in zip(rows, scores)]


def test_no_pair_that_scores_is_put_aside(spark):
    rng = random.Random(11)
    forms = []
    for _ in range(40):
        a, b = ("".join(rng.choice("abdeilmnorstüжя𝄞") for _ in range(rng.randint(3, 24))) for _ in range(2))
        b = rng.choice([b, b[:1], ""])
        slip = rng.randrange(len(a))
        for x, y in ((a, b), (a[:slip] + a[slip + 1 :], b), (a[:slip] + "k" + a[slip:], b[:1]), (b, a), (a + b, ""), (b + a, ""), (names._DOUBLE.sub(r"\1", a + b), "")):
            forms.append((x, y))
    rows = alike(spark, forms)
    assert all(r.ok for r, s in rows if s > 0) and sum(s > 0 for _, s in rows) > 400


def test_words_that_share_a_suffix_only_are_put_aside(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("bdfgklmnprt") + rng.choice("aeiou") for _ in range(4)) + "tokrig" for _ in range(60)}
    rows = alike(spark, [(w, "fiona") for w in sorted(words)])
    assert sum(r.ok for r, _ in rows) < len(rows) / 4
