"""Name links that no block may lose."""

import random

from cratewright.llm import names

CREDITS, SHORT = "credit_id bigint, artist string, mb_artist_id string", "given_name string, short_name string"


def linked(spark, artists, short=()):
    df = spark.createDataFrame([(i, a, None) for i, a in enumerate(artists, 1)], CREDITS)
    roots = {r.credit_id: r.root for r in names.linked_names(df, spark.createDataFrame(list(short), SHORT)).collect()}
    root = {a: roots.get(i, -i) for i, a in enumerate(artists, 1)}
    return lambda x, y: root[x] == root[y]


def test_short_forms_with_another_first_letter(spark):
    same = linked(spark, ["William Tarn", "Bill Tarn", "Margaret Skulmixskend", "Peggy Skulmixskend", "Peggy Tarn", "Robert Flenbrot", "Bob Flenbrott"], [("William", "Bill"), ("Margaret", "Peggy"), ("Robert", "Bob")])
    assert same("William Tarn", "Bill Tarn") and same("Margaret Skulmixskend", "Peggy Skulmixskend") and same("Robert Flenbrot", "Bob Flenbrott")
    assert not same("William Tarn", "Peggy Tarn") and not same("William Tarn", "Robert Flenbrot")


def test_common_family_name(spark):
    rng = random.Random(3)
    crowd = {f"D{''.join(rng.choice('aeiou') + rng.choice('bgklmnprtv') for _ in range(3))} Smith" for _ in range(90)}
    artists = [*sorted(crowd), "Dolores Smith", "D. Smith", "Benedetta Smith", "Bnedetta Smith", "Wilhelmina Smith", "Vilhelmina Smith", "Ilhelmina Smith"]
    forms = {names.parse(a) for a in artists}
    assert len(forms) > 2 * names.COMMON
    same = linked(spark, artists)
    assert same("D. Smith", "Dolores Smith") and same("Benedetta Smith", "Bnedetta Smith") and same("Wilhelmina Smith", "Ilhelmina Smith")
    assert not same("Benedetta Smith", "Wilhelmina Smith")


def test_repeated_spellings_link_as_single_ones_do(spark):
    spellings = ["Anna Smithson", "Smithson Anna", "Anna Smihtson", "Smihtson, Anna"]
    assert linked(spark, ["Anna Smithson", "Anna Smihtson"])("Anna Smithson", "Anna Smihtson")
    same = linked(spark, [*spellings, "Ghosts Vilspondfrind", "G. Volmspondfrind", "G. Vilspodnfrind"])
    assert all(same("Anna Smithson", x) for x in spellings)
    assert same("Ghosts Vilspondfrind", "G. Vilspodnfrind") and not same("Ghosts Vilspondfrind", "G. Volmspondfrind")


def test_short_form_that_no_other_artist_shares(spark):
    same = linked(spark, ["Bob Winterbottom", "Robert Winterbottom"], [("robert", "bob")])
    assert same("Bob Winterbottom", "Robert Winterbottom")


def test_keys_are_suffixes_with_a_refining_letter():
    keys = names.block_keys("skulmixskend", "robert", set(), set())
    assert all(k[0][0] in "skulmixendrobt" for k in keys) and ("ixskend"[1:] + "|r", "xskend|r") in keys
    a, b = (names.block_keys(w, "d", set(), set()) for w in ("smithson", "smihtson"))
    assert {k for k, _ in a} & {k for k, _ in b}
    assert names.suffixes("abc", 6) == {"abc", "bc", "ac", "ab"}


def test_short_forms_seen_in_the_table(spark):
    mains = ("Wolkenbrook", "Trindelspar", "Mostrikvand", "Plundefrek")
    artists = [f"{g} {m}" for m in mains for g in ("Zephyrine", "Tuttie")]
    assert linked(spark, artists)("Zephyrine Wolkenbrook", "Tuttie Wolkenbrook")
    few = [a for a in artists if a.split()[1] in mains[:2]]
    assert not linked(spark, few)("Zephyrine Wolkenbrook", "Tuttie Wolkenbrook")
