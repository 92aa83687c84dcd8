"""Survivors, formatting copies, components: edge cases and brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from cratewright.llm import components, copies, survivor

ENTRY = "entry_id bigint, title string, artist string, ranking string, playcount string, last_played string, loc_dir string, imported_at timestamp, group_id string"
MEMBER = "group_id bigint, entry_id bigint, sha string, ranking int"


def entry(i, ranking=None, playcount=None, last=None, title="t", artist="a"):
    return (i, title, artist, ranking, playcount, last, "/:x/:", None, "clash")


def found(spark, members, entries):
    m = spark.createDataFrame([(g, e, "s", 1) for g, e in members], MEMBER)
    e = spark.createDataFrame(entries, ENTRY)
    return sorted(tuple(r) for r in survivor.best_fields(m, e).select("group_id", "field_name", "entry_id").collect())


def test_best_fields_rules(spark):
    entries = [
        entry(1, " 204.0", "0007", "2020/1/2"),
        entry(2, "51", "+9.00", "31.12.2019"),
        entry(3, "77", "9", "2019/2/30"),
        entry(4, "0255", "4.5", "1999-01-01"),
        entry(5, None, "", None),
        entry(9, "102", "3", "20210304"),
    ]
    members = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 4), (1, 77), (2, 4), (3, 5), (None, 1), (4, None), (5, 9)]
    got = found(spark, members, entries)
    assert got == [(1, "last_played", 1), (1, "playcount", 2), (1, "ranking", 1), (2, "ranking", 4), (5, "last_played", 9), (5, "playcount", 9), (5, "ranking", 9)]


def test_best_fields_ties_and_empty(spark):
    assert found(spark, [(1, 3), (1, 2)], [entry(2, "51", "5", "2020-1-2"), entry(3, "255", "5", "2 Jan 2020")]) == [(1, "last_played", 2), (1, "playcount", 2), (1, "ranking", 2)]
    assert found(spark, [], [entry(1, "51")]) == []
    assert found(spark, [(1, 1)], []) == []


def test_survivors(spark):
    m = spark.createDataFrame([(1, 1, "s", 1), (1, 2, "s", 1)], MEMBER)
    e = spark.createDataFrame([entry(1, "51", "1", None), entry(2, "51", "2", "2020/1/1")], ENTRY)
    r = survivor.survivors(m, e).first()
    assert (r.group_id, r.survivor_id, r.playcount, r.ranking) == (1, 2, "2", "51")


def test_dates(spark):
    good = {"2024/9/1": "2024-09-01", "2024-09-01T10:00:00": "2024-09-01", "01.09.2024": "2024-09-01", "September 1, 2024": "2024-09-01", "1 Sep 2024": "2024-09-01", " 2024/09/01 ": "2024-09-01", "2024/13/1": None, "never": None, "2026-07-01": None, "2000-12-31": None, "2021/6": None, "": None}
    df = spark.createDataFrame(list(good.items()), "t string, want string")
    rows = df.select("t", "want", survivor.calendar_date(F.col("t")).cast("string").alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def brute_copies(rows):
    def canon(s):
        return "".join(ch for ch in (s or "").lower().upper() if ch.isalnum())

    by = defaultdict(list)
    for i, a, t in rows:
        x, y = canon(a), canon(t)
        if x and y:
            by[tuple(sorted((x, y)))].append(i)
    return sorted((min(v), i) for v in by.values() if len(v) > 1 for i in v)


def test_copies_brute_force(spark):
    rng = random.Random(1)
    words = ["Red Sun", "red-sun", "RED  SUN!", "Été", "été.", "Straße", "STRASSE", "", None, "--", "ＡＢ", "AB", "x" * 5000]
    rows = [(i, rng.choice(words), rng.choice(words)) for i in range(600)] + [(1000 + i, "Hot Key", "same") for i in range(400)]
    df = spark.createDataFrame(rows, "entry_id bigint, artist string, title string").withColumn("h", F.lit("clash")).withColumn("run_id", F.lit(0))
    got = sorted(tuple(r) for r in copies.formatting_copies(df).select("group_id", "entry_id").collect())
    assert got == brute_copies(rows)
    total = copies.one_per_record(df).agg(F.sum("copies")).first()[0]
    assert total == sum(1 for _, a, t in rows if a and t and any(map(str.isalnum, a)) and any(map(str.isalnum, t)))


def test_copies_empty(spark):
    df = spark.createDataFrame([], "entry_id bigint, artist string, title string")
    assert copies.formatting_copies(df).count() == 0


def test_scan_runs_across_batches():
    import pyarrow as pa

    h = [1, 1, 2, 2, 2, 3, 4, 4]
    key = ["a", "a", "b", "c", "c", "d", "e", "e"]
    ids = [1, 5, 2, 3, 9, 4, 6, 7]
    whole = pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(ids)], names=["h", "key", "entry_id"])
    want = None
    for size in (1, 2, 3, 8):
        out = [b.to_pylist() for b in copies.scan_runs(iter([whole.slice(i, size) for i in range(0, 8, size)]))]
        rows = sorted((r["entry_id"], r["run_id"]) for b in out for r in b if r["entry_id"] is not None)
        edges = sorted((r["edge_key"], r["run_id"], r["edge_n"]) for b in out for r in b if r["edge_key"])
        assert edges == [("a", 1, 2), ("e", 6, 2)]
        assert rows == [(1, 1), (3, 3), (5, 1), (6, 6), (7, 6), (9, 3)]
        want = want or rows
        assert rows == want


def test_records_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "B", "c c", "d!", "e-f", "EF", "--", None]
    rows = [(i, rng.choice(words), rng.choice(words)) for i in range(300)] + [(1000 + i, "Hot Key", "same") for i in range(200)]
    df = spark.createDataFrame(rows, "entry_id bigint, artist string, title string")
    by = defaultdict(list)
    for i, a, t in rows:
        x, y = ("".join(ch for ch in (v or "").upper() if ch.isalnum()) for v in (a, t))
        if x and y:
            by[tuple(sorted((x, y)))].append(i)
    got = sorted(tuple(r) for r in copies.one_per_record(df.repartition(7)).select("group_id", "copies").collect())
    assert got == sorted((min(v), len(v)) for v in by.values())
    assert copies.one_per_record(df.limit(0)).count() == 0


def test_scan_counts_across_batches():
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 2, 3, 4, 4]), pa.array(["a", "a", "b", "c", "c", "d", "e", "f"]), pa.array([1, 5, 2, 3, 9, 4, 6, 7])], names=["h", "key", "entry_id"])
    for size in (1, 2, 3, 8):
        rows = [(r["run_id"], r["n"], r["edge_key"]) for b in copies.scan_counts(iter([whole.slice(i, size) for i in range(0, 8, size)])) for r in b.to_pylist()]
        assert sorted(rows) == [(1, 2, "a"), (2, 1, None), (3, 2, None), (4, 1, None), (6, 1, "e"), (7, 1, "f")]


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


def test_hash_to_min(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    rnd = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    pairs = chain + star + [(b, a) for a, b in chain[:5]] + [p for p in rnd if p[0] != p[1]]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3), (4, None)], "a bigint, b bigint")
    got = sorted(tuple(r) for r in components.hash_to_min(df, "a", "b").collect())
    assert got == brute_components(pairs)


def test_linked_entries(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 99), (5, 5), (None, 1), (8, 9)], "entry_a bigint, entry_b bigint").withColumn("entry_id", F.lit(0)).withColumn("v", F.lit(1))
    entries = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "entry_id bigint")
    assert sorted(tuple(r) for r in components.linked_entries(pairs, entries).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert components.linked_entries(pairs.limit(0), entries).count() == 0
