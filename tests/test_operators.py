"""Operators against small brute-force versions and invariants."""

import random

from pyspark.sql import functions as F

from cratewright.operators import changes, dedup, graph, joins, normalize, rank, series


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 103), (7, 7), (200, 200)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect())
    assert all(got[i] == 0 for i in range(51)) and got[103] == 100 and got[200] == 200
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_band_pairs_with_and_without_buckets(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(3), rng.uniform(0, 50), rng.uniform(0, 5)) for i in range(120)]
    df = spark.createDataFrame(data, "id bigint, k int, x double, y double")
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 1.5 and abs(a[3] - b[3]) <= 1)
    for hint in (None, "x"):
        assert rows(dedup.band_pairs(df, ["k"], "id", {"x": 1.5, "y": 1.0}, hint)) == want


def test_keep_best_and_losers(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 1), (4, "b", 0), (5, None, 1), (6, None, 2)], "id bigint, k string, q int")
    order = [F.desc("q"), F.asc("id")]
    assert rows(dedup.keep_best(df, ["k"], order), "id") == [(1,), (4,), (6,)]
    assert rows(dedup.losers(df, ["k"], order), "id") == [(2,), (3,), (5,)]
    assert rows(dedup.winners_of_losers(df.where("k is not null"), ["k"], order, "id")) == [("a", 1, 2), ("a", 1, 3)]


def test_greedy_stars_is_not_transitive(spark):
    df = spark.createDataFrame([(1, "t", 1000.0, 10.0, "x"), (2, "t", 1009.0, 11.0, ""), (3, "t", 1018.0, 12.5, "x"), (4, "t", 5000.0, 10.0, "x"), (5, "u", 1000.0, 10.0, "x")], "id bigint, k string, size double, sec double, artist string")
    assert rows(dedup.greedy_stars(df, ["k"], "id", "size", "sec", "artist")) == [(1, 2)]


def brute_stars(pairs):
    near, taken, out = {}, set(), []
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    for n in sorted(near):
        if n not in taken:
            for m in sorted(near[n]):
                if m not in taken:
                    taken.add(m)
                    out.append((n, m))
    return sorted(out)


def test_first_stars_in_tasks_and_in_rounds(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(100, 112)})
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for small in (10_000, 0):
        assert rows(dedup.first_stars(df, small)) == brute_stars(pairs)


def test_fuzzy_pairs_brute_force(spark):
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    rng = random.Random(4)
    names = sorted({rng.choice(("the ", "The ", "a ", "")) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    counts = {n: rng.randrange(3) for n in names}
    df = spark.createDataFrame(list(counts.items()), "name string, n bigint")
    want = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = distance(a.lower(), b.lower())
            if a.lower().split(" ")[0] == b.lower().split(" ")[0] and 1 <= d <= 2:
                want.append((b, a, d) if counts[a] >= counts[b] else (a, b, d))
    assert rows(dedup.fuzzy_pairs(df, "name", "n", 2)) == sorted(want)


def test_numbered_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "b")], "id bigint, n string")
    out = dedup.numbered_names(df, F.col("n"), [F.col("id")], spark.createDataFrame([("b",)], "name string"))
    names = [r.name for r in out.collect()]
    assert len(set(names)) == 4 and "b_2" in names


def test_percentiles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 5.0, 1.0, 9.0, None])], "id int, v double")
    assert rows(rank.percentiles(df, "v", "p"), "id", "p")[:4] == [(0, 0.5), (1, 0.5), (2, 0.0), (3, 1.0)]
    assert [r.p for r in rank.percentiles(df.where("id = 2"), "v", "p").collect()] == [0.5]
    assert sorted(r.p for r in rank.percentiles(df.where("v is not null"), "v", "p", closed=False).collect()) == [0.0, 1 / 3, 1 / 3, 2 / 3]
    star = spark.createDataFrame([(x,) for x in (0.0, 0.199, 0.2, 0.4, 0.6, 0.8, 1.0, None)], "s double").select(rank.stars(F.col("s")).alias("v"))
    assert [r.v for r in star.collect()] == [1, 1, 2, 3, 4, 5, 5, None]
    back = spark.createDataFrame([(x,) for x in (0, 51, 77, 255)], "r int").select(rank.stars_of(F.col("r")).alias("v"))
    assert [r.v for r in back.collect()] == [0, 1, 0, 5]


def test_thresholds_and_batches(spark):
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("v"), "id")
    assert rows(rank.thresholds(df, "v")) == [(0.2, 20.0), (0.4, 40.0), (0.6, 60.0), (0.8, 80.0)]
    assert {r.batch: r.n for r in rank.batches(df, "id", 50).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 50, 1: 50, 2: 1}


def test_diverse_top(spark):
    df = spark.createDataFrame([("g", "a", "p1", 0.9), ("g", "a", "p2", 0.8), ("g", "b", "p3", 0.05), ("g", "c", "p4", 0.5), ("g", "d", "p5", 0.5)], "g string, who string, path string, score double")
    assert rows(rank.diverse_top(df, ["g"], ["who"], "score", ["path"], 3, 0.1), "place", "path") == [(1, "p1"), (2, "p4"), (3, "p5")]
    assert rows(rank.diverse_top(df, ["g"], ["who"], "score", ["path"], 4, 0.1), "place", "path") == [(1, "p1"), (2, "p4"), (3, "p5")]
    assert rows(rank.diverse_top(df, ["g"], ["who"], "score", ["path"], 1, 0.9, least_first=True), "path") == []


def test_rename_cascade(spark):
    counts = spark.createDataFrame([("sinead o connor", 1), ("chemical brothers", 1), ("Chemical Brothers", 3), ("80s-Falco", 2), ("Falco", 5), ("A feat. B", 1), ("A", 9), ("The Cure", 4), ("Cure", 4), ("C & D", 3), ("C", 2), ("múm", 1)], "name string, n bigint")
    typos = spark.createDataFrame([("sinead o connor", "Sinead O'Connor")], "old string, new string")
    got = {r.name: (r.new_name, r.rule) for r in normalize.rename_cascade(counts, typos, keep=("múm",)).collect()}
    assert got == {"sinead o connor": ("Sinead O'Connor", "typo"), "chemical brothers": ("Chemical Brothers", "case_fix"), "80s-Falco": ("Falco", "decade_prefix"), "A feat. B": ("A", "collab_strip"), "Cure": ("The Cure", "article_norm")}


def test_canonical_names_votes_win(spark):
    counts = spark.createDataFrame([("the verve", 9), ("The Verve", 2), ("THE VERVE", 1), ("Solo", 1)], "name string, n bigint")
    assert rows(normalize.canonical_names(counts)) == [("THE VERVE", "The Verve"), ("the verve", "The Verve")]
    votes = spark.createDataFrame([("THE VERVE", 5), ("Other", 9)], "name string, n bigint")
    assert rows(normalize.canonical_names(counts, votes)) == [("The Verve", "THE VERVE"), ("the verve", "THE VERVE")]


def test_resolve_category(spark):
    m = spark.createDataFrame([("electro", "Electronic"), ("ebm music", "EBM"), ("r&b/soul", "Pop")], "raw string, canonical string")
    df = spark.createDataFrame([(1, "Electro / EBM Music"), (2, "ebm"), (3, "R&B/Soul"), (4, "nothing"), (5, None), (6, "")], "id int, raw string")
    got = {r.id: r.canonical for r in normalize.resolve_category(df, "raw", m, normalize.taxonomy(spark)).collect()}
    assert got == {1: "EBM", 2: "EBM", 3: "Pop", 4: None, 5: None, 6: None}


def test_joins(spark):
    a = spark.createDataFrame([("/m/x", 1), ("/keep/y", 2), ("/z", 3)], "path string, id int")
    pm = spark.createDataFrame([("/m/x", "/n/x")], "old_path string, new_path string")
    assert rows(joins.classify_paths(a, "path", pm, ["/keep"]), "id", "outcome", "new_path") == [(1, "remap", "/n/x"), (2, "keep", "/keep/y"), (3, "drop", None)]
    ren = spark.createDataFrame([(1, "/m", "/q"), (2, "/m/x", "/r")], "pos int, old string, new string")
    assert rows(joins.first_prefix(a, "path", ren), "id", "new_path") == [(1, "/q/x"), (2, "/keep/y"), (3, "/z")]
    marks = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b")], "k string, s int, v string")
    pts = spark.createDataFrame([("k", 5), ("k", 10), ("k", 25), ("j", 25)], "k string, t int")
    assert sorted(((r.k, r.t, r.v) for r in joins.as_of(pts, marks, ["k"], "t", "s", "v").collect()), key=str) == [("j", 25, None), ("k", 10, "a"), ("k", 25, "b"), ("k", 5, None)]
    sib = spark.createDataFrame([(1, "g", None), (2, "g", "u"), (3, "g", "v"), (4, None, None)], "id int, g string, u string")
    assert rows(joins.fill_from_siblings(sib, ["g"], "u", [F.col("id")]), "id", "u") == [(1, "u"), (2, "u"), (3, "v"), (4, None)]
    assert rows(joins.set_change(spark.range(3), spark.range(1, 4), "id")) == [(0, "went"), (3, "came")]


def test_series(spark):
    v = [5, 1, 1, 9, 1, 1, 9, 1, 1, 1]
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    assert rows(series.longest_run(df, "k", "i", F.col("v") < 2)) == [("k", 1, 2)]  # the open run at the end does not count
    assert rows(series.islands(df, "k", "i", F.col("v") < 2), "start", "length", "closed") == [(1, 2, True), (4, 2, True), (7, 3, False)]
    assert rows(series.first_sustained(df, "k", "i", "v", F.lit(0.5), 10)) == [("k", 0)] and series.first_sustained(df, "k", "i", "v", F.lit(0.5), 11).count() == 0
    assert series.first_above_mean(df.where("i < 3"), "k", "i", "v").count() == 0
    words = spark.createDataFrame([(1, i, w, float(i)) for i, w in enumerate(["aaaa", "", "bbb.", "cc", "x" * 70, "d"])], "id int, p int, w string, s double")
    assert rows(series.grouped_words(words, "id", "p", "w", "s"), "line", "start", "text") == [(0, 0.0, "aaaa bbb."), (1, 3.0, "cc"), (2, 4.0, "x" * 70), (3, 5.0, "d")]


def test_changes(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "z", 5), (2, "y", 7)], "id int, s string, n int")
    ch = changes.change_set(a, b, "id", ["s", "n"])
    assert rows(ch.na.fill("-")) == [(1, "s", "x", "z"), (2, "n", "-", "7")]
    assert rows(changes.apply_changes(a, ch, "id")) == rows(b) and changes.change_set(b, changes.apply_changes(a, ch, "id"), "id", ["s", "n"]).count() == 0
    r = changes.report(b, ["n"], "s", 1).collect()
    assert {x.n for x in r} <= {1} or all(len(x.examples) <= 1 for x in r)
