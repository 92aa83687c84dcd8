"""Files of wanted songs: equal to brute force, and no row for each pair that begins alike."""

import random

import numpy as np

from cratewright.operators import library, substrings


def brute(wanted, files):
    best = {}
    for key, artist, title in wanted:
        for path in files:
            *dirs, name = path.split("/") if path else [""]
            if not artist or not title or title[:20] not in name:
                continue
            r = 0 if any(d.startswith(artist) for d in dirs) else 1 if dirs and artist[:15] in dirs[-1] else None
            if r is not None:
                best[key] = min(best.get(key, (9, "")), (r, path))
    return {k: p for k, (_, p) in best.items()}


def found(spark, wanted, files):
    w = spark.createDataFrame(wanted, "key string, artist string, title string")
    return library.find_files(w, spark.createDataFrame([(p,) for p in files], "path string"))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda signs, least, most: "".join(rng.choice(signs) for _ in range(rng.randint(least, most)))
    artists = [word("abé𝄞 ", 1, 4) for _ in range(40)] + [f"The Great Orchestra {i}" for i in range(6)]
    titles = [word("xyзz", 1, 5) for _ in range(60)] + [f"Ladder of the Slow Mirror {i}" for i in range(6)]
    wanted = [(str(i), rng.choice(artists), rng.choice(titles)) for i in range(400)] + [("no artist", "", "x"), ("no title", "a", ""), ("null", None, "x"), ("null title", "a", None)]
    folders = ["/".join(["", *(rng.choice([a, f"{a} live", f"x {a}"]) for a in rng.choices(artists, k=rng.randint(0, 3)))]) for _ in range(80)]
    files = [f"{rng.choice(folders)}/{rng.choice(['', 'n '])}{rng.choice(titles)}{rng.choice(['', '.mp3'])}" for _ in range(300)] + ["", "xy", "a/xy", "/xy", None, "/a/"]
    got = {r.key: r.path for r in found(spark, wanted, files).collect()}
    want = brute(wanted, files)
    assert got == want and len(want) > 100


def test_empty_tables(spark):
    assert not found(spark, [], ["/a/b"]).collect() and not found(spark, [("k", "a", "b")], []).collect()


def most_rows(spark, before):
    """The most rows that one step of the queries after the first ``before`` gave; a file gave some 30 pieces before."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(before, runs.size()):
        number = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                m = metrics.apply(k)
                value = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_rows_follow_the_tables(spark):
    n = 1500
    wanted = [(str(i), "Various Artists", f"The {i:04} Song") for i in range(n)]
    files = [f"/music/Various Artists/The {i:04} Song.mp3" for i in range(n)]
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {r.key: r.path for r in found(spark, wanted, files).collect()} == dict(zip((k for k, _, _ in wanted), files))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert n <= most_rows(spark, before) <= 20 * n


def test_no_part_is_missed_by_a_full_filter():
    full = np.full(1 << 12, 255, np.uint8)
    assert list(substrings.passing(["abc", "", "aa"], full, 15, 2, False)) == [(0, "a"), (0, "ab"), (0, "b"), (0, "bc"), (0, "c"), (2, "a"), (2, "aa")]
    assert list(substrings.passing(["abc", "", "a"], full, 15, None, True)) == [(0, "a"), (0, "ab"), (0, "abc"), (2, "a")]
