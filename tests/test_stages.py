"""Stages: conservation of rows, winners inside groups, order of rules."""

import pytest

from cratewright.operators import stages


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())


def test_rebuild_conserves_entries(spark):
    e = spark.createDataFrame([(1, "/o/a", "s1", 2), (2, "/o/b", "s1", 5), (3, "/keep/c", "s2", 1), (4, "/gone/d", "s1", 9), (5, "/keep/e", None, 0)], "entry_idx bigint, path string, sha string, richness int")
    m = spark.createDataFrame([("/o/a", "/n/a"), ("/o/b", "/n/b")], "old_path string, new_path string")
    refs = spark.createDataFrame([("p", 1, "/o/b"), ("p", 2, "/gone/d"), ("p", 3, "/keep/c")], "playlist string, pos int, path string")
    kept, new_refs, outcomes = stages.rebuild(e, m, ["/keep"], refs)
    assert rows(outcomes) == [(1, "merged"), (2, "remap"), (3, "keep"), (4, "drop"), (5, "keep")]
    assert rows(kept, "entry_idx", "path") == [(2, "/n/a"), (3, "/keep/c"), (5, "/keep/e")]
    assert rows(new_refs, "pos", "path") == [(1, "/n/a"), (3, "/keep/c")]


def test_merge_by_name(spark):
    g = spark.createDataFrame([("s1", "/a.mp3", ["/l.mp3"], "The X", "T", 1, 320), ("s2", "/b.flac", [], "x", "t ", 1, 0), ("s3", "/c.mp3", None, "Artist", "Track 1", 9, 1), ("s4", "/d.mp3", [], "artist", "track 1", 9, 1)], "sha string, winner string, losers array<string>, artist string, title string, richness int, bitrate int")
    got = sorted((r.sha, r.winner, r.loser or "") for r in stages.merge_by_name(g).collect())
    assert got == [("s2", "/b.flac", "/a.mp3"), ("s2", "/b.flac", "/l.mp3"), ("s3", "/c.mp3", ""), ("s4", "/d.mp3", "")]


def test_merge_by_tolerance_closes_chains(spark):
    t = spark.createDataFrame([(i, f"/p{i}", "The A", "a song", "1d", 100.0 + i, 120.0, i) for i in range(4)] + [(9, "/q", "A", "song", "2d", 100.0, 120.0, 99)], "idx bigint, path string, artist string, title string, any_key string, playtime double, bpm double, richness int")
    assert rows(stages.merge_by_tolerance(t)) == [("/p0", "/p3"), ("/p1", "/p3"), ("/p2", "/p3")]


def test_merge_converted(spark):
    f = spark.createDataFrame([(1, "/1", "a", "03 Song", 100.0, 10.0), (2, "/2", "A", "song", 200.0, 50.0), (3, "/3", "", "other", 1000.0, 11.0), (4, "/4", "b", "Other", 1001.0, 12.0), (5, "/5", "c", "third", 1000.0, 7.4), (6, "/6", "", "Third", 1005.0, 7.6)], "idx bigint, path string, artist string, title string, size double, seconds double")
    assert rows(stages.merge_converted(f)) == [("/1", "/2", 1), ("/3", "/4", 2), ("/6", "/5", 3)]


def test_small_stages(spark):
    r = spark.createDataFrame([("/x", 20, "a"), ("", 100, "a"), ("/y", 800, "a"), ("/z", 100, "S (Live)"), ("/w", 100, "a")], "path string, seconds int, title string")
    assert rows(stages.drop_reasons(r).na.fill("-"), "path", "reason") == [("", "no place"), ("/w", "-"), ("/x", "short"), ("/y", "long"), ("/z", "live")]
    b = spark.createDataFrame([(1, "m", "ab", "c"), (2, "m", "a", "bc"), (3, "m", "abc", None)], "idx int, md5 string, artist string, title string")
    assert rows(stages.better_tags(b), "idx") == [(1,)]
    s = spark.createDataFrame([(1, "the cure feat. x", "t", "Rock; EBM"), (2, "The Cure", "t", None), (3, "unknown", "t", None), (4, "Cure", "t", "nothing")], "idx int, artist string, title string, genre string")
    m = spark.createDataFrame([("zzz", "Rock")], "raw string, canonical string")
    assert sorted((r.idx, r.artist, r.genre, r.inferred) for r in stages.sanitize(s, m).collect()) == [(1, "The Cure", "EBM", False), (2, "The Cure", "EBM", True), (3, None, None, False), (4, "The Cure", "EBM", True)]
    assert rows(stages.snapshot({"a": spark.range(5), "b": spark.range(3)}, {"a_b": ("a", "b"), "b_a": ("b", "a")})) == [("a", 5), ("a_b", 2), ("b", 3), ("b_a", 0)]
    t = spark.createDataFrame([(1, "/1", "The Foo", "Bar Mix"), (2, "/2", "Foo", "Bar")], "idx int, path string, artist string, title string")
    d = spark.createDataFrame([("a", "foo", "bar"), ("b", "none", "x")], "deck string, artist string, title string")
    assert rows(stages.now_playing(d, t)) == [("a", "/1")]
    k = spark.createDataFrame([("Known",)], "name string")
    n = spark.createDataFrame([(1, "Foo Bar - Known"), (2, "Who Else - Song"), (3, "plain"), (4, None)], "i int, title string")
    assert rows(stages.recover_with_confidence(n, "i", "title", k)) == [(1, "Known", "Foo Bar", "HIGH"), (2, "Who Else", "Song", "MEDIUM")]
    g = spark.createDataFrame([(1, "Dark"), (2, "Rock")], "i int, g string")
    assert rows(stages.consolidate(g, "g", spark.createDataFrame([("Dark", "Rock")], "raw string, canonical string"), ["Rock"]), "i", "g", "changed") == [(1, "Rock", True), (2, "Rock", False)]
    with pytest.raises(ValueError):
        stages.consolidate(g, "g", spark.createDataFrame([("Rock", "Rock")], "raw string, canonical string"), ["Rock"])


def test_suggestions_with_large_numbers(spark):
    from cratewright.plans import suggest

    rows = [(i + (1 << 40) * (i % 2), f"/p{i}", f"artist {i}", f"t{i}", "EBM", 120.0, "1d", 3, "") for i in range(4)]
    t = spark.createDataFrame(rows, "idx bigint, path string, artist string, title string, genre string, bpm double, key string, stars int, theme string")
    got = suggest.lock(t, t.where("path = '/p0'")).orderBy("place").collect()
    assert [r.path for r in got] == ["/p2", "/p1", "/p3"]
    assert suggest.lock(t.limit(0), t.limit(0)).count() == 0
