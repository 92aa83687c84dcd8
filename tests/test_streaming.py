"""Streams over files made here, run to their end; batch twins where they exist."""

import datetime as dt
import time

from pyspark.sql import functions as F

from cratewright.operators import series
from cratewright.plans.planner import Planner
from cratewright.streaming import deck


def stream(spark, tmp_path, name, batches, schema):
    """A file stream that gives one batch after the other."""
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        time.sleep(0.05)
    flat = tmp_path / f"{name}_in"
    flat.mkdir()
    for i in range(len(batches)):
        for f in (folder / f"b{i}").glob("*.parquet"):
            f.rename(flat / f"{i:03d}.parquet")
        time.sleep(1.1)  # files are read in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def result(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_deck_events(spark, tmp_path):
    m = [(1, ts(0), "a", "artist", "X"), (2, ts(1), "a", "play", "1"), (3, ts(2), "a", "title", "T"), (4, ts(3), "a", "play", "0"), (5, ts(4), "a", "play", "1")]
    n = [(6, ts(5), "a", "play", "1"), (7, ts(6), "a", "elapsed_time", "3.5"), (8, ts(7), "a", "elapsed_time", "?"), (9, ts(8), "b", "play", "true")]
    s = stream(spark, tmp_path, "deck", [m, n], "seq bigint, ts timestamp, deck string, field string, value string")
    result(deck.deck_events(s), tmp_path, "deck_out")
    got = sorted((r.deck, r.seq, r.event) for r in spark.table("deck_out").collect())
    assert got == [("a", 2, "play_state"), ("a", 3, "loaded"), ("a", 4, "play_state"), ("a", 5, "play_state"), ("a", 5, "playing"), ("a", 6, "play_state"), ("a", 7, "position"), ("b", 9, "play_state")]


def test_solo_timer(spark, tmp_path):
    first = [("s", ts(0), "a", "/x"), ("s", ts(10), "b", "/y"), ("s", ts(20), "a", None)]
    later = [("s", ts(159), "c", None)]
    last = [("s", ts(400), "c", None), ("s", ts(500), "b", None)]
    s = stream(spark, tmp_path, "solo", [first, later, last], "session string, ts timestamp, deck string, path string")
    result(deck.played_tracks(s), tmp_path, "solo_out")
    got = [(r.path, r.played_at) for r in spark.table("solo_out").collect()]
    assert got == [("/y", ts(160))]


def test_windows_equal_batch(spark, tmp_path):
    rows = [("u", ts(0.01), 1), ("u", ts(0.05), 2), ("u", ts(0.12), 3), ("v", ts(0.03), 4), ("u", ts(99), 9)]
    schema = "k string, at timestamp, v bigint"
    s = stream(spark, tmp_path, "win", [rows, [("u", ts(200), 10)]], schema)
    result(deck.last_per_window(s, "k", "at", "v"), tmp_path, "win_out")
    got = sorted((r.k, r.window.start, r.v) for r in spark.table("win_out").collect())
    batch = series.last_per_window(spark.createDataFrame(rows, schema), "k", "at", 0.1, "v")
    want = sorted((r.k, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.window_start), r.v) for r in batch.collect())
    assert got == want


def test_new_plays_and_sessions(spark, tmp_path):
    rows = [("A", "k", ts(0)), ("a", "k", ts(0)), ("b", "k", ts(5))]
    s = stream(spark, tmp_path, "hist", [rows, rows], "deck string, key string, started_at timestamp")
    result(deck.new_plays(s), tmp_path, "hist_out")
    assert sorted((r.deck, r.started_at) for r in spark.table("hist_out").collect()) == [("a", ts(0)), ("b", ts(5))]


def test_intake(spark, tmp_path):
    drop, done, failed = tmp_path / "in", str(tmp_path / "done"), str(tmp_path / "failed")
    drop.mkdir()
    (drop / "a.mp3").write_bytes(b"1")
    (drop / "bad.txt").write_bytes(b"1")
    parse = lambda df: df.withColumn("ok", F.col("name").endswith(".mp3"))
    for _ in range(2):
        q = deck.intake(spark, str(drop), done, failed, str(tmp_path / "cp"), parse, once=True)
        q.awaitTermination(60)
        (drop / "c.mp3").write_bytes(b"2")
    assert sorted(r.name for r in spark.read.parquet(done).collect()) == ["a.mp3", "c.mp3"]
    assert [r.name for r in spark.read.parquet(failed).collect()] == ["bad.txt"]


def test_decks_and_status(spark):
    assert deck.deck_assignment(["/x", "/y"], {}) == {"a": "/x", "b": "/y"}
    assert deck.deck_assignment(["/y", "/z"], {"a": "/x", "b": "/y"}) == {"a": "/z", "b": "/y"}
    d = spark.createDataFrame([("a", False, True, "A"), ("b", True, True, "B")], "deck string, playing boolean, loaded boolean, label string")
    assert deck.deck_status(d).first()[0] == "B"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["data: one", "data: two", "", "event: x", "data: three", ""])], "stream int, i int, line string")
    assert sorted((r.event, r.data) for r in deck.sse_events(lines, "i", "line").collect()) == [(0, "one"), (1, "three")]


def test_planner(spark):
    tracks = spark.createDataFrame([(f"/p{i}", f"A{i % 4}", f"T{i}", "EBM" if i % 2 else "Darkwave", 120.0 + i, f"{i % 12 + 1}d", i % 6, "", 320.0 + i) for i in range(20)], "path string, artist string, title string, genre string, bpm double, key string, stars int, theme string, bitrate double")
    p = Planner(spark, tracks)
    assert p.count() == 20 and p.search("t1").count() == 11 and p.search("t").count() == 0
    s = p.suggest("/p0").collect()
    assert len({r.artist for r in s}) == len(s) and "A0" not in {r.artist for r in s}
    p.mark_played("/p1", "2024-01-01 00:00:00")
    p.mark_played("/p1", "2024-01-01 00:01:00")
    assert p.setlist().count() == 1 and "A1" not in {r.artist for r in p.suggest("/p0").collect()}
    assert p.bridge("/p0", "/p2").count() > 0 and p.save_me("/p0").count() > 0
    assert p.surprise_me(1).collect() == p.surprise_me(1).collect()
    assert p.resolve("a3", "t3").first().path == "/p3"
    p.reset()
    assert p.setlist().count() == 0


def test_suggestions_by_exchange_are_the_same(spark, monkeypatch):
    from cratewright.plans import suggest

    tracks = spark.createDataFrame([(i, f"/p{i:02d}", f"A{i % 5}", f"T{i}", "EBM" if i % 2 else "Darkwave", 118.0 + i % 9, f"{i % 12 + 1}d", i % 6, "") for i in range(30)], "idx bigint, path string, artist string, title string, genre string, bpm double, key string, stars int, theme string")
    whole = sorted(suggest.lock(tracks, tracks.where("idx < 12")).collect())
    monkeypatch.setattr(suggest, "FEW", 0)
    assert sorted(suggest.lock(tracks, tracks.where("idx < 12")).collect()) == whole and len(whole) > 12
    assert suggest.rescue(tracks, tracks.where("idx < 12")).select("anchor").distinct().count() == 12


def test_open_files(spark, tmp_path):
    schema = "session string, poll bigint, pos int, path string"
    polls = [(1, ["/x"]), (2, ["/x", "/y"]), (3, ["/y", "/z"]), (4, []), (5, ["/q"])]
    rows = [("s", n, i, p) for n, files in polls for i, p in enumerate(files or [None])]
    s = stream(spark, tmp_path, "polls", [rows[:3], rows[3:]], schema)
    result(deck.open_files(s), tmp_path, "polls_out")
    got = sorted((r.poll, r.event, r.deck, r.path) for r in spark.table("polls_out").collect())
    assert got == [(1, "opened", "a", "/x"), (2, "opened", "b", "/y"), (3, "closed", "a", "/x"), (3, "opened", "a", "/z"), (4, "closed", "a", "/z"), (4, "closed", "b", "/y"), (5, "opened", "a", "/q")]


def test_set_lists_equal_their_batch_twin(spark, tmp_path):
    schema = "session string, ts timestamp, seq int, path string, reset boolean"
    rows = [("s", ts(i), i, p, p is None) for i, p in enumerate(["/a", "/b", "/a", None, "/a", "/c", "/c", None, "/b"])]
    s = stream(spark, tmp_path, "plays", [rows[:5], rows[5:]], schema)
    result(deck.set_lists(s), tmp_path, "plays_out")
    got = sorted((r.session, r.night, r.n, r.path) for r in spark.table("plays_out").collect())
    batch = series.set_list(spark.createDataFrame(rows, schema), "session", ["ts", "seq"], "path", F.col("reset"))
    assert got == sorted((r.session, r.night, r.n, r.path) for r in batch.collect()) and len(got) == 5


def test_history_tail_equals_its_batch_twin(spark, tmp_path):
    schema = "library string, file string, read bigint, pos int, deck string, song string, started bigint, age int"
    one = [("a", "k1", 1), ("b", "k2", 2), ("a", "k3", 3)]
    reads = [("f1", 1, one, 10), ("f1", 2, [*one, ("b", "k4", 4)], 10), ("f2", 3, [("a", "k1", 9)], 20000), ("f2", 4, [("a", "k1", 9), ("a", "k5", 10)], 5)]
    rows = [("l", f, n, i, *e, age) for f, n, es, age in reads for i, e in enumerate(es)]
    s = stream(spark, tmp_path, "reads", [rows[:3], rows[3:]], schema)
    result(deck.history_tail(s), tmp_path, "reads_out")
    got = sorted((r.file, r.read, r.deck, r.song, r.started) for r in spark.table("reads_out").collect())
    assert got == [("f1", 1, "a", "k3", 3), ("f1", 1, "b", "k2", 2), ("f1", 2, "b", "k4", 4), ("f2", 4, "a", "k5", 10)]
    batch = series.history_tail(spark.createDataFrame(rows, schema), "file", "read", "deck", "song", "started", "pos", "age")
    assert got == sorted((r.file, r.read, r.deck, r.song, r.started) for r in batch.collect())


def test_watch_and_fan_out(spark, tmp_path):
    cache, seen = str(tmp_path / "cache"), []
    for n, rows in enumerate(([("k", 1), ("l", 2)], [("k", 3), ("m", 4)])):
        s = stream(spark, tmp_path, f"new{n}", [rows], "key string, v int")
        deck.watch_new(s, cache, "key", lambda df: df.withColumn("w", F.col("v") * 2), str(tmp_path / f"wc{n}"), once=True).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(cache).select("key", "w").collect()) == [("k", 2), ("l", 4), ("m", 8)]
    s = stream(spark, tmp_path, "fan", [[("k", 1)]], "key string, v int")
    deck.fan_out(s, [lambda df, n: seen.append(df.count())] * 2, str(tmp_path / "fc"), once=True).awaitTermination(60)
    assert seen == [1, 1]


def test_planner_requests(spark, tmp_path):
    tracks = spark.createDataFrame([(f"/p{i}", f"A{i % 4}", f"T{i}", "EBM" if i % 2 else "Darkwave", 120.0 + i, f"{i % 12 + 1}d", i % 6, "", 320.0 + i) for i in range(20)], "path string, artist string, title string, genre string, bpm double, key string, stars int, theme string, bitrate double")
    p = Planner(spark, tracks, folder=f"file://{tmp_path}/plays")
    assert p.next_track("/p0").count() == 1 and {r.genre: r.n for r in p.genres().collect()} == {"EBM": 10, "Darkwave": 10}
    assert p.playlist("/p0", "/p2").count() > 2 and p.fallback(True).count() > 0 and p.fallback(False).count() == 5
    assert p.command("Select B") == {"action": "load", "argument": "b"} and p.command("hello") is None
    for i in range(3):
        p.mark_played(f"/p{i}", f"2024-01-01 00:0{i}:00")
    assert [r.path for r in p.setlist().collect()] == ["/p0", "/p1", "/p2"]
