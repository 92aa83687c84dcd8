"""Collection files, file trees, state tables and lookups, over files made here."""

import json

from pyspark.sql import functions as F

from cratewright.sources import files, lookups, nml, state

NML = """<?xml version="1.0" encoding="UTF-8" standalone="no" ?>
<NML VERSION="19"><COLLECTION ENTRIES="3">
<ENTRY TITLE="A &amp; B" ARTIST="X"><LOCATION DIR="/:m/:x/:" FILE="a.mp3" VOLUME="V" VOLUMEID="V"></LOCATION><INFO BITRATE="320000" GENRE="EBM" KEY="1d" PLAYTIME="200" RANKING="77" PLAYCOUNT="x"></INFO><TEMPO BPM="120.0"></TEMPO><MUSICAL_KEY VALUE="3"></MUSICAL_KEY>
<CUE_V2 NAME="AutoGrid" TYPE="4" START="12.5" LEN="0" HOTCUE="-1"></CUE_V2><CUE_V2 NAME="n.n." TYPE="0" START="900" LEN="0" HOTCUE="1"></CUE_V2></ENTRY>
<ENTRY TITLE="No info" ARTIST=""><LOCATION DIR="/:m/:" FILE="b.wav" VOLUME="V" VOLUMEID="V"></LOCATION></ENTRY>
<ENTRY TITLE="T1" ARTIST="Y"><LOCATION DIR="/:" FILE="c.flac" VOLUME="V" VOLUMEID="V"></LOCATION><INFO PLAYTIME="abc" RANKING="255"></INFO></ENTRY>
</COLLECTION><PLAYLISTS><NODE><PLAYLIST ENTRIES="2"><ENTRY><PRIMARYKEY TYPE="TRACK" KEY="V/:m/:x/:a.mp3"></PRIMARYKEY></ENTRY>
<ENTRY><PRIMARYKEY TYPE="TRACK" KEY="/plain/key.mp3"></PRIMARYKEY><EXTENDEDDATA DECK="1" STARTTIME="77"></EXTENDEDDATA></ENTRY></PLAYLIST></NODE></PLAYLISTS></NML>
"""


def test_collection_round_trip(spark, tmp_path):
    p = tmp_path / "c.nml"
    p.write_text(NML)
    e = nml.read_entries(spark, str(p))
    t = nml.tracks(e)
    got = {r.title: r for r in t.collect()}
    assert set(got) == {"A & B", "No info", "T1"}
    a = got["A & B"]
    assert (a.path, a.bpm, a.stars, a.ranking, a.playcount, len(a.cues), a.cues[0].start_ms) == ("/m/x/a.mp3", 120.0, 0, 77, 0, 2, 12.5)
    assert (got["T1"].path, got["T1"].playtime, got["T1"].stars, got["No info"].bpm) == ("/c.flac", 0, 5, 0.0)
    assert [r.title for r in nml.complete_tracks(t).collect()] == ["A & B"]
    refs = [(r.path, r.deck) for r in nml.playlist_refs(e).orderBy("pos").collect()]
    assert refs == [("/m/x/a.mp3", None), ("/plain/key.mp3", "1")]
    out = tmp_path / "out.nml"
    assert nml.write_collection(t, nml.playlist_refs(e), str(out)) == 3
    back = nml.read_entries(spark, str(out))
    cols = ["path", "artist", "title", "bpm", "key", "genre", "ranking", "bitrate", "playtime", "cues"]
    assert sorted(map(str, nml.tracks(back).select(cols).collect())) == sorted(map(str, t.select(cols).collect()))
    assert [r.title for r in nml.tracks(back).orderBy("entry_idx").collect()] == ["A & B", "No info", "T1"]
    assert nml.playlist_refs(back).count() == 2
    new = spark.createDataFrame([("/m/x/a.mp3", "New"), ("/z/z.mp3", "Added")], "path string, title string")
    merged = {r.path: r.title for r in nml.insert_or_update(t, new, ["title"]).collect()}
    assert merged == {"/m/x/a.mp3": "New", "/m/b.wav": "No info", "/c.flac": "T1", "/z/z.mp3": "Added"}
    kept, n = nml.without_lyrics(t)
    assert "lyrics_full" not in kept.columns and n.first()[0] == 0


def test_listing(spark, tmp_path):
    for name, data in {"a/x.mp3": b"one", "a/y.MP3": b"one", ".hid/z.mp3": b"two", "b/n.txt": b"t", "skip/q.wav": b"q"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(data)
    df = files.listing(spark, str(tmp_path), excluded=(str(tmp_path / "skip"),), content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(got) == {"x.mp3", "y.MP3"} and got["x.mp3"].sha256 == got["y.MP3"].sha256 and got["x.mp3"].size_bytes == 3
    assert files.newest(df).count() == 1


def test_names_and_lines(spark, tmp_path):
    f = spark.createDataFrame([("/a/Foo - Bar (Mix).mp3",), ("/b/Bar - Foo.mp3",), ("/c/Alone.mp3",)], "path string")
    w = spark.createDataFrame([("foo\tbar",), ("\talone",)], "key string")
    assert sorted(tuple(r) for r in files.file_index(f, w).collect()) == [("\talone", "/c/Alone.mp3"), ("foo\tbar", "/a/Foo - Bar (Mix).mp3")] or files.file_index(f, w).count() == 2
    p = tmp_path / "l.xml"
    p.write_text('<LOCATION DIR="x" FILE="old.mp3"/>\nnothing\n')
    lines = files.attribute_lines(spark, str(p), "FILE")
    assert [(r.value, r.n) for r in lines.select("value", files.patch_attribute(F.col("line"), "FILE", F.lit("new.mp3")).alias("n")).collect()] == [("old.mp3", '<LOCATION DIR="x" FILE="new.mp3"/>')]
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "id string, parent string")
    assert sorted(tuple(r) for r in files.below(tree, "a").collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_state(spark, tmp_path):
    assert state.read_state(spark, str(tmp_path / "none.json"), "k string, v int").count() == 0
    p = tmp_path / "s.json"
    p.write_text('{"k": "a", "v": 1}\nbroken\n{"k": "b", "v": null}\n')
    assert sorted((r.k, r.v) for r in state.read_state(spark, str(p), "k string, v int").collect()) == [("a", 1), ("b", None)]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"x": 1, "y": None}))
    assert sorted((r.key, r.value) for r in state.read_map(spark, str(m), "int").collect()) == [("x", 1), ("y", None)]
    m.write_text("{")
    assert state.read_map(spark, str(m), "int").count() == 0
    target = state.write_version(spark.range(3), str(tmp_path / "v"), "1")
    assert spark.read.parquet(target).count() == 3
    rep = spark.createDataFrame([("settled", "s", ["A "], ["B"]), ("convicted", "c", ["a"], None)], "tier string, summary string, artists array<string>, members array<string>")
    assert sorted(tuple(r) for r in state.reputation(rep).collect()) == [("a", "convicted", "c"), ("b", "settled", "s")]


def test_lookups(spark):
    body = json.dumps({"title": "T", "artist-credit": [{"name": "A", "joinphrase": " & "}, {"name": "B"}], "releases": [{"title": "Boot", "status": "Bootleg", "date": "1999"}, {"title": "R", "status": "Official", "date": "2001-05", "media": [{"track": [{"number": "7"}]}]}], "genres": [], "tags": [{"name": "rock", "count": 1}, {"name": "dark wave", "count": 5}]})
    r = spark.createDataFrame([(body,)], "b string").select(lookups.recording(F.col("b")).alias("x")).first().x
    assert tuple(r) == ("T", "A & B", "R", "2001", "7", "Dark Wave")
    tracks = spark.createDataFrame([("1", "/a/X - Y.mp3"), ("2", "/b/P - Q.mp3"), ("3", "/artist - Track 3.mp3")], "sha string, path string")
    matches = spark.createDataFrame([("1", 0.5, "MA", "MT"), ("2", 0.49, "MA", "MT")], "sha string, confidence double, artist string, title string")
    tags = spark.createDataFrame([("2", "TA", "TT")], "sha string, artist string, title string")
    got = {r.sha: (r.artist, r.title, r.source, r.needs_review) for r in lookups.merge_metadata(tracks, matches, tags).collect()}
    assert got == {"1": ("MA", "MT", "match", False), "2": ("TA", "TT", "tags", False), "3": (None, None, "file name", True)}


def test_exports(spark):
    t = spark.createDataFrame([("/p", "A", "T", 120.0, "1d", "EBM", 0.876, "BLEND", 1, 1, "Darkwave")], "path string, artist string, title string, bpm double, key string, genre string, score double, transition string, place int, group_place int, destination string")
    lines = [r.line for r in state.m3u_lines(t, t, t).collect()]
    assert lines[0] == "#EXTM3U" and "# → Darkwave" in lines and lines.count("/p") == 2 and "#EXTINF:-1,A — T  [120.0 BPM | 1d | EBM | 88% | BLEND]" in lines
    played = t.withColumn("played_at", F.lit("2024-01-01").cast("timestamp"))
    assert state.setlist_lines(played).first().line == "01. A - T [120.0 BPM | EBM]"


def test_added_records_get_different_numbers(spark):
    t = spark.createDataFrame([("/a", "x", 7), ("/b", "y", 3)], "path string, artist string, entry_idx bigint")
    new = spark.createDataFrame([("/b", "z"), ("/c", "u"), ("/d", "v"), ("/d", None)], "path string, artist string")
    got = sorted(tuple(r) for r in nml.insert_or_update(t, new, ["artist"]).collect())
    assert got == [("/a", "x", 7), ("/b", "z", 3), ("/c", "u", 8), ("/d", "v", 9)]
    assert nml.insert_or_update(t.limit(0), new, ["artist"]).count() == 3


def test_state_by_any_kind_of_path(spark, tmp_path):
    spark.createDataFrame([("k", 1)], "key string, n int").write.parquet(f"{tmp_path}/s")
    for path in (f"{tmp_path}/s", f"file://{tmp_path}/s"):
        assert [tuple(r) for r in state.read_state(spark, path, "key string, n int").collect()] == [("k", 1)]
    assert state.read_state(spark, f"file://{tmp_path}/none", "key string, n int").count() == 0


def test_released_files_are_gone(spark):
    import os

    from cratewright.session import cut, release

    df = cut(spark.range(5))
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().replace("file:", "")
    assert os.path.exists(file)
    release(df)
    assert not os.path.exists(file)
