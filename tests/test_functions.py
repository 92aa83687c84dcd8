"""Input and expected value of the column functions."""

from pyspark.sql import functions as F

from cratewright.functions import grid, harmonic, keys, paths, text


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, *x) if isinstance(x, tuple) else (i, x) for i, x in enumerate(inputs)], "i int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(kind.split(","))))
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.v for r in df.select("i", make(*cols).alias("v")).orderBy("i").collect()]


def check(spark, cases, make, kind="string"):
    assert values(spark, list(cases), make, kind) == list(cases.values())


def test_paths(spark):
    check(spark, {("/:Users/:dj/:Music/:", "a.mp3"): "/Users/dj/Music/a.mp3", ("/:", "b.wav"): "/b.wav", (" /:x/: ", "c"): "/x/c", ("", "d"): "/d"}, paths.location_to_path, "string,string")
    check(spark, {"Macintosh HD/:a/:b.mp3": "/a/b.mp3", "/:a/:b": "/a/b", "Macintosh HD": "/"}, paths.key_to_path)
    check(spark, {"Disk/:a/:b.mp3": "/a/b.mp3", "Disk 2/:b": "/b", "/a/b": "/a/b"}, paths.any_key_to_path)
    check(spark, {"/a/b.mp3": "Macintosh HD/:a/:b.mp3"}, paths.path_to_key)
    check(spark, {"/a/b/c.MP3": ".mp3", "/a.b/c": "", "x": ""}, paths.extension)
    check(spark, {"/a/b/c.MP3": "c", "/a/.hid": ".hid", "x.tar.gz": "x.tar"}, paths.stem)
    check(spark, {"/r/Corrected/A/x": "/new/A/x", "/r/q": None}, lambda p: paths.re_anchor(p, "corrected", "/new/"))
    check(spark, {"/m/Root/Artist/x": "Artist", "/m/Other/x": "Other"}, lambda p: paths.folder_after(p, "Root"))
    check(spark, {"/a/b": True, "/ab": False, "/a": True}, lambda p: paths.under_any(p, ["/a"]))
    loc = values(spark, ["/a/b/c.mp3", "/c.mp3"], paths.path_to_location)
    assert [(x.dir, x.file) for x in loc] == [("/:a/:b/:", "c.mp3"), ("/:", "c.mp3")]


def test_keys(spark):
    title = "Song (Radio Edit) [2004]"
    k = lambda f: values(spark, [(" The X ", title)], f, "string,string")[0].split("\t")
    assert k(keys.song_key) == ["the x", "song (radio edit) [2004]"]
    assert k(keys.version_key) == ["the x", "song"] or k(keys.version_key)[1].startswith("song")
    assert k(keys.bare_key)[1] == "song" and k(keys.cut_key)[1] == "song" and k(keys.base_key)[1] == "song (radio edit) [2004]"
    check(spark, {"The Cure": "cure", "A B": "b", "Thelma": "thelma", None: ""}, keys.without_article)
    check(spark, {"03 - Múm Song - Artist": "múm song", "Song 2": "song", "03 It's": "it s"}, keys.loose_title)
    check(spark, {"The  Sisters of Mercy!": "sisters of mercy"}, keys.loose_name)


def test_clean_stem(spark):
    cases = {
        "y2mate.com - Foo - Bar": ("Foo", "Bar"),
        "Like A Prayer- Madonna": ("Madonna", "Like A Prayer"),
        "World Is Yours - Arch Enemy - HQ - 320k": ("World Is Yours", "Arch Enemy"),
        "80s - Take On Me": (None, "Take On Me"),
        "snake_case_name": (None, "snake case name"),
        "artist - Track 3": (None, None),
        "04 - Song": (None, "Song"),
        "Song-Some Artist": ("Some Artist", "Song"),
        "Foo - Bar (Official Video)": ("Foo", "Bar"),
        "": (None, None),
    }
    assert [(r.artist, r.title) for r in values(spark, list(cases), text.clean_stem)] == list(cases.values())


def test_clean_title(spark):
    check(
        spark,
        {("Danzig - She Rides", "Danzig"): "She Rides", ("Danzig-She Rides", "Danzig"): "She Rides", ("Song.mp3", "x"): "Song", ("EBM-Wolfsheim-Now I Fall", "Wolfsheim"): "Now I Fall", ("Song (HD)", ""): "Song", ("Fine (Mix)", "Danzig"): None, ("A+B - C", "A+B"): "C"},
        text.clean_title,
        "string,string",
    )


def test_names(spark):
    check(spark, {"EBM": "EBM", "AC/DC live": "AC/DC Live", "the cure": "The Cure", "nine inch nails of x": "Nine Inch Nails of X", "": ""}, text.title_case)
    check(spark, {"x" * 101: "x" * 100, '\\/:*?"<>|': "Unknown", " a__b ": "a b", "ﬁne": "fine", "": "Unknown", "a/b": "a_b"}, text.safe_name)
    check(spark, {"Foo feat. Bar": "Foo", "A & B": "A", "Solo": None, "X with Y": "X"}, text.primary_artist)
    check(spark, {"80's Pop Band": "Pop Band", "8's x": "8's X", "<unknown>": "", "foo (feat. bar)": "Foo", "80s": "80s"}, text.full_artist)
    check(spark, {"mcCartney of x": "McCartney Of X"}, text.smart_title_case)
    check(spark, {"ab": False, "abc": True, "123": False, "Track 4": False, "x" * 61: False}, text.plausible_artist)


def test_predicates(spark):
    check(spark, {"I Will Live Again": False, "Song (Live)": True, "Live at X": True, "Live Wire": False, None: False}, text.is_live)
    nothing = F.lit(None).cast("string")
    check(spark, {"Song (Instrumental)": True, "Instinct": False, "x no vocals": True}, lambda t: text.is_instrumental(t, nothing, nothing))
    check(spark, {("loop recorder 1", 100, ""): "file name", ("x", 30, ""): "short", ("x", 31, "Track 4"): "title", ("x", 0, "Song"): None}, text.not_a_song, "string,int,string")
    check(spark, {("x", "Track 3"): True, ("Artist", "x"): True, ("a", "b"): False, (None, "b"): True}, text.is_placeholder, "string,string")


def test_comments(spark):
    check(spark, {"theme | ⚑a ⚑b": "theme", "⚑a": "", None: "", "x": "x"}, text.tagged_theme)
    check(spark, {"theme | ⚑a ⚑b": ["a", "b"], "⚑rep:x (n) | ⚑song:y": [], "⚑": []}, text.tagged_flags)
    made = values(spark, [("t", "r", "y" * 70)], lambda a, b, c: text.build_comment(a, F.array(F.lit("f")), b, c), "string,string,string")[0]
    assert made == "t | ⚑f | ⚑rep:r | ⚑song:" + "y" * 60 + "…"


def test_web_and_timed(spark):
    check(spark, {"a<br/>b <b>c</b> &amp; &#65;&#x42; &lt;x&gt;": "a\nb c & AB <x>", None: None}, text.html_to_text)
    check(spark, {'<div class="L">a<div>b</div>c</div><div>no</div><div class="L">d</div>': "a<div>b</div>c\nd"}, lambda p: text.nested_blocks(p, 'class="L"'))
    lines = values(spark, ["[01:02.50] Hello \n[00:05]no\n[00:01.0]  \nx"], text.lrc_lines)[0]
    assert [(x.ms, x.text) for x in lines] == [(62500.0, "Hello")]
    est = values(spark, ["12 ContributorsX Lyrics\n[Intro]\n a \n\nb"], lambda t: text.estimated_lines(t, F.lit(100.0), F.lit(20.0), F.lit(60.0)))[0]
    assert [(x.ms, x.text) for x in est] == [(20.0, "a"), (40.0, "b")]
    got = values(spark, ["```json\n{\"summary\": \"s\", \"flags\": []}\n```", "{}", "broken"], lambda t: text.fenced_json(t, "summary string, flags array<string>", "summary"))
    assert got[0].summary == "s" and got[1] is None and got[2] is None
    check(spark, {61.0: "1:01", 3600.0: "60:00"}, text.minutes, "double")


def test_compatibility(spark):
    k = {("12d", "1d"): 0.85, ("1m", "7m"): 0.05, ("", "3d"): 0.5, ("x", "3d"): 0.5, ("3d", "3m"): 0.9, ("3d", "3d"): 1.0, ("2d", "4d"): 0.4, ("2d", "5m"): 0.2, (None, "1d"): 0.5, ("1d", "2m"): 0.6}
    check(spark, k, harmonic.key_compat, "string,string")
    check(spark, {(120.0, 122.0): 1.0, (120.0, 126.0): 0.85, (120.0, 132.0): 0.6, (120.0, 138.0): 0.3, (120.0, 150.0): 0.1, (120.0, 151.0): 0.0, (0.0, 1.0): 0.5, (None, 1.0): 0.5}, harmonic.bpm_compat, "double,double")
    check(spark, {("EBM", "EBM"): 1.0, ("EBM", "Industrial"): 0.6, ("EBM", "Metal"): 0.3, ("EBM", "Pop"): 0.05, ("", "EBM"): 0.3, ("Pop", "EBM"): 0.05}, harmonic.genre_compat, "string,string")
    check(spark, {("loss", "loss"): 1.0, ("loss", "love"): 1.0, ("euphoria", "longing"): 0.5, ("anger", "love"): 0.0, ("surreal", "anger"): 0.5, ("", "love"): 0.0}, harmonic.theme_compat, "string,string")
    check(spark, {117.5: "1", 118.5: "1", 124.5: "1", 125.5: "2", 87.5: "6", 154.5: "6", 155.0: "7"}, harmonic.bpm_color, "double")
    check(spark, {150.0: 75.0, 59.0: 118.0, 120.0: 120.0, 0.0: 0.0}, harmonic.fold_bpm, "double")
    t = lambda a, b, c, d: harmonic.transition(a, c, F.lit("X"), b, d, F.lit("X"))
    check(spark, {(120.0, 121.0, "1d", "1d"): "BEAT+FRAGMENT", (120.0, 125.0, "1d", "1d"): "BEAT MATCH", (120.0, 125.0, "1d", "7d"): "BEAT+FX", (120.0, 130.0, "1d", "1d"): "BLEND", (120.0, 150.0, "1d", "7m"): "EFFECT FADE", (120.0, 150.0, "1d", "1d"): "LOOP DROP"}, t, "double,double,string,string")


def test_grid(spark):
    a, p = F.lit(100.0), F.lit(500.0)
    check(spark, {100.0: 100.0, 2099.0: 100.0, 2100.0: 2100.0, 50.0: -1900.0}, lambda x: grid.bar_before(x, a, p), "double")
    check(spark, {100.0: 2100.0, 2099.0: 2100.0}, lambda x: grid.bar_after(x, a, p), "double")
    check(spark, {350.0: 100.0, 850.0: 1100.0, 600.0: 600.0}, lambda x: grid.snap(x, a, p), "double")
    check(spark, {349.0: 100.0, 350.0: 600.0}, lambda x: grid.beat_half_up(x, a, p), "double")
    check(spark, {100.0: [100.0, 600.0, 1100.0]}, lambda x: grid.beats_between(x, p, F.lit(1600.0)), "double")
    made = values(spark, [(0.0, 120.0, 60.0), (0.0, 120.0, 29.0), (None, 120.0, 60.0), (0.0, 0.0, 60.0)], grid.fast_cues, "double,double,double")
    assert [c.start_ms for c in made[0]] == [0.0, 0.0, 52000.0] and made[1:] == [None, None, None]
    bars = values(spark, [(0.0, 120.0, 60000.0), (0.0, 120.0, 100.0)], grid.bar_cues, "double,double,double")
    assert [c.start_ms for c in bars[0]] == [0.0, 44000.0] and len(bars[1]) == 1


def test_table_functions(spark):
    from cratewright.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "[00:01.5] a\n[x]b\n[01:00.0] c"), (2, None)], "i int, t string").createOrReplaceTempView("timed")
    assert sorted(tuple(r) for r in spark.sql("select i, l.* from timed, lateral lrc_lines(t) l").collect()) == [(1, 1500.0, "a"), (1, 60000.0, "c")]
    assert [tuple(r) for r in spark.sql("select * from estimated_lines('a\n\nb', double(10)) order by ms").collect()] == [(0.0, "a"), (5.0, "b")]
    assert sorted(tuple(r) for r in spark.sql("select * from name_candidates('Foo - Bar')").collect()) == [("Bar", "Foo"), ("Foo", "Bar")]


def test_parts_of_a_name_keep_their_digits(spark):
    rows = [("A - City - 24",), ("10 Years - 1 Day",), (" B  -  02 ",)]
    got = [tuple(r.x) for r in spark.createDataFrame(rows, "s string").select(text.clean_stem(F.col("s")).alias("x")).collect()]
    assert got == [("A", "City - 24"), ("Years", "1 Day"), ("B", "02")]
