"""Language, look-alikes, names, categories, tokens, mixing and reading level."""

import base64
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewright.llm import canon, language, lookalike, mixing, names, reading, tokens

# ---- language

SAMPLES = {
    "en": "the night is over and the wind knows no answer while we are waiting near the river with all our thoughts",
    "de": "die Nacht ist vorbei und der Wind kennt keine Antwort während wir am Fluss warten mit allen unseren Gedanken",
    "fr": "la nuit est finie et le vent ne connaît pas la réponse pendant que nous attendons près de la rivière",
    "es": "la noche ha terminado y el viento no conoce la respuesta mientras esperamos cerca del río con nuestros pensamientos",
    "pt": "a noite acabou e o vento não sabe a resposta enquanto esperamos perto do rio com os nossos pensamentos",
    "it": "la notte è finita e il vento non conosce la risposta mentre aspettiamo vicino al fiume con i nostri pensieri",
    "nl": "de nacht is voorbij en de wind weet geen antwoord terwijl wij bij de rivier wachten met al onze gedachten",
    "sv": "natten är över och vinden vet inget svar medan vi väntar vid floden med alla våra tankar",
}


def test_language(spark):
    labelled = spark.createDataFrame([(t, k) for k, t in SAMPLES.items()] + [(None, "en"), ("", "de"), ("x", None)], "text string, lang string")
    lyrics = spark.createDataFrame(
        [
            (1, SAMPLES["de"], "de"),
            (2, SAMPLES["de"], "xx"),
            (3, SAMPLES["en"] + "\r\n \r\n\r\n" + SAMPLES["sv"], "en"),
            (4, None, "en"),
            (5, " \n\t", None),
            (6, SAMPLES["fr"], "fre"),
            (7, SAMPLES["fr"], "pt-BR"),
            (8, "[Chorus]\n\n" + SAMPLES["it"] * 400, "Italian"),
            (9, "123 !!!", None),
        ],
        "lyrics_id bigint, lyrics_text string, lang_label string",
    ).withColumn("tagged", F.lit("clash"))
    got = sorted((r.lyrics_id, r.stanza_no, r.lang) for r in language.language_cases(lyrics, labelled).collect())
    assert got == [(2, 1, "de"), (3, 1, "en"), (3, 2, "sv"), (7, 1, "fr")]
    assert language.language_cases(lyrics.limit(0), labelled).count() == 0


def test_confidence_never_falls(spark):
    right, n = np.array([1.0, 0, 8, 5, 10]), np.array([4.0, 0, 10, 10, 10])
    fitted = language.rising(right, n)
    assert len(fitted) == 5 and (np.diff(fitted) >= 0).all() and 0 < fitted[0] < fitted[-1] < 1
    labelled = spark.createDataFrame([(t, k) for k, t in SAMPLES.items()] + [(None, "en"), ("", "de")], "text string, lang string")
    ranks = language.train_profiles(labelled)
    sure = language.fit_confidence(labelled, ranks)
    assert len(sure) == language.SURE_BINS and (np.diff(sure) >= 0).all()
    assert len(language.fit_confidence(labelled.limit(0), ranks)) == language.SURE_BINS


def test_stanzas():
    assert language.stanzas("\n\na\r\nb\r\n \r\n\t\nc\n\n\n") == ["\na\nb", "c\n"] or len(language.stanzas("\n\na\r\nb\r\n \r\n\t\nc\n\n\n")) == 2
    assert language.stanzas(" \n ") == []


def test_out_of_place_matches_plain_version():
    ranks = np.full((language.SIZE, 8), language.PROFILE, np.int16)
    code, starts = language.letters(["abab"])
    grams = np.unique(language.ngrams(code, starts)[1])
    ranks[grams[:5], 0] = np.arange(5)
    d, known = language.out_of_place(["abab"], ranks)
    doc, gram = language.ngrams(code, starts)
    values, n = np.unique(gram, return_counts=True)
    order = sorted(zip(-n, values))
    want = sum(abs(int(ranks[g, 0]) - i) if ranks[g, 0] < language.PROFILE else language.PROFILE for i, (_, g) in enumerate(order)) / len(order) / language.PROFILE
    assert known[0] == len(order) and abs(d[0, 0] - want) < 1e-9


# ---- look-alikes


def test_one_form(spark):
    rows = [
        (1, "Gаrden", "plain"),  # a Cyrillic letter inside
        (2, "Garden", "Ｗｉｄｅ"),
        (3, "Тихая Река", "“quoted” – it’s"),
        (4, "Café", "a​b"),
        (5, "no break", "tab\tand\nline"),
        (6, None, ""),
        (7, "Zоrgmix", "カセットの夜"),  # not a word of the corpus
        (8, "𝖺bc ﬁne", "x" * 20000 + " "),
        (8, "𝖺bc ﬁne", "x"),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, title string, artist string").withColumn("value", F.lit(1)).withColumn("clean", F.lit(1))
    got = sorted((r.entry_id, r.field_name) for r in lookalike.found_values(df).collect())
    assert got == [(1, "title"), (2, "artist"), (4, "artist"), (4, "title"), (5, "title"), (7, "title"), (8, "artist"), (8, "title"), (8, "title")]
    out = {(r.entry_id, r.field_name): r for r in lookalike.one_form(df, ["entry_id"], ["title", "artist"]).collect()}
    assert out[1, "title"].clean == "Garden" and out[1, "title"].repaired == 1
    assert out[7, "title"].clean == "Zоrgmix" and out[7, "title"].mixed == 1
    assert out[4, "title"].clean == "Café" and out[2, "artist"].clean == "Wide" and out[4, "artist"].clean == "ab"
    assert out[6, "title"].clean is None and out[6, "artist"].clean == ""
    assert lookalike.found_values(df.limit(0)).count() == 0


def test_normalising_twice_is_once():
    for v in ("Gаrden", "Ｗｉｄｅ", "ﬁne", "a​b", "Kelvin"):
        once = lookalike.without_forms(v)[0]
        assert lookalike.without_forms(once) == (once, False)


def test_only_whole_words_are_repaired(spark):
    rows = [(1, "аn bаnq"), (2, "an"), (3, "ｍｏｎｏ"), (4, "mоno mоno, x"), (5, "Ёlan"), (6, "Ëlan")]
    df = spark.createDataFrame(rows, "entry_id bigint, title string")
    got = {r.entry_id: (r.clean, r.found, r.repaired, r.mixed) for r in lookalike.one_form(df, ["entry_id"], ["title"]).collect()}
    assert got[1] == ("an bаnq", True, 1, 1)  # "banq" is no word of the corpus
    assert got[4] == ("mono mono, x", True, 1, 0)  # a word written in wide form counts
    assert got[5] == ("Ëlan", True, 1, 0)


# ---- names


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ["ab" * 50, "b" * 500, "a" * 62, "a" * 63]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(500)] + [("ab" * 50, "b" * 500), ("b" * 500, "ab" * 50), ("ab", "b" * 500)]
    got = names.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [lcs(a, b) for a, b in pairs]


def test_linked_names(spark):
    rows = [
        (1, "The Purnvilbrik Mosaic", "m"),
        (2, "Purnvilbrik M.", None),
        (3, "Purnvilbrikmosaic", None),
        (4, "The Purnnvilbrik Mosaic - Topic", None),
        (5, "Margaret Skulmixskend", None),
        (6, "Skulmixskend, M.", None),
        (7, "Maggie Skulmeecksskend", None),
        (8, "Fiona Tokthintok", None),
        (9, "Bernard Tokthintok", None),
        (10, None, None),
        (11, "", None),
        (12, "...", None),
        (13, "The Purnvilbrik Mosaic", "m"),
        (14, "Quite Other Name " + "y" * 3000, None),
        (15, "Somebody Else", "m"),
    ]
    df = spark.createDataFrame(rows, "credit_id bigint, artist string, mb_artist_id string").withColumn("a", F.lit(1)).withColumn("same", F.lit(2))
    short = spark.createDataFrame([("Margaret", "Maggie"), (None, "x")], "given_name string, short_name string")
    got = names.linked_names(df, short)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.root, set()).add(r.credit_id)
    assert {1, 2, 3, 4, 13, 15} in groups.values() and {5, 6, 7} in groups.values()
    assert not any(8 in g and 9 in g for g in groups.values())
    pairs = {tuple(r) for r in names.linked_pairs(got).collect()}
    assert (5, 6) in pairs and (1, 13) in pairs and all(a < b for a, b in pairs)
    assert names.linked_names(df.limit(0), short).count() == 0


# ---- categories


def test_distance_against_search():
    def plain(a, b):  # unweighted optimal string alignment
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abq") for _ in range(rng.randrange(1, 7))) for _ in "xy")
        assert 0.8 * plain(a, b) - 1e-9 <= canon.weighted_distance(a, b) <= 1.2 * plain(a, b) + 1e-9


def test_symmetric_deletes_miss_nothing():
    d = canon.Dictionary([(i, w, [], 0) for i, w in enumerate(("ambient", "cumbia", "krautrock", "soul", "trance"), 1)])
    rng = random.Random(5)
    for _ in range(500):
        w = list(rng.choice(list(d.names)))
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice(([], [rng.choice("abctr")], [w[i], "x"]))
        word = "".join(w)
        edits = canon.allowed_edits(len(word), 3)
        all_keys = [(canon.weighted_distance(word, k, edits), 0, i[0]) for k, i in d.names.items()] if edits else []
        best = min([x for x in all_keys if x[0] <= edits], default=(99.0, 0, 0))
        got = d.nearest(word)
        assert got[0] <= best[0] or best[0] == 99.0


def test_map_values(spark):
    ref = spark.createDataFrame([(1, "Ambient", ["atmospheric"]), (7, "Drum and Bass", None), (9, "Singer-Songwriter", []), (3, "Ambient", []), (4, "Folk", [])], "genre_id bigint, genre_name string, aliases array<string>")
    cases = {"ambient": 1, "AMBIENT (club)": 1, " Ambeint.": 1, "drum & bass": 7, "DrumAndBass": 7, "Singer/Songwriter": 9, "Folk / Ambient": 1, "xyzzy": 0, "genre: fokl": 4, "": 0, " ": 0, None: 0, "q" * 5000: 0, "classicFolkmusic": 4}
    # Words around a value are learned where they stand beside three entries.
    for name, ident in (("Ambient", 1), ("Drum and Bass", 7), ("Singer-Songwriter", 9), ("Folk", 4)):
        cases |= {f"{name} (club)": ident, f"{name} music": ident, f"genre: {name}": ident, f"classic {name}": ident}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "entry_id bigint, genre string").withColumn("genre_name", F.lit("clash"))
    joined = {r.genre: r.mapped_id for r in canon.map_values(df, "genre", ref, "genre_id", "genre_name", "aliases", max_reference=0).collect()}
    assert joined == cases
    got = {r.genre: r.mapped_id for r in canon.map_values(df, "genre", ref, "genre_id", "genre_name", "aliases").collect()}
    assert got == cases
    out = canon.to_map(df, ref)
    assert out.columns == ["entry_id", "genre_id"] and out.count() == len(cases) - 3
    assert canon.to_map(df.limit(0), ref).count() == 0 and {r.genre_id for r in canon.to_map(df, ref.limit(0)).collect()} == {0}
    assert canon.unmatched_report(canon.map_values(df, "genre", ref, "genre_id", "genre_name"), "genre").count() >= 1


# ---- tokens

PATH = tokens.vocabulary("byte_bpe_50k")


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_public_library(spark):
    ref, rng = reference(), random.Random(6)
    alphabet = "ab'stredvlmAé1²٣ \t\n\r 　!?.-’日𝖺🎵​\x00\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["<|endoftext|>", "a" * 20000, " " * 3000 + "x", "don't we'll 's's '''re"]
    ids, ends, where = tokens.encode(texts, PATH)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ref.encode_ordinary(t) for t in texts]
    assert len(where) == len(ids)


def test_corpus_round_trip(spark):
    rows = [(1, "Hello, it's  me\n\n"), (2, None), (3, ""), (4, "naïve 日本 " * 50), (4, "same id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    enc = tokens.encode_corpus(df, offsets=True)
    got = sorted((r.doc_id, len(r.ids), len(r.offsets)) for r in enc.collect())
    assert [(i, n) for i, n, _ in got if i in (2, 3)] == [(2, 0), (3, 0)] and all(n == m for _, n, m in got)
    back = sorted((r.doc_id, r.text) for r in tokens.decode_corpus(enc).collect())
    assert back == sorted((i, t or "") for i, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# ---- mixing


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randrange(1, 40))) + f" {i}", "big" if i < 300 else "small") for i in range(330)]
    rows += [(1000 + i, "one text many times over", "small") for i in range(50)] + [(2000, None, "big"), (2001, "", "big"), (2002, "no target", "other"), (2003, "x", None), (2004, "long " * 4000, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit(1)).withColumn("weight", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.2, 3)], "source_name string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(docs, targets)
    m, s = mixture.collect(), {r.source_name: r for r in shares.collect()}
    assert len({(r.source_name, r.doc_id) for r in m}) == len(m)
    assert all(r.repeats <= {"big": 1, "small": 2}[r.source_name] for r in m)
    assert sum(1 for r in m if 1000 <= r.doc_id < 1050) <= 1  # copies are one text
    assert not {2000, 2001, 2002, 2003} & {r.doc_id for r in m}
    assert abs(s["big"].actual_share - 0.625) < 0.01 and abs(s["small"].actual_share - 0.375) < 0.01 and s["gone"].tokens == 0
    assert all(r.tokens <= r.budget for r in s.values())
    again = mixing.mix(docs, targets)[0].collect()
    assert sorted(again) == sorted(m)
    less, _ = mixing.mix(docs, targets, total_tokens=200)
    assert sum(r.n_tokens * r.repeats for r in less.collect()) <= 200
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_rest_is_filled_in_key_order(spark):
    rng = random.Random(11)
    rows = [(s, i, rng.choice((1, 2, 3, 7, 30, 200)), rng.expovariate(1) / rng.choice((0.05, 1))) for s in ("a", "b", "c") for i in range(400)]
    df = spark.createDataFrame(rows, "source_name string, doc_id bigint, n_tokens bigint, key double").withColumn("bin", F.floor(F.log("key") * 3).cast("int"))
    for rest in (0, 1, 5, 999, 3000, 10**9):
        rests = spark.createDataFrame([("a", rest), ("b", rest // 2), ("gone", 5)], "source_name string, rest bigint")
        got = sorted((r.source_name, r.doc_id) for r in mixing._part_of_an_epoch(df, rests).collect())
        want = []
        for s, room in (("a", rest), ("b", rest // 2)):
            for _, i, n, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1])):
                if n <= room:
                    room -= n
                    want.append((s, i))
        assert got == sorted(want)


# ---- reading level


def test_reading_level(spark):
    rng = random.Random(8)
    bank = {1: ["We had fun.", "He ran to the bus.", "The dog was red.", "I sing."], 2: ["The second band played three songs for us.", "My older sister made the whole room happy."], 3: ["The album gradually reveals a restrained atmosphere, although the chorus is repetitive.", "Its percussion maintains an understated momentum."], 4: ["Ontological heterogeneity problematises phenomenological intertextuality.", "The commodification of subcultural authenticity presupposes institutional legitimation."]}
    rows = [(i, " ".join(rng.choice(bank[i % 4 + 1]) for _ in range(8)), "en", 300) for i in range(160)]
    rows += [(500, None, "en", 300), (501, "", "en", 300), (502, rows[3][1], "de", 300), (503, rows[3][1], "en", 10), (504, rows[3][1] * 300, "en", 50000), (505, rows[0][1], None, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").withColumn("reading", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 4 + 1, "r") for i in range(0, 120)] + [(0, 2, "s"), (None, 1, "r"), (3, None, "r"), (9999, 1, "r")], "doc_id bigint, reading_level int, rater string")
    got = {r.doc_id: r.reading_level for r in reading.document_levels(docs, labels).collect()}
    assert set(got) == set(range(160)) | {500, 501, 504}
    held = [i for i in range(120, 160)]
    assert np.mean([got[i] == i % 4 + 1 for i in held]) >= 0.95 and got[504] == 4
    assert reading.document_levels(docs.limit(0), labels.limit(0)).count() == 0


def test_all_letters_are_hashed_alike():
    f = reading.Features(["one two", "one"])
    assert f.word[0] == f.word[2] and f.words.tolist() == [2, 1]
    assert list(itertools.chain(reading.sentences("- A.\n* B! C"))) == ["A.", "B!", "C"]
