"""Language of texts and of their stanzas by rank-order profiles.

A profile lists the most frequent character n-grams (one to three letters, word
ends included) of a language by rank, counted over all labelled texts with a
partial count per batch.  A stanza's own most frequent n-grams are compared
with each profile: the out-of-place distance is the sum of the rank differences,
with a fixed penalty for n-grams the profile lacks.  The profiles are a table
of fixed size (n-gram codes x languages), whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.llm.batches import by_size

# The languages, their names and codes.
LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "sv")
NAMES = {
    "en": ("eng", "english", "englisch", "anglais"),
    "de": ("deu", "ger", "german", "deutsch", "allemand"),
    "fr": ("fra", "fre", "french", "francais", "français", "französisch"),
    "es": ("spa", "esp", "spanish", "espanol", "español", "castellano"),
    "pt": ("por", "portuguese", "portugues", "português"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "sv": ("swe", "swedish", "svenska"),
}
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"  # code 0 means none, the last code any other letter
BITS = 6
SIZE = 1 << 3 * BITS
MOST = (1 << 32 - 3 * BITS) - 1  # counts above it rank alike
PROFILE, DOC_PROFILE = 2000, 400  # n-grams kept of a language and of a stanza
CALIBRATION, SURE_BINS, PER_BIN = 4_000, 128, 6  # labelled texts the confidence is fitted on, about; its steps and their width

_OTHER = len(ALPHABET) + 1
_FOLD = np.arange(_OTHER + 1, dtype=np.int32)
for _i, _c in enumerate(ALPHABET, 1):
    _base = unicodedata.normalize("NFD", _c)[0]
    if _base in ALPHABET:
        _FOLD[_i] = ALPHABET.index(_base) + 1
_CODE = np.zeros(0x250, np.int32)
for _cp in range(0x250):
    _c = chr(_cp).lower()
    _CODE[_cp] = ALPHABET.index(_c) + 1 if len(_c) == 1 and _c in ALPHABET else _OTHER if chr(_cp).isalpha() else 1

_TAGS = re.compile(r"\[[^\]\n]{0,60}\]|\([^)\n]{0,12}\)|^[^\S\n]*\d+ contributors\b.*\blyrics[^\S\n]*$", re.I | re.M)
_BREAKS = re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")


def stanzas(text: str) -> list[str]:
    """The blocks of a text divided by blank lines, whatever its line ends."""
    lines = _BREAKS.sub("\n", text)
    return [s for s in _BLANK.split(f"\n{lines}\n") if s.strip()]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Alphabet codes of all texts, lower case, one blank between words and around each text; where each text begins."""
    joined = "".join(f" {t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    code = np.where(points < len(_CODE), _CODE[np.minimum(points, len(_CODE) - 1)], _OTHER)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(code), bool)
    keep[1:] = ~((code[1:] == 1) & (code[:-1] == 1) & (doc[1:] == doc[:-1]))
    code, doc = code[keep], doc[keep]
    return code, np.searchsorted(doc, np.arange(len(texts) + 1))


def ngrams(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram code) of all n-grams of one to three signs that stay within a text and hold a letter."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    docs, grams = [doc[code > 1]], [code[code > 1]]
    if len(code) > 1:
        inside = doc[1:] == doc[:-1]
        two = (code[:-1] << BITS) | code[1:]
        inside &= two != (1 << BITS | 1)
        docs.append(doc[1:][inside])
        grams.append(two[inside])
    if len(code) > 2:
        inside = (doc[2:] == doc[:-2]) & (code[1:-1] > 1)  # no word end in the middle
        docs.append(doc[2:][inside])
        grams.append(((code[:-2] << 2 * BITS) | (code[1:-1] << BITS) | code[2:])[inside])
    return np.concatenate(docs), np.concatenate(grams)


def _cleaned(text: str) -> str:
    return _TAGS.sub(" ", unicodedata.normalize("NFC", text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language, over all texts of a partition."""
    total = np.zeros((len(LANGS), SIZE), np.int64)
    for b in batches:
        langs = b.column("lang").to_pylist()
        texts = b.column("text").to_pylist()
        for k, lang in enumerate(LANGS):
            mine = [_cleaned(t) for t, x in zip(texts, langs) if x == lang]
            for part in by_size(mine):
                code, starts = letters(part)
                # Once as written and once without accents, as accents get lost.
                for c in (code, _FOLD[code]):
                    total[k] += np.bincount(ngrams(c, starts)[1], minlength=SIZE)
    at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["k", "gram", "n"])


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Rank of each n-gram in each language (codes x languages), from all labelled texts; PROFILE where it has none."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isin(*LANGS))
    counts = rows.mapInArrow(_counted, "k int, gram int, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < PROFILE)
    ranks = np.full((SIZE, len(LANGS)), PROFILE, np.int16)
    for r in ranked.select("k", "gram", "rank").collect():  # at most PROFILE rows a language
        ranks[r.gram, r.k] = r["rank"]
    return ranks


def out_of_place(texts: list[str], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) mean out-of-place distance between 0 and 1, and the number of n-grams compared."""
    code, starts = letters([_cleaned(t) for t in texts])
    doc, gram = ngrams(code, starts)
    key, n = np.unique(doc.astype(np.int64) * SIZE + gram, return_counts=True)
    doc, gram = key // SIZE, key % SIZE
    # Sorted by text, falling count and n-gram, as one number each.
    packed = np.sort(doc << 32 | (MOST - np.minimum(n, MOST)) << 3 * BITS | gram)
    doc, gram = packed >> 32, packed & (SIZE - 1)
    counts = np.bincount(doc, minlength=len(texts))
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    top = rank < DOC_PROFILE
    doc, gram, rank = doc[top], gram[top], rank[top]
    known = np.bincount(doc, minlength=len(texts))
    # An n-gram the profile lacks is farther than any other.
    place = np.where(ranks >= PROFILE, 3 * PROFILE, ranks).astype(np.int16)[gram]
    far = np.minimum(np.abs(place - rank.astype(np.int16)[:, None]), PROFILE)
    total = np.zeros((len(texts), len(LANGS)))
    some = np.flatnonzero(known)
    if len(some):
        total[some] = np.add.reduceat(far, np.searchsorted(doc, some), axis=0, dtype=np.int64)
    return total / np.maximum(known, 1)[:, None] / PROFILE, known


def label_code(label: Column) -> Column:
    """The language a label names, in whatever notation; null if it names none of the eight."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    code = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        code = F.when(word.isin(lang, *names), F.lit(lang)).otherwise(code)
    return code


RESULT = "lang string, confidence double, parts array<struct<stanza_no:int,lang:string,confidence:double>>"


def _best(distance: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest language, and the step of how much nearer than the second it is, weighed by the n-grams compared."""
    order = np.sort(distance, axis=1)
    margin = (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1], 1e-9)
    return distance.argmin(axis=1), np.minimum(margin * np.sqrt(known) * PER_BIN, SURE_BINS - 1).astype(np.int64)


UNFITTED = (np.arange(SURE_BINS) + 1) / SURE_BINS  # confidence by steps where none was fitted


def tag(texts: list[str | None], ranks: np.ndarray, sure: np.ndarray = UNFITTED) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """Language and confidence of each text and of its stanzas; no language for a text without letters."""
    blocks = [stanzas(t) if t else [] for t in texts]
    flat = [s for b in blocks for s in b]
    if not flat:
        return [(None, 0.0, []) for _ in texts]
    distance, known = out_of_place(flat, ranks)
    choice, step = _best(distance, known)
    sizes = np.array([len(b) for b in blocks])
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    weight = np.zeros(len(texts), np.int64)
    weight[some] = np.add.reduceat(known, starts)
    whole = np.zeros((len(texts), len(LANGS)))
    whole[some] = np.add.reduceat(distance * known[:, None], starts, axis=0) / np.maximum(weight[some], 1)[:, None]
    own, own_step = _best(whole, weight)
    langs, confidence = [LANGS[k] for k in choice], np.where(known > 0, sure[step], 0.0).tolist()
    out, at = [], 0
    for i, n in enumerate(sizes.tolist()):
        if not weight[i]:
            out.append((None, 0.0, []))
        else:
            lang = LANGS[own[i]]
            out.append((lang, float(sure[own_step[i]]), [(j + 1, langs[at + j] if known[at + j] else lang, confidence[at + j]) for j in range(n)]))
        at += n
    return out


def rising(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share that is right at each step, smoothed and never falling (pooled where it would)."""
    groups: list[list[float]] = []
    for r, m in zip(right + 1.0 / len(LANGS), n + 1.0):
        groups.append([r, m, 1])
        while len(groups) > 1 and groups[-2][0] / groups[-2][1] >= groups[-1][0] / groups[-1][1]:
            r2, m2, k2 = groups.pop()
            groups[-1] = [groups[-1][0] + r2, groups[-1][1] + m2, groups[-1][2] + k2]
    return np.concatenate([np.full(k, r / m) for r, m, k in groups])


def fit_confidence(labelled: DataFrame, ranks: np.ndarray, text: str = "text", lang: str = "lang", sample: int = CALIBRATION) -> np.ndarray:
    """How often a stanza's language is right, by steps of the margin, from about ``sample`` labelled texts drawn by a hash of the text, whole."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isin(*LANGS))
    every = max(1, rows.count() // sample)
    drawn = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0))
    shared = labelled.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(SURE_BINS, np.int64), np.zeros(SURE_BINS, np.int64)
        for b in batches:
            texts, langs, at = b.column("text").to_pylist(), b.column("lang").to_pylist(), 0
            for part in by_size(texts):
                blocks = [stanzas(t) for t in part]
                of = [LANGS.index(langs[at + i]) for i, x in enumerate(blocks) for _ in x]
                at += len(part)
                if of:
                    choice, step = _best(*out_of_place([s for x in blocks for s in x], shared.value))
                    n += np.bincount(step, minlength=SURE_BINS)
                    right += np.bincount(step, weights=choice == np.array(of), minlength=SURE_BINS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SURE_BINS, dtype=np.int32)), pa.array(right), pa.array(n)], names=["step", "r", "n"])

    right, n = np.zeros(SURE_BINS), np.zeros(SURE_BINS)
    for r in drawn.mapInArrow(run, "step int, r bigint, n bigint").groupBy("step").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).collect():  # SURE_BINS rows
        right[r.step], n[r.step] = r.r, r.n
    return rising(right, n)


def add_language(rows: DataFrame, text: str, ranks: np.ndarray, sure: np.ndarray = UNFITTED) -> DataFrame:
    """Add a struct column ``tagged`` (lang, confidence, parts: one per stanza) to all rows.

    Null, empty and blank texts, and texts without a letter, get a null language
    and no parts.  A stanza without letters takes the language of its text with
    confidence 0.  All other columns are kept as they are.
    """
    shared = rows.sparkSession.sparkContext.broadcast((ranks, sure))  # of fixed size, whatever the corpus

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for part in by_size(values.tolist()):
            out += tag(part, *shared.value)
        return pd.DataFrame(out, columns=["lang", "confidence", "parts"])

    # Not to be repeated where a filter on the result is pushed below it.
    return rows.withColumn("tagged", F.pandas_udf(run, RESULT).asNondeterministic()(F.col(text)))


def language_cases(lyrics: DataFrame, labelled: DataFrame, fitted: bool = True) -> DataFrame:
    """(lyrics_id, stanza_no, lang, confidence) of each stanza of a text whose label is missing, names no or another language, or whose stanzas differ.

    ``fitted``: confidence is the share of right stanzas among labelled ones with
    such a margin; else the margin itself, for callers who do not ask for it.
    """
    ranks = train_profiles(labelled)
    tagged = add_language(lyrics.select("lyrics_id", "lyrics_text", label_code(F.col("lang_label")).alias("label")), "lyrics_text", ranks, fit_confidence(labelled, ranks) if fitted else UNFITTED)
    parts = tagged.select("lyrics_id", "label", F.col("tagged.lang").alias("own"), F.col("tagged.parts").alias("parts"))
    langs = F.array_distinct(F.transform("parts", lambda p: p["lang"]))
    # With one language in all stanzas, that is the text's.
    wrong = F.col("label").isNull() | (F.size(langs) > 1) | (F.col("label") != F.element_at(langs, 1))
    return parts.where(F.col("own").isNotNull() & wrong).select("lyrics_id", F.inline("parts"))
