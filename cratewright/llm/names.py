"""Linking variant spellings of names.

A name is read as its longest word and the rest (a given name, an initial, the
noun of a band), folded for spellings that sound alike.  Names with equal folds
are one form.  Suffix blocking finds candidates: each word is indexed by its
suffix, as written and with one letter of it left out, so a slip near the end
does no harm.  A suffix alone is too common, so every key is refined by the first
letter of the other word; no key is discarded, at any size of the table.
Candidates whose letters alone rule that out are put aside; the others are
compared by the longest-common-subsequence ratio, and linked forms are closed
with hash-to-min.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewright.llm.components import hash_to_min
from cratewright.session import cut

COMMON = 40  # forms of a key that one part compares with the whole key
SUFFIX, WHOLE_SUFFIX, LEAST = 6, 8, 4  # letters of a word's indexed suffix, of that of two words written together, and of an indexed word at least
ALIKE, REST_ALIKE, TOGETHER = 0.84, 0.72, 0.9  # LCS ratios from which words, rests, and two words written together agree
NEAR_BEST = 0.08  # how far from equal words with a mere initial may be, one slip apart
SEEN, SEEN_PART, SEEN_WHOLE = 3, 0.25, 12  # evidence for a short form, and rests of a main word up to which it counts in full

_NOISE = re.compile(r"\s*[\(\[][^)\]]*[\)\]]|\s+-\s+topic\b.*|\s+official\b.*|\bvevo\b")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
# Spellings that sound alike, applied in this order.
SOUNDS = (("ph", "f"), ("cks", "ks"), ("x", "ks"), ("ck", "k"), ("ch", "\x01"), ("c", "k"), ("q", "k"), ("\x01", "ch"), ("w", "v"), ("ee", "i"), ("oo", "u"), ("j", "i"), ("y", "i"), ("z", "s"))
_DOUBLE = re.compile(r"(.)\1+")
# First letters that may begin the same folded word.
FIRST = {"p": "f", "c": "k", "q": "k", "x": "k", "w": "v", "j": "i", "y": "i", "z": "s"}


def first(word: str) -> str:
    """The class of a word's first letter, empty for no word."""
    return FIRST.get(word[:1], word[:1])


@lru_cache(200_000)
def fold(word: str) -> str:
    """A word as it sounds."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return _DOUBLE.sub(r"\1", word)


def parse(name: str | None) -> tuple[str, str] | None:
    """(longest word, rest) of a name, folded; None if it has no letter or digit.

    Remarks in brackets, channel marks, articles, a final "band" and middle
    initials say nothing about who it is; "B, A" is read as "A B".
    """
    if not name:
        return None
    t = unicodedata.normalize("NFKD", name).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = (_NOISE.sub(" ", t).strip() or t).replace("&", " and ")
    if t.count(",") == 1:
        last, first = t.split(",")
        t = f"{first} {last}"
    words = [w.replace("'", "").replace("’", "") for w in _TOKEN.findall(t)]
    if not words:
        return None
    if len(words) > 1 and words[0] in ("the", "a", "an") and (words[0] == "the" or len(words) > 2):
        words = words[1:]
    if len(words) > 2 and words[-1] == "band":
        words = words[:-1]
    full = [w for w in words if len(w) > 1]
    if len(full) == 1 and len(words) > 1:  # an initial takes the place of the rest
        return fold(full[0]), next(w for w in words if len(w) == 1)
    full = [fold(w) for w in (full if len(full) > 1 else words)]
    main = max(full, key=lambda w: (len(w), w))
    full.remove(main)
    return main, "".join(full)


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair; bit-parallel over all pairs at once, words of any length."""
    n = len(left)
    out = np.zeros(n, np.int32)
    size_a, size_b = np.fromiter(map(len, left), np.int32, n), np.fromiter(map(len, right), np.int32, n)
    fits = size_a <= 62
    for i in np.flatnonzero(~fits):
        out[i] = _lcs_long(left[i], right[i])
    rows = np.flatnonzero(fits & (size_a > 0) & (size_b > 0) & (size_b <= 400))
    for i in np.flatnonzero(fits & (size_b > 400)):
        out[i] = _lcs_long(left[i], right[i])
    if not len(rows):
        return out

    def grid(words: list[str], width: int) -> np.ndarray:
        return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)

    a = grid([left[i] for i in rows], int(size_a[rows].max()))
    b = grid([right[i] for i in rows], int(size_b[rows].max()))
    bits = np.left_shift(np.uint64(1), np.arange(a.shape[1], dtype=np.uint64))
    full = (np.left_shift(np.uint64(1), size_a[rows].astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
    v = full.copy()
    for j in range(b.shape[1]):
        match = ((a == b[:, j : j + 1]) & (b[:, j : j + 1] > 0)) @ bits
        u = v & match
        v = ((v + u) | (v - u)) & full
    left_over = (~v) & full
    out[rows] = np.bitwise_count(left_over)
    return out


def _lcs_long(a: str, b: str) -> int:
    """The same for long words, with unbounded integers."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(left: list[str], right: list[str]) -> np.ndarray:
    """LCS ratio 2 LCS / (|a| + |b|); 0 if either is empty."""
    n = len(left)
    sizes = np.fromiter(map(len, left), np.int64, n) + np.fromiter(map(len, right), np.int64, n)
    return 2 * lcs_lengths(left, right) / np.maximum(sizes, 1)


def _one_slip(a: str, b: str) -> bool:
    """Whether the words differ in one letter or in the order of two neighbours."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1 or len(a) == 2 and a == b[::-1]


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


class Rests:
    """Whether two rests can be of one artist.

    given: the given names a word is a short form of; meant: those of the short
    forms it is a slip of.
    """

    def __init__(self) -> None:
        self.given: dict[str, set[str]] = {}
        self.meant: dict[str, set[str]] = {}
        self.agree = lru_cache(200_000)(self._agree)

    def learn(self, words: list[str], given: list[list[str] | None], meant: list[list[str] | None]) -> None:
        if len(self.given) > 200_000:
            self.given.clear()
            self.meant.clear()
        for w, g, m in zip(words, given, meant):
            if m:
                self.given[w], self.meant[w] = set(g or ()), set(m)

    def _agree(self, x: str, y: str) -> float:
        """0: no; up to 1: how well."""
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        if len(x) == 1 or len(y) == 1:
            return 0.9 if len(x) != len(y) and first(x) == first(y) else 0.0
        if len(x) > len(y):
            x, y = y, x
        names_x, names_y = self.given.get(x, set()) | {x}, self.given.get(y, set()) | {y}
        if names_x & names_y:
            return 0.97
        if len(x) >= 3 and y.startswith(x):
            return 0.95
        if (self.meant.get(x, set()) | {x}) & (self.meant.get(y, set()) | {y}):  # a short form with a slip
            return 0.9
        best = max(ratio([a for a in names_x for _ in names_y], [b for _ in names_x for b in names_y]))
        if best >= REST_ALIKE and len(y) >= 4:
            return float(best)
        if 3 <= len(x) <= 5 and x[0] == y[0] and _subsequence(x, y):
            return 0.8
        return 0.0


def scores(a1: list[str], b1: list[str], a2: list[str], b2: list[str], rests: Rests) -> np.ndarray:
    """How alike two forms are, 0 if they are not one artist's: the LCS ratio of their main words under the better reading, less a little where the rests only agree loosely."""
    n = len(a1)
    best = np.zeros(n)
    for m1, o1, m2, o2 in ((a1, b1, a2, b2), (a1, b1, b2, a2), (b1, a1, a2, b2)):
        r = ratio(m1, m2)
        for i in np.flatnonzero((r >= ALIKE) & (r > best)):
            if min(len(m1[i]), len(m2[i])) < 4:
                continue
            agree = rests.agree(o1[i], o2[i])
            if min(len(o1[i]), len(o2[i])) == 1 and r[i] < 1 - NEAR_BEST and not _one_slip(m1[i], m2[i]):
                continue  # an initial says too little for words that differ more
            if agree and (r[i] > 0.999 or agree > 0.999 or r[i] + agree >= 1.66):
                best[i] = max(best[i], r[i] - (0.001 if agree < 0.999 else 0.0))
    # One word that is both words of the other, written together.
    lone = np.flatnonzero([(not p) != (not q) for p, q in zip(b1, b2)])
    if len(lone):
        single = [a1[i] if not b1[i] else a2[i] for i in lone]
        pair = [(a2[i], b2[i]) if not b1[i] else (a1[i], b1[i]) for i in lone]
        for whole in ([p + q for p, q in pair], [q + p for p, q in pair]):
            whole = [_DOUBLE.sub(r"\1", w) for w in whole]
            r = ratio(single, whole)
            for k in np.flatnonzero((r >= TOGETHER) & (r > best[lone])):
                if len(pair[k][1]) > 1:
                    best[lone[k]] = r[k]
    return best


def suffixes(word: str, size: int) -> set[str]:
    """The last letters of a word, as written and with one of them left out."""
    tail = word[-size - 1 :]
    return {word[-size:], *(tail[:i] + tail[i + 1 :] for i in range(len(tail)))}


def block_keys(a: str, b: str, given_a: set[str], given_b: set[str]) -> set[tuple[str, str]]:
    """The (key, plain key) of a form (a, b): plain is the key of the suffix with no letter left out.

    A word's suffixes are refined by the first letters the other word may have:
    its own and those of the given names it is short for.  Two words are also
    indexed as one, in both orders, refined by the first letter of the whole.
    """
    keys = set()
    if b:
        for word, other, given in ((a, b, given_b), (b, a, given_a)):
            if len(word) >= LEAST:
                letters = {first(other), *map(first, given)}
                keys |= {(f"{x}|{c}", f"{word[-SUFFIX:]}|{c}") for x in suffixes(word, SUFFIX) for c in letters}
    if len(b) != 1:
        for whole in {a + b, b + a}:
            whole = _DOUBLE.sub(r"\1", whole)
            if len(whole) >= LEAST:
                keys |= {(f"{x}+{first(whole)}", f"{whole[-WHOLE_SUFFIX:]}+{first(whole)}") for x in suffixes(whole, WHOLE_SUFFIX)}
    return keys


def letters(word: str) -> int:
    """The letters of a word as 64 bits, a bit for each time a letter stands in it; bits may be shared, so words differ in at least as many letters as bits."""
    bits, seen = 0, {}
    for c in word:
        n = seen[c] = seen.get(c, -1) + 1
        bits |= 1 << (ord(c) % 32 if n == 0 else 32 + ord(c) % 32 if n == 1 else (5 * ord(c) + 11 * n) % 64)
    return bits - (1 << 64) if bits >> 63 else bits


LETTERS = ("in_a", "in_b", "in_ab", "n_a", "n_b", "lost")


def _letters(a: str, b: str) -> Column:
    """LETTERS of a form: the letters of both words and of both together, the length of each, and how many letters writing them together may lose."""

    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lost = [len(x) + len(y) - min(len(_DOUBLE.sub(r"\1", x + y)), len(_DOUBLE.sub(r"\1", y + x))) for x, y in zip(a, b)]
        return pd.DataFrame({"in_a": a.map(letters), "in_b": b.map(letters), "in_ab": (a + b).map(letters), "n_a": a.map(len), "n_b": b.map(len), "lost": lost})

    return F.pandas_udf(of, "in_a bigint, in_b bigint, in_ab bigint, n_a int, n_b int, lost int")(a, b)


def _may_be_alike() -> Column:
    """Whether :func:`scores` can be above 0 by the letters (LETTERS) of two forms 1 and 2.

    An LCS ratio of r asks that at most (1 - r) of all letters stand in one word
    only.  No pair is lost: it only spares comparisons that give 0.
    """

    def few(x: str, y: str, n: Column, least: float, more: Column | int = 0) -> Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= n * (1 - least) + 1e-6 + more

    n = lambda x, y: F.col(x) + F.col(y)
    words = [few(f"in_{x}1", f"in_{y}2", n(f"n_{x}1", f"n_{y}2"), ALIKE) for x, y in ("aa", "ab", "ba")]
    together = [(F.col(f"n_b{i}") == 0) & (F.col(f"n_b{j}") > 0) & few(f"in_a{i}", f"in_ab{j}", F.col(f"n_a{i}") + n(f"n_a{j}", f"n_b{j}"), TOGETHER, F.col(f"lost{j}")) for i, j in ((1, 2), (2, 1))]
    return words[0] | words[1] | words[2] | together[0] | together[1]


def _forms(credits: DataFrame, id_col: str, name_col: str, same_col: str | None) -> DataFrame:
    parsed = F.pandas_udf(lambda v: pd.DataFrame([parse(x) or (None, None) for x in v], columns=["a", "b"]), "a string, b string")
    same = F.col(same_col) if same_col else F.lit(None).cast("string")
    return credits.select(F.col(id_col).alias("credit_id"), same.cast("string").alias("same"), parsed(F.col(name_col)).alias("p")).select("credit_id", "same", "p.a", "p.b").where("a is not null and credit_id is not null")


def _seen_short_forms(forms: DataFrame) -> DataFrame:
    """(given, short): short forms the list lacks: rests that stand with the same main word again and again.

    At least SEEN main words must have both, and these must be a good part of
    all that have the rarer one; people who share a family name by chance do not
    reach that.  The more rests a main word has, the less it says about which of
    them belong together: from SEEN_WHOLE rests on, it counts for as much less as
    each rest has more partners.  Every main word and every pair counts.
    """
    unit = 1_000_000  # evidence in whole parts, so that sums do not depend on their order
    rests = forms.where(F.length("b") > 2)
    many = rests.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    weighed = rests.join(many, "a").select("a", "b", F.least(F.lit(unit), F.floor(F.lit(unit * (SEEN_WHOLE - 1)) / (F.col("n") - 1))).alias("w"))
    # A rest whose main words do not suffice all together makes no pair that does.
    enough = weighed.groupBy("b").agg(F.sum("w").alias("all")).where(F.col("all") >= SEEN * unit).select("b")
    near = weighed.join(enough, "b")
    parts = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COMMON).cast("int").alias("parts"))
    near = cut(near.join(parts, "a"))
    # Every part of a main word's rests meets all of them.
    left = near.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("x"))
    both = left.join(near.select("a", F.pmod(F.hash("b"), "parts").alias("part"), F.col("b").alias("y"), "w"), ["a", "part"]).where("x < y")
    pair = both.groupBy("x", "y").agg(F.sum("w").alias("n")).where(F.col("n") >= SEEN * unit)
    used = forms.groupBy("b").agg(F.count(F.lit(1)).alias("n_b"))
    pair = pair.join(used.select(F.col("b").alias("x"), F.col("n_b").alias("nx")), "x").join(used.select(F.col("b").alias("y"), F.col("n_b").alias("ny")), "y")
    return pair.where(F.col("n") >= SEEN_PART * unit * F.least("nx", "ny")).select(F.col("x").alias("given"), F.col("y").alias("short"))


def _slip_keys(words: pd.Series) -> pd.Series:
    return pd.Series([sorted({w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}) if len(w) >= LEAST else [] for w in words])


def _short_words(forms: DataFrame, short_forms: DataFrame) -> DataFrame:
    """(word, given, meant) of the words that are a short form or a slip of one: the given names of both kinds."""
    folded = F.pandas_udf(lambda v: v.map(lambda x: fold(x.casefold())), "string")
    listed = short_forms.where("given_name is not null and short_name is not null").select(folded("given_name").alias("given"), folded("short_name").alias("short"))
    known = cut(listed.unionByName(_seen_short_forms(forms)).distinct())
    words = forms.select(F.explode(F.array("a", "b")).alias("word")).where("word <> ''").distinct()
    exact = words.join(known, F.col("word") == F.col("short")).select("word", "given", F.lit(True).alias("exact"))
    slips = F.pandas_udf(_slip_keys, "array<string>")
    shorts = known.select("short").distinct()
    near = words.select("word", F.explode(slips("word")).alias("k")).join(shorts.select("short", F.explode(slips("short")).alias("k")), "k").select("word", "short").distinct()
    alike = F.pandas_udf(lambda a, b: pd.Series(ratio(a.tolist(), b.tolist())), "double")
    meant = near.where(alike("word", "short") >= 0.8).join(known, "short").select("word", "given", F.lit(False).alias("exact"))
    # A few given names for each word.
    return exact.unionByName(meant).groupBy("word").agg(F.collect_set(F.when(F.col("exact"), F.col("given"))).alias("given"), F.collect_set("given").alias("meant"))


def linked_names(credits: DataFrame, short_forms: DataFrame, id_col: str = "credit_id", name_col: str = "artist", same_col: str | None = "mb_artist_id") -> DataFrame:
    """(credit_id, root): root is the smallest id of the credits that name the same artist.

    ``same_col`` holds an identifier that is right where it is present: equal
    ones link, different ones keep apart.  Credits without a letter or digit,
    and null ids, have no row; repeated rows and ties do no harm; an empty table
    gives an empty result.
    """
    parsed = cut(_forms(credits, id_col, name_col, same_col))
    # Credits with equal folds and no contradicting identifier are one form; the smallest id stands for it.
    forms = cut(parsed.groupBy("a", "b").agg(F.min("credit_id").alias("id"), F.min("same").alias("same"), F.max("same").alias("other_same")))
    short = cut(_short_words(forms, short_forms))
    told = forms
    for c in ("a", "b"):
        told = told.join(short.select(F.col("word").alias(c), F.struct("given", "meant").alias(f"{c}_short")), c, "left")
    told = cut(told)
    keys = F.pandas_udf(lambda a, b, x, y: pd.Series([list(block_keys(*f)) for f in zip(a, b, x.map(_set), y.map(_set))]), "array<struct<key:string,plain:string>>")
    # A form becomes some dozens of keys, so small forms are spread over all cores before.
    spark = credits.sparkSession
    wide = told.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    form = ("id", "plain", "whole", *LETTERS)
    keyed = wide.select("id", _letters("a", "b").alias("of"), F.inline(keys("a", "b", F.col("a_short.meant"), F.col("b_short.meant")))).select("id", "of.*", F.xxhash64("key").alias("key"), (F.col("key") == F.col("plain")).alias("whole"), F.xxhash64("plain").alias("plain"))
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))  # a key of one form finds nothing
    keyed = cut(keyed.withColumn("parts", F.ceil(size / COMMON).cast("int")).withColumn("size", size).where("size > 1").select("key", "parts", *form))
    # Every part of a block meets the whole block.
    left = keyed.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}1") for c in form))
    right = keyed.select("key", F.pmod(F.hash("id"), F.col("parts")).alias("part"), *(F.col(c).alias(f"{c}2") for c in form))
    # Forms with one plain key meet under that and not again under its shortened ones.
    once = (F.col("plain1") != F.col("plain2")) | F.col("whole1")
    met = left.join(right, ["key", "part"]).where((F.col("id1") < F.col("id2")) & once & _may_be_alike()).select("id1", "id2").distinct()
    parts = [f"{c}{i}" for i in (1, 2) for c in ("a", "b")]
    of = lambda i: told.select(F.col("id").alias(f"id{i}"), F.col("same").alias(f"same{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("a", "b")), *(F.col(f"{c}_short.{x}").alias(f"{x}_{c}{i}") for c in ("a", "b") for x in ("given", "meant")))
    apart = F.col("same1").isNotNull() & F.col("same2").isNotNull() & (F.col("same1") != F.col("same2"))
    found = met.join(of(1), "id1").join(of(2), "id2").where(~F.coalesce(apart, F.lit(False))).drop("same1", "same2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests = Rests()
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            words = {c: col[c].to_pylist() for c in parts}
            for c in parts:
                at = np.flatnonzero(col[f"meant_{c}"].is_valid())
                rests.learn([words[c][i] for i in at], col[f"given_{c}"].take(pa.array(at)).to_pylist(), col[f"meant_{c}"].take(pa.array(at)).to_pylist())
            s = scores(*(words[c] for c in parts), rests)
            keep = pa.array(np.flatnonzero(s))
            yield pa.RecordBatch.from_arrays([col["id1"].take(keep), col["id2"].take(keep)], names=["v", "u"])

    near = found.mapInArrow(compare, "v bigint, u bigint").distinct()
    first_of = parsed.where("same is not null").groupBy("same").agg(F.min("credit_id").alias("u"))
    own = parsed.join(forms.where("same is null or same = other_same").select("a", "b", "id"), ["a", "b"]).select(F.col("id").alias("v"), F.col("credit_id").alias("u"))
    named = parsed.where("same is not null").join(first_of, "same").select(F.col("credit_id").alias("v"), "u")
    return hash_to_min(near.unionByName(own).unionByName(named), "v", "u").select(F.col("v").alias("credit_id"), "root")


def _set(values: object) -> set[str]:
    return set(values) if values is not None else set()


def linked_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of credits of one group, the form the query's columns ask for."""
    a, b = groups.select("root", F.col("credit_id").alias("credit_a")), groups.select("root", F.col("credit_id").alias("credit_b"))
    return a.join(b, "root").where("credit_a < credit_b").select("credit_a", "credit_b")
