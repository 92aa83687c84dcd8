"""Mapping of freely typed values to a reference list.

A symmetric-delete dictionary is built from the reference list: every form of an
entry with up to ``max_edits`` letters left out points to the entry.  A typed
value is looked up through its own deletions, so the candidates within the edit
distance are found without comparing it with the list; they are ranked by
weighted Damerau-Levenshtein distance, then by how often the entry is used.
Words that stand around many different entries ("music", "90s") are learned from
the column itself.  The dictionary goes to every task if it is small; a larger
one is joined by its deletions, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewright.session import cut

MAX_REFERENCE = 5_000
CACHE = 200_000

PART, HEAD = 20.0, 30.0  # ranks, behind all slips, of a name cut short and of a name with other words before it
AROUND_PART, AROUND_LEAST, MAX_AROUND = 0.1, 3, 10_000  # share and number of entries a phrase must stand beside, and phrases kept
LONGEST_PHRASE = 3  # words

# Neighbours on a keyboard.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_SEPARATORS = re.compile(r"\s*[/,;|+]\s*|\s+-\s+")
_KEPT = re.compile(r"[^0-9a-z]+")
_AND = re.compile(r"\band\b")


def plain(text: str) -> str:
    """Lower case, without accents and with one sign for "and"."""
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text.replace("&", " and ")


def squeezed(text: str) -> str:
    return _KEPT.sub("", text)


def _near_keys() -> frozenset[tuple[str, str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return frozenset((a, b) for a, (xa, ya) in at.items() for b, (xb, yb) in at.items() if a != b and abs(ya - yb) <= 1 and abs(xa - xb) <= 1)


NEAR = _near_keys()


def weighted_distance(a: str, b: str, most: float = 99.0) -> float:
    """Damerau-Levenshtein distance in which slips of the fingers count less.

    A swap of neighbours, a doubled letter and a neighbouring key count 0.8, a
    change of the first letter 1.2, all else 1.  Above ``most``: 99.
    """
    if abs(len(a) - len(b)) > most / 0.8:
        return 99.0
    before: list[float] = []
    last = [j * 1.0 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        out = 0.8 if i > 1 and x == a[i - 2] else 1.0
        for j, y in enumerate(b, 1):
            into = 0.8 if j > 1 and y == b[j - 2] else 1.0
            change = 0.0 if x == y else 0.8 if (x, y) in NEAR else 1.2 if i == j == 1 else 1.0
            best = min(last[j] + out, row[j - 1] + into, last[j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return 99.0
        before, last = last, row
    return last[-1] if last[-1] <= most else 99.0


def deletions(word: str, edits: int) -> set[str]:
    found = level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found


def allowed_edits(length: int, most: int) -> int:
    """Letters that may differ: one up to five letters, then two, three from fourteen."""
    return min(most, 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3)


def name_keys(name: str, others: Iterable[str]) -> set[str]:
    """The squeezed forms of an entry's names: as written, "and" as "n", last words first."""
    keys = set()
    for form in {name, *others}:
        p = plain(form)
        keys |= {squeezed(p), squeezed(_AND.sub("n", p)), squeezed("".join(reversed(p.split(" ", 1))))}
    return keys - {""}


def part_keys(name: str) -> set[str]:
    """A name cut short: its first words, each whole or cut after four letters or more, or its last word."""
    words = [w for w in (squeezed(x) for x in plain(name).split()) if w]
    if not words:
        return set()
    cut_words = [{w, *(w[:i] for i in range(4, len(w)))} for w in words[:3]]
    keys = {"".join(x) for k in range(1, len(cut_words) + 1) for x in product(*cut_words[:k])} | {words[-1]}
    return {k for k in keys if len(k) >= 4}


Around = tuple[frozenset[str], frozenset[str]]
NOTHING: Around = (frozenset(), frozenset())


def shapes(part: str, around: Around) -> Iterator[str]:
    """The part as written, with "and" as "n", then without the phrases around it."""
    p = _KEPT.sub(" ", part).strip()
    sizes = [sorted({len(x) for x in side}) for side in around]
    seen: set[str] = set()
    todo = [p]
    while todo:
        p = todo.pop(0)
        for word in (squeezed(p), squeezed(_AND.sub("n", p))):
            if word not in seen:
                seen.add(word)
                yield word
        todo += [x for n in sizes[0] if p[:n] in around[0] and (x := p[n:].lstrip()) and squeezed(x) not in seen]
        todo += [x for n in sizes[1] if p[-n:] in around[1] and (x := p[:-n].rstrip()) and squeezed(x) not in seen]


def asked(value: str, around: Around) -> list[tuple[int, int, str, bool]]:
    """The (part, place, word, tail) to look up for a value: part 0 is the whole of it, then what separators divide; ``tail``: its last words only."""
    whole = plain(value)
    parts = [x for x in _SEPARATORS.split(whole) if x.strip()]
    out = []
    for i, part in enumerate([whole, *(parts if len(parts) > 1 else [])]):
        words = _KEPT.sub(" ", part).split()
        out += [(i, k, w, False) for k, w in enumerate(shapes(part, around))]
        if i or len(parts) <= 1:
            out += [(i, k, squeezed(" ".join(words[k:])), True) for k in range(1, min(len(words), 5))]
    return out


def chosen(value: str, answers: Iterable[tuple[int, int, bool, float, int, int]]) -> int:
    """The id a value stands for, from the (part, place, tail, distance, -uses, id) of its words; 0 if none."""
    best: dict[int, tuple[float, int, int]] = {}
    for part, k, tail, d, uses, ident in answers:
        if tail and d > 0 or d >= 99:
            continue
        found = ((HEAD if tail else d) + 0.01 * k if d or tail else 0.0, uses, ident)
        best[part] = min(best.get(part, found), found)
    whole = best.pop(0, None)
    if whole and whole[0] == 0:
        return whole[2]
    n_parts = len([x for x in _SEPARATORS.split(plain(value)) if x.strip()])
    if n_parts > 1:
        if whole and len(best) < n_parts:
            return whole[2]
        if best:
            return min(b[2] for b in best.values())
    return whole[2] if whole else 0


def limit_of(word: str, key: str, max_edits: int) -> float:
    """The distance a key may have; a slip inside a swapped pair costs three light edits, and long names bear it."""
    return max(allowed_edits(len(word), max_edits), allowed_edits(len(key), max_edits)) + (1.0 if len(key) >= 8 else 0.0)


def lookup_forms(word: str, max_edits: int) -> set[str]:
    """What a word is looked up by; three letters can be an entry of four with one left out."""
    edits = allowed_edits(len(word), max_edits)
    return deletions(word, edits) if edits or len(word) == 3 else set()


class Dictionary:
    """The symmetric-delete dictionary of a reference list of (id, name, other names, uses)."""

    def __init__(self, entries: Iterable[tuple[int, str, list[str], int]], max_edits: int = 3, around: Around = NOTHING):
        self.max_edits, self.around = max_edits, around
        self.exact: dict[str, int] = {}
        self.names: dict[str, list[int]] = {}
        self.uses: dict[int, int] = {}
        self.index: dict[str, set[str]] = {}
        parts: dict[str, set[int]] = {}
        for ident, name, others, uses in sorted(entries, reverse=True):
            self.exact[name] = ident  # the smallest id of equal names
            self.uses[ident] = uses
            for key in name_keys(name, others):
                self.names.setdefault(key, []).append(ident)
            for key in part_keys(name):
                parts.setdefault(key, set()).add(ident)
        self.parts = {k: min(v) for k, v in parts.items() if len(v) == 1 and k not in self.names}
        for key in self.names:
            for cut_form in deletions(key, allowed_edits(len(key), max_edits)):
                self.index.setdefault(cut_form, set()).add(key)

    def nearest(self, word: str) -> tuple[float, int, int]:
        """(distance, -uses, id) of the best entry for a squeezed word; distance 99 if there is none."""
        if word in self.names:
            return min((0.0, -self.uses[i], i) for i in self.names[word])
        best = (99.0, 0, 0)
        for key in {k for form in self.index.keys() & lookup_forms(word, self.max_edits) for k in self.index[form]}:
            limit = limit_of(word, key, self.max_edits)
            d = weighted_distance(word, key, limit)
            if d <= limit:
                best = min(best, *((d, -self.uses[i], i) for i in self.names[key]))
        if best[0] == 99.0 and word in self.parts:
            return PART, -self.uses[self.parts[word]], self.parts[word]
        return best

    def lookup(self, value: str | None) -> int:
        """The id a value stands for, the smallest if it names several, 0 if none."""
        if value is None or not value.strip():
            return 0
        if value in self.exact:
            return self.exact[value]
        found: dict[str, tuple[float, int, int]] = {}

        def near(word: str, tail: bool) -> tuple[float, int, int]:
            if tail:  # the last words count only where they are a name as it is
                return min(((0.0, -self.uses[i], i) for i in self.names.get(word, ())), default=(99.0, 0, 0))
            if word not in found:
                found[word] = self.nearest(word)
            return found[word]

        return chosen(value, ((part, k, tail, *near(w, tail)) for part, k, w, tail in asked(value, self.around)))


_built: dict[tuple, tuple[Dictionary, object]] = {}


def _dictionary(entries: tuple, max_edits: int, around: Around):
    """Built once per Python worker."""
    key = (hash(entries), max_edits, hash(around))
    if key not in _built:
        _built.clear()
        d = Dictionary(entries, max_edits, around)
        _built[key] = (d, lru_cache(CACHE)(d.lookup))
    return _built[key][1]


def _windows(values: pd.Series) -> pd.Series:
    """Per value the (side, phrase, key): what is left beside each run of words that begins or ends a part of it."""

    def of(value: str) -> list[tuple[str, str, str]]:
        out = []
        for part in _SEPARATORS.split(plain(value)):
            words = _KEPT.sub(" ", part).split()
            for i in range(1, min(len(words) - 1, LONGEST_PHRASE) + 1):
                out.append(("before", " ".join(words[:i]), squeezed(" ".join(words[i:]))))
                out.append(("after", " ".join(words[-i:]), squeezed(" ".join(words[:-i]))))
        return out

    return pd.Series([of(v) for v in values])


def _reference(reference: DataFrame, id_col: str, name_col: str, alias_col: str | None, uses_col: str | None) -> DataFrame:
    cols = [F.col(id_col).cast("bigint").alias("id"), F.col(name_col).alias("name")]
    cols += [F.coalesce(F.col(alias_col), F.array()).cast("array<string>").alias("others") if alias_col else F.array().cast("array<string>").alias("others")]
    cols += [F.coalesce(F.col(uses_col).cast("bigint"), F.lit(0)).alias("uses") if uses_col else F.lit(0).cast("bigint").alias("uses")]
    return cut(reference.select(*cols).where("id is not null and name is not null").withColumn("others", F.filter("others", lambda x: x.isNotNull())))


def _keys(names: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([sorted(name_keys(n, o)) for n, o in zip(names, others)])


def learned_around(values: DataFrame, entries: DataFrame) -> Around:
    """The phrases that stand before and after entries: of at least AROUND_LEAST of them, and AROUND_PART of all; never a name itself.

    ``values`` (value) are different ones; counts cover all of them.
    """
    n = entries.count()
    keys = entries.select("id", F.explode(F.pandas_udf(_keys, "array<string>")("name", "others")).alias("key")).distinct()
    keys = F.broadcast(keys) if n <= MAX_REFERENCE else keys
    seen = values.select(F.inline(F.pandas_udf(_windows, "array<struct<side:string,phrase:string,key:string>>")("value")))
    beside = seen.join(keys, "key").groupBy("side", "phrase").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= max(AROUND_LEAST, AROUND_PART * n))
    phrases = beside.join(keys.select(F.col("key").alias("_k")).distinct(), F.replace("phrase", F.lit(" "), F.lit("")) == F.col("_k"), "left_anti")
    rows = phrases.orderBy(F.desc("n"), "side", "phrase").limit(MAX_AROUND).collect()  # a model of bounded size
    return frozenset(r.phrase for r in rows if r.side == "before"), frozenset(r.phrase for r in rows if r.side == "after")


def _by_join(values: DataFrame, entries: DataFrame, around: Around, max_edits: int) -> DataFrame:
    """(value, mapped) of different values, with the reference list and its deletions as tables."""
    text = "array<string>"
    names = cut(entries.select("id", "name", "uses", F.explode(F.pandas_udf(_keys, text)("name", "others")).alias("key")).distinct())
    parts = entries.select("id", "uses", F.explode(F.pandas_udf(lambda v: pd.Series([sorted(part_keys(x)) for x in v]), text)("name")).alias("key"))
    parts = parts.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.first("uses").alias("uses")).where("id = other").join(names.select("key"), "key", "left_anti")
    ask = F.pandas_udf(lambda v: pd.Series([asked(x, around) for x in v]), "array<struct<part:int,k:int,word:string,tail:boolean>>")
    wanted = cut(values.select("value", F.inline(ask("value"))))
    words = wanted.where("not tail").select("word").distinct()
    answer = lambda d: F.struct(d.cast("double").alias("d"), (-F.col("uses")).alias("u"), F.col("id"))
    exact = cut(wanted.select("word").distinct().join(names, F.col("word") == F.col("key")).groupBy("word").agg(F.min(answer(F.lit(0.0))).alias("x")))
    rest = words.join(exact.select("word"), "word", "left_anti")
    forms = F.pandas_udf(lambda v: pd.Series([sorted(lookup_forms(x, max_edits)) for x in v]), text)
    cuts = F.pandas_udf(lambda v: pd.Series([sorted(deletions(x, allowed_edits(len(x), max_edits))) for x in v]), text)
    pairs = rest.select("word", F.explode(forms("word")).alias("form")).join(names.select("key").distinct().select("key", F.explode(cuts("key")).alias("form")), "form").select("word", "key").distinct()
    far = F.pandas_udf(lambda a, b: pd.Series([weighted_distance(x, y, limit_of(x, y, max_edits)) for x, y in zip(a, b)]), "double").asNondeterministic()
    near = cut(pairs.withColumn("d", far("word", "key")).where("d < 99").join(names, "key").groupBy("word").agg(F.min(answer(F.col("d"))).alias("x")))
    short = rest.join(near.select("word"), "word", "left_anti").join(parts, F.col("word") == F.col("key")).select("word", answer(F.lit(PART)).alias("x"))
    plain_names = names.groupBy("name").agg(F.min("id").alias("own"))
    found = wanted.where("not tail").join(exact.unionByName(short).unionByName(near), "word").unionByName(wanted.where("tail").join(exact, "word"))
    pick = F.pandas_udf(lambda v, a: pd.Series([chosen(x, [(r["part"], r["k"], r["tail"], r["x"]["d"], r["x"]["u"], r["x"]["id"]) for r in y]) for x, y in zip(v, a)], dtype="int64"), "bigint")
    # A few words for each value.
    picked = found.groupBy("value").agg(F.collect_list(F.struct("part", "k", "tail", "x")).alias("answers")).select("value", pick("value", "answers").alias("picked"))
    return values.join(picked, "value", "left").join(plain_names, F.col("value") == F.col("name"), "left").select("value", F.coalesce("own", "picked", F.lit(0)).alias("mapped"))


def map_values(rows: DataFrame, value_col: str, reference: DataFrame, id_col: str, name_col: str, alias_col: str | None = None, uses_col: str | None = None, out: str = "mapped_id", max_edits: int = 3, max_reference: int = MAX_REFERENCE) -> DataFrame:
    """Add the id of the reference entry each value stands for; 0: unmatched, null or blank.

    All rows and columns are kept.  An empty reference list leaves all
    unmatched.  Of entries with the same name the smallest id wins.  Lists of up
    to ``max_reference`` entries are sent to every task, larger ones are joined;
    both give the same.
    """
    entries = _reference(reference, id_col, name_col, alias_col, uses_col)
    values = rows.select(F.col(value_col).alias("value")).where(F.regexp_replace("value", r"(?U)\s+", "") != "").distinct()
    around = learned_around(values, entries)
    if entries.count() > max_reference:
        mapped = _by_join(values, entries, around, max_edits).withColumnRenamed("value", "_value")
        return rows.join(mapped, F.col(value_col) == F.col("_value"), "left").withColumn(out, F.coalesce("mapped", F.lit(0))).drop("_value", "mapped")
    known = tuple(sorted((r.id, r.name, tuple(r.others), r.uses) for r in entries.collect()))

    @F.pandas_udf("bigint")
    def mapped(values: pd.Series) -> pd.Series:
        find = _dictionary(known, max_edits, around)
        return pd.Series([find(v) for v in values], dtype="int64")

    return rows.withColumn(out, mapped(F.col(value_col)))


def unmatched_report(mapped: DataFrame, value_col: str, out: str = "mapped_id") -> DataFrame:
    """How often each value that stands for no entry was typed."""
    return mapped.where(F.col(out) == 0).groupBy(value_col).agg(F.count(F.lit(1)).alias("n_rows"))


def to_map(entries: DataFrame, genres: DataFrame) -> DataFrame:
    """(entry_id, genre_id) of each entry whose genre is neither blank nor exactly a reference name."""
    names = genres.select(F.col("genre_name").alias("genre")).where("genre is not null").distinct()
    names = F.broadcast(names) if names.limit(MAX_REFERENCE + 1).count() <= MAX_REFERENCE else names
    used = entries.join(names, "genre", "left_semi").groupBy(F.col("genre").alias("genre_name")).agg(F.count(F.lit(1)).alias("n_uses"))
    counted = genres.select("genre_id", "genre_name", "aliases").join(used, "genre_name", "left")
    typed = entries.select("entry_id", "genre").where(F.regexp_replace("genre", r"(?U)\s+", "") != "").join(names, "genre", "left_anti")
    return map_values(typed, "genre", counted, "genre_id", "genre_name", "aliases", "n_uses", out="genre_id").select("entry_id", "genre_id")
