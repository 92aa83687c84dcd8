"""Text that looks the same, brought to one form.

Values of plain ASCII never leave the JVM.  The others go through an Arrow
batch that takes out what can be decided from a value alone (compatibility
forms, loose accents, invisible characters, odd spaces) and finds words of mixed
script.  A mixed word is repaired towards its dominant script, and only if the
repaired word exists in the vocabulary of the corpus: the candidates are
joined, distributed, with the words of all values.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewright.session import cut

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v", "к": "k", "г": "r", "п": "n", "т": "t", "в": "b", "м": "m", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "η": "n", "τ": "t", "ϲ": "c", "ϳ": "j", "ω": "w", "ε": "e",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "ա": "w", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T",
}
BACK = {script: {} for script in ("GREEK", "CYRILLIC")}
for _foreign, _latin in LOOKALIKES.items():
    _of = unicodedata.name(_foreign).split()[0]
    if _of in BACK and _foreign not in "кгптвмнκγητωε":
        BACK[_of].setdefault(_latin, _foreign)
# Scripts that are written together in one word.
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "HANGUL": "CJK", "BOPOMOFO": "CJK", "IDEOGRAPHIC": "CJK"}
# Scripts in which a joiner between letters is spelling.
JOINING = {"ARABIC", "SYRIAC", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GUJARATI", "GURMUKHI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "ZERO"}

_WORD = re.compile(r"[^\W\d_]+")
_ORDINARY = r"^[\x09\x0a\x20-\x7e]*$"
FIELDS = "clean string, found boolean, words array<struct<word:string,repaired:string,sure:boolean>>, parts array<string>"
FEW = 1_000_000  # repaired words that are sent to every task; more are joined by exchange


@lru_cache(100_000)
def script(c: str) -> str:
    """The script of a letter by the first word of its Unicode name."""
    first = unicodedata.name(c, "OTHER").split()[0]
    return TOGETHER.get(first, first)


@lru_cache(100_000)
def ordinary_form(c: str) -> str | None:
    """What a wide, styled, joined or singleton character is a form of; None if it is an ordinary one."""
    if c <= "\x7e":
        return None
    kind = unicodedata.decomposition(c).split(" ")
    if kind[0] in ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return unicodedata.normalize("NFKC", c)
    if kind[0] == "<compat>" and unicodedata.category(c)[0] in "LN":
        return unicodedata.normalize("NFKC", c)
    if len(kind) == 1 and kind[0]:  # a singleton such as the Kelvin sign
        return unicodedata.normalize("NFC", c)
    return None


@lru_cache(100_000)
def unseen(c: str) -> bool:
    """Whether a character shows nothing: format and control characters, variation selectors, fillers."""
    return unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and c not in "\t\n\r") or "︀" <= c <= "️" or c in "͏ᅟᅠㅤﾠ"


def without_forms(text: str) -> tuple[str, bool]:
    """The text in composed, ordinary characters, and whether it held others."""
    out, found = [], False
    for i, c in enumerate(text):
        if c <= "\x7e" and (c >= " " or c in "\t\n\r"):
            out.append(c)
        elif unseen(c):
            around = (text[i - 1 : i] or " ") + (text[i + 1 : i + 2] or " ")
            if c in "‌‍" and all(unicodedata.category(x) == "So" or script(x) in JOINING for x in around):
                out.append(c)
            else:
                found = True
        elif c == "\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            out.append(" ")
            found = True
        elif (form := ordinary_form(c)) is not None:
            out.append(form)
            found = True
        else:
            out.append(c)
    joined = "".join(out)
    composed = unicodedata.normalize("NFC", joined)
    return composed, found or composed != joined


@lru_cache(100_000)
def lookalike(c: str) -> str | None:
    """The Latin letter a letter of another script looks like, accents included; None if there is none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", LOOKALIKES[base] + "".join(marks)) if marks and base in LOOKALIKES else None


@lru_cache(100_000)
def lookalike_in(target: str, latin: str) -> str | None:
    """The letter of a script that looks like a Latin one, accents included."""
    letters = BACK.get(target, {})
    if latin in letters:
        return letters[latin]
    base, *marks = unicodedata.normalize("NFD", latin)
    made = unicodedata.normalize("NFC", letters[base] + "".join(marks)) if marks and base in letters else ""
    return made if len(made) == 1 else None


def repair(word: str) -> tuple[str, bool] | None:
    """(the word in its dominant script, whether it is mixed beyond doubt), None if the word is of one script or no repair exists.

    Of scripts with equally many letters Latin is tried first.  Only a word
    whose repair lies in a third script is in doubt.
    """
    counts: dict[str, int] = {}
    for c in word:
        if not unicodedata.combining(c):
            s = script(c)
            if s not in ("MODIFIER", "OTHER", "FEMININE", "MASCULINE", "MICRO"):
                counts[s] = counts.get(s, 0) + 1
    if len(counts) < 2:
        return None
    order = sorted(counts, key=lambda s: (-counts[s], s != "LATIN", s))
    for target in order[: 2 if counts[order[0]] == counts[order[1]] else 1]:
        letters = []
        for c in word:
            if script(c) == target or unicodedata.combining(c):
                letters.append(c)
                continue
            latin = c if script(c) == "LATIN" else lookalike(c)
            new = latin if target == "LATIN" else lookalike_in(target, latin) if latin else None
            if new is None:
                break
            letters.append(new)
        else:
            return "".join(letters), True
    # All letters may be look-alikes of a third script's.
    if all(script(c) == "LATIN" or lookalike(c) for c in word):
        return "".join(lookalike(c) or c for c in word), False
    return None


def examine(text: str | None) -> tuple[str | None, bool, list[tuple[str, str, bool]], list[str]]:
    """(text in ordinary characters, whether it held others, its mixed words with their repairs, the text cut at these words)."""
    if text is None:
        return None, False, [], []
    clean, found = without_forms(text)
    words: dict[str, tuple[str, bool] | None] = {}
    parts, at = [], 0
    for m in _WORD.finditer(clean):
        w = m[0]
        if w not in words:
            words[w] = repair(w)
        if words[w]:
            parts += [clean[at : m.start()], w]
            at = m.end()
    mixed = [(w, *r) for w, r in words.items() if r]
    return clean, found, mixed, [*parts, clean[at:]] if mixed else []


def _examined(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([examine(v) for v in values], columns=["clean", "found", "words", "parts"])


def one_form(rows: DataFrame, id_cols: list[str], text_cols: list[str]) -> DataFrame:
    """One row per row and text column: ids, field_name, value, clean, found, repaired (words repaired), mixed (words left).

    ``found`` tells whether the value held characters other than the ordinary
    ones they look like.  A word of mixed script counts if each foreign letter
    has a look-alike in the dominant script, or if its repair is a word of the
    corpus; it is substituted only in the second case, and only as a whole word.
    The corpus' words are those of the values once wide, styled and loosely
    accented characters are brought to one form.  Words wholly in another
    script, typographic quotes and dashes, tabs and line feeds are left alone.
    Null stays null and is not found; the empty text is itself.  Repeated rows
    give repeated results; other columns are ignored.
    """
    examined = F.pandas_udf(_examined, FIELDS)
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in text_cols))
    values = rows.select(*id_cols, F.inline(fields))
    kept = [*id_cols, "field_name", "value"]
    ordinary = values.where(F.col("value").isNull() | F.col("value").rlike(_ORDINARY))
    # Examined once; the values that are not plain ASCII are read again several times.
    looked = cut(values.where(~F.col("value").rlike(_ORDINARY)).withColumn("x", examined("value")).select(*kept, "x.*"))
    mixed = looked.where(F.size("words") > 0)
    spread = cut(mixed.select("value", F.inline("words")).distinct())
    wanted = spread.select(F.lower("repaired").alias("w")).distinct()
    corpus = ordinary.select(F.col("value").alias("text")).unionByName(looked.select(F.col("clean").alias("text")))
    words = corpus.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    # A word of the corpus is kept only if some repair gives it, before words are exchanged.
    few = wanted.count() <= FEW
    known = words.join(F.broadcast(wanted), "w", "left_semi").distinct() if few else words.distinct().join(wanted, "w", "left_semi")
    done = (
        spread.join(known.withColumn("known", F.lit(True)), F.lower("repaired") == F.col("w"), "left")
        .groupBy("value")
        .agg(
            F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("known"), F.struct("word", "repaired"))))).alias("swaps"),
            F.max(F.coalesce(F.col("known"), F.lit(False)) | F.col("sure")).alias("foreign"),
            F.count(F.when(F.col("known").isNull(), 1)).cast("int").alias("mixed"),
        )
    )
    swapped = F.array_join(F.transform("parts", lambda p: F.coalesce(F.try_element_at("swaps", p), p)), "")
    zero = F.lit(0)
    return (
        ordinary.select(*kept, F.col("value").alias("clean"), F.lit(False).alias("found"), zero.alias("repaired"), zero.alias("mixed"))
        .unionByName(looked.where(F.size("words") == 0).select(*kept, "clean", "found", zero.alias("repaired"), zero.alias("mixed")))
        .unionByName(mixed.join(done, "value").select(*kept, swapped.alias("clean"), (F.col("found") | F.col("foreign")).alias("found"), F.size("swaps").alias("repaired"), "mixed"))
    )


def found_values(rows: DataFrame, id_col: str = "entry_id", text_cols: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """(id, field_name) of each value that holds characters other than the ordinary ones it looks like."""
    return one_form(rows, [id_col], list(text_cols)).where("found").select(id_col, "field_name")
