"""Reading level of documents, from the levels of their sentences.

A softmax model with an L2 penalty scores every sentence on hashed words and
character trigrams; it is trained on the sentences of labelled documents.  A
second, small model turns the distribution of a document's sentences into a
calibrated level.  Both are fitted on a bounded sample of labelled documents
(``MAX_LABELLED``) and have a fixed size; all documents are scored, whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewright.llm.batches import by_size
from cratewright.session import cut

MAX_LABELLED, MAX_SIGNS = 4_000, 20_000_000  # labelled documents the model is fitted on, and their signs in all
LEVELS = 4
WORDS, GRAMS = 1 << 14, 1 << 13
PENALTY, STEPS, RATE = 2e-4, 240, 0.25
PARTS = 6  # of the sample, taken in turn by the steps

_SENTENCE = re.compile(r"(?<=[.!?;:])[\"”’')]*\s+|\n+")
_BULLET = re.compile(r"^[\s\-*•–—>#\d.)]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text that hold a letter; line ends and list marks divide too."""
    return [s for s in (_BULLET.sub("", x) for x in _SENTENCE.split(text)) if any(c.isalpha() for c in s)]


_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points belong to words; built once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalnum() or c in (0x27, 0x2019) for c in range(0x110000)), bool, 0x110000)
    return _letters


class Features:
    """Hashed words and trigrams of sentences, as flat arrays."""

    def __init__(self, texts: list[str]):
        joined = "".join(f" {t.lower()} " for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
        of = np.repeat(np.arange(len(texts)), sizes)
        letter = _letter_table()[points]
        begins = letter & ~np.append(False, letter[:-1])
        at = np.flatnonzero(begins)
        stops = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
        place = np.arange(len(points)) - np.repeat(at, np.diff(np.append(at, len(points)))) if len(at) and at[0] == 0 else None
        if place is None:  # signs before the first word belong to none
            place = np.zeros(len(points), np.int64)
            if len(at):
                place[at[0] :] = np.arange(at[0], len(points)) - np.repeat(at, np.diff(np.append(at, len(points))))
        power = (place * 40503 + 7919) % 65521
        mixed = np.where(letter, (points * 2654435761 + 97) % 1000003 * power, 0)
        total = np.concatenate([[0], np.cumsum(mixed)])
        self.word = ((total[stops] - total[at]) % 2147483647 % WORDS).astype(np.int64)
        self.word_of = of[at]
        inside = of[2:] == of[:-2] if len(of) > 2 else np.zeros(0, bool)
        three = (points[:-2] * 961 + points[1:-1] * 31 + points[2:]) * 2654435761 % 2147483647 % GRAMS if len(of) > 2 else np.zeros(0, np.int64)
        self.gram, self.gram_of = three[inside], of[2:][inside]
        self.n = len(texts)
        self.words = np.bincount(self.word_of, minlength=self.n)
        self.grams = np.bincount(self.gram_of, minlength=self.n)
        long = np.bincount(self.word_of, weights=stops - at, minlength=self.n) / np.maximum(self.words, 1)
        self.dense = np.stack([np.ones(self.n), long / 8.0, np.log1p(self.words) / 3.0], axis=1)
        self.sorted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def scores(self, w: np.ndarray, g: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = self.dense @ d
        for ids, counts, table in ((self.word, self.words, w), (self.gram, self.grams, g)):
            some = np.flatnonzero(counts)  # ids are in the order of sentences
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                out[some] += np.add.reduceat(table[ids], starts, axis=0) / counts[some, None]
        return out

    def gradient(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.sorted is None:  # sentences in the order of their features, once
            self.sorted = []
            for ids, of in ((self.word, self.word_of), (self.gram, self.gram_of)):
                order = np.argsort(ids, kind="stable")
                found, starts = np.unique(ids[order], return_index=True)
                self.sorted.append((of[order], found, starts))
        out = []
        for (of, found, starts), counts, size in zip(self.sorted, (self.words, self.grams), (WORDS, GRAMS)):
            table = np.zeros((size, LEVELS))
            if len(found):
                table[found] = np.add.reduceat((e / np.maximum(counts, 1)[:, None])[of], starts, axis=0)
            out.append(table)
        return out[0], out[1], self.dense.T @ e


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _adam(params: list[np.ndarray], grads, steps: int, rate: float, penalty: float) -> list[np.ndarray]:
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(grads(params, t)):
            g = g + penalty * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return params


class Model:
    def __init__(self) -> None:
        self.sentence = [np.zeros((WORDS, LEVELS)), np.zeros((GRAMS, LEVELS)), np.zeros((3, LEVELS))]
        self.document = np.zeros((2 * LEVELS + LEVELS + 2, LEVELS))

    def _doc_features(self, texts: list[str]) -> np.ndarray:
        parts = [sentences(t) for t in texts]
        flat = [s for p in parts for s in p]
        of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        n = len(texts)
        if not flat:
            return np.zeros((n, 3 * LEVELS + 2))
        f = Features(flat)
        prob = softmax(f.scores(*self.sentence))
        count, words = np.bincount(of, minlength=n), np.bincount(of, weights=f.words, minlength=n)
        mean = lambda weight, total: np.stack([np.bincount(of, weights=prob[:, k] * weight, minlength=n) for k in range(LEVELS)], axis=1) / np.maximum(total, 1)[:, None]
        by_one, by_word = mean(np.ones(len(flat)), count), mean(f.words, words)
        return np.concatenate([by_one * 4, by_word * 4, np.log(by_one + 0.02), np.ones((n, 1)), np.log1p(words / np.maximum(count, 1))[:, None]], axis=1)

    def fit(self, texts: list[str], levels: np.ndarray) -> Model:
        """Train on documents with levels 1 to 4 (half steps for raters who differ)."""
        target = np.stack([np.clip(1 - np.abs(levels - k), 0, 1) for k in range(1, LEVELS + 1)], axis=1)
        parts = [sentences(t) for t in texts]
        # Each different sentence once, with the sum of the targets of its documents.
        index: dict[str, int] = {}
        of_doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        of = np.fromiter((index.setdefault(s, len(index)) for p in parts for s in p), np.int64, len(of_doc))
        share = 1.0 / np.maximum(np.bincount(of_doc, minlength=len(texts)), 1)
        goal = np.stack([np.bincount(of, weights=(target[:, k] * share)[of_doc], minlength=len(index)) for k in range(LEVELS)], axis=1)
        weight, scale, all_of = goal.sum(axis=1, keepdims=True), max(len(texts), 1), list(index)
        parts = [(Features(all_of[i::PARTS]), weight[i::PARTS], goal[i::PARTS]) for i in range(PARTS)]

        def step(p: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            f, w, g = parts[t % PARTS]
            return f.gradient((softmax(f.scores(*p)) * w - g) * (PARTS / scale))

        self.sentence = _adam(self.sentence, step, STEPS, RATE, PENALTY)
        x = self._doc_features(texts)
        (self.document,) = _adam([self.document], lambda p, _: [x.T @ (softmax(x @ p[0]) - target) / scale], 600, 0.05, 1e-4)
        return self

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(level 1 to 4, expected level) of each text."""
        p = softmax(self._doc_features(texts) @ self.document)
        return p.argmax(axis=1) + 1, p @ np.arange(1, LEVELS + 1)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_signs: int = MAX_SIGNS) -> Model:
    """Fit on labelled English documents drawn by a hash of their id; the mean of several raters counts.

    At most ``max_labelled`` documents with at most ``max_signs`` signs in all are
    taken, whole, in the order of the hash; one that would pass the bound is
    left out.
    """
    rated = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    drawn = rated.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled)
    rows = docs.where("lang = 'en' and text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = cut(rows)
    room, ids = max_signs, []
    for i, n in sample.select("doc_id", F.length("text"), "h").orderBy("h", "doc_id").drop("h").collect():  # at most max_labelled rows
        if n <= room:
            room -= n
            ids.append(i)
    taken = sample.where(F.col("doc_id").isin(ids)).select("text", "level").toPandas() if ids else pd.DataFrame({"text": [], "level": []})
    taken = taken.sort_values(["text", "level"])
    return Model().fit(taken["text"].tolist(), taken["level"].to_numpy(float))


LEVEL = "level int, expected double"


def add_level(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """Add a struct column ``reading`` (level 1 to 4, expected level); null for null texts and texts without a letter.  All rows and columns stay."""

    def run(values: pd.Series) -> pd.DataFrame:
        levels: list[tuple[int | None, float | None]] = []
        for texts in by_size([t or "" for t in values]):
            level, expected = model.predict(texts)
            levels += [(int(a), float(b)) if any(c.isalpha() for c in t) else (None, None) for a, b, t in zip(level, expected, texts)]
        return pd.DataFrame(levels, columns=["level", "expected"]).astype({"level": "Int32", "expected": "float64"})

    return rows.withColumn("reading", F.pandas_udf(run, LEVEL)(F.col(text)))


def document_levels(docs: DataFrame, labels: DataFrame, min_chars: int = 200) -> DataFrame:
    """(doc_id, reading_level, expected) of each English document of at least ``min_chars`` code points."""
    model = train(docs, labels)
    wanted = docs.where(F.col("lang").eqNullSafe("en") & (F.col("n_chars") >= min_chars)).select("doc_id", "text")
    scored = add_level(wanted, "text", model)
    return scored.select("doc_id", F.coalesce("reading.level", F.lit(1)).alias("reading_level"), "reading.expected")
