"""Encoding of whole texts with a public byte-level BPE vocabulary.

Words are found without regular expressions: code points become classes by a
table, each class is a function from states to states, and the states at all
positions follow from composing these functions.  Composition is associative,
so it runs over blocks side by side: first the function of each block, then a
doubling scan over the blocks, then the states inside all blocks at once.  The
words' slices go through pair merging, which is cached per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.llm.batches import by_size

TOKENIZERS = os.environ.get("CRATEWRIGHT_TOKENIZERS", "/opt/tokenizers")
CACHE_WORDS = 400_000
CHUNK = 2_000_000  # code points of whole texts that are split at a time

# Classes: letter, digit, other sign, apostrophe before a two- or three-sign
# contraction, blank or other white space before a word or not, text end.
L, N, O, A2, A3, SE, SM, WE, WM, END = range(10)
# States, after a sign: free, in letters, digits, signs, after a joining blank,
# in other white space, with one or two letters of a contraction to come.
FREE, IN_L, IN_N, IN_O, JOIN, WHITE, ONE, TWO = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word begins at the sign, by class and state."""
    to = np.zeros((10, 8), np.uint8)
    begins = np.ones((10, 8), bool)
    for c, own in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[c] = own
        begins[c, [own, JOIN]] = False
    for c, left in ((A2, ONE), (A3, TWO)):  # a contraction only where no word of signs goes on
        to[c] = left
        to[c, [IN_O, JOIN]] = IN_O
        begins[c, [IN_O, JOIN]] = False
    to[L, TWO], to[L, ONE] = ONE, FREE
    begins[L, [ONE, TWO]] = False
    to[SE], to[[SM, WM]] = JOIN, WHITE
    to[WE] = FREE
    # The last blank of several goes with the next word or alone; those before it are one word.
    begins[[SM, WM], WHITE] = False
    to[END] = FREE
    begins[END] = True
    return to, begins


TO, BEGINS = _tables()


def _class_table() -> np.ndarray:
    table = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = L
        elif kind == "N":
            table[cp] = N
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo : hi + 1] = WM
    return table


_class_of: np.ndarray | None = None


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each code point; ``ends`` are the positions of the text ends."""
    global _class_of
    if _class_of is None:
        _class_of = _class_table()
    c = _class_of[points]
    c[ends] = END
    white = c == WM
    blank = white & (points == 0x20)
    follows = np.append(c[1:], END)
    before_word = (follows != WM) & (follows != END)
    c[white & before_word] = WE
    c[blank] = np.where(before_word[blank], SE, SM)
    at = np.flatnonzero((points == 0x27) & (c == O))
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        c[at[np.isin(one, [ord(x) for x in "stmd"])]] = A2
        pair = one.astype(np.int64) << 21 | two
        c[at[np.isin(pair, [ord(x) << 21 | ord(y) for x, y in ("re", "ve", "ll")])]] = A3
    return c


def states(c: np.ndarray, block: int = 512) -> np.ndarray:
    """The state before each position, by an associative scan of the classes' functions."""
    n = len(c)
    blocks = -(-n // block)
    grid = np.full(blocks * block, END, np.uint8)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in grid:  # the function of each block
        whole = TO[row[:, None], whole]
    step = 1
    while step < blocks:  # prefix composition over the blocks, by doubling
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.concatenate([[FREE], whole[:-1, FREE]]).astype(np.uint8)
    out = np.empty((block, blocks), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = TO[row, state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions at which a word or a text end begins."""
    c = classes(points, ends)
    return np.flatnonzero(BEGINS[c, states(c)])


class Merger:
    """Pair merging of a byte-level BPE, with a bounded cache of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, list[int]] = {}

    def __call__(self, word: str) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            raw = word.encode()
            ids = [self.ranks[raw]] if raw in self.ranks else self.merged(raw)
            if len(word) <= 64:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps long words cheap."""
        n, ranks = len(raw), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue
            end[i], after[i] = stop, after[j]
            end[j] = 0
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[raw[i : end[i]]])
            i = after[i]
        return ids


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """The vocabulary at a path, or the copy the driver sent, read once per worker."""
    if path not in _mergers:
        sent = SparkFiles.get(os.path.basename(path)) if not os.path.exists(path) else path
        _mergers[path] = Merger(sent)
    return _mergers[path]


def split(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(joined texts, word starts with the text ends among them, text ends) by chunks of whole texts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        joined = "\n".join(texts[i:j]) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
        yield joined, word_starts(points, ends), ends
        i = j


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token ids, the end of each text among them, and the code point at which each token's word begins."""
    merge = merger(path)
    cached = merge.cache.get
    ids: list[int] = []
    where: list[np.ndarray] = []
    text_ends: list[int] = []
    for joined, starts, ends in split([t or "" for t in texts]):
        at = starts.tolist()
        is_end = np.isin(starts, ends, assume_unique=True)
        first = np.concatenate([[0], ends[:-1] + 1])
        counts = np.zeros(len(at), np.int32)
        for k, (a, b, stop) in enumerate(zip(at, at[1:] + [len(joined)], is_end.tolist())):
            if stop:
                text_ends.append(len(ids))
                continue
            word = joined[a:b]
            got = cached(word) or merge(word)
            counts[k] = len(got)
            ids += got
        text_of = np.searchsorted(ends, starts)
        where.append(np.repeat(starts - first[text_of], counts))
    return np.asarray(ids, np.int32), np.asarray(text_ends, np.int32), np.concatenate(where) if where else np.zeros(0, np.int64)


def vocabulary(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> None:
    """Give the executors a vocabulary file, once per application, if the driver has it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _sent.add(key)


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids) of each document, without special tokens; with ``offsets`` also where each token's word begins.

    Null and empty texts give an empty list.  The strings of special tokens are
    ordinary text.  Repeated ids are kept; other columns are ignored.
    """
    path = vocabulary(name, folder)
    send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in by_size(b.column(1).to_pylist(), CHUNK):
                ids, ends, where = encode(texts, path)
                cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32), pa.int32())
                out = [b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()))]
                at += len(texts)
                if offsets:
                    out.append(pa.ListArray.from_arrays(cuts, pa.array(where.astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "offsets"][: len(out)])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else ""))


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens (0 for null and empty texts) and n_different, how many different tokens they are."""
    path = vocabulary(name, folder)
    send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, different = [], []
            for texts in by_size(b.column(b.num_columns - 1).to_pylist(), CHUNK):
                ids, ends, _ = encode(texts, path)
                size = np.diff(np.concatenate([[0], ends]))
                sizes.append(size)
                of = np.repeat(np.arange(len(texts), dtype=np.int64), size) << 32
                different.append(np.bincount(np.unique(of | ids) >> 32, minlength=len(texts)))
            counts = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (sizes, different)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts], names=[*keep, "n_tokens", "n_different"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{schema}, n_tokens bigint, n_different bigint")


def decode_corpus(encoded: DataFrame, name: str = "byte_bpe_50k", id_col: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(id, text) back from (id, ids); an empty list gives the empty text."""
    path = vocabulary(name, folder)
    send(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {i: raw for raw, i in merger(path).ranks.items()}
        for b in batches:
            texts = [b"".join(parts[i] for i in ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
