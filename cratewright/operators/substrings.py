"""Which texts contain which patterns, without comparing each text with each pattern.

Every part of a text is hashed as it grows sign by sign, over all texts of a batch
at once, and looked up in a filter of the patterns' hashes; the few parts that pass
are left to a join with the patterns.  The filter may let a part pass in vain but
never stops one that is a pattern, so its size costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewright.llm.batches import by_size

BITS_EACH, MOST_BITS, BUCKET = 32, 28, 32768  # bits of the filter for a pattern, their logarithm at most (32 MB a filter), and bits of a bitmap of Spark
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PROBES = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))  # fixed values


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signs of the texts in a row, and where each text begins and ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return signs, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _spots(h: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * probe
    return (x ^ (x >> np.uint64(29))) * _BASE >> np.uint64(64 - bits)


def _growing(signs: np.ndarray, at: np.ndarray, ends: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, which, hashes) of the parts of n = 1, 2, ... signs that begin at ``at``, as long as they fit before ``ends``."""
    which, h, n = np.arange(len(at)), np.zeros(len(at), np.uint64), 0
    while most is None or n < most:
        fits = at[which] + n < ends[which]
        which, h = which[fits], h[fits]
        if not len(which):
            return
        h = (h + signs[at[which] + n] + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(32)
        n += 1
        yield n, which, h


def pattern_spots(patterns: list[str], bits: int) -> np.ndarray:
    signs, starts, ends = _signs(patterns)
    whole = np.zeros(len(patterns), np.uint64)
    for _, which, h in _growing(signs, starts, ends, None):
        whole[which] = h
    return np.concatenate([_spots(whole, p, bits) for p in _PROBES])


def passing(texts: list[str], filled: np.ndarray, bits: int, most: int | None, first_only: bool) -> Iterator[tuple[int, str]]:
    """(number of the text, part) of the parts that the filter lets pass, each once a text."""
    signs, starts, ends = _signs(texts)
    owner = np.repeat(np.arange(len(texts)), ends - starts)
    at = starts if first_only else np.arange(len(signs))
    stop = ends if first_only else ends[owner]
    found = set()
    for n, which, h in _growing(signs, at, stop, most):
        for p in _PROBES:
            spot = _spots(h, p, bits)
            hit = (filled[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            which, h = which[hit], h[hit]
        for i in which.tolist():
            k = i if first_only else int(owner[i])
            begin = int(at[i] - starts[k])
            found.add((k, texts[k][begin : begin + n]))
    yield from sorted(found)


def filters(patterns: DataFrame, kinds: int, n_patterns: int) -> tuple[list[np.ndarray], int]:
    """For each kind 0, 1, ... the filter of its patterns, and the logarithm of the bits of each.

    patterns: (kind, pattern), not null; repeated ones do no harm.  ``n_patterns``
    is about the number of the largest kind.
    """
    bits = min(MOST_BITS, max(BUCKET.bit_length() - 1, (BITS_EACH * n_patterns).bit_length()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, texts, done = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
            for part in by_size(texts):
                at = pattern_spots(part, bits).astype(np.int64)
                of = np.tile(kind[done : done + len(part)], len(_PROBES)).astype(np.int64)
                done += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique((of << bits) + at) + 1)], names=["spot"])

    filled = np.zeros((kinds << bits) // 8, np.uint8)
    bitmaps = patterns.select(F.col("kind").cast("int"), "pattern").mapInArrow(spots, "spot bigint").groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    for row in bitmaps.toLocalIterator():
        at = (row.bucket - 1) * BUCKET // 8
        filled[at : at + BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
    return list(filled.reshape(kinds, -1)), bits


def passing_whole(texts: list[str], filled: np.ndarray, bits: int) -> np.ndarray:
    """Whether each text as a whole passes."""
    spots = pattern_spots(texts, bits)
    return ((filled[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).reshape(len(_PROBES), -1).all(axis=0)
