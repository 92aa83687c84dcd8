"""Records that are the same but for formatting, collapsed with exact copy counts.

The canonical records are range-partitioned by the hash of their key and their
id, sorted in place (Spark sorts externally), and read once: adjacent rows with
equal full keys form a run.  As the id is part of the partitioning, a key that
holds a third of all rows is spread over many partitions.  Runs that touch an
edge of a partition are the only ones that can continue in another; there are a
few per partition, and joining these summaries by key makes the groups whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewright.session import cut

SCANNED = "entry_id bigint, run_id bigint, edge_key string, edge_n bigint"


def canonical(text: Column) -> Column:
    """Letters and digits only, in one case; the empty text if there is none."""
    return F.regexp_replace(F.upper(F.lower(text)), r"[^\p{L}\p{N}]+", "")


def keyed(records: DataFrame, first: str, second: str, id_col: str) -> DataFrame:
    """(h, key, entry_id) of the records that have a letter or digit in both fields; one key for both orders of the fields.

    The test for a letter stops at the first one, and each field is brought to
    its canonical form once.
    """
    there = records.where(F.col(first).rlike(r"[\p{L}\p{N}]") & F.col(second).rlike(r"[\p{L}\p{N}]") & F.col(id_col).isNotNull())
    sides = F.array_sort(F.array(canonical(F.col(first)), canonical(F.col(second))))
    rows = there.select(F.array_join(sides, "\t").alias("key"), F.col(id_col).cast("bigint").alias("entry_id"))
    return rows.select(F.xxhash64("key").alias("h"), "key", "entry_id")


def sorted_by_key(records: DataFrame, first: str, second: str, id_col: str) -> DataFrame:
    return keyed(records, first, second, id_col).repartitionByRange("h", "entry_id").sortWithinPartitions("h", "key", "entry_id")


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted partition (columns h, key, entry_id).

    Yields a row (entry_id, run_id) for each row of a run of two or more and of
    each edge run, and a row (run_id, edge_key, edge_n) for each edge run: one
    whose hash is that of the partition's first or last row.  run_id is the
    smallest entry_id of the run.
    """
    first_h: int | None = None
    run: tuple[int, str, int, int] | None = None  # hash, key, run_id, rows so far
    tail: list[tuple[int, str, int, int]] = []  # closed runs of the run's hash

    def close(r: tuple[int, str, int, int]) -> None:
        if tail and tail[-1][0] != r[0]:
            tail.clear()
        tail.append(r)

    def batch(ids: np.ndarray, runs: np.ndarray, edges: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
        k = len(edges)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array(runs, pa.int64()), pa.array([e[2] for e in edges], pa.int64())]),
                pa.concat_arrays([pa.nulls(len(ids), pa.string()), pa.array([e[1] for e in edges], pa.string())]),
                pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array([e[3] for e in edges], pa.int64())]),
            ],
            names=["entry_id", "run_id", "edge_key", "edge_n"],
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h, key, ids = b.column("h").to_numpy(), b.column("key"), b.column("entry_id").to_numpy()
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = run is not None and run[0] == h[0] and run[1] == key[0].as_py()
        starts = np.flatnonzero(~same)
        if first_h is None:
            first_h = int(h[0])
        edges: list[tuple[int, str, int, int]] = []
        ids_out, runs_out = [], []
        bounds = np.append(starts, n)
        if same[0]:  # the run of the last batch goes on
            size = int(bounds[0])
            run = (run[0], run[1], run[2], run[3] + size)
            if run[3] - size == 1 and run[0] != first_h:  # its only row was held back
                ids_out.append(np.array([run[2]]))
                runs_out.append(np.array([run[2]]))
            ids_out.append(ids[:size])
            runs_out.append(np.full(size, run[2]))
        if len(starts):
            if run is not None:
                close(run)
                if run[0] == first_h:
                    edges.append(run)
            sizes = np.diff(bounds)
            of = np.repeat(ids[starts], sizes)  # sorted by id: the first is the smallest
            wide = np.repeat(sizes > 1, sizes)
            at_first = h[starts[0] :] == first_h
            ids_out.append(ids[starts[0] :][wide | at_first])
            runs_out.append(of[wide | at_first])
            last_h = h[starts[-1]]
            back = len(starts) - 1  # closed runs that may still be edge runs
            while back > 0 and h[starts[back - 1]] == last_h:
                back -= 1
            if tail and tail[-1][0] != last_h:
                tail.clear()
            for i in range(back, len(starts) - 1):
                close((int(last_h), key[int(starts[i])].as_py(), int(ids[starts[i]]), int(sizes[i])))
            for i in np.flatnonzero(h[starts[:-1]] == first_h):
                edges.append((first_h, key[int(starts[i])].as_py(), int(ids[starts[i]]), int(sizes[i])))
            s = int(starts[-1])
            run = (int(last_h), key[s].as_py(), int(ids[s]), int(n - s))
        yield batch(np.concatenate(ids_out or [ids[:0]]), np.concatenate(runs_out or [ids[:0]]), edges)
    if run is not None:
        close(run)
        ends = [t for t in tail if t[0] == run[0]] if run[0] != first_h else [run]
        single = [t[2] for t in ends if t[3] == 1 and t[0] != first_h]
        yield batch(np.array(single, np.int64), np.array(single, np.int64), ends)


def scan_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (run_id, n, edge_key) per run of equal keys in a sorted partition; edge_key only for the runs whose hash is that of the first or last row."""
    first_h: int | None = None
    held: list[tuple[int, str, int, int]] = []  # runs of the last hash: hash, key, run_id, rows

    def rows(runs: list[tuple[int, str, int, int]], edge: bool) -> pa.RecordBatch:
        keys = [r[1] if edge or r[0] == first_h else None for r in runs]
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in runs], pa.int64()), pa.array([r[3] for r in runs], pa.int64()), pa.array(keys, pa.string())], names=["run_id", "n", "edge_key"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h, key, ids = b.column("h").to_numpy(), b.column("key"), b.column("entry_id").to_numpy()
        if first_h is None:
            first_h = int(h[0])
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if held and held[-1][0] == h[0] and held[-1][1] == key[0].as_py():
            new[0] = False
        starts = np.flatnonzero(new)
        bounds = np.append(starts, n)
        if bounds[0]:
            held[-1] = (*held[-1][:3], held[-1][3] + int(bounds[0]))
        if not len(starts):
            continue
        last = h[n - 1]
        if held and held[0][0] != last:
            yield rows(held, False)
            held = []
        back = int(np.searchsorted(h[starts], last))  # sorted: runs from here on have the last hash
        done, sizes = starts[:back], np.diff(bounds)
        edge = pa.array(h[done] == first_h)
        keys = pc.if_else(edge, key.take(pa.array(done)), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[done], pa.int64()), pa.array(sizes[:back], pa.int64()), keys], names=["run_id", "n", "edge_key"])
        held += [(int(last), key[int(i)].as_py(), int(ids[i]), int(k)) for i, k in zip(starts[back:], sizes[back:])]
    if held:
        yield rows(held, True)


def formatting_copies(records: DataFrame, first: str = "artist", second: str = "title", id_col: str = "entry_id") -> DataFrame:
    """Each record with at least one copy: group_id (smallest id of its copies) and entry_id.

    Null or blank fields, and fields without a letter or digit, never count.
    Ids are expected to be unique; a repeated id counts as one copy more.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    scanned = cut(sorted_by_key(records, first, second, id_col).mapInArrow(scan_runs, SCANNED))
    edges = scanned.where("edge_key is not null").groupBy("edge_key").agg(F.min("run_id").alias("group_id"), F.sum("edge_n").alias("copies"), F.collect_set("run_id").alias("runs"))
    # A few runs per partition, whatever the number of rows; the planner chooses the join by their size.
    whole = edges.select("group_id", "copies", F.explode("runs").alias("run_id"))
    rows = scanned.where("entry_id is not null").select("entry_id", "run_id").join(whole, "run_id", "left")
    return rows.where("copies is null or copies > 1").select(F.coalesce("group_id", "run_id").alias("group_id"), "entry_id")


def one_per_record(records: DataFrame, first: str = "artist", second: str = "title", id_col: str = "entry_id") -> DataFrame:
    """One row per record that has letters or digits in both fields: its smallest id and number of copies (1 and more)."""
    runs = cut(sorted_by_key(records, first, second, id_col).mapInArrow(scan_counts, "run_id bigint, n bigint, edge_key string"))
    edges = runs.where("edge_key is not null").groupBy("edge_key").agg(F.min("run_id").alias("group_id"), F.sum("n").alias("copies"))
    return runs.where("edge_key is null").select(F.col("run_id").alias("group_id"), F.col("n").alias("copies")).unionByName(edges.select("group_id", "copies"))
