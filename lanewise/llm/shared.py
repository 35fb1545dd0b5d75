"""Bounded joins and run-wise readers used by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.sources.folders import Workspace, shared_root

__all__ = ["Workspace", "shared_root", "open_fs", "all_pairs", "join_small", "attach", "chunked", "whole_runs", "runs", "by_run", "by_runs", "hold", "released", "Forest"]
#: A table is broadcast only if its counted rows are within this (all such tables are a few longs wide).
BROADCAST_ROWS = 1_000_000
#: A key is hot if it holds at least 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and the path of a shared-folder URI, on the driver or an executor."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """big JOIN small, broadcasting small only if its counted rows are within the limit; a shuffle join otherwise."""
    return big.join(F.broadcast(small) if rows <= limit else small.hint("merge"), keys, how)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """Inner join of rows with one row per key, without sending a hot key to one task.

    groups holds in ``count`` how many rows its key has; ``total`` is their sum. Keys with at least
    total / HOT_SHARE rows are at most HOT_SHARE many, so they go by broadcast; the rest are shuffled.
    Both inputs are read twice and should be tables.
    """
    is_hot = F.col(count) * HOT_SHARE >= F.lit(max(total, 1))
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    by_hot = rows.join(F.broadcast(hot), keys)
    left = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_hot.unionByName(left.join(cold.hint("merge"), keys))


def chunks_of(rows: int, count: str = "n", bytes_: str | None = None, room: int = 1) -> Column:
    """How many chunks a group of ``count`` rows has: chunks of so many rows, and of about ``room`` bytes if its bytes are known."""
    s = F.ceil(F.col(count) / F.lit(rows))
    if bytes_:
        s = F.least(F.col(count), F.greatest(s, F.ceil(F.col(bytes_) / F.lit(room))))
    return s.cast("int")


def chunked(rows: DataFrame, id_col: str, size: int, count: str = "n", bytes_: str | None = None, room: int = 1) -> DataFrame:
    """Adds ci <= cj: the pair of chunks in which a row meets others of its group.

    A group of s chunks gives each row to the s pairs that hold its chunk, so every two rows meet in
    exactly one pair of *different* chunks or in (c, c), and no task holds more than two chunks of a
    group. ``own`` is the row's chunk.
    """
    s = chunks_of(size, count, bytes_, room)
    own = F.pmod(F.xxhash64(F.col(id_col)), s).cast("int")
    out = rows.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), s - 1)))
    return out.withColumn("ci", F.least("own", "_other")).withColumn("cj", F.greatest("own", "_other")).drop("_other")


@lru_cache(maxsize=1)
def _trim() -> Callable[[], object]:
    """Gives the C library's free memory back, where it can."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


#: What this worker holds from task to task, and how each is let go of.
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, let_go: Callable[[], None]) -> None:
    """Says that this worker holds something from task to task, until a task begins that doesn't need it (see released)."""
    _held[name] = let_go


def released(batches: Iterator[pa.RecordBatch], forget: Callable[[], None] | None = None, needs: str = "") -> Iterator[pa.RecordBatch]:
    """The batches; at the end of the task's input, calls forget and gives free memory back, as workers outlive tasks beside the executor's heap.

    What tasks before have held goes first, but for what this one needs.
    """
    for name in [x for x in _held if x != needs]:
        _held.pop(name)()
    try:
        yield from batches
    finally:
        if forget:
            forget()
        pa.default_memory_pool().release_unused()
        _trim()()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal integer keys from sorted batches, with the place where each run begins.

    Holds a batch and the run that is open at its end.
    """
    carry: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(cols, last, strict=True))
        cuts = np.flatnonzero(change).tolist()
        last = [c[-1] for c in cols]
        if not cuts:
            carry.append(table)
            continue
        before = sum(t.num_rows for t in carry)
        parts = [*carry, table.slice(0, cuts[-1])]
        carry = [table.slice(cuts[-1])]
        yield pa.concat_tables(parts), [0, *(before + c for c in cuts[:-1])]
    if carry:
        yield pa.concat_tables(carry), [0]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal integer keys."""
    for table, starts in whole_runs(batches, keys):
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            yield table.slice(a, b - a)


def by_run(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Applies function(table) -> iterator of RecordBatch to each group of rows; groups are streamed, not collected."""

    def each(batches):
        for table in runs(released(batches), keys):
            yield from function(table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def by_runs(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Applies function(table, starts) -> iterator of RecordBatch to many whole groups at a time."""

    def each(batches):
        for table, starts in whole_runs(released(batches), keys):
            yield from function(table, starts)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def all_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places p < q of all pairs within each range."""
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        i, j = np.triu_indices(int(size), 1)
        begin = starts[sizes == size][:, None]
        p.append((begin + i).reshape(-1))
        q.append((begin + j).reshape(-1))
    return np.concatenate(p), np.concatenate(q)


class Forest:
    """Union-find over the positions of one task's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)
