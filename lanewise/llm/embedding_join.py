"""Near-duplicate embeddings by a subspace pigeonhole join (operator 1).

Unit vectors with cosine >= c lie within a squared distance of 2 - 2c. After a fixed random rotation
the dimensions are split into blocks, and each block gets a part of that budget in proportion to its
dimensions; two vectors within the whole budget are within it in one block at least. In each block
the vectors of a label are range-joined on a grid over the block's dimensions: a vector goes to its
own cell and to those lower neighbours that a ball of the block's radius around it reaches, so two
vectors in range always meet in the cell that is the lower one of theirs in every dimension. The more
vectors the largest label has, the more dimensions the grid takes and the narrower its cells become
(down to one radius), so that cells keep about CELL_ROWS vectors. The union of the blocks' candidates
is verified by exact cosines; a pair counts in the first block whose budget it keeps, so it counts once
without any removal of repeated pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import local_components, stars
from .components import connected_components
from .forced_bpe import ragged
from .shared import Workspace, all_pairs, attach, by_runs, chunked, join_small, released

COSINE = 0.98
BLOCK_DIM = 8
#: Grids to choose from, each with more cells than the one before: dimensions, and radii of a cell's width.
GRIDS = [*((g, 4.0) for g in range(9)), (8, 3.0), (8, 2.0), (8, 1.5), (8, 1.0)]
#: Vectors of a cell that the grid aims at and of a chunk of a cell (moving a vector costs as much as comparing it with thousands),
#: and of a part of a group of candidates that meet in a task.
CELL_ROWS, CHUNK, GROUP_CHUNK = 8192, 8192, 1024
#: Vectors that are verified at a time, in whole groups; groups up to SMALL_GROUP give all their pairs at once.
ROWS, SMALL_GROUP = 2048, 16
#: Steps of a coordinate as it is stored for the range join.
STEPS = 32767.5
_SEED = 20240229
_SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(_SEED + dim).standard_normal((dim, dim)))[0]


def blocks(dim: int) -> list[tuple[int, int]]:
    """Begin and end of each block of about BLOCK_DIM dimensions."""
    n = max(1, dim // BLOCK_DIM)
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def budget(dim: int, block: tuple[int, int]) -> float:
    return (2 - 2 * COSINE) * (1 + _SLACK) * (block[1] - block[0]) / dim


def turned(vectors: np.ndarray) -> np.ndarray:
    """The rotated unit vectors. Every number is summed in a fixed order, so it is the same in any task."""
    dim = vectors.shape[1]
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    square = np.zeros(len(vectors))
    for k in range(dim):
        square += vectors[:, k] * vectors[:, k]
    vectors /= np.sqrt(square)[:, None]
    out, q = np.zeros_like(vectors), rotation(dim)
    for k in range(dim):
        out += vectors[:, k, None] * q[k]
    return out


@lru_cache(maxsize=64)
def crowding(dim: int, grid: tuple[int, float]) -> float:
    """What share of evenly spread vectors a cell holds on the mean, visitors included.

    A coordinate is about normal with deviation 1 / sqrt(dim), so the share at home follows from the
    normal distribution; how many cells a vector visits is counted on 2,000 made-up ones.
    """
    block = blocks(dim)[0]
    radius = math.sqrt(budget(dim, block))
    x = np.random.default_rng(_SEED).standard_normal((2000, min(8, block[1] - block[0]))) / math.sqrt(dim)
    upto = [0.5 + 0.5 * math.erf(k * grid[1] * radius * math.sqrt(dim / 2)) for k in range(-40, 41)]
    alone = sum((b - a) ** 2 for a, b in zip(upto, upto[1:], strict=False)) ** min(grid[0], x.shape[1])
    return alone * len(visits(x, radius, grid)[1]) / len(x)


def choose_grid(most: int, dim: int) -> tuple[int, float]:
    """The coarsest grid whose cells hold about CELL_ROWS of ``most`` vectors; the finest one beyond."""
    return next((g for g in GRIDS if most * crowding(dim, g) <= CELL_ROWS), GRIDS[-1])


def cells(x: np.ndarray, radius: float, grid: tuple[int, float]) -> np.ndarray:
    """The home cell of each row of a block, a column for each of the grid's dimensions."""
    return np.floor(x[:, : grid[0]] / (grid[1] * radius)).astype(np.int64)


def visits(x: np.ndarray, radius: float, grid: tuple[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cells, and (row, shift) of all cells in which a row is looked for: bit k of a shift is one step down in dimension k.

    A vector in range that is a cell lower in some dimensions is at least as far away as the borders
    between them are together, so shifts whose borders are beyond the radius are left out.
    """
    home = cells(x, radius, grid)
    g = home.shape[1]
    border = (x[:, :g] - home * (grid[1] * radius)) ** 2
    bits = (np.arange(1 << g)[None, :] >> np.arange(g)[:, None]) & 1
    row, shift = np.nonzero(border @ bits <= radius * radius * (1 + 1e-6))
    return home, row, shift


def packed(cell: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cell), np.int64)
    for k in range(cell.shape[1]):
        out = out * 256 + (cell[:, k] + 128)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * size, size, dtype=np.int32)), pa.py_buffer(raw)])


def _visited(batch: pa.RecordBatch, grid: tuple[int, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows (rep, label, embedding, dim): part (dimensions * 65536 + block), reps, labels, the block's coordinates, and rows with the cells that they visit."""
    dims = np.asarray(batch.column(3))
    for dim in np.unique(dims):
        whole = batch.filter(pa.array(dims == dim))
        for a in range(0, whole.num_rows, 2048):
            some = whole.slice(a, 2048)
            x = turned(_matrix(some.column(2)))
            reps, labels = np.asarray(some.column(0)), np.asarray(some.column(1))
            for b, (begin, end) in enumerate(blocks(int(dim))):
                part = x[:, begin:end]
                home, row, shift = visits(part, math.sqrt(budget(int(dim), (begin, end))), grid)
                yield int(dim) * 65536 + b, reps, labels, part, row, packed(home[row] - ((shift[:, None] >> np.arange(home.shape[1])) & 1))


def _placed(classes: DataFrame, grid: tuple[int, float]) -> DataFrame:
    """A row (label, part, cell, rep, x) for each block and cell in which a vector is looked for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part, reps, labels, x, row, cell in _visited(batch, grid):
                low = np.round((np.clip(x, -1, 1) + 1) * STEPS).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array(labels[row]), pa.array(np.full(len(row), part)), pa.array(cell), pa.array(reps[row]), _binaries(low[row])], names=["label", "part", "cell", "rep", "x"])

    return classes.select("rep", "label", "embedding", "dim").mapInArrow(each, "label bigint, part bigint, cell bigint, rep bigint, x binary")


def _crowds(classes: DataFrame, grid: tuple[int, float]) -> DataFrame:
    """label, part, cell, n: how many vectors each cell holds, added up within a batch before rows leave Python."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            found = [np.stack((labels[row], np.full(len(row), part), cell), axis=1) for part, _, labels, _, row, cell in _visited(batch, grid)]
            if found:
                keys, n = np.unique(np.ascontiguousarray(np.concatenate(found).astype(np.int64)).view([("", np.int64)] * 3).reshape(-1), return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(keys[f])) for f in keys.dtype.names), pa.array(n)], names=["label", "part", "cell", "n"])

    rows = classes.select("rep", "label", "embedding", "dim").mapInArrow(each, "label bigint, part bigint, cell bigint, n bigint")
    return rows.groupBy("part", "label", "cell").agg(F.sum("n").alias("n"))


def _in_range(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
    """The vectors of cells that are within the block's budget of others, with the group that they reach."""
    part, reps, own, ci, cj = (table.column(c).to_numpy() for c in ("part", "rep", "own", "ci", "cj"))
    x = table.column("x").combine_chunks()
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    raw = np.frombuffer(x.buffers()[2], "<u2")
    starts_ = np.array(starts, np.int64)
    sizes = np.diff(np.append(starts_, len(reps)))
    meets = lambda p, q: ((own[p] == ci[p]) & (own[q] == cj[p])) | ((own[q] == ci[p]) & (own[p] == cj[p]))
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # cells of one part stand together
    kinds = part[starts_]
    for kind in np.unique(kinds):
        dim, block = divmod(int(kind), 65536)
        begin, end = blocks(dim)[block]
        mine = np.flatnonzero(kinds == kind)
        rows = ragged(starts_[mine], sizes[mine])
        low = (raw[ends[rows][:, None] // 2 + np.arange(end - begin)] / STEPS - 1).astype(np.float32)
        at = np.cumsum(sizes[mine]) - sizes[mine]
        # stored coordinates are half a step off at most, and products are rounded to single precision
        most = np.float32((math.sqrt(budget(dim, (begin, end))) + math.sqrt(end - begin) / STEPS) ** 2 + 1e-5)
        few = sizes[mine] <= SMALL_GROUP
        for a in range(0, int(few.sum()), 4096):
            p, q = all_pairs(at[few][a : a + 4096], sizes[mine][few][a : a + 4096])
            near = ((low[p] - low[q]) ** 2).sum(axis=1) <= most
            i.append(rows[p[near]])
            j.append(rows[q[near]])
        # one product gives squared distances: x.x + y.y - 2 x.y
        square, one = (low * low).sum(axis=1, keepdims=True), np.ones((len(low), 1), np.float32)
        to, of = np.hstack((low, square, one)), np.hstack((-2 * low, one, square))
        for first, size in zip(at[~few].tolist(), sizes[mine][~few].tolist(), strict=True):
            for a in range(first, first + size, 256):
                b = min(a + 256, first + size)
                p, q = np.divmod(np.flatnonzero(to[a:b] @ of[a : first + size].T <= most), first + size - a)
                later = p < q
                i.append(rows[a + p[later]])
                j.append(rows[a + q[later]])
    i, j = np.concatenate(i), np.concatenate(j)
    asked = meets(i, j)
    i, j = i[asked], j[asked]
    if len(i):
        up = local_components(len(reps), i, j)
        some = np.unique(np.concatenate((i, j)))
        group = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(group, up[some], reps[some])
        group = group[up[some]]
        # large groups are divided into parts that meet in pairs (a, b)
        order = np.argsort(group, kind="stable")
        some, group = some[order], group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        sub = place // GROUP_CHUNK
        many = np.repeat(sub[np.append(first[1:], len(group)) - 1] + 1, np.diff(np.append(first, len(group))))
        take = np.repeat(np.arange(len(group)), many)
        other = np.arange(len(take)) - np.repeat(np.cumsum(many) - many, many)
        low, high = np.minimum(sub[take], other), np.maximum(sub[take], other)
        rows = pa.array(some[take])
        yield pa.RecordBatch.from_arrays(
            [*(table.column(c).take(rows).combine_chunks() for c in ("part", "cell", "ci", "cj", "own", "rep")), pa.array(group[take]), *(pa.array(c.astype(np.int32)) for c in (sub[take], low, high))],
            names=["part", "cell", "ci", "cj", "own", "rep", "grp", "sub", "a", "b"],
        )


def _linked(grid: tuple[int, float]):
    """Of groups: the links that count in their block and cell, as a sum for each vector, and edges that join the linked ones."""

    def linked(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        # groups stand in the order of part, so each block's are together
        part = table.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = [s - low for s in starts if low <= s < high]
            # a bounded number of vectors at a time, in whole groups
            k = 0
            while k < len(own):
                end = k + 1
                while end < len(own) and own[end] - own[k] < ROWS:
                    end += 1
                to = own[end] if end < len(own) else high - low
                yield from _block_links(table.slice(low + own[k], to - own[k]), [s - own[k] for s in own[k:end]], grid)
                k = end

    return linked


def _block_links(table: pa.Table, starts: list[int], grid: tuple[int, float]) -> Iterator[pa.RecordBatch]:
    raw = _matrix(table.column("embedding"))
    reps, copies, cell = (table.column(c).to_numpy() for c in ("rep", "n", "cell"))
    own, ci, cj, sub, a_, b_ = (table.column(c).to_numpy() for c in ("own", "ci", "cj", "sub", "a", "b"))
    block, dim, parts = table.column("part")[0].as_py() % 65536, raw.shape[1], blocks(raw.shape[1])
    x, raw = turned(raw), raw.astype(np.float64)
    length = np.sqrt((raw * raw).sum(axis=1))
    starts_ = np.array(starts, np.int64)
    sizes = np.diff(np.append(starts_, len(reps)))
    few = sizes <= SMALL_GROUP
    p, q = all_pairs(starts_[few], sizes[few])
    some = np.einsum("ij,ij->i", raw[p], raw[q]) / (length[p] * length[q]) >= COSINE
    i, j = [p[some]], [q[some]]
    for begin, size in zip(starts_[~few].tolist(), sizes[~few].tolist(), strict=True):
        unit = raw[begin : begin + size] / length[begin : begin + size, None]
        for a in range(0, size, 256):
            # a product finds what may be a link; those near the limit are computed pair by pair, the same in any task
            share = unit[a : a + 256] @ unit.T
            p, q = np.nonzero(share >= COSINE - 1e-9)
            sure = share[p, q] >= COSINE + 1e-9
            p, q = begin + a + p, begin + q
            sure &= p < q
            near = ~sure & (p < q)
            sure[near] = np.einsum("ij,ij->i", raw[p[near]], raw[q[near]]) / (length[p[near]] * length[q[near]]) >= COSINE
            i.append(p[sure])
            j.append(q[sure])
    p, q = np.concatenate(i), np.concatenate(j)
    asked = ((own[p] == ci[p]) & (own[q] == cj[p])) | ((own[q] == ci[p]) & (own[p] == cj[p]))
    asked &= (np.minimum(sub[p], sub[q]) == a_[p]) & (np.maximum(sub[p], sub[q]) == b_[p])
    p, q = p[asked], q[asked]
    home = cells(x[:, slice(*parts[block])], math.sqrt(budget(dim, parts[block])), grid)
    meet = packed(np.minimum(home[p], home[q])) == cell[p]
    p, q = p[meet], q[meet]

    def beyond(part: tuple[int, int]) -> np.ndarray:
        d = np.zeros(len(p))
        for k in range(*part):
            d += (x[p, k] - x[q, k]) ** 2
        return d > budget(dim, part)

    counts = ~beyond(parts[block])
    p, q = p[counts], q[counts]
    for earlier in parts[:block]:
        later = beyond(earlier)
        p, q = p[later], q[later]
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    edges = stars(reps, local_components(len(reps), p, q))
    some = np.flatnonzero(links)
    none = pa.nulls(len(some), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(reps[some]), none, pa.array(links[some])], names=["a", "b", "links"])
    yield pa.RecordBatch.from_arrays([edges.column(0), edges.column(1), pa.nulls(len(edges), pa.int64())], names=["a", "b", "links"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null, they have the same number of
    dimensions and their cosine in double precision is COSINE at least. Null, empty and zero vectors
    and those with null or non-finite components have no link and are their own component. Equal
    vectors of a label are one node with a count; rows that share a vec_id count as several vectors.
    A null vec_id has no link, a null component and is kept. Only the three columns are read, whatever
    others are called; an empty table gives an empty one. Cells larger than a chunk are divided into
    chunks that meet in pairs.
    """
    work = Workspace(vectors.sparkSession, "near-vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = own.where(sound)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = work.keep(classes.withColumn("dim", F.size("embedding")), "classes")
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("reps"), F.sum("n").alias("rows")).agg(F.max("reps"), F.sum("rows"), F.max_by("dim", "reps")).first()
    most, total, dim = counts[0] or 0, counts[1] or 0, counts[2] or 1
    grid = choose_grid(most, dim)

    at = ["part", "label", "cell"]
    placed = _placed(classes, grid)
    large = work.keep(_crowds(classes, grid).where(F.col("n") > CHUNK), "large")
    met = chunked(join_small(placed, large, at, large.count(), "left").fillna(1, ["n"]), "rep", CHUNK)
    near = by_runs(met, [*at, "ci", "cj"], _in_range, "part bigint, cell bigint, ci int, cj int, own int, rep bigint, grp bigint, sub int, a int, b int")
    near = near.hint("merge").join(classes.select("rep", "n", "embedding"), "rep")
    found = work.keep(by_runs(near, ["part", "cell", "ci", "cj", "grp", "a", "b"], _linked(grid), "a bigint, b bigint, links bigint"), "found")

    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(work, found.where("links is null").select("a", "b")).withColumnRenamed("id", "rep")
    named = classes.join(links, "rep", "left").join(roots, "rep", "left")
    named = named.select("label", "embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    named = work.keep(named, "named")
    work.only("named")
    joined = attach(good, named, ["label", "embedding"], total).select("vec_id", "n_links", "component_id")
    alone = own.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
