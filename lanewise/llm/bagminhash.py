"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap (operator 7).

A document is the multiset of its shingles of five words. Each shingle is given a Poisson process of
points (time, weight level, register) that follows from its hash alone; a document with w copies of
the shingle sees the points of levels below w, and register i of its signature is the earliest time
of a seen point in i. Two documents agree in a register with the probability of their weighted
Jaccard similarity, sum of minima / sum of maxima. The levels 0 to 1, 1 to 2, 2 to 4, 4 to 8, ... each
have a process; one over several levels is halved only as far as its earliest time is below what the
signature still needs, so a weight of w costs about log w and most points are never made.

Documents that share one of BANDS bands of ROWS registers and agree in enough registers form candidate
groups, and within these the exact overlap decides. At similarity 0.8 a pair misses all bands with
probability (1 - 0.8**4)**24 = 3e-6, and fewer than one in 1e8 falls below the agreement floor.

Large buckets and groups are taken in two rounds. First every member meets the group's leader, chunk
by chunk, which joins copies of one text in time that grows with their number. What is left over then
meets all members, so that no link is lost. Where very many are left over they may meet by blocks of
registers instead, one more than a pair at the agreement floor can differ in: every such pair has a
block in common, so both ways give the same links, and the one of less work is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .forced_bpe import ragged
from .shared import Workspace, attach, by_run, chunks_of, join_small, released
from .shingles import counted, mix, shingle_hashes, slices

ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
SIMILARITY = 0.8
#: Candidates agree in this share of registers (of a byte each) at least: six deviations below SIMILARITY.
FLOOR = 0.55
#: Documents of a chunk of a bucket or of a candidate group, and bytes of text of a chunk of a group; two chunks meet in a task.
BUCKET_CHUNK, GROUP_CHUNK, CHUNK_BYTES = 2048, 512, 4 << 20
#: Left-over members beyond so many of a bucket may meet by blocks of registers; a pair that agrees in FLOOR of them has one of these in common.
DEEP_BUCKET = 4096
BLOCKS = REGISTERS - math.ceil(FLOOR * REGISTERS) + 1
#: The work of a run of its own, in pairs of signatures: about 0.9 ms at 33 million pairs a second.
RUN_PAIRS = 30_000
_U = np.uint64


def _draw(elem: np.ndarray, lo: np.ndarray, size: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each node (element, interval lo to lo + size) and turn."""
    node = lo.astype(_U) * _U(0xA0761D6478BD642F) ^ size.astype(_U) * _U(0xE7037ED1A0B428DB) ^ turn.astype(_U) * _U(0x8EBC6AF09C88C6E3)
    return mix(elem ^ mix(node))


def _wait(bits: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """An exponential waiting time from the upper 53 bits."""
    return -np.log(((bits >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / rate


def signatures(row: np.ndarray, elem: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The earliest times (rows x registers) of multisets given as (row, element, weight); infinite for a row without elements."""
    sig = np.full(rows * registers, np.inf)
    need = np.full(rows, np.inf)
    if not len(row):
        return sig.reshape(rows, registers)
    parts, lo = [(row, elem, weight, np.zeros(len(row), np.int64), np.ones(len(row), np.int64))], 1
    while (some := weight > lo).any():
        parts.append((row[some], elem[some], weight[some], np.full(int(some.sum()), lo), np.full(int(some.sum()), lo)))
        lo *= 2
    r, e, w, lo, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    turn = np.zeros(len(r), np.int64)
    time = _wait(_draw(e, lo, size, turn), size)
    while True:
        live = (time < need[r]) & (lo < w)
        if not live.any():
            return sig.reshape(rows, registers)
        r, e, w, lo, size, turn, time = (x[live] for x in (r, e, w, lo, size, turn, time))
        leaf = size == 1
        bits = _draw(e, lo, size, turn + 1)
        place = ((bits & _U(0xFFFFFFFF)).astype(np.int64) * registers) >> 32
        np.minimum.at(sig, r[leaf] * registers + place[leaf], time[leaf])
        seen = np.unique(r[leaf])
        need[seen] = sig.reshape(rows, registers)[seen].max(axis=1)
        after = time + _wait(mix(bits), np.where(leaf, 1, size // 2))
        # a leaf goes on to its next point; a wider interval gives its earliest point to one half, and the other half waits on
        if leaf.all():
            turn, time = turn + 1, after
            continue
        half = np.where(leaf, 1, size // 2)
        right = ~leaf & ((bits >> _U(40)) & _U(1)).astype(bool)
        first = (r, e, w, lo + np.where(right, half, 0), half, np.where(leaf, turn + 1, 0), np.where(leaf, after, time))
        wide = ~leaf
        other = (r[wide], e[wide], w[wide], (lo + np.where(right, 0, half))[wide], half[wide], np.zeros(int(wide.sum()), np.int64), after[wide])
        r, e, w, lo, size, turn, time = (np.concatenate(x) for x in zip(first, other, strict=True))


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A key for each row and band."""
    bits = mix(sig.view(np.uint64)).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (len(sig), BANDS))
    for j in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) ^ bits[:, :, j])
    return key.view(np.int64)


def _node(text: Column) -> Column:
    """The number of a text: the first 64 bits of its md5."""
    bits = F.md5(text)
    high, low = (F.conv(F.substring(bits, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the text), bytes of the text, sig (a byte of each register), bands of the documents that have a word."""
    schema = "doc_id bigint, node bigint, bytes bigint, sig binary, bands array<bigint>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for begin, end, raw, at in slices(batch.column(2)):
                hashes, shingle_at = shingle_hashes(raw, at)
                row, elem, weight = counted(hashes, shingle_at)
                has = np.flatnonzero(np.diff(shingle_at))
                if not len(has):
                    continue
                sig = signatures(row, elem, weight, end - begin)[has]
                keys = bands_of(sig)
                low = (mix(sig.view(np.uint64)) & _U(255)).astype(np.uint8)
                pick = pa.array(begin + has)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        pa.array(np.diff(at)[has]),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "node", "bytes", "sig", "bands"],
                )

    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("bigint"), _node(F.col("text")).alias("node"), "text").mapInArrow(each, schema)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs (i, j)."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[i], up[j])
        then = up.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        then = then[then]
        if (then == up).all():
            return up
        up = then


def stars(ids: np.ndarray, up: np.ndarray) -> pa.RecordBatch:
    """An edge from every position to the smallest id of its component."""
    order = np.lexsort((ids, up))
    first = np.ones(len(order), bool)
    first[1:] = up[order][1:] != up[order][:-1]
    top = ids[order][first][np.cumsum(first) - 1]
    own = ids[order]
    return pa.RecordBatch.from_arrays([pa.array(own[own != top]), pa.array(top[own != top])], names=["a", "b"])


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of signatures as rows of REGISTERS bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _told(pairs: DataFrame) -> DataFrame:
    """pairs(key, node, n, b, x, y) without the signatures x and y, with same: whether these agree in FLOOR of their registers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_registers(batch.column(4)) == _registers(batch.column(5))).sum(axis=1) >= FLOOR * REGISTERS if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same)], names=["key", "node", "n", "b", "same"])

    return pairs.select("key", "node", "n", "b", "x", "y").mapInArrow(each, "key bigint, node bigint, n bigint, b bigint, same boolean")


def _agreeing(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that join the left-over documents of a bucket (side 0) with others of it (side 1) that agree in FLOOR of the registers."""
    ids, side, sig = table.column("node").to_numpy(), table.column("side").to_numpy(), _registers(table.column("sig"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    none = np.zeros(0, np.int64)
    pairs = [(none, none)]
    for a in range(0, len(left), 256):
        x = left[a : a + 256]
        agree = np.zeros((len(x), len(right)), np.uint8)
        for k in range(REGISTERS):
            agree += sig[x, k][:, None] == sig[right, k][None, :]
        p, q = np.nonzero(agree >= FLOOR * REGISTERS)
        pairs.append((x[p], right[q]))
    # a node may stand on either side, so its places are one
    place = np.unique(ids, return_inverse=True)[1]
    up = local_components(len(ids), place[np.concatenate([p[0] for p in pairs])], place[np.concatenate([p[1] for p in pairs])])
    first = np.unique(place, return_index=True)[1]
    yield stars(ids[first], up[: len(first)])


def _joined(table: pa.Table, up: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Pairs of places whose multisets overlap by SIMILARITY and that join left with right, and the components then; up has those before.

    Without right the places of left meet one another.

    Of two places that are joined already nothing is computed; of all others the exact overlap is,
    unless a first look at one document of a component joins the whole component. So there are fewer
    pairs than places.
    """
    row, elem, weight = (np.concatenate(x) for x in zip(*_bags(table.column("text")), strict=True))
    n = len(up)
    total = np.bincount(row, weights=weight, minlength=n)
    at = np.searchsorted(row, np.arange(n + 1))
    a, b = [], []

    def similar(c: int, some: np.ndarray) -> np.ndarray:
        mine, count = elem[at[c] : at[c + 1]], weight[at[c] : at[c + 1]]
        take = ragged(at[some], at[some + 1] - at[some])
        place = np.minimum(np.searchsorted(mine, elem[take]), len(mine) - 1)
        shared = np.where(mine[place] == elem[take], np.minimum(count[place], weight[take]), 0)
        overlap = np.bincount(row[take], weights=shared, minlength=n)[some]
        return some[overlap >= SIMILARITY * (total[some] + total[c] - overlap) - 1e-9]

    for k, c in enumerate(left):
        others = left[k + 1 :] if right is None else right
        some = others[(up[others] != up[c]) & (np.minimum(total[others], total[c]) >= SIMILARITY * np.maximum(total[others], total[c]) - 1e-9)]
        first = np.unique(up[some], return_index=True)[1]
        for tried in (some[first], np.delete(some, first)):
            tried = tried[up[tried] != up[c]]
            hit = similar(c, tried) if len(tried) else tried
            for h in hit[np.unique(up[hit], return_index=True)[1]]:
                a.append(int(c))
                b.append(int(h))
            if len(hit):
                joined = np.isin(up, np.append(up[hit], up[c]))
                up[joined] = up[joined].min()
    return a, b, up


def _bags(texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shingle, count) of the texts, a slice at a time."""
    yield np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    for begin, _, raw, at in slices(texts):
        row, elem, weight = counted(*shingle_hashes(raw, at))
        yield row + begin, elem, weight


def _edges(ids: np.ndarray, a: list[int], b: list[int], labels: np.ndarray | None = None, root: int = 0) -> pa.RecordBatch:
    """Rows (kind 0: a pair that was compared; kind 1: a node and the smallest node of its component, in the group root)."""
    kind = np.concatenate((np.zeros(len(a), np.int32), np.ones(0 if labels is None else len(ids), np.int32)))
    x = np.concatenate((ids[a], ids if labels is not None else ids[:0])).astype(np.int64)
    y = np.concatenate((ids[b], labels if labels is not None else ids[:0])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y), pa.array(np.full(len(x), root, np.int64))], names=["kind", "a", "b", "root"])


_EDGES = "kind int, a bigint, b bigint, root bigint"


def _in_chunk(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs that join the documents of a chunk and the group's leader, which is in each chunk, and the components that they make."""
    table = table.sort_by("node")
    ids, root = table.column("node").to_numpy(), table.column("root")[0].as_py()
    everyone = np.arange(len(ids))
    everyone = np.append(everyone[ids == root], everyone[ids != root])  # the leader first
    a, b, up = _joined(table, np.arange(len(ids)), everyone)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, up, ids)
    lead = up == up[everyone[0]] if ids[everyone[0]] == root else np.zeros(len(ids), bool)
    yield _edges(ids, a, b, np.where(lead, root, low[up]), root)


def _left_over(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs that join left-over documents (side 0) with others (side 1); label is the component that a document is in so far."""
    table = table.sort_by([("node", "ascending"), ("side", "ascending")])
    ids, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    up = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    a, b, _ = _joined(table, up.astype(np.int64), np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if a:
        yield _edges(ids, a, b)


def _against_all(rest: DataFrame, everyone: DataFrame, key: str, own: Column, chunks: Column, rest_chunks: Column) -> DataFrame:
    """Gives each left-over row (side 0) to the chunks of all rows of its key, and each row (side 1) to those of the left-over ones: rc, ac."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rest.withColumn("side", F.lit(0)).withColumn("rc", F.pmod(own, rest_chunks).cast("int")).withColumn("ac", upto(chunks))
    right = everyone.withColumn("side", F.lit(1)).withColumn("ac", F.pmod(own, chunks).cast("int")).withColumn("rc", upto(rest_chunks))
    return left.unionByName(right)


def _blocks(sig: Column) -> Column:
    """The bytes of each of BLOCKS runs of registers, with the run's number."""
    cuts = [k * REGISTERS // BLOCKS for k in range(BLOCKS + 1)]
    return F.array(*[F.struct(F.lit(k).alias("k"), F.substring(sig, a + 1, b - a).alias("part")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _blocked(keyed: DataFrame, reps: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """bucket, node, key: each member of the buckets(key, n) with a key for each of its blocks of registers."""
    members = attach(keyed, buckets.select("key", "n"), ["key"], total).join(reps.select("node", "sig"), "node")
    members = members.select(F.col("key").alias("bucket"), "node", F.explode(_blocks(F.col("sig"))).alias("x"))
    return members.select("bucket", "node", F.xxhash64("bucket", "x.k", "x.part").alias("key"))


def _less_by_blocks(blocked: DataFrame, large: DataFrame) -> DataFrame:
    """key, n of the large buckets of which it is less work to meet by blocks than that m left-over members meet all n; only the time follows from it."""
    n = F.col("n").cast("double")
    each = blocked.groupBy("bucket", "key").agg(F.count("*").alias("n")).where("n > 1")
    by_blocks = each.groupBy(F.col("bucket").alias("key")).agg(F.sum(F.when(n > 2, n * n + RUN_PAIRS).otherwise(n)).alias("work"))
    return large.join(by_blocks, "key", "left").where(F.coalesce("work", F.lit(0.0)) < F.col("m") * n).select("key", "n")


def _candidates(work: Workspace, reps: DataFrame, keyed: DataFrame, name: str, deep: bool = True) -> list[DataFrame]:
    """Tables of edges (a, b) that join the nodes of each bucket of keyed(node, key) that agree in enough registers."""
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("b"), F.max("node").alias("node")).where("n > 1")
    buckets = work.keep(buckets, f"{name}-buckets")
    rows, larger = buckets.agg(F.sum("n"), F.sum(F.when(F.col("n") > 2, F.col("n")))).first()
    if not rows:
        return []
    # every member beside the leader; a bucket of two is a pair
    members = buckets.where("n = 2").dropDuplicates(["node", "b"]).select("key", "n", "b", "node")
    if larger:
        others = attach(keyed, buckets.where("n > 2").select("key", "n", "b"), ["key"], larger).where("node <> b")
        members = members.unionByName(others.select("key", "n", "b", "node"))
    # a leader may have very many members, so leaders' signatures are joined as those of hot keys are
    members = work.keep(members, f"{name}-members")
    leaders = members.groupBy("b").agg(F.count("*").alias("m")).join(reps.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    leaders = work.keep(leaders, f"{name}-leaders")
    paired = attach(members, leaders, ["b"], members.count(), "m").join(reps.select("node", F.col("sig").alias("x")), "node")
    told = work.keep(_told(paired), f"{name}-told")
    found = [told.where("same").select(F.col("node").alias("a"), "b").distinct()]
    # the left-over ones beside all members
    rest = told.where("not same and n > 2")
    counts = rest.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("m"))
    counts = work.keep(counts, f"{name}-counts")
    size = counts.agg(F.sum("n"), F.max("m")).first()
    if not size[0]:
        return found
    if deep and size[1] > DEEP_BUCKET:
        # few of those that share a bucket by chance share a block of registers as well, but many of those with a common part of their texts do
        large = counts.where(F.col("m") > DEEP_BUCKET)
        blocks = work.keep(_less_by_blocks(_blocked(keyed, reps, large, size[0]), large), f"{name}-by-blocks")
        some = blocks.count()
        if some:
            again = work.keep(_blocked(keyed, reps, blocks, size[0]).select("node", "key"), f"{name}-deeper")
            found += _candidates(work, reps, again, f"{name}-deep", deep=False)
            counts = work.keep(join_small(counts, blocks.select("key"), ["key"], some, "left_anti"), f"{name}-direct")
    everyone = attach(keyed, counts.select("key", "n", "m"), ["key"], size[0])
    left = attach(rest.select("key", "node"), counts.select("key", "n", "m"), ["key"], size[0])
    met = _against_all(left, everyone, "key", F.xxhash64("node"), chunks_of(BUCKET_CHUNK), chunks_of(BUCKET_CHUNK, "m"))
    met = met.join(reps.select("node", "sig"), "node").select("key", "rc", "ac", "side", "node", "sig")
    return [*found, by_run(met, ["key", "rc", "ac"], _agreeing, "a bigint, b bigint")]


def _links(work: Workspace, docs: DataFrame, groups: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """(a, b) pairs of nodes of groups(id, root) whose multisets overlap by SIMILARITY: enough of them to join all that links reach.

    repeated says that some text stands in several rows of one id, of which one is taken.
    """
    sized = groups.withColumnRenamed("id", "node").join(texts.select("node", F.col("rep").alias("doc_id"), "bytes"), "node")
    sized = work.keep(sized, "sized")
    sizes = work.keep(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    chunks = chunks_of(GROUP_CHUNK, "n", "size", CHUNK_BYTES)
    placed = attach(sized, sizes.withColumn("chunks", chunks), ["root"], total)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # the leader is in every chunk
    placed = placed.withColumn("c", F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))))
    with_text = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), _node(F.col("text")).alias("node"), "text")

    def brought(to: DataFrame) -> DataFrame:
        """The text of each node of to, once, and each of the places that it goes to."""
        rows = join_small(with_text, to, ["doc_id", "node"], to.count())
        return (rows.dropDuplicates(["doc_id", "node"]) if repeated else rows).select("node", "text", F.explode("to").alias("to")).select("node", "text", "to.*")

    once = placed.groupBy("doc_id", "node").agg(F.collect_set(F.struct("root", "c")).alias("to"))
    once = work.keep(once, "once")
    found = work.keep(by_run(brought(once), ["root", "c"], _in_chunk, _EDGES), "in-chunk")
    # groups that are one component by now are done; of the others all that isn't with the leader meets all members
    labels = found.where("kind = 1").select("root", F.col("a").alias("node"), F.col("b").alias("label")).distinct()
    open_ = sizes.where(chunks > 1).join(labels.where("label <> root").groupBy("root").agg(F.count("*").alias("m")), "root").withColumn("chunks", chunks)
    open_ = work.keep(open_, "open")
    rows = open_.agg(F.sum("n")).first()[0] or 0
    pairs = found.where("kind = 0").select("a", "b")
    if not rows:
        return pairs
    members = attach(labels, open_.select("root", "n", "m", "chunks"), ["root"], rows)
    members = work.keep(members.join(texts.select("node", F.col("rep").alias("doc_id")), "node"), "members")
    met = _against_all(members.where("label <> root"), members, "root", F.xxhash64("node"), F.col("chunks"), F.least(F.col("m"), F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("chunks") / F.col("n")))).cast("int"))
    met = work.keep(met.groupBy("doc_id", "node").agg(F.collect_set(F.struct("root", "rc", "ac", "side", "label")).alias("to")), "met")
    more = by_run(brought(met), ["root", "rc", "ac"], _left_over, _EDGES)
    return pairs.unionByName(work.keep(more, "left-over").select("a", "b"))


def _classes(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, node, root (a node of the class), class_id, linked_to of each text with a word, once for each id that it has."""
    signed = work.keep(_signed(docs.select("doc_id", "text")), "signed")
    texts = work.keep(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("bytes").alias("bytes")), "texts")
    total = texts.agg(F.sum("n")).first()[0] or 0
    reps = signed.join(texts.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
    reps = work.keep(reps.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "reps")
    found = _candidates(work, reps, reps.select("node", F.explode("bands").alias("key")), "band")
    if not found:
        work.only("signed", "texts")
        named = texts.select("node", "n", F.col("node").alias("root"), F.col("rep").alias("class_id"), "rep", F.lit(None).cast("bigint").alias("partner"))
    else:
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        groups = work.keep(connected_components(work, edges, "candidates"), "groups")
        repeated = (reps.agg(F.max("copies")).first()[0] or 0) > 1
        work.only("signed", "texts", "groups")
        links = work.keep(_links(work, docs, groups, texts, repeated), "links")
        linked = work.keep(connected_components(work, links, "linked").withColumnRenamed("id", "node").join(texts.select("node", "rep"), "node"), "linked-reps")
        # a class has the smallest id of all its texts
        tops = work.keep(linked.groupBy("root").agg(F.min("rep").alias("top"), F.count("*").alias("n")), "tops")
        topped = attach(linked.select("node", "root"), tops, ["root"], tops.agg(F.sum("n")).first()[0] or 0).select("node", "root", "top")
        reps_of = linked.select(F.col("node").alias("b"), "rep")
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        partners = both.join(reps_of, "b").groupBy(F.col("a").alias("node")).agg(F.min("rep").alias("partner"))
        named = texts.join(topped, "node", "left").join(partners, "node", "left")
        named = named.select("node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("top", "rep").alias("class_id"), "rep", "partner")
    named = work.keep(named, "named")
    work.only("signed", "named")
    out = attach(signed.select("doc_id", "node"), named, ["node"], total)
    link = F.when(F.col("doc_id") != F.col("rep"), F.col("rep")).otherwise(F.col("partner"))
    return out.select("doc_id", "node", "root", "class_id", link.alias("linked_to")).distinct()


def near_duplicates(docs: DataFrame, with_links: bool = False) -> DataFrame:
    """doc_id, class_id: the smallest doc_id that links of similarity >= SIMILARITY reach, for each row of docs.

    Equal texts are one node. Texts with one to four words have one shingle of them all; null texts
    and texts without words link with nothing, equal ones included. Rows that share a doc_id are
    classed by their texts. Null ids give a null class. Texts of any length are taken whole: a task
    holds two chunks of about CHUNK_BYTES, or a single longer text each. Only doc_id and text are
    read, whatever other columns are called; an empty table gives an empty one.

    With with_links there is also linked_to: the smallest doc_id of an equal text, or else the smallest
    one among the texts that this text was compared with and joined to; null where it is alone.
    """
    known = _classes(docs, Workspace(docs.sparkSession, "near-duplicates")).drop("root")
    rows = docs.select(F.col("doc_id").cast("bigint"), _node(F.col("text")).alias("node"))
    out = rows.join(known.hint("merge"), ["doc_id", "node"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "linked_to")
    return out if with_links else out.drop("linked_to")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that are near duplicates of a document with a smaller id.

    Of rows that share a doc_id one stays for each class of their texts, and one of equal texts without a word.
    """
    work = Workspace(docs.sparkSession, "one-of-each")
    id_, node = "__doc_id", "__node"
    classes = work.keep(_classes(docs, work), "classes")
    work.only("classes")
    # of the texts that have their class's id, the one with the smallest node stays
    own = work.keep(classes.where("doc_id = class_id").groupBy("root").agg(F.min("node").alias("first"), F.count("*").alias("n")), "own")
    others = classes.where("doc_id = class_id").join(own.where("n > 1").select("root", "first"), "root").where("node <> first")
    gone = work.keep(classes.where("doc_id <> class_id").select("doc_id", "node").unionByName(others.select("doc_id", "node")), "gone")
    marked = docs.withColumn(id_, F.col("doc_id").cast("bigint")).withColumn(node, _node(F.col("text")))
    left = join_small(marked, gone.toDF(id_, node), [id_, node], gone.count(), "left_anti")
    repeated = work.keep(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias(id_)).count().where("count > 1").select(id_), "repeated")
    some = repeated.count()
    if some:
        alone = join_small(left, repeated, [id_], some, "left_anti")
        left = alone.unionByName(join_small(left, repeated, [id_], some, "left_semi").dropDuplicates([id_, node]))
    return left.select(*docs.columns)
