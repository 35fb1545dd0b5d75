"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

A test item is the set of its shingles of five words. Items are partitioned by the size of that set
(1, 2 to 3, 4 to 7, ...), and each partition has its own sketch size: an item of q shingles contained
by CONTAINMENT in a document lacks at most (1 - CONTAINMENT) q of them there, so the q-th part plus
one smallest MinHash values of the item - as many as the partition's largest q asks for - include one
that the document has. Unlike a symmetric Jaccard search this doesn't weaken as documents get longer:
a whole document is only probed with its shingles' hashes, and an item is a candidate if one of its
sketch is met. Candidates are verified by exact containment of the item's shingles in the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, released
from .shingles import bytes_of, counted, mix, shingle_hashes, slices

CONTAINMENT = 0.8
#: Items and bytes of their texts that are searched for in one pass over the documents; more take further passes.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 32 << 20


@dataclass
class Index:
    """The items of one block: their shingle sets, and the sketches' values with the items that have them."""

    ids: list[int | None]
    at: np.ndarray
    shingles: np.ndarray
    sketch: np.ndarray
    owner: np.ndarray


def build_index(ids: list[int | None], texts: list[str]) -> Index:
    row, shingle, _ = counted(*shingle_hashes(*bytes_of(pa.array(texts, pa.string()))))
    sizes = np.bincount(row, minlength=len(ids))
    at = np.concatenate(([0], np.cumsum(sizes)))
    values, owners = [], []
    for part in range(int(sizes.max(initial=0)).bit_length()):
        most = (1 << (part + 1)) - 1
        length = math.floor((1 - CONTAINMENT) * most + 1e-9) + 1
        for i in np.flatnonzero((sizes > most >> 1) & (sizes <= most)):
            own = shingle[at[i] : at[i + 1]]
            values.append(own[np.argsort(mix(own))[:length]])
            owners.append(np.full(len(values[-1]), i))
    sketch = np.concatenate(values) if values else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(sketch, kind="stable")
    return Index(list(ids), at, shingle, sketch[order], owner[order])


def search(index: Index, texts: pa.Array) -> Iterator[list[dict]]:
    """For each text the items that it contains, by item_id (null first)."""
    values = np.unique(index.sketch)
    for begin, end, raw, at in slices(texts):
        hashes, shingle_at = shingle_hashes(raw, at)
        out: list[list[dict]] = [[] for _ in range(end - begin)]
        if len(values) and len(hashes):
            place = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
            met = np.flatnonzero(values[place] == hashes)
            # places rise, so each document's are together
            doc = np.searchsorted(shingle_at, met, "right") - 1
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=False):
                d = int(doc[a])
                own = np.unique(hashes[shingle_at[d] : shingle_at[d + 1]])
                keys = np.unique(hashes[met[a:b]])
                items = {int(i) for k in keys for i in index.owner[np.searchsorted(index.sketch, k) : np.searchsorted(index.sketch, k, "right")]}
                for i in items:
                    item = index.shingles[index.at[i] : index.at[i + 1]]
                    spot = np.minimum(np.searchsorted(own, item), len(own) - 1)
                    share = float((own[spot] == item).mean())
                    if share >= CONTAINMENT - 1e-9:
                        out[d].append({"item_id": index.ids[i], "containment": share})
                out[d].sort(key=lambda x: (x["item_id"] is not None, x["item_id"] or 0))
        yield from out


def blocks(items: DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    """The ids and texts of items, at most BLOCK_ITEMS of them and about BLOCK_BYTES of text at a time."""
    ids, texts, size = [], [], 0
    rows = items.where("text is not null").select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text.encode())
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(text: Column | str, ids: list[int | None], texts: list[str], alone: bool = False) -> Column:
    """array<struct<item_id, containment>> of each whole text: the items of one block that it contains by CONTAINMENT.

    With alone the optimizer leaves the call where it stands: in filters over stages that aren't written in between, Spark
    left it among the expressions that it evaluates itself, and failed.
    """
    index = build_index(ids, texts)

    @F.arrow_udf("array<struct<item_id: bigint, containment: double>>")
    def contained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in released(batches):
            yield pa.array(list(search(index, part)), pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())])))

    return (contained.asNondeterministic() if alone else contained)(text)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, containment: a row for each document row and item (item_id, text) that it contains.

    The items are fixed test sets. They are searched for in blocks of counted rows and bytes; each
    block is a pass over the documents of its own, so a task is sent one block however many there are.
    Items or documents of one to four words have one shingle of them all; null texts and texts without
    words contain nothing and are contained nowhere. Items that share an id are each looked for, and a
    null item_id stays null. Repeated rows and ties give a row each; other columns aren't read, and
    either table may be empty.
    """
    own, found = docs.select("doc_id", "text"), None
    for ids, texts in blocks(items):
        rows = own.select("doc_id", F.explode(leaks("text", ids, texts)).alias("x")).select("doc_id", "x.item_id", "x.containment")
        found = rows if found is None else found.unionByName(rows)
    return own.limit(0).select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("double").alias("containment")) if found is None else found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all columns of docs. Further blocks of items pass over what the blocks before have left."""
    mark, work = "__leaks", None
    for k, (ids, texts) in enumerate(blocks(items)):
        if k:
            work = work or Workspace(docs.sparkSession, "clean")
            docs = work.keep(docs, f"block-{k}")
            work.only(f"block-{k}")
        docs = docs.withColumn(mark, leaks("text", ids, texts, alone=True)).where(F.size(mark) == 0).drop(mark)
    return docs
