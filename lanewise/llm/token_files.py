"""Token-id files in patched frame-of-reference blocks (operator 2).

A file holds the ids of consecutive documents as one sequence in blocks of BLOCK ids. A block stores
its minimum and, for each id, the difference to it in as many bits as the chosen percentile of the
block's differences needs; larger differences keep their low bits there and put the rest into the
block's exception list. The block starts form the index, which with the document table stands at the
end of the file:

    "PFOR1\\n" | block ... | block starts (u8 each) | doc_id, ids (i8, i8 each) | blocks, docs, ids, BLOCK (i8 each) | "PFOR1\\n"
    a null doc_id has 0 there, and its number of ids n stands as -1 - n
    block: minimum u4 | exceptions u2 | width u1 | 0 u1 | packed words u8 ... | places u2 ... | high parts u4 ...

All numbers are little-endian. Files are made under temporary names and renamed; the manifest with
each file's counts is written last.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forced_bpe import HOLD_BYTES, forced_boundary, text_slices
from .shared import Workspace, open_fs

BLOCK = 1024
PERCENTILE = 95
MAGIC = b"PFOR1\n"
#: Blocks unpacked at a time.
READ_BLOCKS = 512


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of 64-bit words."""
    lanes = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    words = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        words[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return words.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack."""
    words = words.reshape(len(words), BLOCK // 64, width)
    out, mask = np.zeros((len(words), BLOCK // 64, 64), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        lane = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, j] = lane & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One byte string for each full block of ids (a multiple of BLOCK of them)."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint64)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    place = -(-BLOCK * PERCENTILE // 100) - 1
    chosen = np.partition(rest, place, axis=1)[:, place]
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        high = rest[which] >> np.uint64(width)
        words = pack(rest[which] & np.uint64((1 << int(width)) - 1), int(width)).astype("<u8")
        for i, k in enumerate(which):
            odd = np.flatnonzero(high[i])
            head = int(low[k]).to_bytes(4, "little") + len(odd).to_bytes(2, "little") + bytes([int(width), 0])
            out[k] = head + words[i].tobytes() + odd.astype("<u2").tobytes() + high[i][odd].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts in data."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(starts), BLOCK), np.uint64)
    widths = raw[starts + 6]
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        size = BLOCK // 8 * int(width)
        words = raw[starts[which][:, None] + 8 + np.arange(size)].copy().view("<u8") if size else np.zeros((len(which), 0), np.uint64)
        out[which] = unpack(words, int(width))
    for k, at in enumerate(starts.tolist()):
        low, odd, width = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 6], "little"), data[at + 6]
        at += 8 + BLOCK // 8 * width
        if odd:
            places = np.frombuffer(data, "<u2", odd, at)
            out[k, places] += np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(width)
        out[k] += np.uint64(low)
    return out.reshape(-1).astype(np.uint32)


class TokenFileWriter:
    """Writes one file; holds a block's ids, the index and the document table."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.ids = len(MAGIC), [], [], 0
        self.open_ids = np.zeros(0, np.uint32)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        null = np.array([d is None for d in doc_ids], bool)
        sizes = np.where(null, -1 - sizes, sizes).astype(np.int64)
        self.docs.append(np.stack([np.array([d or 0 for d in doc_ids], np.int64), sizes], axis=1))
        self.ids += len(ids)
        ids = np.concatenate((self.open_ids, ids))
        full = len(ids) // BLOCK * BLOCK
        self._put(ids[:full])
        self.open_ids = ids[full:]

    def _put(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids) if len(ids) else []:
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def close(self) -> tuple[int, int]:
        """Documents and ids; the file has its name from here on. The last block is filled up with its last id."""
        if len(self.open_ids):
            self._put(np.pad(self.open_ids, (0, BLOCK - len(self.open_ids)), mode="edge"))
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 2), np.int64)
        tail = np.array(self.starts, "<u8").tobytes() + docs.astype("<i8").tobytes()
        self.out.write(tail + np.array([len(self.starts), len(docs), self.ids, BLOCK], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(docs), self.ids


def read_token_file(uri: str) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, last) in file order; a long document comes in several parts, the last of them marked."""
    fs, path = open_fs(uri)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        end = f.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if end[32:] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        blocks, docs, _, block = np.frombuffer(end[:32], "<i8").tolist()
        if block != BLOCK:
            raise ValueError(f"{path} has blocks of {block} ids")
        tail = size - 32 - len(MAGIC) - 16 * docs - 8 * blocks
        starts = np.append(np.frombuffer(f.read_at(8 * blocks, tail), "<u8").astype(np.int64), tail)
        table = np.frombuffer(f.read_at(16 * docs, tail + 8 * blocks), "<i8").reshape(-1, 2)
        have, block = np.zeros(0, np.uint32), 0
        for doc_id, left in table.tolist():
            if left < 0:
                doc_id, left = None, -1 - left
            while True:
                part, have = have[:left], have[left:]
                left -= len(part)
                yield doc_id, part, not left
                if not left:
                    break
                to = min(block + READ_BLOCKS, blocks)
                have = decode_blocks(f.read_at(int(starts[to] - starts[block]), int(starts[block])), starts[block:to] - starts[block])
                block = to


def write_token_files(docs: DataFrame, path: str, to: str, end_id: int) -> list[dict]:
    """Writes the ids of docs (doc_id, text) below the shared folder to, in ascending doc_id order over its files; returns the manifest.

    The rows are range-partitioned by doc_id (and the text's hash, so that a repeated doc_id is
    divided, too), encoded where they arrive
    (fragments between certain cuts by the tokenizers library's own model) and written at once: ids
    are never shuffled. Null texts
    have the end id alone; a null doc_id stands before all others and stays null.
    Rows of equal doc_id stand in the order of their texts' hashes. A file that an attempt leaves
    unfinished keeps a temporary name and is in no manifest.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out = f"{to}/part-{TaskContext.get().partitionId():06d}.pfor", None
        coder, ending = forced_boundary(path), np.array([end_id], np.uint32)
        for batch in coder.until_end(batches, HOLD_BYTES):
            at, doc_ids = 0, batch.column(0).to_pylist()
            for rows in text_slices(batch.column(1)):
                out = out or TokenFileWriter(name)
                ids, ends = coder.encode(rows)
                out.add(doc_ids[at : at + len(rows)], np.insert(ids, ends[1:], ending[0]), np.diff(ends) + 1)
                at += len(rows)
        if out:
            n, ids = out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [n], "ids": [ids]}, schema=pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest, start = [], 0
    for r in sorted(ordered.mapInArrow(each, "file string, docs bigint, ids bigint").collect()):
        manifest.append({"file": r["file"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    fs, folder = open_fs(to)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.tmp") as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{folder}/manifest.tmp", f"{folder}/manifest.json")
    return manifest


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files that the manifest at lists."""
    fs, folder = open_fs(at)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        files = json.loads(f.read())
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n, crc = [], 0, 0
                for doc_id, part, last in read_token_file(file):
                    n, crc = n + len(part), zlib.crc32(part.astype("<u4").tobytes(), crc)
                    if last:
                        rows.append((doc_id, start, n, crc))
                        start, n, crc = start + n, 0, 0
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=names)

    listed = spark.createDataFrame([(f["file"], f["start"]) for f in files], "file string, start bigint")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(each, ", ".join(f"{n} bigint" for n in names))


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes docs and reads them back: a row of digests per document."""
    to = Workspace(spark, "token-files").path
    write_token_files(docs, path, to, end_id)
    return read_token_files(spark, to)
