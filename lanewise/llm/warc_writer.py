"""Deterministic sharded WARC files (operator 8).

Records are divided into shards of consecutive page_ids by running sums of payload bytes, sorted by
page_id, and written to gzip-per-record files that roll at FILE_BYTES of compressed size. Headers,
record ids and digests are made anew from the row alone, and the shards follow from the rows alone,
so the same table gives the same files byte for byte, in any cluster. Files get their names when they
are complete, and the manifest that lists them is renamed into place last; what a lost executor leaves
has a temporary name and is listed nowhere.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, attach, open_fs, released

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: A shard is a task and aims at 1 / SHARDS of all payload bytes, but no less than the first and no more than the second of
#: SHARD_BYTES (several files), unless there would be more than MAX_SHARDS.
SHARD_BYTES, SHARDS, MAX_SHARDS = (4 << 20, 512 << 20), 64, 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of an uncompressed WARC record; a revisit has the HTTP header alone, with the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {_base32(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class WarcFiles:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, to: str, shard: int):
        self.to, self.shard, self.part, self.out, self.done = to, shard, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.uri = f"{self.to}/shard-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.fs, self.path = open_fs(self.uri)
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.rows = self.fs.open_output_stream(self.temp, compression=None), 0, 0
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = press.compress(data) + press.flush()
        self.out.write(packed)
        self.size, self.rows = self.size + len(packed), self.rows + 1
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, self.path)
            self.done.append((self.uri, self.rows, self.size))
            self.out, self.part = None, self.part + 1


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; holds one record at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        left, press, parts = b"", zlib.decompressobj(31), []
        while True:
            data = left or f.read(1 << 20)
            left = b""
            if not data:
                return
            parts.append(press.decompress(data))
            if press.eof:
                left, whole = press.unused_data, b"".join(parts)
                press, parts = zlib.decompressobj(31), []
                head, _, rest = whole.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield fields, rest[: int(fields["Content-Length"])]


def shard_cuts(work: Workspace, sizes: DataFrame) -> list[int]:
    """The first page_id of each shard but the first, from sizes(page_id, digest, bytes); one number a shard comes to the driver.

    Sums of bytes run along the rows in the order of page_id and digest: within parts of a range
    partitioning that is written once, from the sum of the parts before. The cuts follow from the rows
    alone, wherever the parts begin.
    """
    rows = sizes.where("page_id is not null")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    least, most = SHARD_BYTES
    target = max(least, min(most, total // SHARDS), total // MAX_SHARDS)
    if total <= target:
        return []
    ordered = work.keep(rows.repartitionByRange("page_id", "digest").select("page_id", "digest", "bytes", F.spark_partition_id().alias("part")), "ordered")
    parts = ordered.groupBy("part").agg(F.sum("bytes").alias("own")).withColumn("before", F.sum("own").over(Window.orderBy("part")) - F.col("own")).select("part", "before")
    along = Window.partitionBy("part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ordered.withColumn("upto", F.sum("bytes").over(along)).join(F.broadcast(parts), "part")
    shard = F.floor((F.col("before") + F.col("upto") - F.col("bytes")) / F.lit(target))
    firsts = summed.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("first")).where("shard > 0")
    return sorted({r["first"] for r in firsts.select("first").collect()})


def write_warc(pages: DataFrame, to: str) -> list[dict]:
    """Writes a record for each row of pages (page_id, url, html) below the shared folder to; returns the manifest.

    Of the rows with an equal payload of REVISIT_BYTES at least, those with the largest page_id are
    responses and the others revisits of it; smaller payloads are always responses. Html of any length is
    one record; an empty table gives a manifest without files; other columns aren't read. Null html is an
    empty payload, a null url is about:blank, a null page_id stands first and is a response. Repeated
    rows give repeated records. Only the revisits' ids, not payloads, pass the join by payload; then
    they are sorted in among the pages, so each payload is shuffled once.
    """
    work = Workspace(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    narrow = work.keep(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("bigint").alias("bytes")), "narrow")
    large = narrow.where((F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = work.keep(large.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "groups")
    revisits = attach(large, groups, ["digest"], groups.agg(F.sum("n")).first()[0] or 0).where("page_id < top").select("page_id", "digest", "top").distinct()
    cuts = np.array(shard_cuts(work, narrow), np.int64)

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, np.asarray(ids.fill_null(-(1 << 63))), "right").astype(np.int32))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: WarcFiles | None = None
        done, known, top = [], None, None
        for batch in released(batches):
            for shard, page_id, digest, kind, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files is None or files.shard != shard:
                    if files:
                        files.close()
                        done += files.done
                    files = WarcFiles(to, shard)
                if kind == 0:
                    known, top = (page_id, digest), refers_to
                    continue
                files.add(record(page_id, url, html.encode(), digest, top if known == (page_id, digest) else None))
        if files:
            files.close()
            done += files.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "bytes"])

    page = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("top"))
    mark = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "top")
    placed = page.unionByName(mark).withColumn("shard", shard_of("page_id"))
    order = ["shard", "page_id", "digest", "kind", "url", "html", "top"]
    placed = placed.select(*order).repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = [r.asDict() for r in sorted(placed.mapInArrow(each, "file string, records bigint, bytes bigint").collect())]
    work.drop()
    fs, folder = open_fs(to)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.tmp") as f:
        f.write(json.dumps([m | {"file": os.path.basename(m["file"])} for m in manifest], indent=1).encode())
    fs.move(f"{folder}/manifest.tmp", f"{folder}/manifest.json")
    return manifest


def read_warc(spark: SparkSession, at: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the files that the manifest lists; responses' digests are computed anew."""
    fs, folder = open_fs(at)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        files = [f"{at}/{m['file']}" for m in json.loads(f.read())]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for fields, block in read_records(uri):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"a record of {uri} doesn't match its digest")
                    page, top = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                    rows.append({"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(top) if top else None})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(each, schema)


def warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages and reads the archives back."""
    to = Workspace(spark, "archives").path
    write_warc(pages, to)
    return read_warc(spark, to)
