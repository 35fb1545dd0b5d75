"""Language identification with hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1 that follows from its code point. A run of three
letters (or word edges) is bound into one vector: the first permuted twice, the second once, and the
three multiplied. The bundle, or sum, of all n-gram vectors of a text is its profile; the bundle of
the unit profiles of a language's training texts is the language's prototype. A text has the language
whose prototype has the largest cosine to its profile; ties go to the first name.

Training takes a bounded sample (see ``training_ids``); every text is predicted whole. Null texts and
texts without a letter are ``und`` with score 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forced_bpe import text_slices
from .shared import released
from .shingles import mix

DIM = 1024
#: The sample: the BUCKETS classes of each language's documents give up to PER_BUCKET documents each.
BUCKETS, PER_BUCKET = 32, 12
#: n-gram vectors made at a time, and texts whose counts of them are held at a time.
GRAMS, ROWS = 2048, 640
UNKNOWN = "und"
_SCALE = 10_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same on every machine."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def _bundled(out: np.ndarray, row: np.ndarray, gram: np.ndarray, vectors: np.ndarray) -> None:
    """Adds the vectors of the grams to the rows of out: as a product of a table of counts where that is dense, gram by gram otherwise."""
    n = len(vectors)
    counts = np.bincount(row * n + gram, minlength=len(out) * n)
    pair = np.flatnonzero(counts)
    if len(pair) * 64 >= len(counts):
        out += counts.astype(np.float32).reshape(len(out), n) @ vectors
        return
    for a in range(0, len(pair), GRAMS):
        own, which = pair[a : a + GRAMS] // n, pair[a : a + GRAMS] % n
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[begin]] += np.add.reduceat(vectors[which] * counts[pair[a : a + GRAMS], None].astype(np.float32), begin)


def profiles(texts: list[str]) -> np.ndarray:
    """The profile of each text; a row of zeros for a text without letters. Sums are of whole numbers, so neighbours don't change them."""
    return np.concatenate([_profiles(texts[a : a + ROWS]) for a in range(0, len(texts), ROWS)]) if texts else np.zeros((0, DIM), np.float32)


def _profiles(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, padded)])[:-1]
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(points))))[keep]
    kinds, code = np.unique(np.where(letter, points, 32)[keep], return_inverse=True)
    if len(code) < 3:
        return out
    same = row[2:] == row[:-2]
    n = len(kinds)
    gram = ((code[:-2].astype(np.int64) * n + code[1:-1]) * n + code[2:])[same]
    row = row[2:][same]
    if n**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(gram, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[found] = np.arange(len(found))
        gram = place[gram]
    else:
        found, gram = np.unique(gram, return_inverse=True)
    base = letter_vectors(kinds)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for at in range(0, len(found), GRAMS):
        part = found[at : at + GRAMS]
        vectors = twice[part // (n * n)] * once[part // n % n] * base[part % n]
        mine = slice(None) if len(found) <= GRAMS else (gram >= at) & (gram < at + GRAMS)
        _bundled(out, row[mine], gram[mine] - at, vectors)
    has = np.add.reduceat(letter, starts) > 0
    out[~has] = 0
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_ids(docs: DataFrame) -> list[int]:
    """The ids of the training sample: of each language's and bucket's documents those with the smallest hashes.

    At most BUCKETS * PER_BUCKET ids for a language. Only ids and languages are read, and of those at
    most PER_BUCKET for each task, language and bucket are shuffled.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    order = Window.partitionBy("lang", "bucket").orderBy("h", "doc_id")
    return [r[0] for r in rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_BUCKET).select("doc_id").distinct().collect()]


def train(docs: DataFrame) -> dict[str, list[int]]:
    """The prototype of each language that the training sample of docs (doc_id, text, lang) has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in released(batches):
            langs, at = batch.column(1).to_pylist(), 0
            for rows in text_slices(batch.column(0)):
                vectors = np.rint(unit(profiles(rows)) * _SCALE).astype(np.int64)  # whole numbers: any order gives the same sum
                for lang, v in zip(langs[at : at + len(rows)], vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
                at += len(rows)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v)], names=["lang", "at", "v"])

    ids = training_ids(docs)
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull()).select("text", "lang")
    found: dict[str, list[int]] = {}
    if ids:
        for r in rows.mapInArrow(each, "lang string, at int, v bigint").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect():
            found.setdefault(r["lang"], [0] * DIM)[r["at"]] = r["v"]
    return dict(sorted((k, v) for k, v in found.items() if any(v)))


def predict(text: Column | str, prototypes: dict[str, list[int]]) -> Column:
    """struct<lang_pred, score>: the language of each whole text and its cosine, 0 at least."""
    names = list(prototypes)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = unit(np.array([prototypes[k] for k in names]).reshape(-1, DIM))
        for texts in released(batches):
            langs: list[str] = []
            scores: list[float] = []
            for rows in text_slices(texts):
                mine = profiles(rows)
                some = mine.any(axis=1) & bool(names)
                cosines = unit(mine) @ models.T if names else np.zeros((len(rows), 1))
                best = cosines.argmax(axis=1)
                top = np.clip(cosines[np.arange(len(rows)), best], 0, 1)
                langs += [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                scores += np.where(some, np.round(top, 6), 0).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learns from docs itself."""
    own = docs.select("doc_id", "text", "lang")
    found = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text", train(own)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
