"""Near-duplicate lines by segment partition and banded edit distance (operator 9).

A line of l characters is split into EDITS + 1 segments of nearly equal length. If a line can be turned
into another one with EDITS edits, one of the other's segments stands unchanged in it, at a place that
follows from the lengths up to a few characters. So a line is indexed by its length and segments, and
probes the index of each length from its own down to EDITS less with the substrings that can match,
chosen so that segments left and right still allow the edits that remain. Lines that share a key are
verified by a bit-parallel edit distance over a band of 2 * EDITS + 1 diagonals, many pairs at a time:
the band of a pair is a byte, and a step takes one character of all pairs.

Lines of fewer than MIN_CHARS characters are too general to be near copies. Where short is asked for,
equal ones are a class as well, blank ones apart; no edit join is made of them.

A line is known by a 64-bit hash. A second hash shows where two lines share one, and these lines get
ids of their own, so equal lines are those of equal 128 bits.

Of a class - lines that links reach - the first occurrence by (doc_id, line) stays, all others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import local_components
from .components import connected_components
from .forced_bpe import text_slices
from .shared import Workspace, all_pairs, attach, by_runs, chunked, join_small, released
from .shingles import mix

EDITS = 2
#: Shorter lines are in no edit join: they are too general to be near copies.
MIN_CHARS = 20
#: Lines of a chunk of a key's group, and characters of a chunk; two chunks meet in a task.
CHUNK, CHUNK_CHARS = 1024, 2 << 20
#: Substrings of lines up to this length are hashed from sums along the line, those of longer lines one by one.
LONG = 1 << 16
#: Pairs and characters (with padding) that are compared at a time, places between two looks at which pairs are beyond EDITS, and
#: places that all pairs pass before those that are left take all theirs.
PAIRS, CELLS, LOOK, FIRST = 4096, 1 << 19, 16, 32
#: Groups up to this size give all their pairs at once; of larger ones so many lines at a time meet those they aren't joined with yet.
SMALL_GROUP, LEADERS = 64, 32
_U = np.uint64


def _powers(base: int) -> np.ndarray:
    steps = np.full(LONG + 1, base, _U)
    steps[0] = 1
    return np.cumprod(steps, dtype=_U)


_UP, _DOWN = _powers(0x9E3779B97F4A7C15), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_ids(lines: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each line, as columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<i8").reshape(-1, 2)


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that a line looks up; (0, segment, 0) is its own index entry.

    The shift is from the segment's place in the shorter line. Segment i (from 0) has i segments left
    of it and edits - i right, which bound the shift from the line's begin and from its end.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segment(length: np.ndarray, i: int, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of segment i of lines of a length; later segments are the longer ones."""
    parts = edits + 1
    size, longer = length // parts, length % parts
    short = parts - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def line_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all index entries and probes; equal keys mean equal segments at matching places, up to hash collisions."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.cumsum(size) - size
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(points)) - np.repeat(at, size)
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum(mix(points.astype(_U) + _U(1)) * _UP[np.minimum(place, LONG)], out=sums[1:])
    which, keys = [], []
    for less, i, shift in probes(edits):
        length = size - less
        begin, part = segment(length, i, edits)
        begin = begin + shift
        some = np.flatnonzero((length > edits) & (begin >= 0) & (begin + part <= size))
        a = at[some] + begin[some]
        text = (sums[a + part[some]] - sums[a]) * _DOWN[np.minimum(begin[some], LONG)]
        for k in np.flatnonzero(length[some] > LONG - edits):  # by the indexed line's length, so both sides do the same
            line, b = lines[some[k]], int(begin[some[k]])
            text[k] = xxhash.xxh3_64_intdigest(line[b : b + int(part[some[k]])].encode("utf-8", "surrogatepass"))
        which.append(some)
        keys.append(mix(text ^ mix(length[some].astype(_U) * _U(64) + _U(i))).view(np.int64))
    return np.concatenate(which), np.concatenate(keys)


def _padded(points: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """The ranges at + length of points as rows of a table of a width, filled up with zeros."""
    column = np.arange(width, dtype=np.int32)
    out = points[np.minimum(at.astype(np.int32)[:, None] + column, np.int32(len(points) - 1))]
    out *= column < length.astype(np.int32)[:, None]
    return out


def _same(points: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many places from x and y on, in steps, are the same, most at most; looks further only where all were so far."""
    done, open_, width = np.zeros(len(x), np.int64), np.flatnonzero(most > 0), 8
    while len(open_):
        place = done[open_, None] + np.arange(width)
        a, b = (points[np.clip(s[open_, None] + step * place, 0, len(points) - 1)] for s in (x, y))
        equal = (a == b) & (place < most[open_, None])
        run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        done[open_] += run
        open_, width = open_[run == width], min(4 * width, 128)
    return done


def near(points: np.ndarray, at: np.ndarray, length: np.ndarray, p: np.ndarray, q: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """For each pair of lines p and q whether their edit distance is edits at most.

    Lines are ranges of points (one more than code points, so never 0). Common ends are cut off. What is
    left passes the band: the first places of all pairs, and then all places of those still within it.
    """
    out = np.zeros(len(p), bool)
    close = np.flatnonzero(np.abs(length[p] - length[q]) <= edits)
    for begin in range(0, len(close), PAIRS):
        some = close[begin : begin + PAIRS]
        a_at, a_len, b_at, b_len = at[p[some]], length[p[some]], at[q[some]], length[q[some]]
        both = np.minimum(a_len, b_len)
        head = _same(points, a_at, b_at, both, 1)
        tail = _same(points, a_at + a_len - 1, b_at + b_len - 1, both - head, -1)
        a_at, b_at, m, n = a_at + head, b_at + head, a_len - head - tail, b_len - head - tail
        out[some] = np.maximum(m, n) <= edits
        left = np.flatnonzero(~out[some] & (m > 0) & (n > 0))
        if not len(left):
            continue
        wide = FIRST + 2 * edits + 1
        hit, left_over = banded(_padded(points, a_at[left], m[left], wide), m[left], _padded(points, b_at[left], n[left], FIRST), n[left], edits)
        out[some[left]] = hit
        left = left[left_over]
        left = left[np.argsort(np.maximum(m[left], n[left]), kind="stable")]
        while len(left):
            # lengths rise, so the last pair of a block is its widest
            many = len(left)
            while many > 1 and many * max(m[left[many - 1]], n[left[many - 1]]) > CELLS:
                many = -(-many // 2)
            block, left = left[:many], left[many:]
            width = int(max(m[block].max(), n[block].max()))
            out[some[block]] = banded(_padded(points, a_at[block], m[block], width), m[block], _padded(points, b_at[block], n[block], width), n[block], edits)[0]
    return out


def banded(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """Whether the edit distance of each pair of rows (of lengths m and n, 1 at least, that differ by edits at most) is edits at most, and the pairs of which that is open.

    The rows may be beginnings; a pair is open if it is within the band after all columns of b that there are.

    One byte a pair holds a band of 2 * edits + 1 diagonals of the distance matrix as vertical
    differences; all pairs take one column, a character of b, after the other. The score follows the
    band's lowest diagonal and then the last row. Pairs whose whole band is beyond edits are dropped.
    """
    width = 2 * edits + 1
    kind = np.uint8 if width <= 8 else np.uint16
    mask, top = kind((1 << width) - 1), kind(1 << (width - 1))
    out, who = np.zeros(len(m), bool), np.arange(len(m))
    # rows of a from -edits on, one place after the other, so that a column's band is consecutive
    rows = np.zeros((a.shape[1] + 4 * edits + 2, len(m)), a.dtype)
    rows[edits : edits + a.shape[1]] = a.T
    cols = np.ascontiguousarray(b.T)
    # bit k of the band in column j stands for row j - edits + k (rows from 1); rows before the first have no cost
    vp, vn = np.full(len(m), (int(mask) << edits) & int(mask), kind), np.zeros(len(m), kind)
    score = np.minimum(edits, m).astype(np.int64)
    for j in range(1, cols.shape[0] + 1):
        first = j - edits
        eq = np.zeros(len(who), kind)
        c = cols[j - 1]
        for k in range(width):
            eq |= (rows[first + k - 1 + edits] == c).astype(kind) << kind(k)
        d0 = ((((eq & vp) + vp) & mask) ^ vp) | eq | vn
        hp = vn | (~(d0 | vp) & mask)
        hn = d0 & vp
        live = n >= j
        low = first + width - 1 <= m
        bit = np.where(m >= first, kind(1) << np.clip(m - first, 0, width - 1).astype(kind), kind(0)).astype(kind)
        step = np.where(low, (d0 & top) == 0, ((hp & bit) != 0).astype(np.int64) - ((hn & bit) != 0))
        score += np.where(live, step, 0)
        vp = hn | (~((d0 >> kind(1)) | hp) & mask)
        vn = (d0 >> kind(1)) & hp
        if j % LOOK == 0 or j == cols.shape[0]:
            done = n <= j
            out[who[done]] = score[done] <= edits
            # the least value of the band, from its lowest row up; a band that is cut by the last row goes on
            value, least = score.copy(), score.copy()
            for k in range(width - 1, 0, -1):
                value = value - ((vp >> kind(k)) & kind(1)) + ((vn >> kind(k)) & kind(1)).astype(np.int64)
                least = np.minimum(least, value)
            keep = np.flatnonzero(~done & ((least <= edits) | ~low))
            if not len(keep) or j == cols.shape[0]:
                return out, who[keep]
            if len(keep) < len(who):
                who, m, n, score, vp, vn = (x[keep] for x in (who, m, n, score, vp, vn))
                rows, cols = rows[:, keep], cols[:, keep]
    return out, who


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance of a and b is edits at most."""
    points, at, length = _points([a, b])
    return bool(near(points, at, length, np.array([0]), np.array([1]), edits)[0])


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all lines plus one, and each line's begin and length."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    return np.append(points, np.uint32(0)), np.cumsum(length) - length, length


def _lines(docs: DataFrame, short: bool) -> DataFrame:
    """(doc_id, line, id, check) of each line that counts: those from MIN_CHARS on, and with short all others that are not blank."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids, at = batch.column(0).to_pylist(), 0
            for rows in text_slices(batch.column(1)):
                parts = [t.split("\n") for t in rows]
                lines = [x for p in parts for x in p]
                many = np.fromiter(map(len, parts), np.int64, len(parts))
                counts = np.fromiter((len(x) >= MIN_CHARS or (short and bool(x.strip())) for x in lines), bool, len(lines))
                place = np.arange(len(lines)) - np.repeat(np.cumsum(many) - many, many)
                own = np.repeat(np.array(ids[at : at + len(rows)], np.int64), many)
                at += len(rows)
                some = np.flatnonzero(counts)
                if len(some):
                    known = line_ids([lines[i] for i in some.tolist()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[some]), pa.array(place[some], pa.int32()), pa.array(known[:, 0]), pa.array(known[:, 1])], names=["doc_id", "line", "id", "check"]
                    )

    return docs.mapInArrow(each, "doc_id bigint, line int, id bigint, check bigint")


def _once(docs: DataFrame, schema: str, make) -> DataFrame:
    """make(two hashes, lines) -> RecordBatch, for the new lines of a slice; lines that a task has just met are passed over."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str | int] = set()
        for batch in released(batches):
            for rows in text_slices(batch.column(0)):
                if len(met) > 300_000:
                    met.clear()
                lines = list({x: None for t in rows for x in t.split("\n") if len(x) >= MIN_CHARS})
                if not lines:
                    continue
                known = line_ids(lines)
                both = [a ^ b for a, b in known.tolist()]
                new = [i for i, x in enumerate(both) if x not in met]
                met.update(both)
                if new:
                    yield make(known[new], [lines[i] for i in new])

    return docs.select("text").mapInArrow(each, schema)


def _keyed(known: np.ndarray, lines: list[str], fields: list[str]) -> pa.RecordBatch:
    which, keys = line_keys(lines)
    size = np.fromiter(map(len, lines), np.int32, len(lines))
    all_ = {"key": lambda: keys, "id": lambda: known[which, 0], "check": lambda: known[which, 1], "chars": lambda: size[which]}
    return pa.RecordBatch.from_arrays([pa.array(all_[f]()) for f in fields], names=fields)


def _named(known: np.ndarray, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(known[:, 0]), pa.array(known[:, 1]), pa.array(lines, pa.string())], names=["id", "check", "line"])


def _similar(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
    """Edges that join the lines of each key's group that are within EDITS, directly or over others.

    The pairs of all small groups are compared together. In a large one each line meets the later ones
    that it isn't joined with yet.
    """
    ids, own, ci, cj = (table.column(c).to_numpy() for c in ("id", "own", "ci", "cj"))
    points, at, length = _points(table.column("text").to_pylist())
    starts_ = np.array(starts, np.int64)
    sizes = np.diff(np.append(starts_, len(ids)))
    meets = lambda p, q: ((own[p] == ci[p]) & (own[q] == cj[p])) | ((own[q] == ci[p]) & (own[p] == cj[p]))
    few = sizes <= SMALL_GROUP
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    p, q = all_pairs(starts_[few], sizes[few])
    asked = meets(p, q)
    p, q = p[asked], q[asked]
    hit = near(points, at, length, p, q)
    a.append(p[hit])
    b.append(q[hit])
    for begin, size in zip(starts_[~few].tolist(), sizes[~few].tolist(), strict=True):
        order = begin + np.argsort(length[begin : begin + size], kind="stable")
        up = np.arange(size)
        at_most = np.searchsorted(length[order], length[order] + EDITS, "right")
        low = 0
        while low < size:
            # the first line alone, as it joins most of a group of copies
            high = min(size, low + (LEADERS if low else 1))
            many = at_most[low:high] - np.arange(low, high) - 1
            i = np.repeat(np.arange(low, high), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            asked = up[i] != up[j]
            i, j = i[asked], j[asked]
            asked = meets(order[i], order[j])
            i, j = i[asked], j[asked]
            hit = near(points, at, length, order[i], order[j])
            a.append(order[i[hit]])
            b.append(order[j[hit]])
            if hit.any():
                # joined with the components that there were before
                up = local_components(size, np.concatenate((np.arange(size), i[hit])), np.concatenate((up, j[hit])))
            low = high
    a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _apart(rows: DataFrame, clashes: DataFrame | None, many: int) -> DataFrame:
    """rows(id, check, ...) without check; lines that share an id with others get ids of their own."""
    if clashes is None:
        return rows.drop("check")
    marked = join_small(rows, clashes.withColumn("_clash", F.lit(True)), ["id"], many, "left")
    return marked.withColumn("id", F.when(F.col("_clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("check", "_clash")


def repeated_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, gone: the places (from 0) of the lines of each document that go; documents without any are left out.

    Lines are what stands between line feeds, and count from MIN_CHARS characters on; with short those
    below count as well if they aren't blank, but only as copies of equal lines. Equal lines are one
    node. Rows that share a doc_id are one document, whose lines of equal place occur together; rows
    with a null doc_id or text have no lines. Lines of any length are taken whole; an empty table gives
    an empty one.
    """
    work = Workspace(docs.sparkSession, "lines")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    parsed = work.keep(_lines(own, short), "parsed")
    by_id = parsed.groupBy("id").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    lines = work.keep(by_id, "lines")
    total, many = lines.agg(F.sum("n"), F.count_if(F.col("low") != F.col("high"))).first()
    total, clashes, occurrences = total or 0, None, parsed
    if many:
        clashes = work.keep(lines.where("low <> high").select("id"), "clashes")
        occurrences = work.keep(_apart(parsed, clashes, many), "occurrences")
        lines = work.keep(occurrences.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")), "lines-apart")

    def keyed(*more: str) -> DataFrame:
        fields = ["key", "id", *(["check"] if many else []), *more]
        kinds = ", ".join(f"{f} {'int' if f == 'chars' else 'bigint'}" for f in fields)
        return _apart(_once(own, kinds, lambda known, lines: _keyed(known, lines, fields)), clashes, many)

    shared = keyed("chars").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.max("chars").alias("chars"))
    shared = work.keep(shared.where("low <> high").select("key", "n", (F.col("n") * F.col("chars")).alias("size")), "shared")
    keys, rows = shared.agg(F.count("*"), F.sum("n")).first()
    members = join_small(keyed(), shared, ["key"], keys) if keys <= 1_000_000 else attach(keyed(), shared, ["key"], rows or 0)
    members = work.keep(members.distinct(), "members")
    wanted = work.keep(members.select("id").distinct(), "wanted")
    named = _apart(_once(own, "id bigint, check bigint, line string", _named), clashes, many)
    texts = work.keep(join_small(named, wanted, ["id"], wanted.count()).groupBy("id").agg(F.min("line").alias("text")), "texts")
    groups = chunked(members, "id", CHUNK, "n", "size", CHUNK_CHARS).join(texts, "id")
    links = by_runs(groups.select("key", "ci", "cj", "own", "id", "text"), ["key", "ci", "cj"], _similar, "a bigint, b bigint")
    classes = connected_components(work, links)

    rooted = work.keep(lines.join(classes, "id", "left").select("id", "first", "n", F.coalesce("root", "id").alias("root")), "rooted")
    merged = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("lines"), F.count("*").alias("n")).where("lines > 1")
    merged = work.keep(merged, "merged")
    kept = work.keep(attach(rooted.select("id", "root", F.col("n").alias("copies")), merged, ["root"], merged.agg(F.sum("n")).first()[0] or 0).select("id", "keep", F.col("copies").alias("n")), "kept")
    found = attach(occurrences, kept, ["id"], total).where(F.struct("doc_id", "line") != F.col("keep"))
    gone = work.keep(found.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    work.only("gone")
    return gone


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in gone, in time that grows with the number of lines."""

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n", -1)), left), 0))


def deduplicate(docs: DataFrame, keep_empty: bool = True, short: bool = False) -> DataFrame:
    """docs with their repeated lines taken out of text, and n_chars, if there, made to match; other columns as they are.

    Texts without a repeated line stay as they are, null ones too. With keep_empty=False the rows of
    which nothing but white space is left go, as every line of theirs stands in another document.
    """
    mark, key = "__gone", "__doc_id"
    found = repeated_lines(docs, short).select(F.col("doc_id").alias(key), F.col("gone").alias(mark))
    joined = docs.join(found.hint("merge"), docs["doc_id"].cast("bigint") == found[key], "left").withColumn("text", without(F.col("text"), F.col(mark)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        joined = joined.withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    if not keep_empty:
        joined = joined.where(F.col(mark).isNull() | F.col("text").rlike(r"\S"))
    return joined.select(*docs.columns)


def line_digest(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_gone, gone, text_sha256 (of the text that is left) for each row of docs; a null text has no lines and a null digest."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = own.join(repeated_lines(own, short).hint("merge"), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("bigint").alias("n_gone"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
        F.sha2(without(F.col("text"), F.col("gone")), 256).alias("text_sha256"),
    )
