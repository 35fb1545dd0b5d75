import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from lanewise.llm import bagminhash, decontaminate, embedding_join, line_dedup, shingles
from lanewise.llm.components import connected_components
from lanewise.llm.shared import Forest, Workspace

WORDS = [f"w{i}" for i in range(3000)]


def bag(text):
    words = [w for w in re.split("[\t\n\x0b\f\r ]+", text or "") if w]
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def texts(seed=1, n=40):
    """Random texts, near copies of them at several distances, and odd ones."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 60, 200]))]
        out.append(" ".join(words))
        for share in (0.004, 0.01, 0.02, 0.03, 0.05):
            copy = [rng.choice(WORDS) if rng.random() < share else w for w in words]
            out.append(" ".join(copy))
    base = [rng.choice(WORDS) for _ in range(150)]
    out += [" ".join(base)] * 3 + [" ".join(base[:-1])] + [" ".join([*base * 2])] + ["x y z"] * 2 + ["", "", None, None, " \n ", "same same " * 300, "same same " * 310]
    return out


def classes(rows, linked):
    ids = sorted({i for i, _ in rows})
    forest = Forest(max(ids) + 1)
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if linked(x, y):
            forest.union(a, b)
    return {i: forest.find(i) for i in ids}


def test_classes_by_brute_force(spark):
    rows = list(enumerate(texts()))
    bags = {t: bag(t) for _, t in rows}

    def linked(x, y):
        a, b = bags[x], bags[y]
        return bool(a and b) and sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9

    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    want = classes(rows, linked)
    assert got == want
    kept = {r["doc_id"] for r in bagminhash.one_of_each(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_small_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BUCKET_CHUNK", 3)
    monkeypatch.setattr(bagminhash, "GROUP_CHUNK", 2)
    base = WORDS[:120]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(5, 25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["class_id"] for r in bagminhash.near_duplicates(docs).collect()} == {5}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    elem = np.arange(1, 61, dtype=np.uint64) * np.uint64(7919)
    row = np.repeat([0, 1], 60)
    weight = np.concatenate((a, b))
    some = weight > 0
    sig = bagminhash.signatures(row[some], np.concatenate((elem, elem))[some], weight[some], 2, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=4 * (true * (1 - true) / 4096) ** 0.5)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bagminhash.near_duplicates(empty).count() == 0
    assert line_dedup.line_digest(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in bagminhash.near_duplicates(rows).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert sorted(r["doc_id"] or 0 for r in bagminhash.one_of_each(rows).collect()) == [0, 1]


def test_rows_of_one_id_are_classed_by_their_texts(spark):
    rng = random.Random(11)
    x, y, z = ([rng.choice(WORDS) for _ in range(100)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "other"])
    x, y, z, near_x, near_y, near_z = *(" ".join(w) for w in (x, y, z)), near(x), near(y), near(z)
    rows = [(1, x), (1, y), (1, near_y), (2, near_x), (3, near_y), (4, z), (4, None), (4, None), (5, near_z), (5, "a b c d e f g"), (6, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(tuple, bagminhash.near_duplicates(docs).collect()))
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4), (5, 5), (6, 6), (7, 7)]
    kept = bagminhash.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    kept = [tuple(r) for r in kept.collect()]
    of_y = [r for r in kept if r in ((1, y), (1, near_y))]
    assert len(of_y) == 1
    rest = [r for r in kept if r not in of_y]
    assert len(rest) == 6
    assert set(rest) == {(1, x), (4, z), (4, None), (5, "a b c d e f g"), (6, ""), (7, "")}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = dict(connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    forest = Forest(500)
    for a, b in edges:
        forest.union(a, b)
    assert got == {x: forest.find(x) for a, b in edges if a != b for x in (a, b)}


def test_shingles_by_brute_force():
    import pyarrow as pa

    data = [*texts(3, 5), "é ü\tß x y", "one"]
    hashes, at = shingles.shingle_hashes(*shingles.bytes_of(pa.array(data)))
    names = {}
    for text, a, b in zip(data, at, at[1:], strict=False):
        words = [w for w in re.split("[\t\n\x0b\f\r ]+", text or "") if w]
        want = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        assert len(want) == b - a
        for h, s in zip(hashes[a:b].tolist(), want, strict=True):
            assert names.setdefault(h, s) == s
    assert len(set(names.values())) == len(names)


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        v = rng.standard_normal(64)
        rows += [v, v * 3, v]
        rows += [v + rng.standard_normal(64) * s for s in (0.05, 0.1, 0.18, 0.2, 0.21, 0.25)]
    return [[float(np.float32(x)) for x in v] for v in rows]


def test_links_do_not_depend_on_how_many_share_a_bucket(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 256, (24, bagminhash.REGISTERS), dtype=np.uint8)
    places = rng.permutation(bagminhash.REGISTERS)
    # all share one band and no second one; pairs agree in 60 registers, at the floor and one below it
    for x, y, most in ((5, 9, 60), (6, 10, 53), (7, 11, 52)):
        sig[y, places[:most]] = sig[x, places[:most]]
    rows = [(k, bytearray(x.tobytes()), [77, *(1000 * k + b for b in range(1, bagminhash.BANDS))]) for k, x in enumerate(sig)]
    reps = spark.createDataFrame(rows, "node bigint, sig binary, bands array<bigint>")
    got = {}
    for most in (1000, 8):
        monkeypatch.setattr(bagminhash, "DEEP_BUCKET", most)
        tables = bagminhash._candidates(Workspace(spark, "test"), reps, reps.selectExpr("node", "explode(bands) AS key"), "band")
        got[most] = {(min(r), max(r)) for t in tables for r in map(tuple, t.select("a", "b").collect()) if r[0] != r[1]}
    agree = {(i, j) for i, j in itertools.combinations(range(len(sig)), 2) if (sig[i] == sig[j]).sum() >= bagminhash.FLOOR * bagminhash.REGISTERS}
    assert got[1000] == got[8] == agree == {(5, 9), (6, 10)}


def test_vectors_by_brute_force(spark, monkeypatch):
    data = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(vectors())]
    n = len(data)
    data += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] + [1.0] * 63, 1), (n + 3, [], 1), (n + 4, [None] + [1.0] * 63, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1)]
    sound = [(i, np.array(v), c) for i, v, c in data if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, forest = Counter(), Forest(len(data))
    for (a, x, c), (b, y, d) in itertools.combinations(sound, 2):
        if c == d and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links.update((a, b))
            forest.union(a, b)
    want = sorted((i, links[i], forest.find(i), forest.find(i) == i) for i, _, _ in data)
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id bigint, embedding array<float>, label int, n int")
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == want
    monkeypatch.setattr(embedding_join, "CHUNK", 7)
    monkeypatch.setattr(embedding_join, "CELL_ROWS", 4)
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == want
    monkeypatch.setattr(embedding_join, "GROUP_CHUNK", 2)
    assert sorted(map(tuple, embedding_join.near_vectors(df.union(df.where("vec_id % 7 = 0"))).where("vec_id % 7 <> 0").select("vec_id", "component_id").collect())) == [(w[0], w[2]) for w in want if w[0] % 7]
    for grid in embedding_join.GRIDS:
        monkeypatch.setattr(embedding_join, "choose_grid", lambda most, dim, grid=grid: grid)
        if grid in ((8, 4.0), (8, 2.0), (8, 1.0)):
            assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == want


def test_grids_keep_up_with_the_vectors():
    """What a vector is compared with grows far slower than the number of vectors."""
    cost = {n: n * embedding_join.crowding(64, embedding_join.choose_grid(n, 64)) for n in (50_000, 400_000, 4_000_000, 40_000_000)}
    assert max(cost.values()) <= embedding_join.CELL_ROWS


def test_no_vectors(spark):
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        then = [i]
        for j, y in enumerate(b, 1):
            then.append(min(row[j] + 1, then[-1] + 1, row[j - 1] + (x != y)))
        row = then
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance_and_segments(edits):
    rng = random.Random(edits)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 16)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        b = "".join(b)
        near = distance(a, b) <= edits
        assert line_dedup.within(a, b, edits) is near
        if near and min(len(a), len(b)) > edits:
            which, keys = line_dedup.line_keys([a, b], edits)
            assert set(keys[which == 0]) & set(keys[which == 1])


def test_lines_by_brute_force(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 45))) for _ in range(60)]
    pool = lines + [x[:9] + "!" + x[9:] for x in lines[:20]] + [x[:5] + x[7:] for x in lines[10:30]] + [x[:-3] + "zzz" for x in lines[:10]] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1])]
    distinct = sorted({x for _, t in rows if t for x in t.split("\n") if len(x) >= line_dedup.MIN_CHARS})
    forest = Forest(len(distinct))
    for (a, x), (b, y) in itertools.combinations(enumerate(distinct), 2):
        if distance(x, y) <= line_dedup.EDITS:
            forest.union(a, b)
    place, first = {x: forest.find(i) for i, x in enumerate(distinct)}, {}
    spots = sorted((i, k, place[x]) for i, t in rows if t for k, x in enumerate(t.split("\n")) if x in place)
    gone = {}
    for i, k, c in spots:
        if first.setdefault(c, (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id bigint, text string, n_chars int, line string")
    got = line_dedup.line_digest(docs).collect()
    assert {r["doc_id"]: set(r["gone"]) for r in got} == {i: gone.get(i, set()) for i, _ in rows}
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert left == {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}
    assert line_dedup.deduplicate(docs).columns == docs.columns


def test_short_lines_go_as_exact_copies_only(spark, tmp_path):
    from lanewise.llm import queries

    rows = [(1, "one\n\none\n  \ntwo"), (2, "two\none\n\n  \nonee"), (3, "x" * 19 + "\n" + "y" * 25), (4, "x" * 19 + "\n" + "y" * 24 + "\n" + "x" * 18), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["gone"] for r in got} == {1: [2], 2: [0, 1], 3: [], 4: [0, 1], 5: []}
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs, short=True).collect()}
    assert left == {1: "one\n\n  \ntwo", 2: "\n  \nonee", 3: rows[2][1], 4: "x" * 18, 5: None}


def test_contained_items_by_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 5, 9, 14, 40, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 3, 30, 2000]))]
        part = (rng.choice(items)[1] or "").split()
        cut = rng.choice([0, 0, 1, 2, len(part) // 4])
        spot = rng.randint(0, len(words))
        docs.append((i, " ".join([*words[:spot], *part[cut:], *words[spot:]])))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    want = []
    for d, t in docs:
        own = set(bag(t))
        for i, x in items:
            item = set(bag(x))
            if item and len(item & own) / len(item) >= 0.8 - 1e-9:
                want.append((d, i, len(item & own) / len(item)))
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    assert got == sorted(want)
    assert want
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    decontaminate_blocks = decontaminate.BLOCK_ITEMS
    try:
        decontaminate.BLOCK_ITEMS = 4
        assert sorted(map(tuple, decontaminate.contaminated(df, bench).collect())) == sorted(want)
    finally:
        decontaminate.BLOCK_ITEMS = decontaminate_blocks
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_items_without_an_id(spark):
    text = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, text), (-1, text), (3, " ".join(WORDS[5:25]))], "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()]
    assert got == [(1, None), (1, -1), (1, 3)]
    old = decontaminate.BLOCK_BYTES
    try:
        decontaminate.BLOCK_BYTES = 10
        assert sorted(map(str, decontaminate.contaminated(docs, items).collect())) == sorted(f"Row(doc_id=1, item_id={i}, containment=1.0)" for i in (None, -1, 3))
        assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]
    finally:
        decontaminate.BLOCK_BYTES = old


def test_large_groups_of_lines_by_brute_force(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(40))
    lines = sorted({base[:20] + "".join(rng.choice("xyz") if rng.random() < 0.12 else c for c in base[20:]) for _ in range(150)})
    rows = [(i, rng.randint(0, 1)) for i in range(len(lines))]
    table = pa.table({"id": [i for i, _ in rows], "own": [o for _, o in rows], "ci": [0] * len(rows), "cj": [1] * len(rows), "text": lines})
    forest = Forest(len(lines))
    for (a, x), (b, y) in itertools.combinations(enumerate(lines), 2):
        if rows[a][1] != rows[b][1] and distance(x, y) <= 2:
            forest.union(a, b)
    want = {i: forest.find(i) for i in range(len(lines))}
    for small in (4, 1000):
        monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
        got = Forest(len(lines))
        for batch in line_dedup._similar(table, [0]):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                assert distance(lines[a], lines[b]) <= 2
                got.union(a, b)
        assert {i: got.find(i) for i in range(len(lines))} == want


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(1, "first line of twenty characters\nsecond line of many characters"), (2, "second line of many characters\nthird, and another line of text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = line_dedup.line_ids
    monkeypatch.setattr(line_dedup, "line_ids", lambda lines: np.stack((np.zeros(len(lines), np.int64), plain(lines)[:, 1]), axis=1))
    make = line_dedup._lines(docs, False)
    assert make.count() == 4
    got = {r["doc_id"]: r["gone"] for r in line_dedup.line_digest(docs).collect()}
    assert got == {1: [], 2: [0]}


def test_many_repeated_lines_in_one_text(spark):
    import time

    text = "\n".join(["a line that is repeated in this text", *(f"another line with the number {i * 7919} in it, {i * i}" for i in range(300))] * 130)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    gone = spark.range(1).select(F_array(spark, 301, 39130).alias("gone"))
    began = time.time()
    left = docs.crossJoin(gone).select(line_dedup.without(docs["text"], gone["gone"])).first()[0]
    assert time.time() - began < 5
    assert left == "\n".join(text.split("\n")[:301])


def F_array(spark, low, high):
    from pyspark.sql import functions as F

    return F.sequence(F.lit(low), F.lit(high - 1))
