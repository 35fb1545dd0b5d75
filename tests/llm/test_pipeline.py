import itertools
import random
import unicodedata
import zlib

import numpy as np

import corpus_pipeline
from lanewise.llm import language_id
from lanewise.llm.queries import tokenizer_path
from lanewise.llm.shared import Forest
from tests.llm.test_near_duplicates import bag, classes, distance

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_what_is_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = stage(spark, left, SF)
        assert then.columns == docs.columns, name
        assert then.join(docs, "doc_id", "left_anti").count() == 0
        left = then
    got = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in left.select("doc_id").collect()}
    assert got.where("n_tokens = 0").count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def plain_languages(rows):
    """Ids of the rows that language ID keeps: trigram by trigram, from the vectors of single letters."""
    letter = {}

    def profile(text):
        words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
        total = np.zeros(language_id.DIM)
        s = f" {' '.join(words)} "
        for three in zip(s, s[1:], s[2:], strict=False):
            for c in three:
                if c not in letter:
                    letter[c] = language_id.letter_vectors(np.array([ord(c)], np.uint32))[0].astype(float)
            a, b, c = (letter[x] for x in three)
            total += np.roll(a, 2) * np.roll(b, 1) * c
        return total / np.linalg.norm(total) if words else None

    sums = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2 and (p := profile(text)) is not None:
            sums[lang] = sums.get(lang, 0) + np.rint(p * 10_000)
    models = [v / np.linalg.norm(v) for v in sums.values()]
    return {i for i, text, _ in rows if (p := profile(text)) is not None and round(max(p @ m for m in models), 6) >= corpus_pipeline.LEAST_COSINE}


def plain_lines(rows):
    """id -> text without the lines that stand in an earlier place, near copies from 20 characters on."""
    spots = sorted((i, k, x) for i, t in rows.items() for k, x in enumerate(t.split("\n")) if len(x) >= 20 or x.strip())
    distinct = sorted({x for _, _, x in spots})
    forest, first, gone = Forest(len(distinct)), {}, set()
    for (a, x), (b, y) in itertools.combinations(enumerate(distinct), 2):
        if min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
            forest.union(a, b)
    place = {x: forest.find(i) for i, x in enumerate(distinct)}
    for i, k, x in spots:
        if first.setdefault(place[x], (i, k)) != (i, k):
            gone.add((i, k))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows.items()}
    return {i: t for i, t in left.items() if t.strip() or t == rows[i]}


def plain_near(rows):
    bags = {i: bag(t) for i, t in rows.items()}
    found = classes(sorted(rows.items()), lambda x, y: bool(bag(x)) and sum((bag(x) & bag(y)).values()) >= 0.8 * sum((bag(x) | bag(y)).values()) - 1e-9)
    return {i: t for i, t in rows.items() if found[i] == i or not bags[i]}


def plain_leaks(rows, items):
    return {i: t for i, t in rows.items() if not any(len(set(bag(x)) & set(bag(t))) >= 0.8 * len(set(bag(x))) - 1e-9 for x in items)}


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rng, sounds, rows = random.Random(3), {"aa": "aeioulmn", "bb": "bdgkrtzä", "cc": "шжчайор"}, []
    make = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [make(sounds["aa"], 12), make(sounds["bb"], 20)]
    for k in range(24):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, "\n".join(make(sounds[lang], rng.randint(2, 30)) for _ in range(3)), lang))
    rows += [(30, "12 34 !", "aa"), (31, None, "aa"), (32, "ᚠᚢᚦ ᚨᚱᚲ", None), (33, "ღმერთი ქართული", None)]
    rows += [(40, f"{make(sounds['aa'], 30)}\n{items[0]}\n{make(sounds['aa'], 30)}", "aa"), (41, " ".join(items[1].split()[:19]), "bb")]
    long = make(sounds["bb"], 150).split()
    rows += [(50, " ".join(long), "bb"), (51, " ".join([*long[:70], "xx", *long[71:]]), "bb"), (52, " ".join([*long[:100], *make(sounds["bb"], 50).split()]), "bb")]
    line = make(sounds["aa"], 9)
    rows += [(60, f"{line}\nla\n\nmeno\nla", "aa"), (61, f"{line[:5]}x{line[5:]}\nla\n\nmeno", "aa"), (62, f"la\n{make(sounds['aa'], 20)}\n{line[:-3]}", "aa")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = plain_languages(rows)
    want = [{i: t for i, t, _ in rows if i in kept}]
    want += [plain_lines(want[-1])]
    want += [plain_near(want[-1])]
    want += [plain_leaks(want[-1], items)]
    assert [len(a) > len(b) for a, b in zip([rows, *want], want, strict=False)] == [True] * 4
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        then = stage(spark, left, str(tmp_path)).collect()
        assert {r["doc_id"]: r["text"] for r in then} == want[k], name
        assert len(then) == len(want[k]), name
        left = spark.createDataFrame(then, docs.schema)
    tokens = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()}
    assert got == {i: tokens.encode(t, add_special_tokens=False).ids for i, t in want[-1].items()}


def test_near_dedup_does_not_depend_on_how_many_share_a_bucket(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lanewise.llm import bagminhash

    # all texts share one band and no second one
    signed = bagminhash._signed
    monkeypatch.setattr(bagminhash, "_signed", lambda docs: signed(docs).withColumn("bands", F.array(F.lit(77).cast("bigint"), F.xxhash64("node"))))
    rng = random.Random(8)
    rows = {i: [f"w{rng.randrange(9999)}" for _ in range(120)] for i in range(12)}
    rows |= {20 + i: [*rows[i][:118], "x", "y"] for i in range(4)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows.items()], "doc_id bigint, text string")
    for most in (1000, 4):
        monkeypatch.setattr(bagminhash, "DEEP_BUCKET", most)
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(12))


def test_near_dedup_meets_by_blocks_only_where_that_is_less_work(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lanewise.llm import bagminhash

    # half of each text is the same, so that all share a band and about a quarter of them each block of registers
    rng = random.Random(9)
    rows = {i: [*(f"b{k}" for k in range(40)), *(f"w{rng.randrange(9999)}" for _ in range(40))] for i in range(60)}
    rows |= {100 + i: [*rows[i][:-1], "x"] for i in range(4)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows.items()], "doc_id bigint, text string")
    signed, less = bagminhash._signed, bagminhash._less_by_blocks
    monkeypatch.setattr(bagminhash, "DEEP_BUCKET", 4)
    monkeypatch.setattr(bagminhash, "_signed", lambda docs: signed(docs).withColumn("bands", F.array(F.lit(77).cast("bigint"), F.xxhash64("node"))))
    ways = [less, lambda blocked, large: large.select("key", "n").limit(0), lambda blocked, large: large.select("key", "n")]
    for way in ways:
        monkeypatch.setattr(bagminhash, "_less_by_blocks", way)
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()) == list(range(60))
    # a bucket of common texts meets as it is; one whose members have nothing else in common, by blocks
    blocked = spark.createDataFrame([(k, i, f) for k in (1, 2) for i in range(90) for f in (range(44) if k == 1 else range(1000 * i, 1000 * i + 44))], "bucket bigint, node bigint, key bigint")
    large = spark.createDataFrame([(1, 90, 89), (2, 90, 89)], "key bigint, n bigint, m bigint")
    assert [tuple(r) for r in less(blocked, large).collect()] == [(2, 90)]
