import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import forced_bpe, token_files
from lanewise.llm.queries import tokenizer_path

PARTS = ["a", "é", "th", "ing", " ", "\n", "\t", "\x1c", " ", "é", "İ", "Σ", "ß", "ǅ", "中", "文", "😀", "1", "٣", "½", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|", "!", "%%%", "...", "\x00", "ﬁ", "क्", "\x85", "zx"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_like_the_library(library):
    coder, rng = forced_bpe.forced_boundary(tokenizer_path()), random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "x" * 5000, "ab" * 3000 + "é"]
    ids, ends = coder.encode(texts)
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert coder.decode(ids[a:b]).decode() == library.decode(want, skip_special_tokens=False)


def test_letters_that_are_normalised_here(library):
    """Every letter below the limit is lowered and split as the library does."""
    coder = forced_bpe.forced_boundary(tokenizer_path())
    texts = [f"a{chr(c)}b" for c in range(1, 0x250)]
    ids, ends = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_columns(spark, library):
    rows = spark.createDataFrame([("Hello, world!",), (None,), ("",)], "text string").withColumn("ids", forced_bpe.encode_column("text", tokenizer_path()))
    got = rows.withColumn("back", forced_bpe.decode_column("ids", tokenizer_path())).collect()
    assert got[0]["ids"] == library.encode("Hello, world!", add_special_tokens=False).ids
    assert got[0]["back"] == library.decode(got[0]["ids"], skip_special_tokens=False)
    assert [(r["ids"], r["back"]) for r in got[1:]] == [([], "")] * 2


@pytest.mark.parametrize("high", [1, 2, 300, 49408, 1 << 32])
def test_blocks(high):
    rng = np.random.default_rng(high % 97)
    ids = rng.integers(0, high, 4 * token_files.BLOCK, dtype=np.uint64).astype(np.uint32)
    ids[7], ids[2000] = high - 1, 0
    parts = token_files.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    assert (token_files.decode_blocks(b"".join(parts), starts) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(token_files.BLOCK, 5, np.uint32)
    ids[::100] = 4_000_000_000
    (block,) = token_files.encode_blocks(ids)
    assert len(block) < 100
    assert (token_files.decode_blocks(block, np.array([0])) == ids).all()


def test_files(spark, library):
    rows = [(5, "the cat", 1), (None, "null id", 1), (-(1 << 63), "least id", 1), (3, None, 1), (3, "", 1), (4, "word " * 9000, 1), (5, "the cat", 1), (-7, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = [tuple(r) for r in token_files.token_files(spark, docs, tokenizer_path()).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.token_files(spark, docs, tokenizer_path()).count() == 0
    assert forced_bpe.round_trip(docs, tokenizer_path()).count() == 0


def test_round_trip_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (2, "")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = forced_bpe.round_trip(docs, tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0)]


def test_tables_of_pieces_are_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(forced_bpe, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(forced_bpe, "SLICE_BYTES", 3000)
    coder, rng = forced_bpe.ForcedBoundary(tokenizer_path()), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(80)) for _ in range(40)]
    texts.append("\n".join(texts) + "\x1c" + " x" * 4000 + "y" * 9000)
    for text in texts:
        ids, _ = coder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert all(known.bytes < 20_000 + 3 * 3000 * forced_bpe.KEY_BYTES for known in (coder.known_pieces, coder.known_words))
    coder.forget()
    assert not coder.known_pieces.slots
    assert "".join(forced_bpe.parts(texts[-1])) == texts[-1]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        forced_bpe.ForcedBoundary(public_tokenizers.path("byte_bpe_50k.json"))


def test_workers_let_go_of_the_encoder_when_other_work_begins():
    import os

    from lanewise.llm import forced_bpe, shared

    coder = forced_bpe.forced_boundary(tokenizer_path())
    assert list(coder.until_end(iter([1, 2]), 0)) == [1, 2]
    assert forced_bpe.forced_boundary(tokenizer_path()) is coder, "the next task of the kind has it still"
    assert list(shared.released(iter([3]))) == [3]
    again = forced_bpe.forced_boundary(tokenizer_path())
    assert again is not coder
    assert all((x == y).all() for x, y in zip(again.encode(["some words"]), coder.encode(["some words"]), strict=True))
    # no thread beside the task's own
    before = len(os.listdir("/proc/self/task"))
    again.encode([" ".join(f"word{i}x{i * 7919}" for i in range(20_000))])
    assert len(os.listdir("/proc/self/task")) == before
