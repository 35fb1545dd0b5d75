"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_subspace_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(_table(spark, folder, "embeddings"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from .token_files import token_files

    return token_files(spark, _table(spark, folder, "documents"), tokenizer_path())


def op3_containment_search(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, folder, "documents"))


def op5_tiered_shards(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .tiered_shards import compacted

    rows = compacted(spark, _table(spark, folder, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op6_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    from .pii_crf import find_personal_data

    return find_personal_data(_table(spark, folder, "documents"))


def op7_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .bagminhash import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"), with_links=True).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op8_warc_writer(spark: SparkSession, folder: str) -> DataFrame:
    from .warc_writer import warc

    return warc(spark, _table(spark, folder, "pages"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(_table(spark, folder, "documents"), short=True)


def op10_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from .forced_bpe import HOLD_BYTES, round_trip

    return round_trip(_table(spark, folder, "documents"), tokenizer_path(), hold=HOLD_BYTES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_SHINGLES = """
    words AS (
        SELECT {key} AS k, list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL
    ), shingles AS (
        SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))
            WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM words
    )"""


def oracle_sql() -> dict[str, str]:
    docs = _SHINGLES.format(key="doc_id", table="documents").replace("words AS", "doc_words AS").replace("FROM words", "FROM doc_words").replace("shingles AS", "doc_shingles AS")
    items = _SHINGLES.format(key="item_id", table="benchmark").replace("words AS", "item_words AS").replace("FROM words", "FROM item_words").replace("shingles AS", "item_shingles AS")
    return {
        "op1_subspace_pigeonhole": """
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
            link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                AND list_cosine_similarity(a.e, b.e) >= 0.98),
            reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
            low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
            SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
            FROM embeddings e JOIN low ON low.a = e.vec_id""",
        "op3_containment_search": f"""
            WITH {docs}, {items}, sizes AS (SELECT k, count(*) AS q FROM item_shingles GROUP BY k)
            SELECT d.k AS doc_id, i.k AS item_id, count(*)::DOUBLE / any_value(z.q) AS containment
            FROM item_shingles i JOIN doc_shingles d USING (s) JOIN sizes z ON z.k = i.k
            GROUP BY d.k, i.k HAVING count(*)::DOUBLE / any_value(z.q) >= 0.8 - 1e-9""",
        "op5_tiered_shards": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
        "op8_warc_writer": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
            t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM t""",
    }
