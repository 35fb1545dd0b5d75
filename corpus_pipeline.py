"""The corpus pipeline: five stages from the table documents to token ids (counted as part of lanewise.llm).

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import bagminhash, decontaminate, forced_bpe, language_id, line_dedup
from lanewise.llm.queries import tokenizer_path
from lanewise.llm.shared import Workspace

#: A text whose profile is almost at right angles to that of every language is in none of them.
LEAST_COSINE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Leaves out texts without a letter, null ones too, and those of no known language; learns from docs."""
    mark = "__language"
    known = docs.withColumn(mark, language_id.predict("text", language_id.train(docs.select("doc_id", "text", "lang"))))
    return known.where((F.col(f"{mark}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{mark}.score") >= LEAST_COSINE)).drop(mark)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Takes out lines that stand in an earlier place, and documents of which nothing else is left."""
    return line_dedup.deduplicate(docs, keep_empty=False, short=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return bagminhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Leaves out documents that contain an item of the table benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded text, and ids (little-endian unsigned 32-bit)."""
    return forced_bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode_tokens),
]

#: Learned prototypes, signatures and BPE merges can't be put as SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Applies STAGES to the whole table documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, folder), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
