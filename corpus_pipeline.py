"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the last
returns token ids. A stage's result is written as Parquet and read again before the next begins; then the
stage's work tables are deleted.

Defined cases: documents with a null or empty text or without a letter go in the first stage, as do those of no
recognised language (where no row says its language, a letter is enough); a null ``doc_id`` is one document to the line
stage, alike to nothing in the join, and otherwise kept; rows that share an id are one document, of which
all different texts stay if it is the first of its group, ties between documents going to the smallest id;
texts of any length are read whole; other columns, whatever their names, are kept up to the last stage;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, jaccard_join, language, line_dedup
from cairn.llm.common import WorkTables, collecting
from cairn.llm.queries import pattern, vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a recognised language go."""
    return language.keep_known(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; their documents stay."""
    return line_dedup.apply(docs, WorkTables(spark, "pipeline-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.keep_first(docs, WorkTables(spark, "pipeline-join"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of what is left."""
    made = bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", token_ids),
]

#: Language ID is a trained network, so SQL can't state the pipeline's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    work = WorkTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = work.keep(stage(spark, docs, sf_dir), name)
        for tables in made:
            tables.clear()
    return STAGES[-1][1](spark, docs, sf_dir)
