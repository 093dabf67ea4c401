"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread for the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm import bpe, common, decontaminate, language_id, line_dedup, simhash
from kinetext.llm.queries import VOCABULARY


def _recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; others and those without words go."""
    return language_id.identify_documents(docs).where("accepted").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 10 characters or more that an earlier document has; documents that lose lines and are left with nothing but ASCII white space go."""
    out = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _recount(out, docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: by their texts as they are, or as ``documents`` has them, since line dedup takes apart what copies have in common."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.dedup(docs, before=raw).select(docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items; documents that consist of them by half or more go."""
    return _recount(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the SHA-256 of the text that they decode to."""
    out = bpe.encode(docs, VOCABULARY, drop_text=True, decoded=True)
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe_encode", encode),
]

#: SQL cannot express the language model or the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other. Once a stage is written, its input and its own tables are deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with common.tables_made() as made:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
        for path in last + made[:-1]:
            common.delete(spark, path)
        last = made[-1:]
    return docs
