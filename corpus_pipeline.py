"""Pipeline over the documents table: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import configured, table
from barloom.llm.linechunks import HAS_WORD, drop_repeated_chunks
from barloom.llm.mixing import mixed, repeated
from barloom.llm.nearcopies import drop_near_copies
from barloom.llm.packing import pack
from barloom.llm.perplexity import drop_rejected
from barloom.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    configured(spark)
    return drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated multi-line chunks go; a document that loses its last word that way goes with them."""
    found = drop_repeated_chunks(docs)
    left = found.filter((F.size("_dropped") == 0) | F.col("text").rlike(HAS_WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8, over wide SimHash fingerprints."""
    configured(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are drawn at rates raked to source, language and topic shares, above one with repeats."""
    return repeated(mixed(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What is left, in token sequences of at most 2048."""
    configured(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_copies),
    ("mixing", mixing),
    ("best-fit packing", packing),
]

#: SimHash and the tokenizer of the last stage have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before is settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
