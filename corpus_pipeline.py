"""A training-corpus pipeline: quality filter, line dedup, near-dedup, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, decontamination, linededup, quality, simhash
from lexspark.llm.common import fresh, held_out, scratch_path, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote scores under 0.5 go.  Learned from the labelled rows outside the held-out fold."""
    model = quality.fit_quality(docs.where(~held_out(3, 1)), table(spark, sf_dir, "labels"))
    score, good = fresh(docs, "score"), fresh(docs, "predicted")
    scored = quality.score_quality(docs, model, docs.columns, (score, good))
    return scored.where(F.col(good) == 1).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines and clauses are cut out of the texts; ``n_chars`` follows."""
    cut = linededup.dedup_lines(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest key."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL cannot express the classifier or the transducer; the stages are tested against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
