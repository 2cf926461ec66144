"""Exact dedup against a persistent index of text digests.

Texts are equal when they are identical after each run of blanks (space, tab, line ends, form feeds) has become one space; a null
text is an empty one.  The index is a Parquet table in a folder of the shared file system, bucketed and sorted by the SHA-256 digest
of the normalised text.  A batch of documents is reduced to one row per digest before any of it is shuffled, digests that the index
lacks are found by a sort-merge anti-join that moves nothing of the index, and are appended.

Defined results, one row per document: ``keep_id`` is the key of the row that stays: the one that the index has, else the smallest
key in the batch (null keys last); ``group_size`` counts the batch's rows of that text; ``kept`` is true for exactly one row of a
text that the index did not have, also where rows or keys are repeated; a null or empty text is the empty text, which is a text like
any other; whole texts are digested, however long; an empty table adds nothing; other columns, of any name, are ignored by ``add``
and carried along by ``keep_new``.  A batch that was added before, or only in part because its job was lost, can be added again
under its name with the same results.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, fresh, joined_by_share, scratch_path, written

#: What changes under normalisation: runs of blanks, and single ones that are no space.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
BUCKETS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ").cast("binary"), 256))


class DigestIndex:
    """The index in ``folder``; it is made where there is none.  ``buckets`` must be that with which it was made."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.buckets, self.path = spark, buckets, f"{folder.rstrip('/')}/digests-{buckets}"
        self.scratch = f"{folder.rstrip('/')}/scratch"
        self.table = f"lexspark_digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {kind}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        """Rows (digest, keep_id, batch), one per digest."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "batch").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def clear_scratch(self) -> None:
        """Delete what batches have left to read their results from."""
        delete_path(self.spark, self.scratch)

    def forget(self) -> None:
        """Drop the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.path)
        self.clear_scratch()

    def _scratch(self) -> str:
        return f"{self.scratch}/{uuid.uuid4().hex}"

    def _decide(self, signed: DataFrame, key: str, batch: str) -> DataFrame:
        """From a written table (key, _row, digest): rows (digest, n, keep_id, keep_row); appends what is new."""
        first = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "_row")).alias("first")
        grouped = signed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
        groups = written(grouped, self._scratch())
        placed = groups.repartition(self.buckets, "digest")
        known = self.read().select("digest")
        new = placed.join(known.hint("merge"), "digest", "left_anti")
        self.append(new.select("digest", F.col("first.key").alias("keep_id"), F.lit(batch).alias("batch")))
        old = self.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        met = placed.join(old.hint("merge"), "digest", "left")
        keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("first.key"))
        return met.select("digest", "n", keep.alias("keep_id"), F.when(F.col("old").isNull(), F.col("first._row")).alias("keep_row"))

    def _add(self, signed: DataFrame, key: str, batch: str) -> DataFrame:
        decided = written(self._decide(signed, key, batch), self._scratch())
        total = signed.count()
        return joined_by_share(signed, decided, ["digest"], "n", total).select(
            key,
            "_row",
            "keep_id",
            F.col("n").alias("group_size"),
            F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def add(self, docs: DataFrame, batch: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
        """Rows (key, keep_id, group_size, kept, text_sha256), one per document; what is new is in the index afterwards.

        Texts are read once: their digests are written, and all else works on those.
        """
        digests = docs.select(key, F.monotonically_increasing_id().alias("_row"), text_digest(F.col(text)).alias("digest"))
        signed = written(digests, self._scratch())
        return self._add(signed, key, batch).drop("_row")

    def keep_new(self, docs: DataFrame, batch: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``docs``, with all their columns, that stay."""
        row, digest = fresh(docs, "_row"), fresh(docs, "_digest")
        marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(digest, text_digest(F.col(text)))
        whole = written(marked, self._scratch())
        signed = whole.select(F.col(key), F.col(row).alias("_row"), F.col(digest).alias("digest"))
        stays = self._add(signed, key, batch).where("kept").select(F.col("_row").alias(row))
        return whole.join(stays, row, "left_semi").select(*docs.columns)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``DigestIndex.add`` to an index of these documents alone, which goes when the rows are written."""
    spark = docs.sparkSession
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), docs.select(key).schema[0].dataType.simpleString())
    found = written(index.add(docs, "", key, text), scratch_path(spark, "exact-duplicates"))
    index.forget()
    return found


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
