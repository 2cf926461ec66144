"""What the training-data operators share: table access, shared scratch space, bounded samples, Arrow row mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..sources.tables import read_table

#: Upper bound of a row batch handed to a Python worker.  Documents can be long, so batches are bounded in rows and bytes.
BATCH_ROWS = 10_000
BATCH_BYTES = "4m"


#: A table of a few numbers a row is broadcast up to this count, which is looked up; beyond it, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long documents cannot fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).  Where none is set, a single-machine session gets a local one; a cluster raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexspark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Shuffle files of an execution go when it has ended, instead of when the driver collects garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session for what is planned and run meanwhile; those from before come back."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` in the shared folder and read it back: cuts lineage, survives lost executors, frees its shuffle files."""
    with settings(df.sparkSession, FREED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def preceding_sum(df: DataFrame, order: list[str], size: str, into: str, path: str) -> DataFrame:
    """Adds ``into``: the sum of ``size`` over all rows before, in ascending ``order`` (nulls first).

    Rows are range-partitioned and written to ``path``; a window runs within each range, and only the ranges' sums (a partition
    count, not data) meet in one task.  Small neighbouring ranges are read as one (no number of them is asked for), so that there are
    no more files than the rows need.
    """
    by = [F.asc_nulls_first(c) for c in order]
    ranged = written(df.repartitionByRange(*by).withColumn("_seg", F.spark_partition_id()), path)
    sums = ranged.groupBy("_seg").agg(F.sum(size).alias("_sum"))
    earlier = F.sum("_sum").over(W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
    before = sums.select("_seg", F.coalesce(earlier, F.lit(0)).cast("bigint").alias("_before"))
    within = F.sum(size).over(W.partitionBy("_seg").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    return ranged.join(F.broadcast(before), "_seg").withColumn(into, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_seg", "_before")


#: A key with this part of all rows, or more, is looked up in a broadcast table, which so has at most this many rows.
SHARES = 10_000


def joined_by_share(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, shares: int = SHARES) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row per key and in ``count`` how many rows of ``left`` have it.

    Keys with a ``shares``-th of the ``total`` rows or more are at most ``shares``: they are broadcast, whatever the size of the tables.
    Other rows are shuffled, and none of their keys can fill a task.  Both tables are read twice, so they should be written ones.
    """
    hot = F.col(count) * shares >= total
    heavy = F.broadcast(right.where(hot))
    light = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot), on)
    return left.join(heavy, on).unionByName(light)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True where the row belongs to the held-out fold; a null key is held out, too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def one_label_per_document(labels: DataFrame, label: str) -> DataFrame:
    """Repeated label rows of a document become one (the largest); null keys and null labels go."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).alias("_label"))
    )


def balanced_hashes(hashed: DataFrame, by: str, per_class: int) -> DataFrame:
    """Rows (``by``, _h): the first ``per_class`` distinct hashes of each value of ``by``, in a fixed order that is like a random one."""
    distinct = hashed.where(F.col(by).isNotNull()).select(by, "_h").distinct()
    counts = distinct.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    mixed = F.xxhash64(F.lit(1), "_h")
    unit = F.pmod(mixed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = distinct.join(counts, by).withColumn("_unit", unit).where(F.col("_unit") * F.col("_n") < 2 * per_class + 100)
    rank = F.row_number().over(W.partitionBy(by).orderBy("_unit", "_h"))
    return some.withColumn("_rank", rank).where(F.col("_rank") <= per_class).select(by, "_h")


def balanced_sample(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """Rows (``by``, text): of each value of ``by``, ``per_class`` distinct texts, or all if there are fewer; each text once.

    Texts are chosen by the order of their hashes, so copies count once and neither crowd out nor swell a sample.  Hashes are made
    distinct before they are counted, a threshold scaled by the class's count leaves some two times as many as wanted, and only
    those are ranked; texts move for the chosen hashes alone.  Every class has its sample, however many there are.
    """
    named = rows.select(by, "text", F.xxhash64("text").alias("_h"))
    chosen = written(balanced_hashes(named.select(by, "_h"), by, per_class), scratch_path(rows.sparkSession, "sample"))
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    return named.join(small, [by, "_h"]).groupBy(by, "_h").agg(F.max("text").alias("text")).select(by, "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """Rows (text, _label) of a bounded, balanced sample of distinct texts; only the sample's texts are moved."""
    one = one_label_per_document(labels, label)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_h")).join(one, "doc_id").select("_label", "_h")
    chosen = balanced_hashes(hashed, "_label", per_label)
    return docs.select("text", F.xxhash64("text").alias("_h")).join(F.broadcast(chosen), "_h").groupBy("_label", "_h").agg(F.max("text").alias("text")).select("text", "_label")


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive tasks, and two of them share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What operators remember in a Python worker beyond a task, by name.
_REMEMBERED: dict[str, dict] = {}


def remembered(name: str) -> dict:
    return _REMEMBERED.setdefault(name, {})


def map_rows(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, remembers: str | None = None
) -> DataFrame:
    """``function`` over the Arrow batches of each partition.  A worker keeps what one operator remembers at a time."""
    bound_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches):
        for name in _REMEMBERED.keys() - {remembers}:
            _REMEMBERED[name].clear()
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
