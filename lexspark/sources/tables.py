"""Reading a table so that work on its rows uses all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bound of a batch of rows that goes to a Python worker, which holds some ten times as much while it works on it.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """A batch is bounded in bytes as well as in rows, so that a worker's memory depends neither on the table's size nor on its texts'."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table.  A file can only be split between row groups; a table of fewer partitions than cores is dealt to all of them.

    Only small tables are: a large one has more row groups than a cluster has cores, and its rows stay where they are.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
