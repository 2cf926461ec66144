"""Tables that a job writes on its way: in the folder that all executors share, so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

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


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A local session without one gets a folder of its own; a cluster raises."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexspark-checkpoint-"))
        set_before = context._jsc.sc().getCheckpointDir()
    return set_before.get().rstrip("/")


def scratch_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``: cuts lineage."""
    with settings(df.sparkSession, FREED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, store = _at(spark, path)
    store.delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder."""
    target, store = _at(spark, path)
    return store.getContentSummary(target).getLength()


def folders_with(spark: SparkSession, path: str, name: str) -> list[str]:
    """The folders in ``path`` that hold a file of that name, sorted."""
    target, store = _at(spark, path)
    if not store.exists(target):
        return []
    below = [s.getPath() for s in store.listStatus(target) if s.isDirectory()]
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(str(p) for p in below if store.exists(made(p, name)))
