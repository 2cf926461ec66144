"""The package's own code for the executors: zipped once per application and served by Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_served: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Python workers can import the package, wherever they run and whatever their path is."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _served:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lexspark-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(target)
    _served.add(spark.sparkContext.applicationId)
