"""Pipeline descriptions and texts from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import ConfigError


def read_config(spark: SparkSession | None, path: str) -> str:
    """The text of ``tokenizer.json`` in a folder; through Spark where a session is given, so any of its stores will do."""
    file = f"{path.rstrip('/')}/tokenizer.json"
    try:
        if spark is not None:
            return spark.read.text(file, wholetext=True).first()[0]
        with open(os.path.expanduser(file), encoding="utf-8") as f:
            return f.read()
    except Exception as error:
        raise ConfigError(f"cannot read {file}") from error


def read_texts(spark: SparkSession, path: str, format: str = "parquet", text: str = "text") -> DataFrame:
    """Texts from any format that Spark reads; a plain text file gives one row per line."""
    df = spark.read.format(format).load(path)
    return df.withColumnRenamed("value", text) if format == "text" and text != "value" else df


def checked_utf8(df: DataFrame, data: str, into: str = "text", invalid: str = "raise") -> DataFrame:
    """Bytes become text; bytes that are no UTF-8 raise, give null, or are replaced."""
    text = F.col(data).cast("string")
    made = {"raise": F.validate_utf8, "null": F.try_validate_utf8, "replace": F.make_valid_utf8}[invalid](text)
    return df.withColumn(into, made)


def vocab_rows(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """Rows (*keep, piece, id) of vocabularies that are JSON objects; escapes in the pieces are resolved."""
    return df.select(*keep, F.explode(F.from_json(F.col(json), "map<string,int>")).alias("piece", "id"))
