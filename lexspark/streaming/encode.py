"""Encoding of streams: the pipeline is a stateless map, so a stream's plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def encode_stream(stream: DataFrame, engine: Engine, text: str = "text", into: str = "encoding") -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream; use Engine.encode")
    return engine.encode(stream, text, into)


def token_counts(stream: DataFrame, engine: Engine, time: str, text: str = "text", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Texts and tokens per time window; windows close once the watermark has passed."""
    counted = encode_stream(stream, engine, text).withColumn("_n", F.size("encoding.ids"))
    return (
        counted.withWatermark(time, late)
        .groupBy(F.window(time, window))
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("_n").alias("tokens"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "texts", "tokens")
    )


def write_encoded(stream: DataFrame, engine: Engine, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Encoded texts as Parquet; everything that is there, then it stops."""
    return (
        encode_stream(stream, engine, text)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
