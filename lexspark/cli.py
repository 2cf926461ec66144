"""``python -m lexspark.cli FOLDER TEXT``: encode one text and print the encoding and the text it decodes to."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.engine import Engine


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine.load(spark, arguments[0])
    encoded = engine.encode(spark.createDataFrame([(arguments[1],)], "text string")).withColumn("ids", F.col("encoding.ids"))
    row = engine.decode(encoded).first()
    for name in ("ids", "type_ids", "tokens", "words", "offsets", "attention_mask"):
        values = row.encoding[name]
        print(f"{name}: {[tuple(v) for v in values] if name == 'offsets' else values}")
    print(f"decoded: {row.decoded}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
