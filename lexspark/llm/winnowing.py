"""Winnowing in DataFrame functions: document fingerprints with a match guarantee.

``k`` consecutive token hashes make a gram hash; of every ``w`` consecutive grams the least one is kept, the rightmost on ties,
with its position.  So any run of ``w + k - 1`` equal tokens in two texts gives them a common fingerprint.

A gram is one long: its upper 40 bits are the hash, the lower 24 bits count down with the position, so that a plain minimum takes
the rightmost of equal hashes (positions wrap at 2**24, which only matters for ties across the wrap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, written

POSITION_BITS = 24
POSITIONS = (1 << POSITION_BITS) - 1
#: A run of Latin letters and digits is a token; of other scripts and signs, each character is.
TOKEN = r"[0-9A-Za-zÀ-ɏ]+|\S"


def gram_hashes(hashes: Column, k: int) -> Column:
    """Array of packed grams over an array column of hashes; fewer than k hashes make one gram, none make none."""
    size = F.size(hashes)
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
            .bitwiseAND(F.lit(~POSITIONS))
            .bitwiseOR((F.lit(POSITIONS) - i % (POSITIONS + 1)).cast("bigint")),
        )
    )


def window_minima(grams: Column, w: int) -> Column:
    """The distinct packed minima of all windows of w grams; fewer grams make one window."""
    size = F.size(grams)
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.greatest(size - w, F.lit(0)) + 1), lambda i: F.array_min(F.slice(grams, i, w)))
        )
    )


def gram_hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def gram_position(packed: Column) -> Column:
    return F.lit(POSITIONS) - packed.bitwiseAND(F.lit(POSITIONS))


def with_fingerprint(df: DataFrame, text: str, into: str, k: int, w: int) -> DataFrame:
    """Adds ``into``: the packed fingerprints of the text column.  Each step is a column of its own, so none is computed twice."""
    return (
        df.withColumn("_hashes", F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
        .withColumn("_grams", gram_hashes(F.col("_hashes"), k))
        .drop("_hashes")
        .withColumn(into, window_minima(F.col("_grams"), w))
        .drop("_grams")
    )


def digest(packed: Column) -> Column:
    """Short name of a fingerprint: hash of its hashes and positions in order."""
    return F.sha2(F.array_join(packed.cast("array<string>"), ",").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints' hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, gram_hash))


def fingerprints(docs: DataFrame, key: str = "doc_id", k: int = 5, w: int = 12) -> DataFrame:
    """Rows (key, fingerprint): array of (hash, position), positions counted in tokens.  Null text is empty text: no fingerprint."""
    found = with_fingerprint(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), "text", "_packed", k, w)
    return found.select(key, F.transform("_packed", lambda p: F.struct(gram_hash(p).alias("hash"), gram_position(p).cast("int").alias("position"))).alias("fingerprint"))


def successors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, half, next): the next smaller key, after the smallest the largest, and half of the key's longest text.

    Keys are range-partitioned; a window runs within each range, and only the ranges' ends (a partition count) meet in one task.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "successors")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    down = F.desc_nulls_last(key)
    keys = docs.groupBy(key).agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    ranged = written(keys.repartitionByRange(parts, down).withColumn("seg", F.spark_partition_id()), folder)
    ends = ranged.groupBy("seg").agg(F.max_by(F.struct(key), F.struct(F.col(key).isNotNull(), key)).alias("top"))
    order = W.orderBy("seg")
    wrapped = ends.select("seg", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("following"))
    within = F.lead(F.struct(key)).over(W.partitionBy("seg").orderBy(down))
    return ranged.join(F.broadcast(wrapped), "seg").select(key, "half", F.coalesce(within, F.col("following"))[key].alias("next"))


def compare_with_edits(docs: DataFrame, key: str = "doc_id", k: int = 5, w: int = 12) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text: the last half of its characters gives way to as many of the next document's first (or all of them).
    Null text is empty text; of repeated keys, the greatest text stands for the next document.
    """
    # keys travel as structs: null keys compare as equal, and a join keeps the partitioning of the grouping before it
    boxed = lambda c: F.struct(F.col(c).alias("key"))
    plain = docs.select(boxed(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    chain = successors(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), key)
    given = (
        plain.join(chain.select(boxed(key).alias("_for"), "half", boxed("next").alias("_next")), F.col("_key") == F.col("_next"))
        .select("_for", "text", F.expr("substring(text, 1, cast(half as int))").alias("lead"))
    )
    given = with_fingerprint(given, "text", "_packed", k, w).select("_for", "lead", hash_set(F.col("_packed")).alias("next_set"))
    given = given.groupBy("_for").agg(F.max(F.struct("lead", "next_set")).alias("g"))
    own = plain.join(given, F.col("_key") == F.col("_for")).select(
        F.col("_key.key").alias(key), "text", F.length("text").cast("bigint").alias("n_chars"), F.col("g.lead").alias("lead"), F.col("g.next_set").alias("next_set")
    )
    edited = own.withColumn(
        "edited",
        F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 2) as int)), substring(lead, 1, cast(floor(n_chars / 2) as int)))"),
    ).drop("lead")
    both = with_fingerprint(with_fingerprint(edited, "text", "_own", k, w), "edited", "_edited", k, w)
    sets = both.withColumn("_own_set", hash_set(F.col("_own"))).withColumn("_edited_set", hash_set(F.col("_edited")))
    return sets.select(
        key,
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("_own")).alias("fingerprint"),
        digest(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own_set"), F.col("_edited_set")).alias("near_edited"),
        likeness(F.col("_own_set"), F.col("next_set")).alias("near_next"),
    )
