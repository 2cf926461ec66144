"""Benchmark decontamination in DataFrame functions: prefix-filtered exact containment of item windows.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window).  Containment of a window is exact, so
one necessary token per window is enough as its prefix: the two-word shingle that is rarest in the whole corpus (a first pass
counts the shingles that items have, combined before the shuffle; windows with a shingle that the corpus lacks go).  A second
pass meets those rare shingles; the window must fit before and after the meeting point, and its words are then compared.

Defined results: null and wordless texts have no words and no hits; wordless items have no window; equal windows of several items
count for each; words of an item with a null ``item_id`` are hit, but it has no id to be counted or listed under; an empty benchmark
marks nothing; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows are broadcast up to this count (a window takes some hundred bytes); beyond it they are joined by shuffle.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; ``text`` null gives none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows: (window, width, items)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width, F.lit(0)) + 1)
    windows = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("width", F.size("window"))


def shingle(words: Column, at: Column) -> Column:
    """Hash of the word at a place and the one after it (of the last word, of it alone)."""
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside any occurrence of a window), items (their ids, an array)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "decontamination")
    windows = written(item_windows(benchmark, width), f"{folder}/windows")
    rows, singles = windows.agg(F.count(F.lit(1)), F.sum((F.col("width") == 1).cast("int"))).first()
    tokens = windows.select("window", F.explode(F.sequence(F.lit(0), F.greatest(F.col("width") - 2, F.lit(0)))).alias("offset"))
    tokens = tokens.select("window", "offset", shingle(F.col("window"), F.col("offset")).alias("token"))

    texts = docs.select(F.col(key), F.monotonically_increasing_id().alias("_row"), words_of(F.col("text")).alias("words"))
    at = texts.select(key, "_row", "words", F.posexplode_outer("words").alias("pos", "word"))
    pair = shingle(F.col("words"), F.col("pos"))
    if singles:  # one-word items: every word is a token of its own as well
        token = F.explode_outer(F.when(F.col("pos").isNull(), F.array(pair)).otherwise(F.array_distinct(F.array(pair, F.xxhash64("word")))))
    else:
        token = pair
    met = at.select(key, "_row", "words", "pos", token.alias("token"))

    known = tokens.select("token").distinct()
    counted = met.select("token").join(_small(known, rows * width), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = (
        tokens.join(F.broadcast(written(counted, f"{folder}/counts")) if rows <= BROADCAST_WINDOWS else written(counted, f"{folder}/counts"), "token", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("r"))
        .where(F.col("r.n") > 0)
        .select("window", F.col("r.offset").alias("offset"), F.col("r.token").alias("rare"))
    )
    anchors = written(rare.join(windows, "window").select("rare", "offset", "window", "width", "items"), f"{folder}/anchors")
    start = F.col("pos") - F.col("offset")
    fits = (
        (F.col("token") == F.col("rare"))
        & (start >= 0)
        & (start + F.col("width") <= F.size("words"))
        & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("width")) == F.col("window"))
    )
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    if singles:
        first = first & (F.coalesce(F.col("token") == pair, F.lit(True)))
    found = (
        met.join(_small(anchors, rows), fits, "left")
        .where(F.col("rare").isNotNull() | first)
        .select(key, "_row", F.size("words").alias("n_words"), F.when(F.col("rare").isNotNull(), F.struct(start.alias("start"), (start + F.col("width")).alias("end"))).alias("span"), "items")
    )
    grouped = found.groupBy(key, "_row").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["sum"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return grouped.select(key, "n_words", covered.alias("n_hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id") -> DataFrame:
    found = hits(docs, benchmark, width, key)
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id") -> DataFrame:
    """The documents without any hit.  Rows are told apart by their texts, which alone decide: ``key`` may be null or shared."""
    name = fresh(docs, "_hit")
    hit = hits(docs.select(F.md5("text").alias(name), "text"), benchmark, width, name).where(F.col("n_hit") > 0).select(name)
    return docs.join(hit, F.md5("text") == F.col(name), "left_anti")
