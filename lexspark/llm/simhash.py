"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: a bit is set if it is set in more than half of the 64-bit hashes of the text's word shingles.  Texts link where
fingerprints differ in at most ``radius`` bits; classes are the connected components of the links.

Equal fingerprints collapse first.  Distinct fingerprints that differ in at most r bits agree on at least two of r + 2 blocks of
bits, so they meet in one of the buckets keyed by two blocks.  Within a bucket the fingerprints are stored vertically: plane b
holds bit b of all of them in one long integer.  One fingerprint is compared with all others at once: each plane, exclusive-or
the query's bit, is added to bitwise counters by carry-save addition; a sticky overflow marks those beyond the radius, and the
comparison is abandoned once all are.  A breadth-first search that only asks for not yet reached fingerprints emits a spanning
forest of the bucket's links: at most one edge per fingerprint, never all pairs.  Buckets over ``block`` fingerprints are dealt
into blocks, and every pair of blocks is compared in a task of its own.

``similar_texts`` links by the Jaccard index of shingles instead, by the same comparison of wider fingerprints.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; an empty table gives no rows; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows, scratch_path, texts_of, written
from .graph import components
from .wordscan import mix

BLOCK = 2048


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = words_per_shingle
    shingles = map(b" ".join, zip(*[words[i:] for i in range(n)])) if len(words) >= n else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(words) - n + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", words_per_shingle: int = 3) -> DataFrame:
    """Rows (key, fp): the fingerprint as a signed 64-bit number."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words_per_shingle) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return map_rows(docs.select(key, "text"), run, f"{key} {kind}, fp long")


class BitPlanes:
    """Fingerprints stored vertically; ``within`` compares one with all of them."""

    def __init__(self, values: list[int], bits: int = 64):
        self.values, self.all = values, (1 << len(values)) - 1
        square = np.frombuffer(b"".join([v.to_bytes(bits // 8, "little") for v in values]), np.uint8).reshape(-1, bits // 8)
        columns = np.packbits(np.unpackbits(square, axis=1, bitorder="little").T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(columns[b].tobytes(), "little") for b in range(bits)]

    def within(self, value: int, radius: int, wanted: int) -> int:
        """The mask of those of ``wanted`` that differ from ``value`` in at most ``radius`` bits."""
        levels = radius.bit_length()
        start = (1 << levels) - 1 - radius  # counters start so that radius + 1 differences overflow
        counters = [self.all if start >> k & 1 else 0 for k in range(levels)]
        alive = wanted
        for b, plane in enumerate(self.planes):
            carry = (plane ^ self.all if value >> b & 1 else plane) & alive
            for k in range(levels):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
                if not carry:
                    break
            if carry:
                alive &= ~carry  # beyond the radius
                if not alive:
                    return 0
        return alive


def spanning_links(values: list[int], radius: int, bits: int = 64) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct ``values``."""
    if len(values) == 2:
        if (values[0] ^ values[1]).bit_count() <= radius:
            yield values[0], values[1]
        return
    planes = BitPlanes(values, bits)
    left = planes.all
    while left:
        first = left & -left
        left ^= first
        frontier = [first.bit_length() - 1]
        while frontier and left:
            at = frontier.pop()
            near = planes.within(values[at], radius, left)
            left &= ~near
            while near:
                low = near & -near
                near ^= low
                to = low.bit_length() - 1
                frontier.append(to)
                yield values[at], values[to]


def bit_blocks(count: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` blocks that part ``bits`` bits evenly."""
    edges = [round(i * bits / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what distinct fingerprints (column ``fp``) link to, without loss of connection."""
    tables = list(combinations(bit_blocks(radius + 2), 2))
    part = lambda low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("table"), F.shiftleft(part(*x), y[1]).bitwiseOR(part(*y)).alias("bucket"))
            for i, (x, y) in enumerate(tables)
        ]
    )
    return links_in_buckets(distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.bucket"), radius, block)


def links_in_buckets(dealt: DataFrame, radius: int, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Edges (a, b) between the fingerprints of each bucket: rows (table, bucket, fp), fp a long or, beyond 64 bits, little-endian bytes."""
    sizes = dealt.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    grouped = (
        dealt.join(sizes, ["table", "bucket"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
                    F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))
                )
            ),
        )
        .select("table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("table", "bucket", "i", "j")
        .sortWithinPartitions("table", "bucket", "i", "j")
    )

    def compare(batches):
        group, values = None, []
        found: list[tuple[int, int]] = []

        def out():
            if bits == 64:
                pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
                ends = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            else:
                ends = [pa.array([p[i].to_bytes(bits // 8, "little") for p in found], pa.binary()) for i in (0, 1)]
            found.clear()
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in range(4)]))
            if bits == 64:
                prints = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            else:
                prints = [int.from_bytes(x, "little") for x in batch.column(4).to_pylist()]
            for name, fp in zip(names, prints):
                if name != group:
                    found += spanning_links(values, radius, bits)
                    group, values = name, []
                values.append(fp)
            if len(found) > 10_000:
                yield out()
        found += spanning_links(values, radius, bits) if values else []
        yield out()

    return map_rows(grouped, compare, "a long, b long" if bits == 64 else "a binary, b binary").distinct()


def classed(prints: DataFrame, distinct: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The columns of ``prints`` and component_id: the smallest key that links lead to; ``distinct``: (fp, least key)."""
    roots = components(edges).withColumnRenamed("node", "fp")
    found = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(found.join(smallest, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """Rows (key, fingerprint as 16 hex digits, component_id): the smallest key that links lead to, itself included."""
    folder = scratch_path(docs.sparkSession, "simhash")
    prints = written(fingerprints(docs, key, words_per_shingle), f"{folder}/prints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), f"{folder}/distinct")
    return classed(prints, distinct, links(distinct.select("fp"), radius), key).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SimilarityParams:
    """Links at a Jaccard index of word shingles, as wide fingerprints tell it."""

    similarity: float = 0.8
    words_per_shingle: int = 5
    bits: int = 512  #: of a fingerprint
    slack: float = 1.5  #: standard deviations that a pair of just that similarity may lie beyond its expected distance
    bands: int = 16  #: buckets of a text, each named by the least hashes of its shingles
    rows: int = 4  #: least hashes that name a bucket

    @property
    def radius(self) -> int:
        """Two sets of the same size and Jaccard index s have a cosine of 2 s / (1 + s); a bit differs with the angle's share of pi."""
        share = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return round(self.bits * share + self.slack * math.sqrt(self.bits * share * (1 - share)))

    @property
    def found(self) -> float:
        """The share of pairs of just that similarity that meet in a bucket."""
        return 1 - (1 - self.similarity**self.rows) ** self.bands


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles; fewer words make one, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = words_per_shingle
    shingles = map(b" ".join, zip(*[words[i:] for i in range(n)])) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(7)), np.uint64, max(1, len(words) - n + 1)))


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
STEP = 2048


def wide_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """A bit is set if it is set in more than half of the hashes, each widened to ``bits`` bits; bits are counted by their bytes' values."""
    width = bits // 8
    if not len(hashes):
        return bytes(width)
    seen = np.zeros(width * 256, np.int64)
    waves = mix(np.arange(1, bits // 64 + 1, dtype=np.uint64))
    places = np.arange(width) * 256
    for at in range(0, len(hashes), STEP):
        wide = mix(hashes[at : at + STEP, None] + waves[None, :]).astype("<u8").view(np.uint8)
        seen += np.bincount((wide + places).ravel(), minlength=len(seen))
    ones = seen.reshape(width, 256) @ _BITS_OF_BYTE
    return np.packbits((ones * 2 > len(hashes)).ravel(), bitorder="little").tobytes()


def bucket_names(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One name per band, made of ``rows`` least hashes; texts without shingles share theirs."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP]
        least = np.minimum(least, (part[None, :] * factors[:, None]).min(axis=1))
    names = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, rows).T:
        names = mix(names * np.uint64(0xD6E8FEB86659FD93) + column)
    return names


def similar_texts(docs: DataFrame, params: SimilarityParams = SimilarityParams(), key: str = "doc_id") -> DataFrame:
    """Rows (key, component_id: the smallest key that links lead to, itself included), one per row of ``docs``.

    Texts link where wide fingerprints differ in at most ``params.radius`` bits.  They are compared within buckets named by least
    hashes of their shingles: blocks of fingerprint bits, as for a small radius, would not be selective at this one.
    """
    folder = scratch_path(docs.sparkSession, "similar")
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, params.words_per_shingle) for t in texts_of(batch.column(1))]
            prints = pa.array([wide_fingerprint(h, params.bits) for h in hashes], pa.binary())
            names = np.concatenate([bucket_names(h, params.bands, params.rows) for h in hashes]).view(np.int64) if hashes else np.zeros(0, np.int64)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * params.bands), pa.array(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, buckets], [key, "fp", "buckets"])

    prints = written(map_rows(docs.select(key, "text"), run, f"{key} {kind}, fp binary, buckets array<long>"), f"{folder}/prints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), f"{folder}/distinct")
    dealt = prints.select("fp", F.posexplode("buckets").alias("table", "bucket")).distinct()
    edges = links_in_buckets(dealt, params.radius, BLOCK, params.bits)
    return classed(prints.select(key, "fp"), distinct, edges, key).select(key, "component_id")


def drop_near_duplicates(docs: DataFrame, params: SimilarityParams = SimilarityParams(), key: str = "doc_id") -> DataFrame:
    """One row of each class stays: the one with the smallest key, null last.  Rows are told apart by key and text; of equal ones, one stays."""
    name = fresh(docs, "_row")
    rows = docs.withColumn(name, F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), F.md5("text").alias("text")))
    classes = similar_texts(rows.select(name, "text"), params, name)
    stay = classes.groupBy("component_id").agg(F.min(name).alias(name)).select(name)
    return rows.join(stay, name, "left_semi").dropDuplicates([name]).select(docs.columns)
