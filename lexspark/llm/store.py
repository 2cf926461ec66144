"""Token-id output as a content-addressed store.

Every document's id stream is cut where a rolling hash of the last ids meets a mask (content-defined cuts, so that shared
passages give equal chunks), chunks are named by a digest of their bytes and stored once, a document is a *recipe* (the list of
its chunks), and Merkle roots over chunks, documents and segments let a reader verify what it reads.

Files, all Parquet, in one folder of the shared file system:

* ``chunks``: digest, n, width (bytes per id), data (little-endian ids); each digest once
* ``recipes``: seg, doc_id, row (place in its segment), n_tokens, root, recipe (array of digest, n, tail = ids after the chunk);
  segments ascend by doc_id
* ``manifest``: level, seg, at, documents, ids, root: a Merkle tree over the recipes in order.  A node of level 0 covers up to
  ``FAN`` recipes of a segment, one of a higher level up to ``FAN`` nodes, the last level has one node

Reading back checks each chunk against its digest, each recipe against its Merkle root, and the tree recomputed from the recipes
against the manifest: a lost, added, altered or reordered recipe and a damaged manifest raise.  The CRC-32 of a document is
composed from the CRC-32 of its stored chunks: shifted by the ids that follow and combined by exclusive or, so no document's ids
have to be moved; ``read_ids`` reassembles whole id streams where they are wanted.

Defined results: null text is empty text (just the end id); an empty table gives an empty store; repeated rows and repeated keys
keep one recipe each; null keys sort first; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.split import BYTE_CHARS
from .bpe import share_file
from .chunks import PartTable
from .common import map_rows, remembered, scratch_path, written


#: Recipes of a segment, about, and the most nodes under a node of the manifest's tree.
SEGMENT = 4_000_000
FAN = 4096


@dataclass(frozen=True)
class ChunkParams:
    least: int = 64  #: ids
    mean_bits: int = 8  #: a cut every 2**mean_bits ids on average
    most: int = 1024


#: Latin-1 characters to the printable ones that stand for bytes.
BYTES = dict(enumerate(BYTE_CHARS))
RECIPE = "array<struct<digest:binary,n:int,tail:long>>"


def gear_table(size: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random number for each id modulo ``size``, from a multiplicative rule."""
    x = np.arange(1, size + 1, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


GEAR = gear_table()


#: Ids that the rolling hash covers.
REACH = 16


def _marks(ids: np.ndarray, params: ChunkParams) -> np.ndarray:
    """Ends of the runs of ``REACH`` ids (at the start: of fewer) whose rolling hash meets the mask."""
    h = GEAR[ids & 0xFFFF]
    for reach in (1, 2, 4, 8):  # doubling: after it, h[i] covers the last 2 * reach ids
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint64(reach)
        h = wider
    return np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << params.mean_bits) - 1) == 0) + 1


def _ends(marks: list[int], size: int, params: ChunkParams) -> list[int]:
    ends, start = [], 0
    for end in [*marks, size]:
        while end - start > params.most:
            start += params.most
            ends.append(start)
        if end - start >= params.least or end == size and end > start:
            ends.append(end)
            start = end
    return ends


def cut_points(ids: np.ndarray, params: ChunkParams = ChunkParams()) -> list[int]:
    """Ends of the chunks: the rolling hash of the last 16 ids meets the mask; chunks are ``least`` to ``most`` ids long."""
    return _ends(_marks(ids, params).tolist(), len(ids), params)


def cut_all(ids: np.ndarray, ends: np.ndarray, params: ChunkParams = ChunkParams()) -> list[list[int]]:
    """The cut points of every document, whose ids end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    if params.least < REACH:
        return [cut_points(ids[a:b], params) for a, b in zip(starts.tolist(), ends.tolist())]
    # the hash reaches into the document before only where a chunk would be too short
    marks = _marks(ids, params)
    first, last = np.searchsorted(marks, starts, "right").tolist(), np.searchsorted(marks, ends, "right").tolist()
    own = (marks - np.repeat(starts, np.array(last, np.int64) - np.array(first, np.int64))).tolist()
    return [_ends(own[a:b], size, params) for a, b, size in zip(first, last, (ends - starts).tolist())]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary Merkle tree; an odd node moves up unchanged; no leaves: the digest of nothing."""
    level = leaves or [b""]
    level = [hashlib.blake2b(b"\x00" + x, digest_size=16).digest() for x in level]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return width, ids.astype("<u2" if width == 2 else "<u4").tobytes()


def chunk_digest(width: int, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=bytes([width])).digest()


def unpack(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")


class LibraryEncoder:
    """The tokenizers library, asked once per distinct part of the texts that is not remembered, and by its parts: splitter, then model.

    The library's own call spends most of its time around the model; a word of letters needs no splitter, as it is one match.
    """

    #: Bound of the remembered parts; each takes some 200 bytes.
    MOST_PARTS = 1_500_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        splitter = self.library.pre_tokenizer
        self.simple = self.library.normalizer is None and type(splitter).__name__ == "ByteLevel" and splitter.use_regex and not splitter.add_prefix_space
        self.blank = self.library.pre_tokenizer.pre_tokenize_str(" a")[0][0][0] if self.simple else " "
        self.table = PartTable(self._encode_parts, self.MOST_PARTS)

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part as little-endian 32-bit numbers."""
        blank, split, tokenize = self.blank, self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        ids, ends = [], [0]
        for part in parts:
            text = part.decode()
            word = text[1:] if text[0] == " " else text
            if word.isalpha():
                piece = text if text is word else blank + word
                if not word.isascii():
                    piece = part.decode("latin-1").translate(BYTES)
                ids += [t.id for t in tokenize(piece)]
            else:
                ids += [t.id for m, _ in split(text) for t in tokenize(m)]
            ends.append(4 * len(ids))
        data = array("I", ids).tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with the end id, end to end; and where each text's ids end."""
        # the library looks for special tokens before it splits
        apart = np.full(len(texts), not self.simple)
        for token in self.special:
            apart |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(apart)
        ids, ends = self.table.encode(pc.if_else(pa.array(apart), "", texts) if len(rows) else texts)
        if len(rows):
            whole = [np.array(self.library.encode(texts[i].as_py() or "", add_special_tokens=False).ids, np.uint32) for i in rows.tolist()]
            sizes = np.zeros(len(texts), np.int64)
            sizes[rows] = [len(w) for w in whole]
            ids, ends = np.insert(ids, np.repeat(ends[rows], sizes[rows]), np.concatenate(whole)), ends + np.cumsum(sizes)
        return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)

    def encode(self, text: str, end_id: int) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()), end_id)[0]


_of_this_worker: dict[str, LibraryEncoder] = remembered("store")


def worker_encoder(path: str) -> LibraryEncoder:
    if path not in _of_this_worker:
        _of_this_worker.clear()
        _of_this_worker[path] = LibraryEncoder(path)
    return _of_this_worker[path]


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", params: ChunkParams = ChunkParams()) -> DataFrame:
    """Rows (key, n_tokens, root, recipe, chunks): one per document; ``chunks`` holds those that the task has not sent yet."""
    name = share_file(docs, tokenizer_path)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(SparkFiles.get(name))
        sent: set[bytes] = set()
        for batch in batches:
            every, ends = encoder.encode_batch(batch.column(1), end_id)
            roots, digests, sizes, tails, recipe_ends = [], [], [], [], [0]
            new, chunk_ends = [], [0]  # new: digest, n, width, data
            narrow = every.astype("<u2").tobytes() if not len(every) or int(every.max()) < 1 << 16 else None
            at = 0
            for cuts in cut_all(every, ends, params):
                first, begin, size = at, len(digests), cuts[-1]
                for end in cuts:
                    end += first
                    width, data = (2, narrow[2 * at : 2 * end]) if narrow is not None else pack(every[at:end])
                    digest = chunk_digest(width, data)
                    digests.append(digest)
                    sizes.append(end - at)
                    tails.append(first + size - end)
                    if digest not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(digest)
                        new.append((digest, end - at, width, data))
                    at = end
                roots.append(merkle_root(digests[begin:]))
                recipe_ends.append(len(digests))
                chunk_ends.append(len(new))
            recipes = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tails, pa.int64())], ["digest", "n", "tail"])
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            chunks = pa.StructArray.from_arrays([pa.array([c[i] for c in new], k) for i, k in enumerate(kinds)], ["digest", "n", "width", "data"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ends, prepend=0), pa.int64()),
                    pa.array(roots, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(recipe_ends, pa.int32()), recipes),
                    pa.ListArray.from_arrays(pa.array(chunk_ends, pa.int32()), chunks),
                ],
                [key, "n_tokens", "root", "recipe", "chunks"],
            )

    schema = f"{key} {kind}, n_tokens long, root binary, recipe {RECIPE}, chunks array<struct<digest:binary,n:int,width:int,data:binary>>"
    return map_rows(docs.select(key, "text"), run, schema, "store")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, key: str = "doc_id", params: ChunkParams = ChunkParams()) -> str:
    """Encode, cut, and write the store; returns its folder."""
    from .common import delete_path

    spark = docs.sparkSession
    encoded_path = f"{folder}/_encoded"
    encode_chunks(docs, tokenizer_path, end_id, key, params).write.option("compression", "zstd").parquet(encoded_path)
    encoded = spark.read.parquet(encoded_path)
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.*").dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-encoded.count() // SEGMENT))
    recipes = encoded.select(key, "n_tokens", "root", "recipe")
    ordered = recipes.repartitionByRange(parts, F.asc_nulls_first(key)).sortWithinPartitions(F.asc_nulls_first(key), "root")
    numbered = ordered.withColumn("seg", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.parquet(f"{folder}/recipes")
    tree(spark.read.parquet(f"{folder}/recipes"), key).write.parquet(f"{folder}/manifest")
    delete_path(spark, encoded_path)
    return folder


def tree(recipes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (level, seg, at, documents, ids, root) of the Merkle tree over recipes in order; at most ``FAN`` rows meet in a group."""
    spark = recipes.sparkSession
    folder = scratch_path(spark, "merkle")
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.hex(F.col(key).cast("string").cast("binary")), F.lit("null")), "row", "n_tokens", F.hex("root")).cast("binary"), 256)
    nodes = recipes.select("seg", F.col("row").alias("at"), F.lit(1).cast("bigint").alias("documents"), F.col("n_tokens").alias("ids"), leaf.alias("root"))
    levels: list[DataFrame] = []
    while True:
        up = nodes.withColumn("to", F.floor(F.col("at") / FAN)).groupBy("seg", "to").agg(
            F.sum("documents").alias("documents"),
            F.sum("ids").alias("ids"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda r: r["root"]), "").cast("binary"), 256).alias("root"),
        )
        up = written(up.select("seg", F.col("to").alias("at"), "documents", "ids", "root"), f"{folder}/{len(levels)}")
        levels.append(up.select(F.lit(len(levels)).alias("level"), "*"))
        far, last = up.agg(F.max("at"), F.max("seg")).first()
        if not far and not last:
            return reduce(DataFrame.unionByName, levels)
        nodes = up if far else up.select(F.lit(0).alias("seg"), F.col("seg").cast("bigint").alias("at"), "documents", "ids", "root")


# --- CRC-32 of concatenations -------------------------------------------------------------------------------------------


def _crc_step(columns: list[int], value: int) -> int:
    out = 0
    for bit in range(32):
        if value >> bit & 1:
            out ^= columns[bit]
    return out


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """For each k, byte-wise lookup tables of appending 4 * 2**k zero bytes to a message, as it changes the CRC-32."""
    one_bit = [0xEDB88320] + [1 << (b - 1) for b in range(1, 32)]
    columns = one_bit
    for _ in range(5):  # 2, 4, 8, 16, 32 bits
        columns = [_crc_step(columns, columns[b]) for b in range(32)]
    tables = []
    for _ in range(bits):
        tables.append(np.array([[_crc_step(columns, byte << (8 * lane)) for byte in range(256)] for lane in range(4)], np.uint32))
        columns = [_crc_step(columns, columns[b]) for b in range(32)]
    return tables


_tables: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """The part that a chunk's CRC-32 has in the whole message's, given how many 4-byte ids follow it."""
    if not _tables:
        _tables.extend(_shift_tables())
    crc, ids_after = crc.astype(np.uint32), ids_after.astype(np.int64)
    for k, table in enumerate(_tables):
        due = (ids_after >> k) & 1 == 1
        if due.any():
            c = crc[due]
            crc[due] = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
        elif not (ids_after >> k).any():
            break
    return crc


# --- reading ------------------------------------------------------------------------------------------------------------


def _values(column: pa.Array) -> list:
    """Like ``to_pylist``, for flat columns and several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def checked_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (digest, n, crc) of all chunks; a chunk that differs from its digest raises."""

    def run(batches):
        for batch in batches:
            crcs = []
            for digest, n, width, data in zip(*[_values(batch.column(c)) for c in ("digest", "n", "width", "data")]):
                ids = unpack(width, data)
                if chunk_digest(width, data) != digest or len(ids) != n:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64())], ["digest", "crc"])

    return map_rows(spark.read.parquet(f"{folder}/chunks"), run, "digest binary, crc long")


def checked_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct recipes (root, recipe); any recipe that differs from its Merkle root raises."""

    def run(batches):
        for batch in batches:
            recipes = batch.column("recipe")
            digests, ends = _values(recipes.flatten().field("digest")), np.cumsum(pc.fill_null(recipes.value_lengths(), 0).to_numpy()).tolist()
            for root, start, end in zip(_values(batch.column("root")), [0, *ends], ends):
                if merkle_root(digests[start:end]) != root:
                    raise ValueError(f"recipe {root.hex()} is damaged")
            yield batch

    return map_rows(spark.read.parquet(f"{folder}/recipes").select("root", "recipe"), run, f"root binary, recipe {RECIPE}").dropDuplicates(["root"])


def check_manifest(spark: SparkSession, folder: str, key: str = "doc_id") -> None:
    """Raises where the tree over the recipes differs from the manifest."""
    names = ["level", "seg", "at", "documents", "ids", "root"]
    now = tree(spark.read.parquet(f"{folder}/recipes"), key).select(*names)
    stored = spark.read.parquet(f"{folder}/manifest").select(*names)
    odd = now.withColumn("n", F.lit(1)).unionByName(stored.withColumn("n", F.lit(-1))).groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")
    if bad := odd.orderBy("level", "seg", "at").first():
        raise ValueError(f"the recipes differ from the manifest: level {bad['level']}, segment {bad['seg']}, node {bad['at']}")


def document_facts(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    check_manifest(spark, folder, key)
    used = checked_recipes(spark, folder).select("root", F.explode("recipe").alias("c")).select("root", "c.digest", "c.n", "c.tail")
    parts = used.join(checked_chunks(spark, folder), "digest").select("root", "n", "tail", "crc")

    def shift(batches):
        for batch in batches:
            moved = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), batch.column("tail").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("n"), pa.array(moved.astype(np.int64))], ["root", "n", "crc"])

    whole = map_rows(parts, shift, "root binary, n int, crc long").groupBy("root").agg(F.sum("n").alias("found"), F.bit_xor("crc").alias("ids_crc32"))
    # in a table of its own, so that tasks with one frequent root can be split
    whole = written(whole, scratch_path(spark, "id-store-crc"))
    recipes = spark.read.parquet(f"{folder}/recipes").select("seg", key, "row", "n_tokens", "root")
    # one row per segment (a partition count, not data) is ordered in one task
    sizes = spark.read.parquet(f"{folder}/manifest").where("level = 0").groupBy("seg").agg(F.sum("ids").alias("ids"))
    before = sizes.select("seg", F.coalesce(F.sum("ids").over(W.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(W.partitionBy("seg").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    started = recipes.join(F.broadcast(before), "seg").withColumn("start", F.col("base") + F.coalesce(within, F.lit(0)))
    joined = started.join(whole, "root", "left")
    ids_crc32 = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe has lost chunks")).cast("long"))
    return joined.select(key, "start", "n_tokens", ids_crc32.alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Whole id streams: (key, seg, row, ids).  A document's ids are gathered in one row, bounded by its own length; damage raises."""
    check_manifest(spark, folder, key)
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "width", "data")
    parts = spark.read.parquet(f"{folder}/recipes").select(key, "seg", "row", "root", F.explode_outer("recipe").alias("c")).select(key, "seg", "row", "root", "c.digest", "c.tail")
    gathered = parts.join(chunks, "digest", "left").groupBy(key, "seg", "row", "root").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("tail")).alias("at"), "digest", "width", "data"))).alias("parts")
    )
    kind = gathered.schema[0].dataType.simpleString()

    def join(batches):
        for batch in batches:
            whole = []
            for root, parts in zip(batch.column("root").to_pylist(), batch.column("parts").to_pylist()):
                if any(p["data"] is None or chunk_digest(p["width"], p["data"]) != p["digest"] for p in parts) or merkle_root([p["digest"] for p in parts]) != root:
                    raise ValueError(f"the ids of recipe {root.hex()} are damaged")
                whole.append(np.concatenate([unpack(p["width"], p["data"]) for p in parts]).astype(np.int64))
            lengths = np.cumsum([0, *map(len, whole)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(whole) if whole else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), ids], [key, "seg", "row", "ids"])

    return map_rows(gathered, join, f"{key} {kind}, seg int, row long, ids array<long>")


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    folder = write_store(docs, tokenizer_path, end_id, scratch_path(docs.sparkSession, "id-store"), key)
    return document_facts(docs.sparkSession, folder, key)
