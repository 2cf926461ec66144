"""Alignment of the tokens that two tokenizers give the same text.

A is a byte-level BPE of the tokenizers library, which gets a space and the text; B is a sentencepiece model, which adds that space
itself.  A token covers a range of the bytes of space and text.  Each side's tokens are exploded, their ends are running sums of
lengths, and ends at which both sides have a token (an equi-join on document and end) are the cuts.  The tokens between two cuts are a
group.  The two tokens that end at a cut are linked; how often an id pair is linked is counted over the whole corpus.

A row holds its document whole, so explosion, running sums and join need no other row: they are array operations over the Arrow batch
in which a text is encoded, and no text or token moves.  In a batch the texts' bytes stand end to end, so document and end are one
number, and the join looks it up.  Links are written; they are exploded, counted and scored by Spark: to give each the count of its
pair, pairs with a ten-thousandth of all links or more are broadcast, and only links of rarer pairs are shuffled.  A row's place in
the table, not its key, tells it apart.

Defined results, one row per document: a null or empty text, and one whose tokens' bytes are not those of space and text on either side
(U+2581 in it, say), has no tokens: zeros, and an empty ``groups`` and ``groups_sha256``; the strings of special tokens in a text are
plain text; texts are encoded whole, however long; ties for a B id's best pair all count; repeated rows and keys and null keys keep
one row each; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.split import CHAR_BYTES
from .bpe import share_file
from .chunks import PartTable
from .common import SHARES, delete_path, map_rows, remembered, scratch_path, written

BLANK = "▁"
#: Bytes of text that are aligned at once, about: arrays of their tokens take some hundred times as much.
PORTION = 1 << 20


def byte_level_token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; those of special tokens are their strings'."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    size = library.get_vocab_size()
    named = [library.id_to_token(i) or "" for i in range(size)]
    return [bytes(CHAR_BYTES[c] for c in t) if all(c in CHAR_BYTES for c in t) else t.encode() for t in named]


def piece_token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(named)]


# --- alignment of the texts of a batch ---------------------------------------------------------------------------------------------


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A, and of B, that end where one of the other side ends, in order; each two are linked.

    The tokens, of these sizes and none of them empty, are those of the same texts end to end, so a running sum tells text and end.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.zeros((2, (int(a_ends[-1]) if len(a_ends) else 0) + 1), bool)
    ends[0, a_ends] = ends[1, b_ends] = True
    return np.flatnonzero(ends[1, a_ends]), np.flatnonzero(ends[0, b_ends])


MARKS = b",|;"


def written_ids(count: int) -> np.ndarray:
    """For each of ``MARKS`` and each id, eight bytes: its decimal digits, the mark and zeros."""
    if count > 10_000_000:
        raise ValueError("ids of more than seven digits")
    return np.array([[b"%d%c" % (i, mark) for i in range(count)] for mark in MARKS], "S8").view(np.uint64)


def group_text(a_written: np.ndarray, a_ids: np.ndarray, a_cut: np.ndarray, b_written: np.ndarray, b_ids: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the bytes of all groups, and how many of them the first 0, 1, ... tokens have."""
    a_size, b_size = np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1)
    marks = np.zeros(len(a_ids), np.intp), np.zeros(len(b_ids), np.intp)
    marks[0][a_cut], marks[1][b_cut] = 1, 2
    made = np.empty(len(a_ids) + len(b_ids), np.uint64)
    made[np.arange(len(a_ids)) + np.repeat(b_cut + 1 - b_size, a_size)] = a_written[marks[0], a_ids]
    made[np.arange(len(b_ids)) + np.repeat(a_cut + 1, b_size)] = b_written[marks[1], b_ids]
    data = made.view(np.uint8)
    used = data != 0
    sizes = np.bitwise_count(used.view(np.uint64))
    return data[used], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


# --- encoding ------------------------------------------------------------------------------------------------------------------


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places where a text begins, or a space that follows another byte: no piece of the model reaches over them."""
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins[:-1])


class PieceEncoder:
    """The sentencepiece library, asked once per distinct word that is not remembered, where its pieces hold spaces only at their front."""

    MOST_PARTS = 400_000

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.lone = self.library.piece_to_id(BLANK)
        self.by_words = not any(BLANK in p.lstrip(BLANK) for p in pieces) and pieces[self.lone] == BLANK
        self.table = PartTable(self._encode_parts, self.MOST_PARTS, word_starts, portion=1 << 21)

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, which begins with the space that the library adds, but to nothing."""
        listed = self.library.encode([p[1:].decode() for p in parts], num_threads=1)
        return [np.array(ids if len(p) > 1 else [self.lone], np.uint32).tobytes() for p, ids in zip(parts, listed)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that begin with a space, the ids end to end, and where each text's ids end."""
        if self.by_words:
            return self.table.encode(texts)
        return _listed(self.library.encode([t[1:] for t in texts.to_pylist()], num_threads=1))


def _listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for own in ids for i in own], np.uint32), np.cumsum([len(own) for own in ids], dtype=np.int64)


class BothEncoders:
    def __init__(self, a_path: str, b_path: str):
        from .store import LibraryEncoder

        self.a, self.b = LibraryEncoder(a_path), PieceEncoder(b_path)
        self.a.library.encode_special_tokens = True
        self.a.table = PartTable(self.a._encode_parts, PieceEncoder.MOST_PARTS, portion=1 << 21)
        self.whole = not self.a.simple
        self.tokens = [pa.array(t, pa.large_binary()) for t in (byte_level_token_bytes(a_path), piece_token_bytes(b_path))]
        self.sizes = [pc.binary_length(t).to_numpy() for t in self.tokens]
        self.written = [written_ids(len(t)) for t in self.tokens]

    def _same(self, side: int, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts' tokens have the bytes of the text."""
        if not len(ids):
            return np.diff(offsets) == 0
        joined = self.tokens[side].take(pa.array(ids))
        _, where, held = joined.buffers()
        stops = np.frombuffer(where, np.int64)[: len(ids) + 1][np.concatenate([[0], ends])]
        own = np.frombuffer(held, np.uint8)[: stops[-1]] if held is not None else np.zeros(0, np.uint8)
        if np.array_equal(stops, offsets) and np.array_equal(own, data):
            return np.ones(len(ends), bool)
        same = np.diff(stops) == np.diff(offsets)
        for t in np.flatnonzero(same).tolist():
            same[t] = np.array_equal(own[stops[t] : stops[t + 1]], data[offsets[t] : offsets[t + 1]])
        return same

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B, the ids of all texts end to end, and where each text's ids begin and the last ones end; texts without tokens have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        _, where, held = spaced.buffers()
        n = len(spaced)
        offsets = np.frombuffer(where, np.int32)[spaced.offset : spaced.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(held, np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        made = [_listed([e.ids for e in self.a.library.encode_batch(spaced.to_pylist(), add_special_tokens=False)]) if self.whole else self.a.table.encode(spaced), self.b.encode(spaced)]
        good = self._same(0, *made[0], data, offsets) & self._same(1, *made[1], data, offsets)
        out = []
        for ids, ends in made:
            counts = np.diff(ends, prepend=0)
            kept = ids if good.all() else ids[np.repeat(good, counts)]
            out.append((kept, np.concatenate([[0], np.cumsum(counts * good)])))
        return out

    def align(self, texts: pa.Array, whole: bool = False) -> list[pa.Array]:
        """Columns n_a, n_b, n_groups, groups_sha256, links and, if ``whole``, groups of the texts."""
        (a_ids, a_at), (b_ids, b_at) = self.encode(texts)
        a_cut, b_cut = cuts(self.sizes[0][a_ids], self.sizes[1][b_ids])
        links = a_ids[a_cut].astype(np.int64) << 32 | b_ids[b_cut]
        at = np.searchsorted(a_cut, a_at)
        data, upto = group_text(self.written[0], a_ids, a_cut, self.written[1], b_ids, b_cut)
        stops = upto[a_at + b_at]
        groups = [data[x : max(x, y - 1)] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]  # the last group has no mark after it
        digests = pa.array([sha256(g).hexdigest() if len(g) else "" for g in groups], pa.string())
        listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(links))
        counts = [pa.array(np.diff(x)) for x in (a_at, b_at, at)]
        return [*counts, digests, listed, *([pa.array([bytes(g).decode() for g in groups], pa.string())] if whole else [])]


_of_this_worker: dict[tuple, BothEncoders] = remembered("alignment")


def worker_encoders(*paths: str) -> BothEncoders:
    if paths not in _of_this_worker:
        _of_this_worker.clear()
        _of_this_worker[paths] = BothEncoders(*paths)
    return _of_this_worker[paths]


def portions(batch: pa.RecordBatch, text: int):
    """The rows of the batch in parts of ``PORTION`` bytes of column ``text``, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(upto // PORTION, prepend=0)), [len(upto)]])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a < b:
            yield batch.slice(a, b - a)


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``align``, not written: it moves no row, and rows are told apart only once it is written."""
    names = share_file(docs, a_path), share_file(docs, b_path)
    kind = docs.select(key).schema[0].dataType.simpleString()
    made = ["n_a", "n_b", "n_groups", "groups_sha256", "links", *(["groups"] if whole else [])]

    def run(batches):
        encoders = worker_encoders(*map(SparkFiles.get, names))
        for batch in batches:
            for part in portions(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *encoders.align(part.column(2), whole)], ["key", "_row", *made])

    schema = f"key {kind}, _row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>" + (", groups string" if whole else "")
    rows = map_rows(docs.select(key, F.monotonically_increasing_id().alias("_row"), text), run, schema, "alignment")
    count = F.size("links").cast("bigint").alias("n_links")
    return rows.select(F.col("key").alias(key), "_row", "n_a", "n_b", "n_groups", count, "groups_sha256", *(["groups"] if whole else []), "links")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", whole: bool = False, folder: str | None = None) -> DataFrame:
    """Rows (key, _row, n_a, n_b, n_groups, n_links, groups_sha256, links), one per document; a link is a_id * 2**32 + b_id.

    ``whole`` adds ``groups``, the text of which ``groups_sha256`` is the digest.  The result is written to ``folder``.
    """
    folder = folder or scratch_path(docs.sparkSession, "alignment")
    return written(aligned_rows(docs, a_path, b_path, key, text, whole), f"{folder}/aligned")


# --- links of the corpus ---------------------------------------------------------------------------------------------------------


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (a_id, b_id, link, n, best): how many links hold an id pair, and whether none of the B id's pairs has more."""
    counted = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    ids = counted.select(F.shiftright("link", 32).cast("int").alias("a_id"), F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "link", "n")
    return ids.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b_id")))


def scores(aligned: DataFrame, folder: str) -> DataFrame:
    """Rows (_row, n_best, count_sum): over a document's links, those whose pair is its B id's best, and the sum of counts."""
    pairs = written(pair_counts(aligned).select("link", "n", "best"), f"{folder}/pairs")
    total = aligned.agg(F.sum("n_links")).first()[0] or 0
    links = aligned.select("_row", F.explode("links").alias("link"))
    heavy = pairs.where(F.col("n") * SHARES >= total)
    met = links.join(F.broadcast(heavy), "link", "left")
    known = [F.sum(F.when(F.col("best"), 1).otherwise(0)).alias("n_best"), F.sum("n").alias("count_sum")]
    common = met.where(F.col("n").isNotNull()).groupBy("_row").agg(*known)
    rare = met.where(F.col("n").isNull()).groupBy("_row", "link").agg(F.count(F.lit(1)).alias("times"))
    light = rare.join(pairs.where(F.col("n") * SHARES < total), "link")
    several = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    both = common.unionByName(light.groupBy("_row").agg(*several))
    return both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """One row per document: counts, digests and scores, written; what was needed on the way goes."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "alignment")
    aligned = align(docs, a_path, b_path, key, folder=folder)
    scored = scores(aligned, folder)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = aligned.join(scored, "_row", "left").select(key, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    found = written(out, scratch_path(spark, "alignment-report"))
    delete_path(spark, folder)
    return found
