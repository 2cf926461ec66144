"""The prefix trie of conversations: which of them begin alike, how far, and what storing shared beginnings once would save.

A node of depth d is a distinct sequence of the first d turns (role, text) of a conversation; the root has depth 0.  Prefixes get
polynomial rolling fingerprints (two of 64 bits over two hashes of each turn), which numpy scans make along sorted partitions.  Rows
of one depth and fingerprint are a candidate node.  Each is verified against its representative, the member with the smallest id:
turns that hash alike must be alike, and a member's last turn and parent node must be those of the representative; so, by induction
over the depth, are all turns before.  Candidates that fail are split until none does.

The rollup to parents goes by chains.  A node belongs to the chain of its representative; a conversation's chain is the end of its
path, and hangs as a whole under every node that has the conversation as a member.  So a subtree's sum is the members' chain sums, but
for what lies above the node on its own chain: one grouping for the whole trie, however deep it is.

Defined results: null roles and texts are empty; rows with a null conversation id belong to no conversation and are left out;
turns are ordered by turn (nulls first), then role and text, so repeated rows and ties give the same trie however they lie; long texts
are taken whole; a conversation without turns is a member of the root alone; an empty table has no nodes, not even a root;
other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import delete_path, joined_by_share, map_rows, scratch_path, written
from .scan import running

WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of the two fingerprints (odd numbers).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NODE = ["depth", "f1", "f2", "part"]
PARENT = ["p1", "p2", "parent_part"]
TURN = ["x1", "x2", "variant"]


@dataclass(frozen=True)
class TrieParams:
    hash_bits: int = 64  #: of a turn's hashes; fewer give collisions, for tests


def _texts(conversations: DataFrame) -> DataFrame:
    named = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")}
    return conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", named["role"], named["text"])


def rebuilt(conversations: DataFrame, span: int = 20, heads: int = 4, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: of every id c, the first h turns of c - c mod ``span``, then its own but its first h;
    h = crc32(c) mod ``heads``.  Gives turns (conv_id, source, turn, role, text) to be ordered by source and turn, and all ids (conv_id).

    ``folder`` gets what has to be written; it must stay while the result is used.
    """
    folder = folder or scratch_path(conversations.sparkSession, "rebuilt")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    rows = running(_texts(conversations), "conv_id", order, {}, "place", f"{folder}/places").withColumn("at", F.col("place") - 1)
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(span))
    ids = written(rows.select("conv_id").distinct(), f"{folder}/ids")
    own = rows.where(F.col("at") >= taken).select("conv_id", F.lit(1).alias("source"), F.col("at").alias("turn"), "role", "text")
    first = rows.where((F.col("at") < heads - 1) & (F.pmod(F.col("conv_id"), F.lit(span)) == 0))
    first = first.select(F.col("conv_id").alias("base"), F.col("at").alias("turn"), "role", "text")
    wanted = ids.where(taken > 0).select("conv_id", base.alias("base"), F.explode(F.sequence(F.lit(0).cast("bigint"), taken - 1)).alias("turn"))
    head = wanted.join(first, ["base", "turn"]).select("conv_id", F.lit(0).alias("source"), "turn", "role", "text")
    return written(own.unionByName(head), f"{folder}/turns"), ids


def _variants(turns: DataFrame) -> DataFrame | None:
    """Turns that hash alike but are not alike: rows (x1, x2, role, text, variant), or None if there are none."""
    groups = turns.groupBy("x1", "x2").agg(F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1"))
    mixed = groups.where((F.col("r0") != F.col("r1")) | (F.col("t0") != F.col("t1"))).select("x1", "x2")
    if mixed.isEmpty():
        return None
    each = turns.join(mixed, ["x1", "x2"]).select("x1", "x2", "role", "text").distinct()
    return each.withColumn("variant", F.row_number().over(W.partitionBy("x1", "x2").orderBy("role", "text")).cast("bigint") - 1)


def _hashed(turns: DataFrame, order: list[str], params: TrieParams) -> DataFrame:
    """Numbers in the place of texts: rows (conv_id, order, x1, x2, variant, words, mix1, mix2)."""
    keep = F.lit(-1 if params.hash_bits >= 64 else (1 << params.hash_bits) - 1).cast("bigint")
    hashed = turns.select(
        "conv_id",
        *order,
        "role",
        "text",
        F.xxhash64("role", "text").bitwiseAND(keep).alias("x1"),
        F.xxhash64(F.lit(1), "text", "role").bitwiseAND(keep).alias("x2"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )
    variants = _variants(hashed)
    if variants is None:
        marked = hashed.withColumn("variant", F.lit(0).cast("bigint"))
    else:
        marked = hashed.join(variants, ["x1", "x2", "role", "text"], "left").fillna(0, "variant")
    return marked.select("conv_id", *order, *TURN, "words")


def _members(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation and depth: its prefix, the prefix before, and the turn between."""
    none = [F.lit(0).cast("bigint").alias(c) for c in ("f1", "f2", "part", "p1", "p2", "parent_part", *TURN, "words")]
    roots = ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), *none)
    zero = F.lit(0).cast("bigint")
    turns = numbered.select("conv_id", "depth", "f1", "f2", zero.alias("part"), "p1", "p2", zero.alias("parent_part"), *TURN, "words")
    return roots.unionByName(turns)


def _split(members: DataFrame, folder: str) -> DataFrame:
    """Verify candidate nodes against their representatives and split those that fail, until none does."""
    facts = [*PARENT, *TURN]
    turn = 0
    while True:
        sides = [f(c).alias(f"{n}_{c}") for c in facts for n, f in (("least", F.min), ("most", F.max))]
        unlike = F.lit(False)
        for c in facts:
            unlike = unlike | (F.col(f"least_{c}") != F.col(f"most_{c}"))
        failed = members.groupBy(*NODE).agg(*sides).where(unlike).select(*NODE)
        if failed.isEmpty():
            return members
        turn += 1
        kinds = members.join(failed, NODE, "left_semi").select(*NODE, *facts).distinct()
        # each kind of member but the first gets a number that no node has yet
        named = written(kinds.withColumn("to", F.monotonically_increasing_id() + (turn << 50)), f"{folder}/kinds-{turn}")
        moved = members.join(named, [*NODE, *facts], "left").withColumn("part", F.coalesce("to", "part")).drop("to")
        moved = written(moved, f"{folder}/moved-{turn}")
        parents = moved.where(F.col("part") != 0).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("part").alias("of"))
        again = moved.join(parents, ["conv_id", "depth"], "left").withColumn("parent_part", F.coalesce("of", F.lit(0))).drop("of")
        members = written(again, f"{folder}/members-{turn}")


def _digests(ends: DataFrame) -> DataFrame:
    """Of rows (node, conv_id): rows (node, ends_sha256), the digest of the node's ascending, comma-joined ids.

    Ids are joined within ranges, so that a node at which most conversations end takes no more memory than another; only the digest
    itself, which is sequential, runs over one node's ranges in one stream.
    """
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = ends.repartitionByRange(parts, *NODE, "conv_id").withColumn("range", F.spark_partition_id())
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    joined = ranged.groupBy(*NODE, "range").agg(listed.alias("ids"))
    placed = joined.repartition(parts, *NODE).sortWithinPartitions(*NODE, "range")

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
            yield _rows(out)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    return map_rows(placed.select(*NODE, "ids"), digest, ", ".join(f"{c} bigint" for c in NODE) + ", ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * len(NODE), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, order: list[str], ids: DataFrame, params: TrieParams = TrieParams(), folder: str | None = None) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the conversations ``ids``
    (conv_id, each once), whose turns (conv_id, role, text, neither null) are ordered by the columns ``order``.

    A node's conv_id is its smallest member; ``saved_tokens`` sums (members - 1) * words of the last turn over its subtree.
    ``folder`` gets what has to be written; it must stay while the result is used.
    """
    folder = folder or scratch_path(turns.sparkSession, "trie")
    hashed = _hashed(turns, order, params)
    mixed = {f"m{i}": _mix(F.col(f"x{i}"), F.col("variant"), i).alias(f"m{i}") for i in (1, 2)}
    sums = {f"f{i}": (f"m{i}", BASES[i - 1]) for i in (1, 2)}
    placed = running(hashed.select("*", *mixed.values()), "conv_id", [F.col(c) for c in order], sums, "depth", f"{folder}/prefixes", {"p1": "f1", "p2": "f2"})
    members = _members(placed, ids)
    members = _split(written(members, f"{folder}/members"), folder)

    least = [F.min(c).alias(c) for c in (*PARENT, "words")]
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *least)
    nodes = written(nodes, f"{folder}/nodes")
    parent = [(F.col("depth") - 1).alias("depth"), *[F.col(c).alias(n) for c, n in zip(PARENT, NODE[1:])]]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").fillna(0, "n_children"), f"{folder}/children")

    # every node's own value, summed up along the chain of its representative
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    summed = running(own, "conv_id", [F.col("depth")], {"upto": ("own", 1)}, "_place", f"{folder}/chains", {"above": "upto"})
    above = summed.select("conv_id", "depth", "above")
    chains = own.groupBy("conv_id").agg(F.sum("own").alias("chain"), F.max("leaf").alias("leaf"))
    last = members.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"))
    chains = written(chains.join(last, "conv_id", "right").fillna(0, ["chain", "leaf"]).withColumnRenamed("depth", "last"), f"{folder}/conversations")
    credited = joined_by_share(members.select("conv_id", *NODE), chains, ["conv_id"], "n", members.count())
    sums = credited.groupBy(*NODE).agg(F.sum("chain").alias("under"), F.sum("leaf").alias("n_leaves"))
    ended = credited.where(F.col("depth") == F.col("last")).select(*NODE, "conv_id")
    digests = _digests(ended)

    known = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(n).alias(c) for c, n in zip(PARENT, NODE[1:])], "n_children")
    below = nodes.where("depth > 0").select(*NODE, *PARENT)
    total = nodes.count()
    named = joined_by_share(below, known, ["depth", *PARENT], "n_children", total).select(*NODE, "parent_conv_id")
    whole = nodes.join(sums, NODE).join(digests, NODE, "left").join(named, NODE, "left").join(above, ["conv_id", "depth"])
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("under") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _mix(x: Column, variant: Column, i: int) -> Column:
    """What stands for a turn in the sums: its hash, and for the rare others of the same hash another one."""
    return F.when(variant == 0, x).otherwise(F.xxhash64(F.lit(i), x, variant))


def conversation_trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """The trie of the rebuilt conversations, written; what was needed on the way goes."""
    spark = conversations.sparkSession
    folder = scratch_path(spark, "conversations")
    turns, ids = rebuilt(conversations, folder=f"{folder}/rebuilt")
    found = written(prefix_trie(turns, ["source", "turn"], ids, params, f"{folder}/trie"), scratch_path(spark, "conversation-trie"))
    delete_path(spark, folder)
    return found


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: " + _CRC_STEP + "))"
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS j,
           coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - ((c % 20) + 20) % 20 AS b, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, 0 AS s, j, role, text FROM i JOIN (SELECT c AS b, j, role, text FROM t) USING (b) WHERE j < h
      UNION ALL SELECT c, 1, j, role, text FROM t JOIN i USING (c) WHERE j >= h),
l AS (SELECT c, list({{'r': role, 't': text}} ORDER BY s, j) AS x FROM r GROUP BY c),
m AS (SELECT c, d, len(x) AS n, CASE WHEN d = 0 THEN NULL ELSE x[d].t END AS last, sha256(list_slice(x, 1, d)::JSON::VARCHAR) AS p, CASE WHEN d > 0 THEN sha256(list_slice(x, 1, d - 1)::JSON::VARCHAR) END AS q
      FROM (SELECT c, coalesce(x, []) AS x, unnest(range(0, coalesce(len(x), 0) + 1)) AS d FROM (SELECT DISTINCT c FROM t) LEFT JOIN l USING (c))),
v AS (SELECT d, p, any_value(q) AS q, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')), 0) AS own,
      coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (d, p)),
u AS (SELECT m.d, m.p, sum(w.own) AS saved, sum((w.n_children = 0)::INT) AS leaves FROM w JOIN m ON m.c = w.c AND m.d <= w.d GROUP BY m.d, m.p)
SELECT w.c AS conv_id, w.d AS depth, a.c AS parent_conv_id, w.n_convs, w.n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u USING (d, p) LEFT JOIN w a ON a.d = w.d - 1 AND a.p = w.q
"""
