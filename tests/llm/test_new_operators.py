"""Prefix trie, token alignment, exact dedup and running sums against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import alignment, entries, exactdedup, prefixtrie, scan, toxicity
from lexspark.llm.common import joined_by_share, scratch_path

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- running sums --------------------------------------------------------------------------------------------------------------


def test_running_sums(spark):
    draw = random.Random(3)
    rows = [(k, at, draw.randrange(-(1 << 63), 1 << 63)) for k, n in (("a", 700), ("b", 1), ("c", 3), ("d", 40)) for at in range(n)]
    frame = spark.createDataFrame(rows, "k string, at int, x long").repartition(7)
    base = prefixtrie.BASES[0]
    made = scan.running(frame, "k", [F.col("at")], {"s": ("x", 1), "f": ("x", base)}, "place", scratch_path(spark, "t"), {"e": "f"})
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    found = {(r.k, r.at): r for r in made.collect()}
    assert len(found) == len(rows)
    sums = collections.defaultdict(lambda: [0, 0])
    for k, at, x in sorted(rows):
        r, t = found[k, at], sums[k]
        assert (r.place, r.e) == (at + 1, wrap(t[1]))
        t[0], t[1] = t[0] + x, t[1] + x * pow(base, at, 1 << 64)
        assert (r.s, r.f) == (wrap(t[0]), wrap(t[1]))
    # one sequence holds nearly all rows and lies in several partitions
    assert spark.conf.get("spark.sql.shuffle.partitions") != "1"
    empty = scan.running(frame.limit(0), "k", [F.col("at")], {"s": ("x", 1)}, "place", scratch_path(spark, "t"))
    assert empty.count() == 0 and empty.columns == ["k", "at", "x", "place", "s"]


def test_share_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 40)], "k int, v int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = joined_by_share(left, right, ["k"], "n", 88, shares=10)
    assert sorted((r.k, r.v, r.n) for r in found.collect()) == sorted([(1, i, 50) for i in range(50)] + [(k, k, 1) for k in range(2, 40)])


# --- prefix trie ---------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + ts[zlib.crc32(str(c).encode()) % 4 :] for c, ts in own.items()}
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), children[p], sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def conversations(draw):
    rows = []
    for c in [*range(0, 64), 200, 205, 207, 1000]:  # 200 begins a span of its own, 1000 stands alone, 60 to 63 have a base
        for t in range(draw.randrange(0, 5) + (c % 7 == 0)):
            rows.append((c, t, draw.choice(["user", "system"]), draw.choice(["hi", "hi there", " a  b\tc ", "a b", ""])))
    rows += [(3, None, None, None), (3, None, "user", None), (9, 0, "user", "hi"), (9, 0, "user", "hi"), (None, 0, "user", "hi"), (None, None, None, None)]
    rows += [(41, t, "user", "hi" if t < 90 else "so " * 3000) for t in range(200)]  # much longer than the others
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_prefix_trie(spark, bits):
    rows = conversations(random.Random(8))
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, f1 int, part string").repartition(5)
    if bits < 64:  # collisions of turns and of prefixes, to be split
        rows = [r for r in rows if r[0] != 41]
        frame = frame.where("conv_id <> 41")
    found = prefixtrie.conversation_trie(frame, prefixtrie.TrieParams(hash_bits=bits)).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefixtrie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    # c = 4 has h = crc32("4") % 4 own turns dropped and no base: it may lose all of them
    one = [(4, 1, None, "only")]
    assert sorted(map(tuple, prefixtrie.conversation_trie(spark.createDataFrame(one, schema)).collect())) == sorted(brute_trie(one))


# --- token alignment -----------------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    sides = alignment.byte_level_token_bytes(A), alignment.piece_token_bytes(B)
    docs, count = [], collections.Counter()
    for key, text in rows:
        ids = (library.encode(f" {text}", add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        joined = [[s[i] for i in x] for s, x in zip(sides, ids)]
        if not text or any(b"".join(j) != f" {text}".encode() for j in joined):
            ids, joined = ([], []), [[], []]
        ends = []
        for j in joined:
            at, here = 0, {}
            for i, t in enumerate(j):
                at += len(t)
                here[at] = i
            ends.append(here)
        groups, links, first = [], [], [0, 0]
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            last = [e[cut] for e in ends]
            groups.append("|".join(",".join(map(str, x[a : b + 1])) for x, a, b in zip(ids, first, last)))
            links.append(tuple(x[b] for x, b in zip(ids, last)))
            first = [b + 1 for b in last]
        count.update(links)
        docs.append((key, len(ids[0]), len(ids[1]), groups, links))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for key, a, b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, a, b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest, ";".join(groups)))
    return out


def odd_texts(draw):
    syllables = "ha re on ti th ed in er an ou st ble nd es at en".split()
    prose = lambda n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(n))
    return [
        *[prose(80) for _ in range(20)],
        None, "", " ", "  two  blanks ", "\n\t x\n\n y", "<s> </s> <unk> <0x0A> <|endoftext|> a<|endoftext|>b", "a▁b", "é😀 世界 ß ﬁ ①", "é", "\x00\x01\x7f",
        "don't we'll 12345 --- !!!", "a b　c", "x" * 3000, prose(20_000),
    ]


def test_token_alignment(spark):
    texts = odd_texts(random.Random(4))
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None)]
    schema = "doc_id long, text string, links string, _row long, a_ids int, groups int"
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema).repartition(3)
    want = sorted(brute_alignment(rows), key=str)
    found = alignment.report(frame, A, B).collect()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == [w[:-1] for w in want]
    whole = alignment.align(frame, A, B, whole=True).collect()
    assert sorted(((r.doc_id, r.groups) for r in whole), key=str) == sorted(((w[0], w[-1]) for w in want), key=str)
    assert alignment.report(frame.limit(0), A, B).count() == 0
    assert {t for t in spark.catalog.listTables() if t.name.startswith("lexspark_tokens_")} == set()


def test_alignment_makes_no_rows_of_tokens(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(alignment, "written", lambda df, path: frames.append(df) or df)
    alignment.align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B)
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" in plan and not [name for name in ("Generate", "Window", "Exchange", "Sort", "Join") if name in plan]


def test_groups_of_a_batch():
    tokens = [b"%d" % i for i in range(12)]
    sizes = [2, 1, 1, 3, 2], [1, 1, 2, 1, 1, 1, 2]
    cut = alignment.cuts(*map(alignment.np.array, sizes))
    assert [c.tolist() for c in cut] == [[0, 2, 3, 4], [1, 2, 5, 6]]
    ids, written = [alignment.np.arange(5), alignment.np.arange(5, 12)], alignment.written_ids(len(tokens))
    data, upto = alignment.group_text(written, ids[0], cut[0], written, ids[1], cut[1])
    assert bytes(data) == b"0|5,6;1,2|7;3|8,9,10;4|11;"
    assert bytes(data[upto[3] : upto[6]]) == b"1,2|7;"


def test_rare_pairs_are_scored_by_shuffle(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(odd_texts(random.Random(5))[:20])]
    monkeypatch.setattr(alignment, "SHARES", 20)
    found = alignment.report(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in found) == [(w[0], w[5], w[6]) for w in brute_alignment(rows)]


def test_pieces_by_words_equal_the_library():
    encoder, library = alignment.PieceEncoder(B), sentencepiece.SentencePieceProcessor(model_file=B)
    assert encoder.by_words
    texts = [t for t in odd_texts(random.Random(6)) if t and "▁" not in t]
    ids, ends = encoder.encode(alignment.pa.array([f" {t}" for t in texts]))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == library.encode(texts)


# --- exact dedup ---------------------------------------------------------------------------------------------------------------


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark):
    texts = ["a b", "a  b", "a\n\tb", " a b", "a b ", None, "", " ", "\r\n", "a b", "A b", "x " * 40_000, "x  " * 40_000, *["copy"] * 60, "é", "é"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, "copy"), (7, "copy"), (None, "copy"), (None, "lone"), (None, "lone")]
    schema = "doc_id long, text string, digest string, _row long, _digest int, n int"
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema).repartition(6)
    found = exactdedup.exact_duplicates(frame).collect()
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[normal(text)].append(key)
    keep = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    want = [(k, keep[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for k, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == sorted(want, key=str)
    kept = [r for r in found if r.kept]
    assert sorted((r.text_sha256, r.doc_id) for r in kept if r.doc_id is not None) == sorted((hashlib.sha256(t.encode()).hexdigest(), k) for t, k in keep.items() if k is not None)
    assert len(kept) == len(groups)
    assert exactdedup.exact_duplicates(frame.limit(0)).count() == 0


def test_digest_index_grows_by_batches(spark, tmp_path):
    folder = str(tmp_path / "index")
    index = exactdedup.DigestIndex(spark, folder, buckets=4)
    frame = lambda rows: spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, text string, keep_id long")
    verdicts = lambda found: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect())
    first = frame([(5, "a"), (6, "b"), (7, "a")])
    assert verdicts(index.add(first, "one")) == [(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)]
    assert verdicts(index.add(first, "one")) == [(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)]  # the batch again
    second = frame([(1, "b"), (2, "c"), (3, "c  "), (4, "c ")])
    assert verdicts(index.add(second, "two")) == [(1, 6, 1, False), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False)]
    # another session finds the index by its folder; only what is new to it stays
    spark.sql(f"DROP TABLE {index.table}")
    again = exactdedup.DigestIndex(spark, folder, buckets=4)
    assert sorted((r.keep_id, r.batch) for r in again.read().collect()) == [(2, "two"), (3, "two"), (5, "one"), (6, "one")]
    kept = again.keep_new(frame([(8, "a"), (9, "d"), (10, "d"), (11, None)]), "three")
    assert sorted((r.doc_id, r.text, r.keep_id) for r in kept.collect()) == [(9, "d", 9), (11, None, 11)]
    plan = again.read().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed by digest
    again.forget()


# --- toxicity: exception phrases ------------------------------------------------------------------------------------------------


class Found:
    """Stands for an automaton: the matches of a text are given."""

    def __init__(self, matches):
        self.matches = matches

    def __len__(self):
        return 1

    def iter(self, folded):
        return iter(self.matches)


def test_exception_spans_by_brute_force():
    draw = random.Random(12)
    for _ in range(300):
        spans = [(a, a + draw.randrange(0, 6)) for a in (draw.randrange(0, 40) for _ in range(draw.randrange(0, 8)))]
        terms = {draw.randrange(0, 45): draw.random() for _ in range(draw.randrange(0, 12))}
        matches = [(b, (b - a + 1, None)) for a, b in spans] + [(s, (1, w)) for s, w in terms.items()]
        kept = [w for s, w in terms.items() if not any(a <= s <= b for a, b in spans)]
        assert toxicity.weight_of("", Found(matches)) == (sum(kept), len(kept))


def test_many_exceptions_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        matches = [(20 * i + j, (5, None if j == 9 else 1.0)) for i in range(n) for j in (9, 15)]
        begin = time.process_time()
        toxicity.weight_of("", Found(matches))
        took.append(time.process_time() - begin)
    assert took[1] < 12 * max(took[0], 0.01)


# --- the queries ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where, draw = str(tmp_path_factory.mktemp("tables")), random.Random(71)
    texts = odd_texts(draw)
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, texts[3], f"{texts[4]} "])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    rows = [r for r in conversations(draw) if r[0] is not None]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{where}/conversations.parquet")
    return where, docs, rows


def test_queries(spark, folder):
    where, docs, rows = folder
    trie = entries.op11_prefix_trie(spark, where)
    assert trie.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in trie.schema if f.name != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, trie.collect()), key=lambda r: (r[1], r[0])) == brute_trie(rows)
    aligned = entries.op12_token_alignment(spark, where)
    assert {f.dataType.simpleString() for f in aligned.schema if f.name != "groups_sha256"} == {"bigint"}
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[c] for c in columns) for r in aligned.collect()) == [w[:-1] for w in brute_alignment([d[:2] for d in docs])]
    first, sizes = {}, collections.Counter(normal(d[1]) for d in docs)
    for d in docs:
        first.setdefault(normal(d[1]), d[0])
    found = {r.doc_id: r for r in entries.op13_exact_dedup(spark, where).collect()}
    assert all((found[k].keep_id, found[k].group_size, found[k].kept) == (first[normal(t)], sizes[normal(t)], first[normal(t)] == k) for k, t, *_ in docs)
