"""The training-data operators against brute-force versions, on small fixtures with the odd cases."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lexspark.llm import bpe, common, decontamination, language, licenses, linededup, quality, simhash, store, toxicity, winnowing

SYLLABLES = "ha re on ti th ed in er an ou st ble nd es at en".split()


def words(draw, n):
    return ["".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4))) for _ in range(n)]


def prose(draw, n):
    out = words(draw, n)
    for i in range(7, n, 9):
        out[i] += draw.choice([".", ",", ".\n"])
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    texts = [prose(draw, 60) for _ in range(12)]
    odd = [None, "", " \n\t ", "one", "x" * 5000, "é😀 世界 ß", "a  b   c\n\n d", texts[0], texts[1], prose(draw, 4000)]
    return [(i * 3 + 1, t) for i, t in enumerate([*texts, *odd])] + [(1, texts[0])]  # one repeated row


SCHEMA = "doc_id long, text string, fp long, words string, score double, _row long, codes string, root string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 0.5, 2, "c", "r") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- BPE -----------------------------------------------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(RANKS)
    return bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_merging(both):
    mine, theirs = both
    draw = random.Random(1)
    alphabet = "abc  \n\t'sdrev.,!?éßñ世😀 　́٣²Ⅷ\x1c\x85​"
    for _ in range(3000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))
        assert mine.encode(text) == theirs.encode_ordinary(text), repr(text)
    for _ in range(800):
        text = "".join(draw.choice("aeionrst") for _ in range(draw.randrange(120)))
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_lookahead_is_bounded(both):
    mine, _ = both
    mine.encode("ab" * 20000)
    longest = max(map(len, mine.transducer.ranks))
    assert max(map(len, mine.transducer.residue)) <= 2 * longest


def test_states_are_bounded():
    small = bpe.MergeTransducer(bpe.load_ranks(RANKS), max_states=50)
    draw = random.Random(2)
    for _ in range(200):
        small.encode("".join(draw.choice("aeionrst") for _ in range(9)).encode())
        assert len(small.residue) < 200


def test_states_are_bounded_within_a_piece(both):
    draw = random.Random(3)
    small = bpe.MergeTransducer(bpe.load_ranks(RANKS), max_states=1000)
    piece = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(100_000)).encode()
    assert small.encode(piece) == both[0].transducer.encode(piece) and len(small.residue) <= 1000


def test_streaming_decoder_completes_characters(both):
    mine, _ = both
    text = "a😀é世ß" * 50
    ids = mine.encode(text)
    decoder = bpe.StreamingDecoder(mine.tokens)
    out = []
    for i in ids:
        out.append(decoder.feed([i]).decode("utf-8"))  # never a broken character
    assert "".join(out) == text and decoder.finish() == b""
    single = {v: k for k, v in mine.tokens.items()}
    assert decoder.feed([single[b"\xf0"], single[b"\x9f"]]) == b"" and decoder.finish() == b"\xf0\x9f"
    with pytest.raises(KeyError):
        decoder.feed([10**9])


def test_encode_and_decode(docs, rows, nothing, both):
    _, theirs = both
    outputs = ["ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
    found = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, outputs).collect()
    expected = []
    for key, text in rows:
        ids = theirs.encode_ordinary(text or "")
        expected.append((key, tuple(ids), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (text or "").encode(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((r[0], tuple(r[1]), r[2], r[3], bytes(r[4]), r[5]) for r in found) == sorted(expected)
    assert bpe.encode_and_decode(nothing, RANKS, public_tokenizers.PATTERN, ["ids"]).count() == 0


def test_transducer_is_asked_once_per_distinct_match(both):
    asked = []

    class Watched(bpe.ByteBpe):
        def _encode_parts(self, parts):
            asked.extend(parts)
            return super()._encode_parts(parts)

    draw = random.Random(23)
    some = ["alba", "été", "Überaus", "nord", "x2"]
    texts = ["".join(draw.choice(some) + draw.choice([" ", ". ", ".\n", "&&& ", "\n", " 7, "]) for _ in range(40)) for _ in range(20)]
    mine = Watched(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    for text in texts:
        assert mine.encode(text) == both[1].encode_ordinary(text)
    assert len(asked) <= len({m for t in texts for m in mine.pieces(t)}) + 2  # white space before a blank or a text's end goes with what is next to it


def test_other_patterns_are_not_cut_at_blanks():
    ranks, pattern = bpe.load_ranks(RANKS), r"\S+\s*|\s+"
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.ByteBpe(ranks, pattern)
    for text in ("the cat, the  dog.\nAnd 42 x's", " lead", "", "of the of the"):
        assert mine.encode(text) == theirs.encode_ordinary(text), text


def test_streaming_decoder_in_portions(both):
    mine, _ = both
    draw = random.Random(24)
    lone = [i for i, t in mine.tokens.items() if max(t) >= 0x80]
    ids = [draw.choice(lone) if draw.random() < 0.4 else draw.randrange(len(mine.tokens)) for _ in range(6000)]
    decoder, out, at = bpe.StreamingDecoder(mine.tokens), [], 0
    while at < len(ids):
        n = draw.randrange(5)
        out.append(decoder.feed(ids[at : at + n]))
        now = bpe.Utf8Machine.START
        for byte in b"".join(mine.tokens[i] for i in ids[: at + n]):
            now = bpe.Utf8Machine.step(now, byte)
        assert len(decoder.rest) == now[3]
        at += n
        if at > 300:
            break
    out += [decoder.feed(ids[at:3000]), decoder.feed(np.array(ids[max(at, 3000) :])), decoder.finish()]
    assert b"".join(out) == b"".join(mine.tokens[i] for i in ids)


# --- store -----------------------------------------------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_store(spark, docs, rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    folder = store.write_store(docs, TOKENIZER, 2, f"file://{tmp_path}/s")
    found = sorted(map(tuple, store.document_facts(spark, folder).collect()))
    ids = sorted((k, library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows)
    at, expected = 0, []
    for key, own in ids:
        expected.append((key, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert found == sorted(expected)
    assert sorted((r["doc_id"], r["ids"]) for r in store.read_ids(spark, folder).collect()) == ids
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = store.write_store(nothing, TOKENIZER, 2, f"file://{tmp_path}/e")
    assert store.document_facts(spark, empty).count() == 0


def test_special_token_text_is_left_to_the_library():
    encoder = store.LibraryEncoder(TOKENIZER)
    for text in ("a<|endoftext|>b", " lead", "it's  two\n x!", "Çédille, ok. Naïve; 42nd x²", " a 　b"):
        assert encoder.encode(text, 2).tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [2], text


def test_parts_are_cut_where_matches_begin():
    import regex
    from tokenizers import Tokenizer

    from lexspark.llm import chunks

    draw = random.Random(21)
    alphabet = "abcTs  \n\t'sdrevml.,!?éßñ世😀 \u3000\u0301٣²Ⅷ\x1c\x85\u200b\xa0ÀжΩ×÷'19\rªʼ\x00"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(5000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = chunks.part_starts(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    parts = [bytes(data[a:b]).decode() for a, b in zip(starts, [*starts[1:], len(data)])]
    split = Tokenizer.from_file(TOKENIZER).pre_tokenizer.pre_tokenize_str
    for find in (regex.compile(public_tokenizers.PATTERN).findall, lambda t: [m for m, _ in split(t)]):
        assert [m for p in parts for m in find(p)] == [m for t in texts for m in find(t)]


def test_library_is_asked_once_per_distinct_match():
    asked = []

    class Watched(store.LibraryEncoder):
        def _encode_parts(self, parts):
            asked.extend(parts)
            return super()._encode_parts(parts)

    draw = random.Random(22)
    some = ["alba", "été", "Überaus", "nord", "x2"]
    texts = ["".join(draw.choice(some) + draw.choice([" ", ". ", ".\n", "&&& ", "\n", " 7, "]) for _ in range(40)) for _ in range(20)]
    encoder = Watched(TOKENIZER)
    for text in texts:
        assert encoder.encode(text, 2).tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [2], text
    matches = {m for t in texts for m, _ in encoder.library.pre_tokenizer.pre_tokenize_str(t)}
    assert len(asked) <= len(matches) + 2  # white space before a blank or a text's end goes with what is next to it


def test_whole_batches_are_encoded_and_cut_like_single_texts(rows):
    import pyarrow as pa

    encoder = store.LibraryEncoder(TOKENIZER)
    texts = [*(t for _, t in rows), "a<|endoftext|>b", "", None, "x" * 100]
    for array in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array([], pa.string())):
        ids, ends = encoder.encode_batch(array, 2)
        wanted = [encoder.library.encode(t or "", add_special_tokens=False).ids + [2] for t in array.to_pylist()]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == (wanted or [[]])
        for params in (store.ChunkParams(), store.ChunkParams(least=3, mean_bits=3)):
            assert store.cut_all(ids, ends, params) == [store.cut_points(np.array(w, np.uint32), params) for w in wanted]


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}])
def test_other_splitters_are_left_to_the_library(tmp_path, change):
    import json

    with open(TOKENIZER) as file:
        said = json.load(file)
    said["pre_tokenizer"] |= change
    (tmp_path / "t.json").write_text(json.dumps(said))
    encoder = store.LibraryEncoder(str(tmp_path / "t.json"))
    for text in ("one two.\nThree, four", " lead", "it's  two\n x!", "", "of the of the"):
        assert encoder.encode(text, 2).tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [2], text


def test_damage_is_found(spark, docs, tmp_path):
    folder = store.write_store(docs, TOKENIZER, 2, f"file://{tmp_path}/d")
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    bad = [(r.digest, r.n, r.width, bytes(r.data)[::-1]) for r in chunks]
    spark.createDataFrame(bad, "digest binary, n int, width int, data binary").write.mode("overwrite").parquet(f"{folder}/chunks2")
    import shutil

    shutil.rmtree(tmp_path / "d/chunks")
    (tmp_path / "d/chunks2").rename(tmp_path / "d/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.document_facts(spark, folder).collect()


def test_lost_or_altered_recipes_are_found(spark, docs, tmp_path, monkeypatch):
    """A removed, reordered or altered recipe and a damaged manifest raise; so do lost chunks; the tree may have many levels."""
    import shutil

    monkeypatch.setattr(store, "FAN", 3)
    whole = store.write_store(docs, TOKENIZER, 2, f"file://{tmp_path}/w")
    assert store.document_facts(spark, whole).count() == docs.count()
    manifest = spark.read.parquet(f"{whole}/manifest")
    assert manifest.where("level = 0").count() >= 8 and manifest.agg(F.max("level")).first()[0] >= 2
    top = manifest.orderBy(F.desc("level")).first()
    assert manifest.where(f"level = {top.level}").count() == 1 and top.documents == docs.count()

    def damaged(table, change):
        folder = tmp_path / "x"
        shutil.rmtree(folder, ignore_errors=True)
        shutil.copytree(tmp_path / "w", folder)
        change(spark.read.parquet(f"file://{tmp_path}/w/{table}")).write.mode("overwrite").parquet(f"file://{folder}/{table}")
        return f"file://{folder}"

    one = spark.read.parquet(f"{whole}/recipes").orderBy("doc_id").first()
    here = (F.col("seg") == one.seg) & (F.col("row") == one.row)
    changes = [
        ("recipes", lambda df: df.where(~here)),
        ("recipes", lambda df: df.withColumn("row", F.when(F.col("row") < 2, 1 - F.col("row")).otherwise(F.col("row")))),
        ("recipes", lambda df: df.withColumn("recipe", F.when(here, F.slice("recipe", 1, 0)).otherwise(F.col("recipe")))),
        ("recipes", lambda df: df.withColumn("n_tokens", F.when(here, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))),
        ("manifest", lambda df: df.withColumn("root", F.when(F.col("level") == 1, F.reverse("root")).otherwise(F.col("root")))),
        ("manifest", lambda df: df.where("level > 0")),
        ("chunks", lambda df: df.limit(df.count() - 1)),
    ]
    for table, change in changes:
        bad = damaged(table, change)
        with pytest.raises(Exception, match="damaged|differ from the manifest|lost chunks"):
            store.document_facts(spark, bad).collect()
        with pytest.raises(Exception, match="damaged|differ from the manifest"):
            store.read_ids(spark, bad).collect()


def test_cuts_follow_content():
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 50000, 5000).astype(np.uint32)
    ends = store.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= 1024
    moved = store.cut_points(np.concatenate([ids[:7], ids]))
    assert len({e - 7 for e in moved} & set(ends)) > len(ends) // 2
    assert store.cut_points(ids[:1]) == [1] and store.cut_points(ids[:0]) == []


def test_crc_of_concatenation():
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 9, 1000).astype("<u4"), draw.integers(0, 9, 777).astype("<u4")
    whole = zlib.crc32(a.tobytes() + b.tobytes())
    assert whole == int(store.crc_shift(np.array([zlib.crc32(a.tobytes())]), np.array([777]))[0]) ^ zlib.crc32(b.tobytes())


# --- SimHash ---------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) > 2 else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    label = {k: k for k, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(docs, rows, nothing):
    prints = [(k, brute_fingerprint(t)) for k, t in rows]
    label = brute_components(prints)
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted((k, f"{p:016x}", label[k]) for k, p in prints)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("block", [4, 4096])
def test_links_lose_nothing(spark, block):
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for b in base[:6]:
        for _ in range(25):
            for _ in range(draw.randrange(1, 5)):
                b ^= 1 << draw.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from lexspark.llm.graph import components

    edges = simhash.links(frame, block=block)
    root = {r["node"] % (1 << 64): r["root"] for r in components(edges).collect()}
    label = brute_components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(label[p], set()).add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert edges.count() <= 10 * len(prints) * 40


def test_bit_planes():
    draw = random.Random(9)
    values = [draw.getrandbits(64) & 0xFFFF for _ in range(300)]
    planes = simhash.BitPlanes(values)
    for radius in (0, 1, 3, 6):
        for query in values[:20]:
            mask = planes.within(query, radius, planes.all)
            assert [i for i, v in enumerate(values) if (v ^ query).bit_count() <= radius] == [i for i in range(300) if mask >> i & 1]


# --- decontamination -----------------------------------------------------------------------------------------------------------


def brute_hits(rows, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for key, text in rows:
        w, hit, found = split(text), set(), set()
        for window, ids in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("single", [False, True])
def test_decontamination(spark, docs, rows, nothing, single):
    texts = [t for _, t in rows]
    w = texts[2].split()
    items = [(1, " ".join(w[10:35]).upper()), (2, "no such words here at all, none of them to be found"), (3, None), (4, "..."), (5, " ".join(w[12:22])), (6, " ".join(w[3:6])), (7, " ".join(w[10:20]) + " other")]
    items += [(8, "one"), (9, w[0])] if single else []
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int")
    assert sorted(map(tuple, decontamination.report(docs, benchmark).collect())) == brute_hits(rows, items)
    assert decontamination.report(nothing, benchmark).count() == 0
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, *_, bad in brute_hits(rows, items) if not bad)
    none = decontamination.report(docs, benchmark.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


# --- winnowing -----------------------------------------------------------------------------------------------------------------


def brute_winnow(grams, w):
    chosen = {}
    for s in range(max(len(grams) - w, 0) + 1 if grams else 0):
        window = grams[s : s + w]
        least = min(window)
        at = max(i for i, g in enumerate(window) if g == least)
        chosen[s + at] = least
    return sorted(chosen.items())


def test_window_minima_are_rightmost(spark):
    draw = random.Random(4)
    cases = [[draw.randrange(4) for _ in range(draw.randrange(0, 30))] for _ in range(60)]
    packed = [[(g << 24) | (winnowing.POSITIONS - i) for i, g in enumerate(c)] for c in cases]
    frame = spark.createDataFrame(list(enumerate(packed)), "i int, p array<long>")
    found = frame.select("i", winnowing.window_minima(F.col("p"), 5).alias("m")).collect()
    for r in found:
        assert sorted((winnowing.POSITIONS - (m & winnowing.POSITIONS), m >> 24) for m in r.m) == brute_winnow(cases[r.i], 5)


def test_shared_run_gives_shared_fingerprint(spark):
    draw = random.Random(6)
    run = " ".join(words(draw, 16))  # w + k - 1 tokens
    frame = spark.createDataFrame([(1, f"{prose(draw, 50)} {run} {prose(draw, 50)}"), (2, f"{prose(draw, 31)} {run} {prose(draw, 9)}")], "doc_id long, text string")
    a, b = ({x["hash"] for x in r.fingerprint} for r in winnowing.fingerprints(frame).collect())
    assert a & b


def test_compare_with_edits(docs, rows, nothing):
    found = {}
    for r in winnowing.compare_with_edits(docs).collect():
        found.setdefault(r.doc_id, r)
    keys = sorted({k for k, _ in rows})
    text = {k: t or "" for k, t in rows}
    for i, key in enumerate(keys):
        t, following = text[key], text[keys[i - 1]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    same = {}
    for key in keys:
        same.setdefault(text[key], set()).add(found[key].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert winnowing.compare_with_edits(nothing).count() == 0
    assert winnowing.compare_with_edits(docs).count() == len(rows)


# --- line dedup ----------------------------------------------------------------------------------------------------------------


def test_units_join_to_the_text(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").where("text is not null")
    assert frame.where(F.array_join(linededup.units_of(F.col("text")), "") != F.col("text")).count() == 0


def test_line_dedup(spark, nothing):
    draw = random.Random(11)
    passage = prose(draw, 80)
    own = [prose(draw, 90) for _ in range(6)]
    data = [
        (1, f"{own[0]}.\n{passage}.\n{own[1]}."),
        (2, f"{own[2]}. {passage}. {own[3]}."),  # the same passage within a line
        (3, f"{own[4]}."),
        (4, f"{own[4]}."),  # an exact copy
        (5, f"{own[5]}.\n{own[5]}.\nend"),  # repeats itself
        (6, None),
        (7, ""),
        (None, f"{own[4]}."),
        (8, "short. line. again. short. line. again."),
    ]
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, codes string, _key int").repartition(3)
    found = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    assert len(found) == len(data)
    text = dict(data)
    for key in (1, 3, 6, 7, 8, None):
        assert found[key].text == text[key] and found[key]._removed == 0
    assert found[4].text == ""
    assert own[2][:150] in found[2].text and own[3][-150:] in found[2].text
    kept = found[2].text
    inner = passage.split()
    assert sum(" ".join(inner[i : i + 10]) in " ".join(kept.split()) for i in range(len(inner) - 9)) <= 30
    assert found[5].text.count(own[5].split()[20] + " " + own[5].split()[21]) == 1 and found[5].text.endswith("end")
    assert linededup.dedup_lines(nothing).count() == 0


def brute_line_dedup(rows, width=25):
    """Texts in order of their keys, as words; every window but its first place goes."""
    seen, kept = set(), {}
    for key, text in sorted(rows):
        words = text.split()
        bad = set()
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                bad.update(range(i, i + width))
            seen.add(window)
        kept[key] = [w for i, w in enumerate(words) if i not in bad]
    return kept


def test_line_dedup_finds_runs_across_short_lines_and_inside_long_ones(spark):
    draw = random.Random(15)
    verse = "\n".join(" ".join(words(draw, 3)) for _ in range(32))
    plain = " ".join(words(draw, 40))
    han = "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(60))
    more = lambda n: " ".join(words(draw, n))
    data = [
        (1, f"{verse}\n{more(30)}"),
        (2, f"{verse}\n{more(30)}"),  # short lines, then a differing line
        (3, f"{more(30)} {plain} {more(30)}"),
        (4, f"  {more(9)} {plain} {more(13)} \n"),  # inside a long clause without stops
        (5, f"{han[:40]}一二三"),
        (6, f"四五{han[:40]}七八九"),  # no blanks at all
        (7, f"{more(24)}"),
        (8, " ".join(["la", "le"] * 40)),
    ]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    for key, kept in brute_line_dedup(data).items():
        if key not in (5, 6):
            assert found[key].text.split() == kept
            assert found[key]._removed == len(dict(data)[key].split()) - len(kept)
    assert len(found[2].text.split()) == 30 and found[4].text.startswith("  ")
    assert found[5].text == data[4][1] and found[6].text == "四五七八九" and found[6]._removed == 40


def test_line_dedup_compares_with_every_earlier_place(spark):
    draw = random.Random(16)
    lines = [" ".join(words(draw, 6)) for _ in range(10)]
    more = lambda n: " ".join(words(draw, n))
    data = [(i, f"{more(12)}\n{lines[i]}\n{lines[i + 1]}\n{more(12)}") for i in range(9)]  # neighbouring pairs, in earlier documents
    data += [(100 + i, "\n".join([more(20), *lines, more(20)])) for i in range(3)]  # the whole passage
    data += [(200, "\n".join([lines[3], more(10), *lines, more(10), *lines]))]
    found = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert {k: t.split() for k, t in found.items()} == brute_line_dedup(data)
    assert all(found[i] == dict(data)[i] for i in [*range(9), 100]) and len(found[101].split()) == 40


def test_stages_decide_by_row(spark):
    draw = random.Random(17)
    item, *own = [" ".join(words(draw, 40)) for _ in range(8)]
    data = [(None, own[0]), (None, own[1]), (1, own[2]), (1, own[3]), (2, own[2]), (3, own[4]), (None, own[4])]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    same = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert same(simhash.drop_near_duplicates(frame)) == sorted([*data[:4], data[5]], key=str)
    bad = spark.createDataFrame([(None, item), (1, f"{own[5]} {item}")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert same(decontamination.drop_contaminated(frame.union(bad), benchmark)) == sorted(data, key=str)
    shared = [(4, own[6]), (5, f"{own[6]} {own[5]}"), (5, own[3])]  # only the second of key 5's rows holds nothing of key 4's
    assert {tuple(r) for r in linededup.dedup_lines(spark.createDataFrame(shared, "doc_id long, text string")).select("doc_id", F.trim("text")).collect()} == {(4, own[6]), (5, own[5]), (5, own[3])}


# --- licenses ------------------------------------------------------------------------------------------------------------------


def test_license_join_is_exact(spark, nothing):
    draw = random.Random(12)
    pool = sorted({w for t, _ in licenses.TEMPLATES for w in t.split()}) + words(draw, 10)
    lines = []
    for _ in range(400):
        base = draw.choice(licenses.TEMPLATES)[0].split()
        draw.shuffle(base)
        base = base[draw.randrange(3) :] + draw.choices(pool, k=draw.randrange(5))
        lines.append(" ".join(base))
    lines += ["MIT License, MIT\nlicense", "the Apache--License 2.0", "Licensed under CC BY-NC 4.0."]
    data = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(58)] + [(90, None), (91, ""), (92, "éapache license")]
    full = [t for t, _ in licenses.TEMPLATES]
    wrapped = ["\n * ".join(textwrap.wrap(t, 30)) for t in full]
    data += [(100, "\n".join(full)), (101, " x ".join(wrapped)), (102, " ".join(full[1].split()[3:])), (103, f"{full[1]} {full[1]}")]
    data += [(104, " ".join(draw.choices(pool, k=20_000)) + wrapped[1]), (105, " by ".join(full[0].split())), (104, full[0]), (None, full[0])]
    frame = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, places int")
    found = {(r.doc_id, r.n_words): r for r in licenses.scan(frame).collect()}
    assert len(found) == len(data)
    for key, text in data:
        w = [x.decode() for x in licenses.words_of(text or "")]
        expected = []
        for template, label in licenses.TEMPLATES:
            t, size, runs = set(template.split()), len(template.split()), []
            for end in range(len(w)):  # every window, by its last word
                window = range(max(0, end - size + 1), end + 1)
                overlap = len(t.intersection(w[i] for i in window))
                if w[end] in t and 10 * overlap >= 9 * len(t):
                    if not runs or end - runs[-1][-1][0] >= size:
                        runs.append([])
                    runs[-1].append((end, overlap, next(i for i in window if w[i] in t)))
            for run in runs:
                best = max(run, key=lambda x: x[1])
                expected.append((best[2], label, best[1] / len(t)))
        assert sorted(map(tuple, found[key, len(w)].blocks)) == sorted(expected)
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted(map(tuple, found[key, len(w)].places)) == places
    assert {b.label for b in found[101, len(licenses.words_of(data[62][1]))].blocks} >= {"mit-text", "gnu-gpl-text", "bsd-text", "mpl-2.0"}
    assert licenses.scan(nothing).count() == 0


# --- classifiers ---------------------------------------------------------------------------------------------------------------


def classifier_data(spark):
    draw = random.Random(13)
    rows = []
    for i in range(400):
        text, bad, toxic = prose(draw, 60), i % 4 == 0, i % 5 == 0
        if bad:
            text = " ".join(w + draw.choice(["***", "%%%", "$$$"]) for w in text.split())
        if toxic:
            at = text.split(" ")
            at[draw.randrange(len(at))] = draw.choice(["grublin", "Grуblin,", "gru6lin", "grvmsk", "snorvex"])
            text = " ".join(at)
        rows.append((i, text, int(not bad), int(toxic)))
    odd = [(1000, None, None, None), (1001, "", 1, 0), (1002, "!!! 42", None, None), (1003, "grublin", None, None), (1004, "x" * 200_000, None, None)]
    every = rows + odd
    docs = spark.createDataFrame([(r[0], r[1], 7, "s") for r in every], "doc_id long, text string, label int, source string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in every if r[2] is not None] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_quality(spark):
    docs, labels, rows = classifier_data(spark)
    model = quality.fit_quality(docs.where("doc_id % 3 <> 1"), labels)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found.values())
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(found[r[0]].predicted == r[2] for r in held) > 0.95 * len(held)
    assert found[1000].score == found[1001].score == pytest.approx(model.prior)
    unlabelled = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, unlabelled).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_neighbour_vote_equals_brute_force():
    draw = np.random.default_rng(1)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, labels, asked = unit(draw.normal(size=(80, 5))), draw.integers(0, 2, 80).astype(np.float32), unit(draw.normal(size=(20, 5)))
    params = quality.QualityParams(neighbours=7)
    model = quality.QualityModel(np.zeros(0), np.zeros(0), np.zeros((0, 5)), known, labels, 0.5, params)
    for row, score in zip(asked, quality.vote(asked, model)):
        near = sorted(((float(row @ k), float(y)) for k, y in zip(known, labels)), reverse=True)[:7]
        weight = [max(c, 0) ** 4 for c, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), rel=1e-4)


def test_toxicity(spark):
    docs, labels, rows = classifier_data(spark)
    model = toxicity.fit_toxicity(docs.where("doc_id % 4 <> 2"), labels)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found.values())
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(found[r[0]].predicted == r[3] for r in held) > 0.95 * len(held)
    assert found[1003].predicted == 1 and found[1000].predicted == found[1001].predicted == found[1002].predicted == 0
    bare = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, bare).collect()} == {0.0}


def test_folding_and_exceptions():
    assert toxicity.fold("Trаsh! 1d10t $cum (499) 555") == " trash idiot scum "
    model = toxicity.ToxicityModel({" trash": 2.0}, ("trash can",))
    machine = toxicity.automaton(model)
    assert toxicity.weight_of(toxicity.fold("what trash"), machine) == (2.0, 1)
    assert toxicity.weight_of(toxicity.fold("a TRASH-can there"), machine) == (0, 0)


def test_language(spark):
    draw = random.Random(14)
    kinds = {"aa": "ka lo mi nu".split(), "bb": "stra venk dor ulp".split(), "cc": "éta çon ûri ñel".split()}
    data = [(i, " ".join("".join(draw.choices(kinds[k], k=3)) for _ in range(20)), k) for i in range(150) for k in [sorted(kinds)[i % 3]]]
    odd = [(900, None, None), (901, "", "aa"), (902, "12 +-", None), (903, "kalomi", None), (904, "世界" * 30, None)]
    frame = spark.createDataFrame([(*d, 1.0) for d in data + odd], "doc_id long, text string, lang string, score double")
    model = language.fit_language(frame.where("doc_id % 4 <> 2").select("text", "lang"))
    found = {r.doc_id: r for r in language.identify(frame, model).collect()}
    assert sum(found[i].lang_pred == k for i, _, k in data) > 0.98 * len(data)
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert found[904].rejected and 0 <= found[904].score <= 1
    bare = language.fit_language(frame.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in language.identify(frame, bare).collect()} == {"und"}


@pytest.mark.parametrize("seed", [31, 32])
def test_line_dedup_equals_brute_force_on_tangled_texts(spark, seed):
    """Few distinct words, shared pieces, whole copies, self-repeats, a text of 100,000 words, odd column names."""
    draw = random.Random(seed)
    pool = words(draw, 40)
    pieces = [" ".join(draw.choices(pool, k=draw.randrange(20, 70))) for _ in range(8)]
    blank = lambda: draw.choice([" ", "\n", "\t ", " \r\n"])
    texts = [blank().join(draw.choice([*pieces, *draw.choices(pool, k=6)]) for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    texts += [texts[3], texts[3], " ".join(draw.choices(words(draw, 3000), k=100_000)), f"x {pieces[0]}", "", " \n "]
    data = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, 2, "r", 3) for d in data], "doc_id long, text string, _runs int, base int, _text string, _removed int").repartition(5)
    found = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    kept = brute_line_dedup(data)
    assert {k: r.text.split() for k, r in found.items()} == kept
    assert all(found[k]._removed == len(t.split()) - len(kept[k]) for k, t in data)
    assert frame.columns == linededup.dedup_lines(frame.limit(0)).columns


def test_line_dedup_writes_no_windows_and_tells_texts_apart_once(spark, monkeypatch):
    """Windows go into the shuffle that compares them, and how a text's words are found comes with its grams."""
    paths, looked, odd, written = [], [], linededup._odd, linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, path: paths.append(path.rsplit("/", 1)[-1]) or written(df, path))
    monkeypatch.setattr(linededup, "_odd", lambda text: looked.append(1) or odd(text))
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, own), (2, own.replace(" ", "  ")), (3, f"x\t{own}"), (4, own.replace(" ", "\n") + " y"), (5, " ".join("世" * 40)), (6, "世" * 40 + "界")]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]._removed for i in range(1, 7)] == [0, 60, 60, 60, 39, 40]
    assert [found[i].text.split() for i in (2, 3, 4, 6)] == [[], ["x"], ["y"], ["界"]]
    assert "windows" not in paths and "later" in paths
    assert len(looked) == 3  # for the sample's grams, all grams and the texts that are cut


@pytest.mark.parametrize("merged", ["true", "false"])
def test_sums_of_few_rows_are_not_written_as_many_files(spark, tmp_path, merged):
    sizes = {(k * 37 % 1000 if k else None): k % 11 + 1 for k in range(1000)}
    frame = spark.createDataFrame(list(sizes.items()), "k long, size long")
    with common.settings(spark, {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": merged}):
        found = dict(common.preceding_sum(frame, ["k"], "size", "before", f"{tmp_path}/order").select("k", "before").collect())
    total = 0
    for k in sorted(sizes, key=lambda k: -1 if k is None else k):
        assert found.pop(k) == total
        total += sizes[k]
    files = len(list(tmp_path.glob("order/*.parquet")))
    assert not found and (files <= 4 if merged == "true" else files > 4)


def test_line_dedup_needs_no_python_on_executors(spark, monkeypatch):
    """Frequent lines, texts of many copies, odd blanks: DataFrame operations alone find what brute force does."""

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    draw = random.Random(34)
    pool = words(draw, 3000)
    line, copied = " ".join(words(draw, 30)), " ".join(words(draw, 60))
    data = [(i, f"{' '.join(draw.choices(pool, k=30))}{draw.choice([' ', chr(9), ' ' + chr(10)])}{line}") for i in range(2500)]
    data += [(5000 + i, copied) for i in range(100)] + [(6000, f"x {copied}"), (6001, " ".join(["la"] * 200)), (6002, f"la {line} le"), (-1, f"{copied}\r")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    plan = linededup._grams(frame.select(F.xxhash64("text").alias("_text"), "text").where("doc_id < 2500 and pmod(_text, 64) = 0"), 25, 10)
    assert linededup._frequent(plan).count()
    found = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    kept = brute_line_dedup(data)
    assert {k: r.text.split() for k, r in found.items()} == kept
    assert all(found[k]._removed == len(t.split()) - len(kept[k]) for k, t in data)


def test_words_by_expressions_equal_words_of_characters(spark):
    draw = random.Random(35)
    texts = ["", " ", "a", "世界 a世b", "กขa ข", "\U00020001x\U00020002 é\n\n😀 ", *["".join(draw.choices("ab é世ก😀\n\t\U00020001", k=draw.randrange(40))) for _ in range(300)]]
    texts += ["".join(draw.choices("ab é\n", k=draw.randrange(40))) for _ in range(100)]
    for r in linededup.with_words(spark.createDataFrame([(t,) for t in texts], "text string"), "words").collect():
        assert r.words.split(" ") == (re.findall(rf"[{linededup.UNSPACED}]|[^ \t\n\x0b\f\r{linededup.UNSPACED}]+", r.text) or [""]), r.text


def test_words_of_bytes_equal_words_of_characters():
    from lexspark.llm import wordscan
    import pyarrow as pa

    draw = random.Random(33)
    texts = ["", " ", "a", "世界 a世b", "กขa ข", "\U00020001x\U00020002 é\n\n😀 ", *["".join(draw.choices("ab é世ก😀\n\t\U00020001", k=draw.randrange(40))) for _ in range(300)]]
    alone = "".join(f"{chr(a)}-{chr(b)}" for a, b in wordscan.UNSPACED_RANGES)
    units = [re.findall(rf"[{alone}]|[^ \t\n\x0b\f\r{alone}]+", t) for t in texts]
    by_hash: dict[int, str] = {}
    for a, b, found in wordscan.steps(pa.array(texts)):
        for t in range(a, b):
            own = range(found.first[t - a], found.first[t - a + 1])
            assert [bytes(found.data[found.starts[w] : found.ends[w]]).decode() for w in own] == units[t], texts[t]
            for w, unit in zip(own, units[t]):
                assert by_hash.setdefault(int(found.hashes[w]), unit) == unit
    assert len(by_hash) == len({u for own in units for u in own})
    long = np.frombuffer(("x" * 20_000 + " " + "x" * 19_999 + "y").encode(), np.uint8)
    assert len(set(wordscan.words_of(long, np.array([0, len(long)])).hashes.tolist())) == 2


# --- samples -------------------------------------------------------------------------------------------------------------------


def test_samples_are_bounded_and_filled_in_spite_of_copies(spark):
    from lexspark.llm.common import balanced_sample, labelled_sample

    texts = [("aa", "copy")] * 20_000 + [("aa", f"other {i}") for i in range(50)] + [("bb", "copy")] * 300 + [(None, "x"), ("cc", None)]
    texts += [(f"l{i}", f"text {i} {j}") for i in range(300) for j in range(2)]
    frame = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    found = balanced_sample(frame, "lang", 40).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("d"), F.max("text").alias("t")).collect()
    n = {r.lang: r.n for r in found}
    assert n["aa"] == 40 and n["bb"] == 1 and n["cc"] == 1 and len(n) == 303 and all(r.n == r.d for r in found if r.lang != "cc")
    assert {r.t for r in found if r.lang == "bb"} == {"copy"} and all(n[f"l{i}"] == 2 for i in range(300))
    docs = spark.createDataFrame([(7, f"t {i}") for i in range(5000)] + [(i, "same") for i in range(100, 900)] + [(8, "u"), (9, "v"), (10, "w")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (10, 0)] + [(i, 1) for i in range(100, 900)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 2).collect()
    assert sorted(r._label for r in rows) == [0, 0, 1, 1] and len({r.text for r in rows}) == 4


def test_tied_neighbours_are_taken_in_order():
    same = np.tile(np.array([[1.0, 0.0]], np.float32), (4000, 1))
    labels = np.zeros(4000, np.float32)
    labels[:25] = 1
    model = quality.QualityModel(np.zeros(0), np.zeros(0), np.zeros((0, 2)), same, labels, 0.5, quality.QualityParams())
    assert quality.vote(same[:3], model).tolist() == [1, 1, 1]


def test_toxic_matching_equals_a_naive_scan():
    draw = random.Random(41)
    pool = words(draw, 60)
    lexicon = {f" {w[: draw.randrange(3, 7)]}": float(i + 1) for i, w in enumerate(pool[:12])} | {f" {w} ": 0.5 + i for i, w in enumerate(pool[12:20])}
    model = toxicity.ToxicityModel(lexicon, (f"{pool[0]} {pool[30]}", f"{pool[31]} {pool[13]}"))
    machine = toxicity.automaton(model)
    shields = [toxicity.fold(p)[:-1] for p in model.exceptions]
    for _ in range(300):
        folded = toxicity.fold(" ".join(draw.choices(pool, k=40)))
        covered = {q for p in shields for s in range(len(folded)) if folded.startswith(p, s) for q in range(s, s + len(p))}
        best = {}
        for s in range(len(folded)):
            hits = [(len(p), w) for p, w in lexicon.items() if folded.startswith(p, s)]
            if hits and s not in covered:
                best[s] = max(hits)[1]
        total, n = toxicity.weight_of(folded, machine)
        assert n == len(best) and total == pytest.approx(sum(best.values()))


# --- near-duplicates by similarity -----------------------------------------------------------------------------------------------


def jaccard(a, b, n=5):
    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similar_texts_are_found(spark):
    draw = random.Random(51)
    data, pairs, base = [], [], [" ".join(words(draw, draw.choice([60, 150, 400, 1500]))) for _ in range(150)]
    passage = " ".join(words(draw, 15))
    for i, text in enumerate(base):
        w = text.split()
        for _ in range(max(1, round(len(w) * draw.choice([0.005, 0.01, 0.02])))):
            w[draw.randrange(len(w))] = draw.choice(words(draw, 1))
        data += [(i, text), (1000 + i, " ".join(w))]
        pairs.append((i, jaccard(text, " ".join(w))))
    data += [(2000 + i, " ".join([*words(draw, 30), passage, *words(draw, 30)])) for i in range(300)]  # a shared passage is no near copy
    data += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "one two"), (None, base[0]), (3005, "x" * 100_000)]
    frame = spark.createDataFrame([(*d, 1, "c") for d in data], "doc_id long, text string, fp int, component_id string").repartition(5)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame).collect()}
    close = [(i, j) for i, j in pairs if j >= 0.8]
    assert len(close) > 60 and sum(1000 + i not in kept for i, _ in close) >= 0.95 * len(close)
    far = [i for i, j in pairs if j < 0.6]
    assert all(1000 + i in kept for i in far) and set(range(150)) | set(range(2000, 2300)) <= kept
    assert kept & {3000, 3001, 3002} == {3000} and kept & {3003, 3004} == {3003} and None not in kept and 3005 in kept
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0 and simhash.SimilarityParams().found > 0.999


def test_hot_buckets_of_wide_fingerprints_lose_nothing(spark):
    draw = random.Random(52)
    base = draw.getrandbits(256)
    prints = sorted({base ^ sum(1 << b for b in draw.sample(range(256), draw.randrange(12))) for _ in range(200)} | {draw.getrandbits(256) for _ in range(50)})
    frame = spark.createDataFrame([(0, 5, p.to_bytes(32, "little")) for p in prints], "table int, bucket long, fp binary")
    from lexspark.llm.graph import components

    label = brute_components([(p, p) for p in prints], radius=9)
    for block in (16, 4096):
        root = {int.from_bytes(r["node"], "little"): r["root"] for r in components(simhash.links_in_buckets(frame, 9, block, 256)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(label[p], set()).add(bytes(root.get(p, p.to_bytes(32, "little"))))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
