"""The registered queries themselves, over a small folder of tables: columns, folds, thresholds, and results by brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexspark.llm import entries, winnowing

from .test_operators import brute_components, brute_fingerprint, brute_hits, brute_line_dedup, prose


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(61)
    texts = [prose(draw, 70) for _ in range(40)] + [" ".join(w + draw.choice(["***", "%%%"]) for w in prose(draw, 60).split()) for _ in range(20)]
    texts += [None, "", " \n", "one", texts[0], texts[1] + " more words", "MIT License é😀 世界", "12 34", prose(draw, 3000)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, None if t is None else "en" if i % 2 else "fr", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(not 40 <= i < 60), int(i % 7 == 0)) for i, _ in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    item = " ".join(rows[3][1].split()[5:30])
    spark.createDataFrame([(1, item), (2, "no such words"), (3, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def held(key, modulus, remainder):
    return zlib.crc32(str(key).encode()) % modulus == remainder


@pytest.mark.parametrize(
    "query, modulus, remainder, threshold", [(entries.op1_quality_classifier, 3, 1, 0.5), (entries.op2_toxicity, 4, 2, 0.3)]
)
def test_classifiers(spark, rows, folder, query, modulus, remainder, threshold):
    frame = query(spark, folder)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= kinds.items()
    found = frame.collect()
    assert sorted(r.doc_id for r in found) == [i for i, _ in rows]
    assert all(r.held_out == held(r.doc_id, modulus, remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)


def test_language(spark, rows, folder):
    found = {r.doc_id: r for r in entries.op3_language_id(spark, folder).collect()}
    assert len(found) == len(rows) and all(r.held_out == held(k, 4, 2) and 0 <= r.score <= 1 for k, r in found.items())
    for key, text in rows:
        assert (found[key].lang_pred == "und") == (text is None or not any(map(str.isalpha, text)))
        assert found[key].lang_pred in ("en", "fr", "und")


def test_tokens(spark, rows, folder):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in entries.op4_byte_bpe(spark, folder).collect()}
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        r = found[key]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_token_files(spark, rows, folder):
    from tokenizers import Tokenizer

    library, at, wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, entries.op6_token_store(spark, folder).collect())) == wanted


def test_fingerprints_of_edited_texts(spark, rows, folder):
    text = {k: t or "" for k, t in rows}
    keys = sorted(text)
    edited = {}
    for i, key in enumerate(keys):  # the next in descending order is the one below; after the last comes the first
        half = len(text[key]) // 2
        edited[key] = text[key][: len(text[key]) - half] + text[keys[i - 1]][:half]
    prints = {}
    for name, of in (("own", text), ("edited", edited)):
        frame = spark.createDataFrame(list(of.items()), "doc_id long, text string")
        prints[name] = {r.doc_id: {x["hash"] for x in r.fingerprint} for r in winnowing.fingerprints(frame).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    found = {r.doc_id: r for r in entries.op7_fingerprints(spark, folder).collect()}
    for i, key in enumerate(keys):
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text[key]), hashlib.sha256(edited[key].encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(prints["own"][key], prints["edited"][key]))
        assert r.near_next == pytest.approx(alike(prints["own"][key], prints["own"][keys[i - 1]]))


def test_duplicates(spark, rows, folder):
    prints = [(k, brute_fingerprint(t)) for k, t in rows]
    label = brute_components(prints)
    assert sorted(map(tuple, entries.op10_simhash(spark, folder).collect())) == sorted((k, f"{p:016x}", label[k]) for k, p in prints)
    found = {r.doc_id: r for r in entries.op8_line_dedup(spark, folder).collect()}
    kept = brute_line_dedup([(k, t) for k, t in rows if t and "世" not in t])
    for key, words in kept.items():
        text = dict(rows)[key]
        assert found[key].text.split() == words and found[key].n_removed == len(text.split()) - len(words)
        assert (found[key].n_chars, found[key].n_kept) == (len(text), len(found[key].text))


def test_contamination_and_licenses(spark, rows, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(tuple, entries.op9_decontamination(spark, folder).collect())) == brute_hits(rows, items)
    found = {r.doc_id: r for r in entries.op5_license_scan(spark, folder).collect()}
    marked = [k for k, t in rows if t and "MIT License" in t]
    assert marked and all(found[k].base_labels == "mit" and found[k].n_base == 1 and found[k].first_word == 0 and found[k].score == 1 for k in marked)
    assert all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for k, r in found.items() if k not in marked)
    assert spark.read.parquet(f"{folder}/documents.parquet").where(F.col("text").isNull()).count() == 1
