"""The pipeline on a small fixture: stages keep the columns, decisions take effect, clean documents stay."""

import random

import pytest

from .test_operators import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    draw = random.Random(21)
    clean = [prose(draw, 70) + "." for _ in range(60)]
    junk = [" ".join(w + draw.choice(["***", "%%%"]) for w in prose(draw, 70).split()) for _ in range(30)]
    item = " ".join(prose(draw, 25).split())
    docs = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(junk)]
    docs += [(200, clean[0]), (201, f"{prose(draw, 40)}. {item}. {prose(draw, 40)}."), (202, None), (203, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in docs if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "bpe":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(range(60)) <= seen["quality"] and len(seen["quality"] & set(range(100, 130))) <= 2
    assert spark.read.parquet(f"{tmp_path}/line_dedup").where("doc_id = 200").first().text == ""
    assert len(seen["near_dedup"] & {200, 202, 203}) <= 1
    assert 201 not in seen["decontamination"] and set(range(60)) <= seen["decontamination"]
    assert {"ids", "n_tokens", "decoded_sha256"} <= set(now.columns)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, now.select("doc_id", "ids_sha256").collect()))
