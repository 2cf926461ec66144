"""The thin queries over the training-data operators, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, exactdedup, language, licenses, linededup, prefixtrie, quality, simhash, store, toxicity, winnowing
from .common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(3, 1))
    model = quality.fit_quality(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, ["doc_id", "held_out"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs.where(~held_out(4, 2)), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted", "matches")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(~held_out(4, 2)).select("text", "lang"))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_byte_bpe(
    spark: SparkSession,
    sf_dir: str,
    ranks: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_and_decode(docs, ranks, pattern, ["n_tokens", "ids_sha256", "decoded_sha256"])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_token_store(
    spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json"), end_id: int = 2
) -> DataFrame:
    return store.store_and_read(table(spark, sf_dir, "documents"), tokenizer, end_id)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.dedup_lines(docs.withColumn("n_chars", F.length("text")))
    return found.select("doc_id", "n_chars", F.length("text").alias("n_kept"), F.col("_removed").alias("n_removed"), "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(
    spark: SparkSession,
    sf_dir: str,
    a: str = public_tokenizers.path("byte_bpe_50k.json"),
    b: str = public_tokenizers.path("piece_bpe_32k.model"),
) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), a, b)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_toxicity,
        op3_language_id,
        op4_byte_bpe,
        op5_license_scan,
        op6_token_store,
        op7_fingerprints,
        op8_line_dedup,
        op9_decontamination,
        op10_simhash,
        op11_prefix_trie,
        op12_token_alignment,
        op13_exact_dedup,
    )
}

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op11_prefix_trie": prefixtrie.ORACLE,
    "op13_exact_dedup": exactdedup.ORACLE,
    "op5_license_scan": licenses.oracle(WORDS_SQL),
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
      FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM b)),
ns AS (SELECT DISTINCT n FROM v),
p AS (SELECT r, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
      FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d JOIN ns ON len(w) >= n)),
h AS (SELECT p.r, p.s, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.k = v.k),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
""",
}
