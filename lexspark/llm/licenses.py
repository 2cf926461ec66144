"""License scan: an exact set-similarity join between text blocks and license templates.

A block is a window of as many consecutive words as the template has, wherever lines, comment marks and sentences end; a template is a
set of words; they join where the block holds at least ``threshold`` of the template's words.  Words are ordered by their frequency in
the whole corpus, rarest first.  With an overlap of at least a needed, a block must hold one of a template's first |T| - a + 1 words
(prefix filter), so only windows around those are looked at; the words around must have at least a of the template's (length filter),
and of the template's order enough must be left from the rarest of them on (positional filter); exact overlaps are counted last, by
a sliding window.  Phrases are templates whose block is a window of consecutive words: their prefix is their rarest word, the positional
filter is its place in the phrase.

Windows that meet the threshold and overlap are one block: the first of those with the largest overlap stands for it.

Templates and phrases are parameters of bounded number; their index is broadcast, texts are never moved.

Defined results: null and empty texts have no words and no places; texts are scanned whole, however long, at a cost linear in their
words; of equally good windows the first counts; an empty table gives no rows; repeated rows and null keys each get a row; other
columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of

#: Phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and opening sentences of public licenses, as lower-case words, and the labels that the method adds.
TEMPLATES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gnu-gpl-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu-gpl-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
#: A block must hold this share of a template's words, as a fraction of whole numbers.
THRESHOLD = (9, 10)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of digits, letters and characters beyond ASCII."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    """The places of its words in the order by rarity, its length in words, the overlap needed, and its label."""

    places: dict[bytes, int]
    length: int
    needed: int
    label: str


@dataclass(frozen=True)
class LicenseIndex:
    """Templates, the inverted prefix lists, and phrases by their rarest word.  Bounded by the templates."""

    templates: tuple[Template, ...]
    prefix: dict[bytes, tuple[int, ...]]  # word -> templates
    rare: dict[bytes, tuple[tuple[int, tuple[bytes, ...], str], ...]]  # word -> (place in phrase, phrase, label)


def build_index(counts: dict[bytes, int], templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> LicenseIndex:
    split = [(tuple(words_of(t)), label) for t, label in templates]
    said = [(tuple(words_of(p)), label) for p, label in phrases]
    every = {w for words, _ in split + said for w in words}
    rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (counts.get(w, 0), w)))}
    made, prefix, rare = [], {}, {}
    for t, (words, label) in enumerate(split):
        mine = sorted(set(words), key=rank.__getitem__)
        needed = -(-threshold[0] * len(mine) // threshold[1])
        made.append(Template({w: i for i, w in enumerate(mine)}, len(words), needed, label))
        for word in mine[: len(mine) - needed + 1]:
            prefix.setdefault(word, []).append(t)
    for words, label in said:
        place = min(range(len(words)), key=lambda i: rank[words[i]])
        rare.setdefault(words[place], []).append((place, words, label))
    return LicenseIndex(tuple(made), {w: tuple(x) for w, x in prefix.items()}, {w: tuple(x) for w, x in rare.items()})


def places_of(word: bytes, words: list[bytes]) -> list[int]:
    found, at = [], -1
    for _ in range(words.count(word)):
        at = words.index(word, at + 1)
        found.append(at)
    return found


def phrase_places(words: list[bytes], present: set[bytes], index: LicenseIndex) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    found = []
    for rare in index.rare.keys() & present:
        for at in places_of(rare, words):
            for place, phrase, label in index.rare[rare]:
                start = at - place
                if start >= 0 and start + len(phrase) <= len(words) and tuple(words[start : start + len(phrase)]) == phrase:
                    found.append((start, label))
    return sorted(found)


def regions(places: list[int], length: int, end: int) -> list[tuple[int, int]]:
    """The ranges of words, in order, that the windows of ``length`` words around the ascending ``places`` reach over."""
    found: list[tuple[int, int]] = []
    before = None
    for at in places:
        start = found.pop()[0] if before is not None and at - before < length else max(0, at - length + 1)
        found.append((start, min(end, at + length)))
        before = at
    return found


def template_blocks(words: list[bytes], present: set[bytes], index: LicenseIndex) -> list[tuple[int, str, float]]:
    """(word, label, containment) of every block that holds enough of a template; a block begins with a word of the template."""
    near: dict[int, list[int]] = {}
    for word in index.prefix.keys() & present:
        at = places_of(word, words)
        for t in index.prefix[word]:
            near.setdefault(t, []).extend(at)
    found = []
    for t, at in near.items():
        template = index.templates[t]
        blocks: list[tuple[int, int, int]] = []  # start, overlap, last word of the last window
        for lo, hi in regions(sorted(at), template.length, len(words)):
            held = [(i, words[i]) for i in range(lo, hi) if words[i] in template.places]
            around = {w for _, w in held}
            rarest = min(template.places[w] for w in around)
            if min(len(template.places) - rarest, len(around)) < template.needed:
                continue
            counts: Counter = Counter()
            tail = 0
            for i, word in held:
                counts[word] += 1
                while held[tail][0] <= i - template.length:
                    gone = held[tail][1]
                    counts[gone] -= 1
                    if not counts[gone]:
                        del counts[gone]
                    tail += 1
                if len(counts) < template.needed:
                    continue
                start, overlap = held[tail][0], len(counts)
                if blocks and i - blocks[-1][2] < template.length:
                    was = blocks.pop()
                    start, overlap = was[:2] if was[1] >= overlap else (start, overlap)
                blocks.append((start, overlap, i))
        found.extend((start, template.label, overlap / len(template.places)) for start, overlap, _ in blocks)
    return sorted(found)


def word_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Frequency of the given (bounded) words in all texts, summed on the executors."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                total.update(w for w in words_of(text) if w in words)
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    summed = map_rows(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in summed.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD, key: str = "doc_id") -> DataFrame:
    """Rows (key, n_words, places: array of (word, label), blocks: array of (word, label, containment))."""
    every = {w for text, _ in (*templates, *phrases) for w in words_of(text)}
    index = build_index(word_counts(docs, every), templates, phrases, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        ix = shared.value
        for batch in batches:
            sizes, places, blocks = [], [], []
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                present = set(words)
                sizes.append(len(words))
                places.append([{"word": s, "label": x} for s, x in phrase_places(words, present, ix)])
                blocks.append([{"word": n, "label": x, "containment": c} for n, x, c in template_blocks(words, present, ix)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                    pa.array(blocks, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
                ],
                [key, "n_words", "places", "blocks"],
            )

    schema = f"{key} {kind}, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<word:long,label:string,containment:double>>"
    return map_rows(docs.select(key, "text"), run, schema)


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    found = scan(docs, key=key)
    base, own = F.col("places.label"), F.col("blocks.label")
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        key,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )


def oracle(words_sql: str, templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> str:
    """The report in SQL; ``words_sql`` gives the list of words of a column ``text``."""
    said = []
    for phrase, label in phrases:
        words = phrase.split()
        test = " AND ".join(f"w[i + {j + 1}] = '{word}'" for j, word in enumerate(words))
        said.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(0, len(w) - {len(words)} + 1), lambda i: {test})) AS s FROM d")
    values = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in templates)
    return f"""
WITH t0 AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS (SELECT r, doc_id, {words_sql} AS w FROM t0),
p AS ({" UNION ALL ".join(said)}),
u AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
t(label, ws) AS (VALUES {values}),
tw AS (SELECT label, len(ws) AS size, len(list_distinct(ws)) AS n, unnest(list_distinct(ws)) AS word FROM t),
x AS (SELECT r, i, word, label, size, n FROM u JOIN tw USING (word)),
m AS (SELECT r, label, n, count(DISTINCT word) OVER (PARTITION BY r, label ORDER BY i RANGE BETWEEN size - 1 PRECEDING AND CURRENT ROW) AS o FROM x),
k AS (SELECT r, label, o / n AS c FROM m WHERE {threshold[1]} * o >= {threshold[0]} * n),
pb AS (SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM p GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM p) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM k) GROUP BY r),
kc AS (SELECT r, max(c) AS c FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN pb USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN kc USING (r)
"""
