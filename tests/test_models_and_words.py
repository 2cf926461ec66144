"""Unigram and word-level models, encoding by words, word tables, pairs, large added vocabularies, and the parts that came with them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark import AddedToken, ConfigError, Engine, fixtures
from lexspark.functions import decode, split
from lexspark.operators import added, encoding, models, words
from lexspark.plans.config import Part, Truncation, UnigramModel, WordLevelModel

from .test_engine import column, decoded, pieces


def segmentations(word, longest):
    if not word:
        yield []
    for n in range(1, min(longest, len(word)) + 1):
        for rest in segmentations(word[n:], longest):
            yield [word[:n], *rest]


SCORES = [("<unk>", 0.0), ("a", -2.0), ("b", -2.5), ("ab", -4.5), ("ba", -3.0), ("aba", -5.0), ("bb", -6.0), ("c", -1.0), ("cab", -4.0)]


def tokens_by_join(spark, texts, model):
    frame = spark.createDataFrame([(t,) for t in texts], "word string")
    return {r.word: [tuple(t) for t in r.tokens] for r in models.unigram_by_join(frame, model).collect()}


def test_unigram_is_the_likeliest_segmentation(spark):
    model = UnigramModel(tuple(SCORES), 0)
    scores = dict(SCORES[1:])
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcx") for _ in range(draw.randrange(1, 9))) for _ in range(60)] + ["", "x", "xx", "axxb", "ab", "世", "a" * 120]
    one = models.Unigram(model)
    found = tokens_by_join(spark, [*texts, None, "ab"], model)
    assert found == {t: one.tokenize(t) for t in texts}
    cost = lambda p: scores.get(p, model.unknown_score if len(p) == 1 else -math.inf)
    for text in texts:
        if len(text) > 9:
            continue
        best = max((sum(map(cost, s)) for s in segmentations(text, 3)), default=0.0)
        parts = [p for i, v, s, e in found[text] for p in ([v] if i else list(v))]
        assert "".join(parts) == text and math.isclose(sum(map(cost, parts)), best)
    # of equal segmentations the one whose last piece is longest; runs of unknown characters are one token
    assert [t[1] for t in found["ab"]] == ["ab"] and [t[:2] for t in found["axxb"]] == [(1, "a"), (0, "xx"), (2, "b")]


@pytest.mark.parametrize("options", [{"fuse_unk": False}, {"unk_id": None}, {"byte_fallback": True}])
def test_unigram_options(spark, options):
    pieces = [*SCORES, *((f"<0x{b:02X}>", -9.0) for b in range(256) if options.get("byte_fallback") and b != 0xFF)]
    model = UnigramModel(tuple(pieces), **({"unk_id": 0} | options))
    texts = ["axxb", "é世a", "xx", "cab"]
    assert tokens_by_join(spark, texts, model) == {t: models.Unigram(model).tokenize(t) for t in texts}


def test_unigram_configuration():
    raw = {"type": "Unigram", "unk_id": 1, "vocab": [["a", -1.0], ["<unk>", 0]], "byte_fallback": None}
    model = Engine.from_json(fixtures.EMPTY | {"model": raw}).plan.model
    assert model.vocab == {"a": 0, "<unk>": 1} and model.unk_id == 1 and not model.byte_fallback
    with pytest.raises(ConfigError):
        Engine.from_json(fixtures.EMPTY | {"model": raw | {"unk_id": 2}})


def test_word_level(spark):
    model = WordLevelModel({"a": 3, "<unk>": 9})
    frame = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "word string")
    found = {r.word: [tuple(t) for t in r.tokens] for r in models.wordlevel_by_join(frame, model).collect()}
    assert found == {w: models.WordLevel(model).tokenize(w) for w in ("a", "b", "")} and found["b"] == [(9, "<unk>", 0, 1)]
    bare = WordLevelModel({"a": 3})
    assert [r.tokens for r in models.wordlevel_by_join(frame.where("word = 'b'"), bare).collect()] == [[]] and models.WordLevel(bare).tokenize("b") == []


# --- encoding by words -----------------------------------------------------------------------------------------------------------

TEXTS = ["Hello the station!  isn't", "", None, "déjà vu é 世界 [MASK]the", "a\x00b́c \t tions", "İstanbul 가나 x", " lead", "x" * 50, "﷐ ab ﷑", "[MASK]", "the the [NEW] thé"]
METASPACE = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first"}
ENGINES = {
    "bert": fixtures.bert_small(),
    "byte": fixtures.byte_bpe_small(),
    "byte with prefix": fixtures.byte_bpe_small(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}, normalizer={"type": "NFC"}),
    "left": fixtures.trunc_pad("Left"),
    "unigram": fixtures.unigram_small(),
    "first mark": fixtures.unigram_small(pre_tokenizer=METASPACE, normalizer={"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "the"}, "content": "of"}, {"type": "Strip", "strip_left": True, "strip_right": False}]}),
    "no model": fixtures.EMPTY,
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(TEXTS)], "i int, text string, k int, word string").repartition(3).cache()


@pytest.mark.parametrize("name", list(ENGINES))
def test_encoding_by_words_equals_encoding_by_rows(spark, texts, name):
    engine, _ = Engine.from_json(ENGINES[name]).add_tokens(AddedToken("[NEW]"), AddedToken("[RAW]", normalized=False))
    rows, by_words = engine.encode(texts), engine.encode_by_words(texts, key="i")
    assert rows.schema == by_words.schema
    wanted = {r.i: r.encoding for r in rows.collect()}
    assert {r.i: r.encoding for r in by_words.collect()} == wanted
    if name == "bert":
        bare = texts.select("text", "k")  # no key: repeated and null rows are told apart
        found = engine.encode_by_words(bare.union(bare), add_special_tokens=False)
        assert found.columns == ["text", "k", "encoding"] and found.count() == 2 * len(TEXTS)
        counts = lambda f: sorted(map(tuple, f(texts.union(texts), by=("word",)).collect()), key=str)
        assert counts(engine.counts_by_words) == counts(engine.token_counts)


def test_the_plan_has_no_python_where_nothing_needs_it(spark, texts):
    engine = Engine.from_json(fixtures.unigram_small(normalizer=None))
    plan = words.tokens_of_words(texts.select("word"), engine)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipelines_that_cannot_be_planned_by_words(spark, texts):
    after = {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, {"type": "Digits"}]}
    with pytest.raises(words.NotByWords):
        Engine.from_json(fixtures.byte_bpe_small(pre_tokenizer=after)).encode_by_words(texts, key="i")
    with pytest.raises(words.NotByWords):
        Engine.from_json(fixtures.byte_bpe_small(model=fixtures.byte_bpe_small()["model"] | {"dropout": 0.5})).encode_by_words(texts, key="i")


def test_padding_to_the_longest_of_the_table(spark, texts):
    padding = {"strategy": "BatchLongest", "direction": "Right", "pad_id": 0, "pad_type_id": 0, "pad_token": "[PAD]", "pad_to_multiple_of": 8}
    engine = Engine.from_json(fixtures.bert_small(padding=padding))
    rows, by_words = engine.encode(texts, pad_scope="dataset"), engine.encode_by_words(texts, key="i", pad_scope="dataset")
    wanted = {r.i: r.encoding for r in rows.collect()}
    assert {r.i: r.encoding for r in by_words.collect()} == wanted
    assert len({len(e.ids) for e in wanted.values() if e}) == 1


def test_word_table_grows_by_what_it_lacks(spark, tmp_path):
    engine = Engine.from_json(fixtures.bert_small())
    table = words.WordTable(spark, str(tmp_path), engine)
    frame = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    assert table.read().count() == 0
    assert table.extend(frame("the", "stat", "the", None), "1") == 2
    assert table.extend(frame("the", "new"), "2") == 1
    assert table.extend(frame("the", "new"), "2") == 1  # the batch again, as after a lost job
    assert sorted(r.word for r in table.read().collect()) == ["new", "stat", "the"]
    (tmp_path / table.folder.rsplit("/", 1)[1] / "batch-3").mkdir()  # not complete
    assert table.read().count() == 3
    docs = spark.createDataFrame([(1, "the new day"), (2, "stat")], "i int, text string")
    wanted = {r.i: r.encoding for r in engine.encode(docs).collect()}
    for batch, fresh in (("4", 1), ("5", 0)):
        before = table.read().count()
        assert {r.i: r.encoding for r in engine.encode_by_words(docs, key="i", table=table, batch=batch).collect()} == wanted
        assert table.read().count() - before == fresh
    other = words.WordTable(spark, str(tmp_path), Engine.from_json(fixtures.unigram_small()))
    assert other.folder != table.folder and other.read().count() == 0


def test_word_table_in_a_stream(spark, tmp_path):
    engine = Engine.from_json(fixtures.bert_small())
    table = words.WordTable(spark, str(tmp_path / "words"), engine)
    for n, texts in enumerate((["the new day"], ["the old day", "new"])):
        spark.createDataFrame([(f"{n}-{i}", t) for i, t in enumerate(texts)], "k string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def each(batch, epoch):
        engine.encode_by_words(batch, key="k", table=table, batch=str(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = {r.k: r.encoding.ids for r in spark.read.parquet(out).collect()}
    wanted = {r.k: r.encoding.ids for r in engine.encode(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert found == wanted and {r.word for r in table.read().collect()} == {"the", "new", "old", "day"}


# --- pairs -----------------------------------------------------------------------------------------------------------------------


def lengths(n, m, most):
    """Takes tokens away one by one: from the longer, of equal ones from the first."""
    while n + m > most:
        n, m = (n - 1, m) if n > m or n == m and m > 0 else (n, m - 1)
    return n, m


def test_pair_lengths(spark):
    cases = [(n, m, most) for most in (1, 2, 5, 8) for n in range(0, 12) for m in range(0, 12)]
    for most in (1, 2, 5, 8):
        frame = spark.createDataFrame([c for c in cases if c[2] == most], "n int, m int, most int")
        for r in frame.select("n", "m", encoding.pair_lengths(F.col("n"), F.col("m"), Truncation(most)).alias("k")).collect():
            first, second = r.k
            assert first + second == min(most, r.n + r.m) and first <= r.n and second <= r.m
            want = lengths(r.n, r.m, most)
            # an odd token of two long texts goes to the longer of them
            assert sorted((first, second)) == sorted(want)
        only = frame.select("n", "m", encoding.pair_lengths(F.col("n"), F.col("m"), Truncation(most, strategy="OnlySecond")).alias("k")).collect()
        for r in only:
            over = r.n + r.m - most
            assert tuple(r.k) == (r.n, r.m - over if 0 < over < r.m else r.m)


@pytest.mark.parametrize("by_words", [True, False])
def test_pairs(spark, by_words):
    rule = {"max_length": 6, "stride": 1, "strategy": "LongestFirst", "direction": "Right"}
    padding = {"strategy": {"Fixed": 10}, "direction": "Right", "pad_id": 0, "pad_type_id": 0, "pad_token": "[PAD]", "pad_to_multiple_of": None}
    engine = Engine.from_json(fixtures.bert_small(truncation=rule, padding=padding))
    frame = spark.createDataFrame([("the of", "and to", 1), ("the", None, 2), (None, "the", 3), ("the the the the the", "of of", 4), ("", "", 5)], "a string, b string, i int")
    found = {r.i: r.encoding for r in engine.encode_pairs(frame, "a", "b", by_words=by_words).collect()}
    the, of, and_, to = (engine.vocab[w] for w in ("the", "of", "and", "to"))
    assert found[1].ids == [2, the, of, 3, and_, to, 3, 0, 0, 0] and found[1].type_ids == [0, 0, 0, 0, 1, 1, 1, 0, 0, 0]
    assert found[1].words == [None, 0, 1, None, 0, 1, None, 0, 0, 0] and found[1].special_tokens_mask == [1, 0, 0, 1, 0, 0, 1, 1, 1, 1]
    assert found[2].ids[:3] == [2, the, 3] and found[3] is None and found[5].ids[:3] == [2, 3, 3]
    assert found[4].ids == [2, the, the, the, the, 3, of, of, 3, 0]
    assert [p.ids for p in found[4].overflowing] == [[2, the, the, 3, of, of, 3, 0, 0, 0]]
    assert [tuple(o) for o in found[4].offsets[1:3]] == [(0, 3), (4, 7)] and tuple(found[4].offsets[6]) == (0, 2)
    plain = Engine.from_json(fixtures.bert_small(post_processor=None))
    first = plain.encode_pairs(frame, "a", "b", by_words=by_words).where("i = 1").first().encoding
    assert first.ids == [the, of, and_, to] and first.type_ids == [0, 0, 1, 1]


# --- large added vocabularies ------------------------------------------------------------------------------------------------------


def longest_matches(text, contents, longest):
    out, at = [], 0
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if text[at : at + n] in contents:
                out.append((at, text[at : at + n]))
                at += n
                break
        else:
            at += 1
    return out


def test_large_added_vocabulary(spark):
    draw = random.Random(9)
    syllables = "ha re on ti th ed in er an ou st ble nd es at en é 世 .* [x] \\d".split()
    contents = list(dict.fromkeys("".join(draw.choice(syllables) for _ in range(draw.randrange(2, 7))) for _ in range(120_000)))[:50_000]
    assert len(contents) == 50_000
    vocabulary, count = added.AddedVocabulary().add(tuple(map(AddedToken, contents)), {})
    assert count == 50_000
    texts = [" ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 9))) for _ in range(300)) for _ in range(20)] + ["", None, "nothing here?"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    tokens = vocabulary.matchable({}, True)
    found = added.occurrences(frame, tokens, vocabulary.by_content, "i").collect()
    known, longest = vocabulary.by_content, max(map(len, contents))
    wanted = [(i, at, known[t], t) for i, text in enumerate(texts) for at, t in longest_matches(text or "", known, longest)]
    assert len(wanted) > 2000 and sorted(map(tuple, found)) == sorted(wanted)


def test_trie_equals_alternatives():
    draw = random.Random(10)
    contents = list({"".join(draw.choice("ab.") for _ in range(draw.randrange(1, 6))) for _ in range(40)})
    listed = "|".join(map(re.escape, sorted(contents, key=lambda c: (-len(c), c))))
    for _ in range(200):
        text = "".join(draw.choice("ab.c") for _ in range(30))
        assert [m.span() for m in re.finditer(added.trie(contents), text)] == [m.span() for m in re.finditer(listed, text)]


# --- splits and decoders -----------------------------------------------------------------------------------------------------------

SPLITS = [
    ({"type": "Split", "pattern": {"Regex": "[0-9]"}, "behavior": "MergedWithPrevious"}, "a1b22c3", ["a1", "b2", "2", "c3"]),
    ({"type": "Split", "pattern": {"Regex": "[0-9]"}, "behavior": "MergedWithNext"}, "1a1b22c3", ["1a", "1b", "2", "2c", "3"]),
    ({"type": "Split", "pattern": {"Regex": "[0-9]"}, "behavior": "Contiguous"}, "a1b22c", ["a", "1", "b", "22", "c"]),
    ({"type": "Split", "pattern": {"String": "."}, "behavior": "Removed"}, "a.b", ["a", "b"]),
    ({"type": "Split", "pattern": {"Regex": "[0-9]+"}, "behavior": "Removed", "invert": True}, "a1b22c", ["1", "22"]),
    ({"type": "Digits", "individual_digits": False}, "a12b٣", ["a", "12", "b", "٣"]),
    ({"type": "Punctuation", "behavior": "Contiguous"}, "a?!b", ["a", "?!", "b"]),
    ({"type": "Whitespace"}, "é_1 --b", ["é_1", "--", "b"]),
    ({"type": "WhitespaceSplit"}, "a　b! c", ["a", "b!", "c"]),
    ({"type": "CharDelimiterSplit", "delimiter": "-"}, "a-b--c", ["a", "b", "c"]),
    ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"}, "a b  c", ["▁a", "▁b", "▁", "▁c"]),
    ({"type": "Metaspace", "replacement": "_", "prepend_scheme": "never"}, "a b", ["a", "_b"]),
]


@pytest.mark.parametrize("raw,text,expected", SPLITS)
def test_splits(spark, raw, text, expected):
    native, fused = pieces(spark, text, raw)
    assert [p[0] for p in native] == [p[0] for p in fused] == expected
    engine = Engine.from_json(fixtures.EMPTY | {"pre_tokenizer": raw})
    sized = column(spark, text, lambda t: words.pre_tokenized(words.sized(engine.split_normalized(t)), engine.plan.pre_tokenizer)[0])
    assert [p.text for p in sized if p.kept] == expected and sum(p.size for p in sized) == len(text)


def test_new_decoders(spark):
    assert decoded(spark, ["▁a", "▁b", "c"], {"type": "Metaspace", "replacement": "▁"}) == ["a", " b", "c"]
    assert decoded(spark, ["▁a"], {"type": "Metaspace", "add_prefix_space": False}) == [" a"]
    assert decoded(spark, ["a</w>", "b", "c</w>"], {"type": "BPEDecoder"}) == ["a ", "b", "c"]
    ctc = {"type": "CTC", "pad_token": "<pad>", "word_delimiter_token": "|", "cleanup": True}
    assert decoded(spark, ["<pad>", "h", "h", "<pad>", "h", "|", "|", "o", "<pad>"], ctc) == ["h", "h", " ", "o"]
    assert decoded(spark, [], ctc) == []
    engine = Engine.from_json(fixtures.EMPTY | {"model": {"type": "WordLevel", "vocab": {"h": 0, "<pad>": 1, "|": 2}}, "decoder": ctc})
    engine.register(spark)
    assert spark.sql("SELECT decode_ids(array(0, 0, 1, 0, 2)) AS r").first().r == "hh "


def test_marks_move_no_offsets(spark):
    engine = Engine.from_json(fixtures.unigram_small(normalizer=None))
    found = engine.encode_by_words(spark.createDataFrame([("the of\nthe",)], "text string")).first().encoding
    assert [tuple(o) for o in found.offsets] == [(0, 3), (4, 6), (7, 10)]


def test_contiguous_pieces_in_columns(spark):
    made = column(spark, "aab", lambda t: split.pre_tokenize(split.whole(t), (Part("Split", {"pattern": {"Regex": "a"}, "behavior": "Contiguous"}),)))
    assert [(p.text, p.start, p.end) for p in made] == [("aa", 0, 2), ("b", 2, 3)]
    assert column(spark, ["a", "a"], lambda t: decode.ctc(t, "x"), "array<string>") == ["a"]
