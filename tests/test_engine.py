"""The reference behaviour's unit cases, as configurations, inputs and literal expectations."""

import json

import pytest
from pyspark.sql import functions as F

from lexspark import AddedToken, ConfigError, Engine, fixtures
from lexspark.functions import decode, normalize, split
from lexspark.operators import added, encoding, models
from lexspark.plans.config import BpeModel, Padding, Part, Truncation, WordPieceModel, parse
from lexspark.sources.config_file import checked_utf8

TEXT = "Hello World!\tThis is a test.\n"


def column(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()[0]


def part(raw):
    return Engine.from_json(fixtures.EMPTY | {"normalizer": raw}).plan.normalizer


BERT = {"type": "BertNormalizer", "clean_text": False, "handle_chinese_chars": False, "strip_accents": False, "lowercase": False}
NORMALIZERS = [
    ({"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]}, TEXT, "▁Hello▁World!\tThis▁is▁a▁test.\n"),
    (BERT | {"clean_text": True}, TEXT, "Hello World! This is a test. "),
    (BERT | {"clean_text": True}, "a\x00b�c\x07d\u0085e f", "abcde f"),
    (BERT | {"handle_chinese_chars": True}, "Hello 世界!", "Hello  世  界 !"),
    (BERT | {"strip_accents": True}, "Hélló Wórld! Thïs ïs á tést.", "Hello World! This is a test."),
    (BERT | {"lowercase": True}, "HÉLLO", "hello"),
    ({"type": "NFC"}, "á", "á"),
    ({"type": "NFD"}, "á", "á"),
    ({"type": "NFKC"}, "ﬁ", "fi"),
    ({"type": "NFKD"}, "áﬁ", "áfi"),
    ({"type": "Prepend", "prepend": "▁"}, "", ""),
    ({"type": "Prepend", "prepend": "▁"}, "x", "▁x"),
    ({"type": "Replace", "pattern": {"String": "ab"}, "content": "."}, "aababb", "a..b"),
    ({"type": "Strip", "strip_left": True, "strip_right": True}, "　 a b  \n", "a b"),
    ({"type": "Strip", "strip_left": True, "strip_right": False}, " a ", "a "),
    ({"type": "StripAccents"}, "áé", "aé"),
]


@pytest.mark.parametrize("raw,text,expected", NORMALIZERS)
def test_normalizers_and_alignment(spark, raw, text, expected):
    parts = part(raw)
    assert column(spark, text, lambda t: normalize.normalize(t, parts)) == expected
    made, starts, ends = normalize.normalize_aligned(normalize.aligned(text), parts)
    assert made == expected and len(starts) == len(ends) == len(made)
    assert all(0 <= s <= e <= len(text) for s, e in zip(starts, ends)) and list(starts) == sorted(starts)


def test_names_without_behaviour_warn():
    with pytest.warns(UserWarning):
        assert part({"type": "Lowercase"}) == ()
    with pytest.warns(UserWarning):
        assert Engine.from_json(fixtures.EMPTY | {"pre_tokenizer": {"type": "UnicodeScripts"}}).plan.pre_tokenizer == ()
    for slot, raw in (("model", {"type": "Markov", "vocab": {}}), ("decoder", {"type": "Telegraph"})):
        with pytest.raises(NotImplementedError):
            Engine.from_json(fixtures.EMPTY | {slot: raw})


def pieces(spark, text, raw):
    engine = Engine.from_json(fixtures.EMPTY | {"pre_tokenizer": raw})
    native = [(p.text, p.start, p.end) for p in column(spark, text, engine.pieces)]
    fused = [(t, s[0], e[-1]) for t, s, e, _ in engine._words()(text)]
    return native, fused


def test_bert_split(spark):
    native, fused = pieces(spark, "Hey friend!     How are you?!?", {"type": "BertPreTokenizer"})
    expected = [("Hey", 0, 3), ("friend", 4, 10), ("!", 10, 11), ("How", 16, 19), ("are", 20, 23), ("you", 24, 27), ("?", 27, 28), ("!", 28, 29), ("?", 29, 30)]
    assert native == fused == expected
    native, fused = pieces(spark, "a b　$c+", {"type": "BertPreTokenizer"})
    assert native == fused == [("a", 0, 1), ("b", 2, 3), ("$c+", 4, 7)]


PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def test_regex_split(spark):
    raw = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False}
    native, fused = pieces(spark, "Why don't you give 100 dollars?", raw)
    assert native == fused
    assert [p[0] for p in native] == ["Why", " don", "'t", " you", " give", " ", "100", " dollars", "?"] and native[5] == (" ", 18, 19)
    native, fused = pieces(spark, "a1b22c", {"type": "Split", "pattern": {"Regex": "[0-9]+"}, "behavior": "Removed", "invert": False})
    assert native == fused == [("a", 0, 1), ("b", 2, 3), ("c", 5, 6)]


def test_byte_level_split(spark):
    native, _ = pieces(spark, "How are ya doing?", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": False})
    assert native == [("ĠHowĠareĠyaĠdoing?", 0, 18)]
    native, fused = pieces(spark, "Hé's  x\n\n", {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
    assert [p[0] for p in native] == [p[0] for p in fused] == ["HÃ©", "'s", "Ġ", "Ġx", "ĊĊ"]
    every = "".join(map(chr, range(256))) + "世😀"
    assert column(spark, every, lambda t: split.from_byte_characters(split.to_byte_characters(t))) == every
    assert len(set(split.BYTE_CHARS)) == 256


def test_wordpiece():
    one = lambda word, **m: models.WordPiece(WordPieceModel(**m)).tokenize(word)
    assert one("hello", vocab={"[UNK]": 7}) == [(7, "[UNK]", 0, 5)]
    assert one("hello", vocab={}) == [(0, "[UNK]", 0, 5)]
    assert one("hello", vocab={"hello": 1}, max_input_chars_per_word=4) == [(0, "[UNK]", 0, 5)]
    assert one("helloworld", vocab={"hello": 420, "TEST_##world": 111}, continuing_subword_prefix="TEST_##") == [(420, "hello", 0, 5), (111, "TEST_##world", 5, 10)]
    assert one("helxx", vocab={"hel": 1, "##x": 2, "[UNK]": 3}) == [(1, "hel", 0, 3), (2, "##x", 3, 4), (2, "##x", 4, 5)]
    assert one("helxy", vocab={"hel": 1, "##x": 2, "[UNK]": 3}) == [(3, "[UNK]", 0, 5)]


def test_bpe_unknown():
    vocab = {"<unk>": 0, "a": 1, "b": 2}
    assert models.Bpe(BpeModel(vocab, unk_token="<unk>")).tokenize("cc") == [(0, "<unk>", 0, 1), (0, "<unk>", 1, 2)]
    assert models.Bpe(BpeModel(vocab, unk_token="<unk>", fuse_unk=True)).tokenize("accb") == [(1, "a", 0, 1), (0, "<unk>", 1, 3), (2, "b", 3, 4)]
    assert models.Bpe(BpeModel(vocab)).tokenize("cc") == []
    bytes_ = {f"<0x{b:02X}>": b + 10 for b in "é".encode()}
    assert [t[1] for t in models.Bpe(BpeModel(vocab | bytes_, byte_fallback=True)).tokenize("aé")] == ["a", "<0xC3>", "<0xA9>"]
    marked = BpeModel({"a": 0, "##b</w>": 1, "ab</w>": 2, "a</w>": 3}, (("a", "##b</w>"),), continuing_subword_prefix="##", end_of_word_suffix="</w>")
    assert models.Bpe(marked).tokenize("ab") == [(2, "ab</w>", 0, 2)]


UNRELATED = ["r e", "a t", "e d", "u n", "at ed", "re l", "rel ated", "un related"]


def unrelated(**options):
    names = list("unrelatd") + [m.replace(" ", "") for m in UNRELATED]
    return BpeModel({n: i for i, n in enumerate(dict.fromkeys(names))}, tuple(tuple(m.split(" ")) for m in UNRELATED), **options)


def test_bpe_merges(spark):
    tokens = models.Bpe(unrelated()).tokenize("unrelated")
    assert [(t[1], t[2], t[3]) for t in tokens] == [("unrelated", 0, 9)] and tokens[0][0] == 15
    assert [t[1] for t in models.Bpe(unrelated(dropout=1.0, ignore_merges=True)).tokenize("unrelated")] == list("unrelated")
    assert [t[1] for t in models.Bpe(unrelated(ignore_merges=True)).tokenize("unrelated")] == ["unrelated"]
    some = models.Bpe(unrelated(dropout=0.5))
    assert some.tokenize("unrelated") == some.tokenize("unrelated") and "".join(t[1] for t in some.tokenize("unrelated")) == "unrelated"
    assert column(spark, "unrelated", lambda t: models.bpe_by_replace(t, unrelated())) == ["unrelated"]
    order = BpeModel({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}, (("a", "b"), ("b", "c")))
    assert [t[1] for t in models.Bpe(order).tokenize("abc")] == ["ab", "c"]
    assert [t[1] for t in models.Bpe(order, "highest").tokenize("abc")] == ["a", "bc"]
    assert not models.replaceable(BpeModel({}, (("ab", "c"), ("a", "b"))))


def test_wordpiece_plans_agree(spark):
    model = Engine.from_json(fixtures.bert_small()).plan.model
    words = ["the", "station", "zzz", "世", "a世", "x" * 41, "thethe", "q", ""]
    frame = spark.createDataFrame([(w,) for w in [*words, "the", None]], "word string")
    found = {r.word: [tuple(t) for t in r.tokens] for r in models.wordpiece_by_join(frame, model).collect()}
    assert found == {w: models.WordPiece(model).tokenize(w) for w in words}


# --- encodings ------------------------------------------------------------------------------------------------------------------


def made(n):
    return {"ids": list(range(n)), "tokens": [f"t{i}" for i in range(n)], "words": list(range(n)), "starts": list(range(n)), "ends": list(range(1, n + 1))}


KIND = "struct<ids:array<int>,tokens:array<string>,words:array<int>,starts:array<int>,ends:array<int>>"


def spans(spark, n, **rule):
    return [(w.start, w.end) for w in column(spark, n, lambda c: encoding.window_starts(c, Truncation(**rule)), "int")]


def test_truncation(spark):
    assert spans(spark, 10, max_length=3, stride=1) == [(0, 3), (2, 5), (4, 7), (6, 9), (8, 10)]
    assert spans(spark, 10, max_length=3, direction="Left") == [(7, 10), (4, 7), (1, 4), (0, 1)]
    assert spans(spark, 2, max_length=1) == [(0, 1), (1, 2)]
    cut = lambda n, **r: column(spark, made(n), lambda c: encoding.truncate(encoding.from_tokens(c), Truncation(**r)), KIND)
    parts = cut(2, max_length=1)
    assert [p.ids for p in parts] == [[0], [1]] and parts[1].tokens == ["t1"] and tuple(parts[1].offsets[0]) == (1, 2)
    assert len(cut(2, max_length=0)) == len(cut(2, max_length=2)) == len(cut(5, max_length=2, strategy="OnlySecond")) == 1
    for bad in ({"max_length": 3, "stride": 3}, {"max_length": 3, "direction": "Up"}):
        with pytest.raises(ConfigError):
            Engine.from_json(fixtures.EMPTY | {"truncation": {"strategy": "LongestFirst", "stride": 0} | bad})


def test_padding(spark):
    pad = lambda n, **r: column(spark, made(n), lambda c: encoding.pad(encoding.from_tokens(c), Padding(**r)), KIND)
    six = pad(4, pad_to_multiple_of=3, pad_id=9, pad_type_id=2, pad_token="P")
    assert six.ids == [0, 1, 2, 3, 9, 9] and six.type_ids[-1] == 2 and six.tokens[-1] == "P" and six.words[-2:] == [0, 0]
    assert six.special_tokens_mask == [0, 0, 0, 0, 1, 1] and six.attention_mask == [1, 1, 1, 1, 0, 0] and tuple(six.offsets[-1]) == (0, 0)
    assert pad(2, fixed=1).ids == [0, 1] and pad(1, fixed=1, pad_to_multiple_of=3).ids == [0, 0, 0]
    assert pad(2, fixed=4, direction="Left", pad_id=7).ids == [7, 7, 0, 1]


def test_trimmed_offsets(spark):
    tokens = ["Ġ", "ĠĠĠĠHelloĠĠ", "ĠĠHello", "HelloĠĠ", "ĠĠĠĠ"]
    ends = [1, 11, 18, 25, 29]
    given = {"ids": [0] * 5, "tokens": tokens, "words": [0] * 5, "starts": [0, 0, 11, 18, 25], "ends": ends}
    given["ends"][0], given["starts"][1] = 1, 0
    result = column(spark, given, lambda c: encoding.trim_offsets(encoding.from_tokens(c), False), KIND)
    assert [tuple(o) for o in result.offsets] == [(1, 1), (4, 9), (13, 18), (18, 23), (29, 29)]


def test_end_to_end(spark):
    config = fixtures.bert_small(
        added_tokens=[],
        normalizer=BERT | {"clean_text": True, "lowercase": True},
        post_processor=fixtures.template(101, 102),
        model={"type": "WordPiece", "unk_token": "[UNK]", "max_input_chars_per_word": 100, "continuing_subword_prefix": "##", "vocab": {"[PAD]": 0}},
    )
    frame = spark.createDataFrame([("Hello World!",), ("",), (None,)], "text string")
    first, empty, null = [r.encoding for r in Engine.from_json(json.dumps(config)).encode(frame).collect()]
    assert first.ids == [101, 0, 0, 0, 102] and first.words == [None, 0, 1, 2, None]
    assert [tuple(o) for o in first.offsets] == [(0, 0), (0, 5), (6, 11), (11, 12), (0, 0)]
    assert first.special_tokens_mask == [1, 0, 0, 0, 1] and first.attention_mask == [1] * 5 and first.type_ids == [0] * 5
    assert empty.ids == [101, 102] and null is None
    bare = Engine.from_json(config).encode(frame, add_special_tokens=False).first().encoding
    assert bare.ids == [0, 0, 0]
    nothing = Engine.from_json(fixtures.EMPTY).encode(frame).first().encoding
    assert nothing.ids == nothing.tokens == nothing.offsets == nothing.overflowing == []


def test_config_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        Engine.load()
    for call in (lambda: Engine.load(path=str(tmp_path / "none")), lambda: Engine.load(spark, str(tmp_path / "none")), lambda: parse("{}"), lambda: parse("{")):
        with pytest.raises(ConfigError):
            call()
    (tmp_path / "tokenizer.json").write_text(json.dumps(fixtures.bert_small()), encoding="utf-8")
    assert Engine.load(spark, str(tmp_path)).vocab_size() == Engine.load(path=str(tmp_path)).vocab_size() == len(fixtures.wordpiece_vocab())


def test_added_vocabulary(spark):
    engine = Engine.from_json(fixtures.bert_small(added_tokens=[]))
    grown, count = engine.add_special_tokens("[CLS]", "[SEP]", "[NEW]", "")
    assert count == 3 and engine.added.tokens == () and grown.added.by_content == {"[CLS]": 2, "[SEP]": 3, "[NEW]": engine.vocab_size()}
    assert grown.add_tokens("other")[0].added.by_content["other"] == engine.vocab_size() + 1
    text = "[CLS] Hello [NEW]you[SEP]"
    found = column(spark, text, lambda t: added.extract(split.whole(t), grown.added.matchable(grown.vocab, True), grown.added.by_content))
    assert [(p.text, p.start, p.end, p.token_id) for p in found] == [("[CLS]", 0, 5, 2), (" Hello ", 5, 12, None), ("[NEW]", 12, 17, engine.vocab_size()), ("you", 17, 20, None), ("[SEP]", 20, 25, 3)]
    strict = Engine.from_json(fixtures.bert_small(added_tokens=[]), match_only_in_vocab=True).add_tokens("[NEW]")[0]
    assert strict.added.matchable(strict.vocab, True) == []


def test_added_token_options(spark):
    tokens = (AddedToken("ab", single_word=True), AddedToken("[M]", lstrip=True, rstrip=True))
    vocabulary, _ = added.AddedVocabulary().add(tokens, {})
    found = column(spark, "ab cab x  [M]  y", lambda t: added.extract(split.whole(t), vocabulary.matchable({}, True), vocabulary.by_content))
    assert [p.text for p in found if p.token_id is not None] == ["ab", "  [M]  "]


# --- decoders --------------------------------------------------------------------------------------------------------------------


def decoded(spark, tokens, *raw):
    parts = Engine.from_json(fixtures.EMPTY | {"decoder": {"type": "Sequence", "decoders": list(raw)}}).plan.decoder
    result = F.col("v")
    for p in parts:
        result = decode.apply_one(result, p)
    return column(spark, tokens, lambda c: result, "array<string>")


def test_decoders(spark):
    wordpiece = {"type": "WordPiece", "prefix": "##", "cleanup": True}
    assert decoded(spark, ["##uelo", "Ara ?", "##új", "##o", "No .", "##guera"], wordpiece) == ["##uelo", " Ara?", "új", "o", " No.", "guera"]
    assert decoded(spark, ["a", "do not", "##x"], wordpiece | {"cleanup": False}) == ["a", " do not", "x"]
    assert decoded(spark, ["How", "Ġare", "Ġya", "Ġdoing", "?"], {"type": "ByteLevel"}) == ["How are ya doing?"]
    assert decoded(spark, ["aÃ"], {"type": "ByteLevel"}) == ["a\ufffd"]
    assert decoded(spark, ["a▁b"], {"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "Fuse"}) == ["a b"]
    assert decoded(spark, ["a", "<0xC3>", "<0xA9>", "<0xFF>", "b"], {"type": "ByteFallback"}) == ["a", "�", "�", "�", "b"]
    assert decoded(spark, ["a", "<0xC3>", "<0xA9>", "b"], {"type": "ByteFallback"}) == ["a", "é", "b"]
    assert decoded(spark, ["  a  ", " b"], {"type": "Strip", "content": " ", "start": 1, "stop": 1}) == [" a ", "b"]


def test_decode(spark):
    engine = Engine.from_json(fixtures.bert_small())
    frame = spark.createDataFrame([([2, 74, 115, 284, 3],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in engine.decode(frame).collect()] == ["the stat", "", None]
    assert engine.decode(frame, skip_special_tokens=False).first().decoded == "[CLS] the stat [SEP]"
    plain = Engine.from_json(fixtures.bert_small(decoder=None))
    assert plain.decode(frame).first().decoded == "the st ##at"
    with pytest.raises(Exception, match="no token"):
        engine.decode(spark.createDataFrame([([99999],)], "ids array<int>")).collect()


def test_round_trip_and_offsets(spark):
    engine = Engine.from_json(fixtures.byte_bpe_small())
    texts = ["How are you?  \n", "Çé😀 世界's", "the station and the", " lead", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = engine.encode(frame).select("text", F.col("encoding.ids").alias("ids"), "encoding.offsets").collect()
    back = engine.decode(spark.createDataFrame([(r.ids,) for r in rows], "ids array<int>")).collect()
    assert [r.decoded for r in back] == texts
    bert = Engine.from_json(fixtures.bert_small())
    for r in bert.encode(frame).collect():
        e = r.encoding
        assert len({len(e[n]) for n in encoding.FIELDS}) == 1
        inner = [o for o, s in zip(e.offsets, e.special_tokens_mask) if not s]
        assert all(0 <= o.start <= o.end <= len(r.text) for o in inner) and [o.start for o in inner] == sorted(o.start for o in inner)


def test_utf8(spark):
    frame = spark.createDataFrame([(bytearray("é世".encode()),)], "data binary")
    assert checked_utf8(frame, "data").first().text == "é世"
    bad = spark.createDataFrame([(bytearray(b"a\xff"),)], "data binary")
    assert checked_utf8(bad, "data", invalid="null").first().text is None
    assert checked_utf8(bad, "data", invalid="replace").first().text == "a�"
    with pytest.raises(Exception):
        checked_utf8(bad, "data").collect()


def test_sql_functions(spark):
    Engine.from_json(fixtures.bert_small()).register(spark)
    assert spark.sql("SELECT encode_ids('the the') AS r").first().r == [74, 74]
    assert [(r.token, r.start) for r in spark.sql("SELECT * FROM tokenize('the stat')").collect()] == [("the", 0), ("st", 4), ("##at", 6)]


def test_streaming(spark, tmp_path):
    from lexspark.streaming.encode import encode_stream, token_counts, write_encoded

    engine = Engine.from_json(fixtures.bert_small())
    data = spark.createDataFrame([(f"the station {i}", i) for i in range(20)], "text string, i int").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    write_encoded(stream, engine, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    ids = lambda df: sorted((r.i, r.ids) for r in df.select("i", F.col("encoding.ids").alias("ids")).collect())
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == ids(engine.encode(data))
    with pytest.raises(ValueError):
        encode_stream(data, engine)
    query = token_counts(stream, engine, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(texts) AS n FROM counts").first().n == 20


def test_template_parts():
    assert Part("Sequence", {}, (Part("a"), Part("Sequence", {}, (Part("b"),)))).flat() == (Part("a"), Part("b"))


def test_chained_post_processors_and_raw_added_tokens(spark):
    post = {"type": "Sequence", "processors": [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}, fixtures.template(300, 301)]}
    config = fixtures.byte_bpe_small(
        post_processor=post,
        normalizer={"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "x"}, "content": "yy"}, {"type": "StripAccents"}]},
        added_tokens=[{"content": "[M]", "normalized": False, "special": True}],
    )
    engine = Engine.from_json(config)
    frame = spark.createDataFrame([("ax [M]x",)], "text string")
    e = engine.encode(frame).first().encoding
    assert e.tokens == ["[CLS]", "a", "y", "y", "Ġ", "[M]", "y", "y", "[SEP]"]
    assert [tuple(o) for o in e.offsets] == [(0, 0), (0, 1), (1, 2), (1, 2), (3, 3), (3, 6), (6, 7), (6, 7), (0, 0)]
    native = frame.select(engine.pieces(F.col("text")).alias("p")).first().p
    assert [(p.text, p.token_id) for p in native] == [("ayy", None), ("Ġ", None), ("[M]", engine.added.by_content["[M]"]), ("yy", None)]


def test_sql_functions_equal_the_engines_columns(spark):
    from lexspark import fixtures

    texts = ["the station, isn't it? " * 6, "déjà vu . 世界", "", None, "a", "x" * 60, " lead"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for build in (fixtures.bert_small, fixtures.byte_bpe_small, fixtures.trunc_pad):
        engine = Engine.from_json(build())
        engine.register(spark)
        frame.createOrReplaceTempView("_texts")
        for flag in (True, False):
            columns = engine.encode(frame, add_special_tokens=flag).select("i", F.col("encoding.ids").alias("ids"))
            wanted = {r.i: r.ids for r in columns.collect()}
            decoded = {r.i: r.decoded for r in engine.decode(columns, skip_special_tokens=flag).collect()}
            found = spark.sql(f"SELECT i, encode_ids(text, {flag}) AS ids, decode_ids(encode_ids(text, {flag}), {flag}) AS decoded FROM _texts").collect()
            assert {r.i: r.ids for r in found} == wanted and all(r.decoded == (None if r.ids is None else decoded[r.i]) for r in found)
        both = spark.sql("SELECT i, encode_ids(text) AS a, encode_ids(text, false) AS b, decode_ids(encode_ids(text)) AS c, decode_ids(encode_ids(text), true) AS d FROM _texts").collect()
        assert all(r.a == r.b and r.c == r.d for r in both)


def test_token_counts_equal_counted_encodings(spark):
    from lexspark import fixtures

    engine, _ = Engine.from_json(fixtures.bert_small(post_processor=None)).add_tokens("tion")
    frame = spark.createDataFrame([("a", "the station the tions"), (None, "the the"), ("b", ""), ("b", None), ("a", "zzz the")], "g string, text string")
    single = engine.encode(frame).select("g", F.explode(F.arrays_zip("encoding.tokens", "encoding.ids")).alias("t")).groupBy("g", "t.tokens", "t.ids").count()
    assert sorted(map(tuple, engine.token_counts(frame, by=("g",)).collect()), key=str) == sorted(map(tuple, single.collect()), key=str)
    total = engine.token_counts(frame).groupBy().agg(F.sum("n")).first()[0]
    assert total == sum(r["count"] for r in single.collect())
