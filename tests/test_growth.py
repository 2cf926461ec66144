"""What grew faster than the input once: results as before, and what must not be made or sent any more."""

import pickle
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from lexspark import Engine, fixtures, queries
from lexspark.functions import normalize
from lexspark.operators import models
from lexspark.operators import words as words_plan
from lexspark.plans.config import WordPieceModel


def test_parts_of_pairs_are_counted_without_making_them(spark):
    texts = ["", "the station", "on the land of the sea, " * 9, "an old man " * 3, None]
    frame = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for strategy in ("LongestFirst", "OnlyFirst", "OnlySecond"):
        for length, stride in ((9, 3),):
            rule = {"max_length": length, "stride": stride, "strategy": strategy, "direction": "Right"}
            engine = Engine.from_json(fixtures.bert_small(truncation=rule))
            all = engine.encode_pairs(frame, "a", "b", by_words=False).select("a", "b", "encoding.ids", "encoding.words", (F.size("encoding.overflowing") + 1).alias("n"))
            few = engine.encode_pairs(frame, "a", "b", by_words=False, parts="n")
            assert few.where(F.size("encoding.overflowing") > 0).count() == 0
            few = few.select("a", "b", "encoding.ids", "encoding.words", "n")
            assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, all.collect()), key=repr)


def test_batches_for_python_are_bounded_in_bytes(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1_000_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    @F.arrow_udf("int")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    frame = queries.read(spark, str(tmp_path), "documents").coalesce(1)
    assert frame.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= 8


def test_normal_forms_over_parts_of_a_batch(spark):
    texts = ["", None, "e\u0301", "\ufb01", "\uac01"] * 50
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for form in normalize.NORMAL_FORMS:
        found = frame.select("i", normalize.normal_form(form)("t").alias("n")).orderBy("i").collect()
        assert [r.n for r in found] == [None if t is None else unicodedata.normalize(form, t) for t in texts]


def test_a_worker_remembers_few_words_once(monkeypatch):
    from lexspark.plans import engine as plans
    from lexspark.plans.rows import row_encoder

    monkeypatch.setattr(plans, "MOST_TOKENS", 20)
    made = plans.Made(Engine.from_json(fixtures.bert_small()))
    run = made.tokenizer()
    alone = [plans.Made(made.engine).tokenizer()(f"land{i} sea") for i in range(50)]
    for i in range(50):
        assert run(f"land{i} sea") == alone[i]
        assert len(run.known) <= 20
    assert all(pickle.loads(pickle.dumps(made)).tokenizer() is made.tokenizer() for _ in range(3))
    for _ in range(9):
        plans.Made(made.engine, row_encoder).tokenizer()
    assert len(plans._made) <= plans.MOST_MADE


def test_models_read_their_words_once(spark):
    words = spark.range(9).select(F.concat(F.lit("the"), F.col("id").cast("string")).alias("word"))
    wordpiece, unigram = Engine.from_json(fixtures.bert_small()).plan.model, Engine.from_json(fixtures.unigram_small()).plan.model
    for made in (models.wordpiece_by_join(words, wordpiece), models.unigram_by_join(words, unigram)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert len([line for line in plan.split("\n") if " Range (" in line]) == 1


def test_wordpiece_patterns(spark):
    texts = ["", "ab", "abc", "abcab", "a", "b", "[UNK]", "#", "##b", "a.b", "世a", "xab", "abx", "ab" * 30, "a\nb", "(a", "𝒳ab", "aab"]
    frame = spark.createDataFrame([(t,) for t in [*texts, None, "ab"]], "word string")
    listed = ["[UNK]", "a", "ab", "abc", "##b", "##bc", "##c", "##ab", "##", ".", "##.", "(", "##a", "\n", "##\n", "𝒳", "#"]
    for names, prefix in ((listed, "##"), (listed, ""), (["[UNK]", "ab"], "##"), (["[UNK]"], "##"), (["##b", "a"], "##")):
        model = WordPieceModel({p: i for i, p in enumerate(names)}, "[UNK]", 50, prefix)
        expected = {t: models.WordPiece(model).tokenize(t) for t in texts}
        for plan in (models.wordpiece_by_join(frame, model), models._wordpiece_by_spans(frame, model, "word")):
            assert {r.word: [tuple(t) for t in r.tokens] for r in plan.collect()} == expected


def test_only_rare_words_move(spark, monkeypatch):
    texts = ["the land  of\tthe sea", "", None, " zq! [MASK] the", "déjà vu the 世界", " x the\x0b.", "[MASK]"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    engine = Engine.from_json(fixtures.bert_small())
    expected = {r.i: r.encoding for r in engine.encode(frame).collect()}
    for most in (0, 1, 50_000):
        monkeypatch.setattr(words_plan, "MOST_HOT", most)
        found = engine.encode_by_words(frame, key="i")
        assert {r.i: r.encoding for r in found.collect()} == expected
    counted = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "word string, n bigint")
    assert [words_plan.least_frequent(counted, "n", most) for most in (0, 1, 2, 3, 4)] == [21, 9, 9, 5, 1]


def test_places_move_as_texts(spark):
    frame = spark.createDataFrame([(1, "the sea")], "i int, _s string").select("i", F.expr("array(named_struct('text', _s, 'start', 0, 'end', 7, 'token_id', cast(null as int)))").alias("_s"))
    placed = words_plan.placed_words(Engine.from_json(fixtures.bert_small()), frame.repartition(3, "i"), "i")
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_ids_alone_are_found_without_places(monkeypatch):
    from lexspark.plans import engine as plans

    texts = ["", " ", "the land  of\tthe sea", "Déjà VU, 世界! a b c", "x\x0b\x1cy\x85z\x00", "İstanbul ﬁ Σς", "é 각", "zq" * 30, "w" * 90, "a.b,c" * 40]
    for changes in ({}, {"pre_tokenizer": {"type": "Metaspace"}}, {"normalizer": {"type": "StripAccents"}}, {"normalizer": None}, {"normalizer": {"type": "NFKD"}}):
        engine = Engine.from_json(fixtures.bert_small(**changes)).add_tokens("sea")[0]
        run = engine.tokenizer()
        for most in (0, 20, 200_000):
            monkeypatch.setattr(plans, "MOST_TOKENS", most)
            ids = engine.id_tokenizer()
            for text in [*texts, "[MASK] the", "the[SEP]", "the sea", "SEA"] * 2:
                assert ids(text) == run(text)[0]
    monkeypatch.setattr(plans, "LONGEST_KNOWN", 3)
    ids = Engine.from_json(fixtures.bert_small()).id_tokenizer()
    assert ids("the seas, " + "w" * 90) and set(ids.known) == {"the", ",", ""}


def test_a_worker_encodes_words_it_has_met_by_looking_them_up(monkeypatch):
    from lexspark.plans.rows import row_decoder, row_encoder

    engine = Engine.from_json(fixtures.bert_small())
    run, back, called = row_encoder(engine), row_decoder(engine), []
    expected, decoded = run("the land of the sea, déjà"), "the land of the sea, deja"
    monkeypatch.setattr(models.WordPiece, "tokenize", lambda *_: called.append(1))
    monkeypatch.setattr(models.WordPieceIds, "__call__", lambda *_: called.append(1))
    monkeypatch.setattr(normalize, "_each", lambda *_: called.append(1))
    assert run("the land of the sea, déjà") == expected and not called
    assert back(expected) == decoded and len(back(expected, False)) > len(decoded)
    assert back([]) == "" and back([2, 3]) == ""


def test_wordpiece_ids():
    words = ["", "ab", "abc", "abcab", "a", "b", "[UNK]", "#", "##b", "a.b", "世a", "xab", "abx", "ab" * 30, "a\nb", "(a", "𝒳ab", "aab", "##"]
    listed = ["[UNK]", "a", "ab", "abc", "##b", "##bc", "##c", "##ab", "##", ".", "##.", "(", "##a", "\n", "##\n", "𝒳", "#"]
    for names, prefix in ((listed, "##"), (listed, ""), (["[UNK]", "ab"], "##"), (["[UNK]"], "##"), (["##b", "a"], "##"), ([], "")):
        model = WordPieceModel({p: i for i, p in enumerate(names)}, "[UNK]", 50, prefix)
        assert [models.id_evaluator(model)(w) for w in words] == [[t[0] for t in models.WordPiece(model).tokenize(w)] for w in words]


def test_functions_over_one_batch_tokenise_it_once(monkeypatch):
    from lexspark.plans.rows import row_encoder

    engine, texts, calls = Engine.from_json(fixtures.bert_small()), ["the sea", None, ""], []
    run = row_encoder(engine)
    monkeypatch.setattr(models.WordPieceIds, "__call__", lambda self, word: calls.append(word) or [7] * bool(word))
    assert run.of_batch(texts, [True] * 3) == [[2, 7, 7, 3], None, [2, 3]] and "the" in calls
    found = len(calls)
    assert run.of_batch(texts, [False] * 3) == [[7, 7], None, []] and run.of_batch(texts, [True] * 3)[0] == [2, 7, 7, 3]
    assert len(calls) == found
    assert run.of_batch(["land", "the"], [False, True]) == [[7], [2, 7, 3]]


def test_ids_by_words_are_those_of_the_encodings(spark, monkeypatch):
    texts = ["the land  of\tthe sea", "", None, " zq! [MASK] the", "déjà vu the 世界", " x the\x0b.", "[MASK]", " "]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    short = {"truncation": {"max_length": 4, "stride": 1, "strategy": "LongestFirst", "direction": "Right"}}
    for changes, special, most in (({}, True, 1), ({}, False, 50_000), (short, True, 50_000)):
        engine = Engine.from_json(fixtures.bert_small(**changes))
        expected = {r.i: r.ids for r in engine.encode(frame, add_special_tokens=special).select("i", "encoding.ids").collect()}
        monkeypatch.setattr(words_plan, "MOST_HOT", most)
        found = engine.ids_by_words(frame, "i", add_special_tokens=special).collect()
        assert len(found) == len(texts) and {r.i: r.ids for r in found} == expected


def test_ids_alone_need_no_places(spark, tmp_path):
    spark.createDataFrame([(1, "the sea"), (2, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES["s4_encode"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window " not in plan and "Python" not in plan
