"""Characters and columns of the caller's that were lost once."""

import pytest
from pyspark.sql import functions as F

from lexspark import AddedToken, Engine, fixtures
from lexspark.functions import split
from lexspark.operators import models
from lexspark.plans.config import BpeModel

from .test_engine import pieces

MARKS = "a﷐b ﷑ c﷑d.﷐﷐e﷑"


@pytest.mark.parametrize(
    "raw",
    [
        {"type": "BertPreTokenizer"},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
        {"type": "Split", "pattern": {"Regex": "[cb. ]+"}, "behavior": "Isolated", "invert": False},
        {"type": "Split", "pattern": {"Regex": r"(?<=﷑)d|\s"}, "behavior": "Removed", "invert": False},
    ],
)
@pytest.mark.parametrize("text", [MARKS, "﷐", "x\n﷑\ny", "plain text. here"])
def test_splits_keep_the_characters_that_mark_matches(spark, raw, text):
    native, fused = pieces(spark, text, raw)
    if raw["type"] == "ByteLevel":
        native, fused = [p[0] for p in native], [p[0] for p in fused]
    assert native == fused
    if raw["type"] == "BertPreTokenizer":
        assert "".join(p[0] for p in native) == "".join(text.split())


def test_added_tokens_beside_marks(spark):
    engine, _ = Engine.from_json(fixtures.EMPTY).add_tokens(AddedToken("[M]"))
    found = spark.createDataFrame([(MARKS + "[M]﷐[M]",)], "t string").select(engine.pieces(F.col("t")).alias("p")).first().p
    assert [p.text for p in found] == [MARKS, "[M]", "﷐", "[M]"] and [p.token_id is None for p in found] == [True, False, True, False]


def test_replacing_plan_keeps_marks(spark):
    model = BpeModel({"a": 0, "b": 1, "ab": 2}, (("a", "b"),))
    texts = ["ab﷐ab", "﷑", "a﷑b", "abab", ""]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(models.bpe_by_replace(F.col("t"), model).alias("r")).collect()
    assert [r.r for r in found] == [["ab", "﷐", "ab"], ["﷑"], ["a", "﷑", "b"], ["ab", "ab"], []]
    with pytest.raises(ValueError, match="marks"):
        models.bpe_by_replace(F.col("t"), BpeModel({"﷐": 0}))


def test_columns_of_the_caller_stay(spark):
    engine = Engine.from_json(fixtures.bert_small())
    frame = spark.createDataFrame([("the station", 7, [74])], "text string, _tokens int, _held array<int>")
    encoded = engine.encode(frame)
    assert encoded.columns == ["text", "_tokens", "_held", "encoding"] and encoded.first()._tokens == 7
    decoded = engine.decode(frame, "_held")
    assert decoded.columns == ["text", "_tokens", "_held", "decoded"] and decoded.first()._held == [74] and decoded.first().decoded == "the"


def test_a_distant_id_costs_no_long_table(spark):
    vocab = {"a": 0, "b": 2_000_000_000}
    engine = Engine.from_json(fixtures.EMPTY | {"model": {"type": "BPE", "vocab": vocab, "merges": []}})
    frame = spark.createDataFrame([([0, 2_000_000_000],)], "ids array<int>")
    assert engine.decode(frame).first().decoded == "a b"
    with pytest.raises(Exception, match="no token"):
        engine.decode(spark.createDataFrame([([5],)], "ids array<int>")).collect()


def test_marks_are_found_only_where_they_are(spark):
    plan = spark.createDataFrame([("x y",)], "t string").select(split.split_bert(split.whole(F.col("t"))).alias("p"))
    assert [p.text for p in plan.first().p] == ["x", "y"]
