"""The command line, and names and lookups that no other test touches."""

import json

import pytest

from lexspark import AddedToken, Engine, cli, fixtures


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tokenizer.json").write_text(json.dumps(fixtures.bert_small()), encoding="utf-8")
    assert cli.main([str(tmp_path), "the station"]) == 0
    lines = dict(line.split(": ", 1) for line in capsys.readouterr().out.strip().split("\n"))
    assert list(lines) == ["ids", "type_ids", "tokens", "words", "offsets", "attention_mask", "decoded"]
    assert lines["tokens"].startswith("['[CLS]', 'the', ") and lines["decoded"] == "the station" and lines["words"].startswith("[None, 0, 1")
    assert cli.main([]) == 2 and "FOLDER TEXT" in capsys.readouterr().err


def test_special_tokens_and_ids():
    engine, _ = Engine.from_json(fixtures.bert_small(added_tokens=[])).add_tokens(AddedToken("[CLS]", special=True), "plain")
    assert engine.added.is_special("[CLS]") and not engine.added.is_special("plain") and not engine.added.is_special("none")
    assert engine.added.by_id == {2: "[CLS]", engine.vocab_size(): "plain"}


@pytest.mark.parametrize("kind", ["BertProcessing", "RobertaProcessing"])
def test_post_processors_by_name_only(spark, kind):
    with pytest.warns(UserWarning, match=kind):
        engine = Engine.from_json(fixtures.bert_small(post_processor={"type": kind, "sep": ["[SEP]", 3], "cls": ["[CLS]", 2]}))
    assert engine.plan.post_processor == ()
    assert engine.encode(spark.createDataFrame([("the",)], "text string")).first().encoding.ids == [engine.vocab["the"]]


def test_special_tokens_may_be_encoded_as_text(spark):
    config = fixtures.bert_small(post_processor=None)
    text = spark.createDataFrame([("a [SEP] b",)], "text string")
    assert 3 in Engine.from_json(config).encode(text).first().encoding.ids
    as_text = Engine.from_json(config, encode_special_tokens=True)
    for encoded in (as_text.encode(text), as_text.encode_by_words(text)):
        assert 3 not in encoded.first().encoding.ids
