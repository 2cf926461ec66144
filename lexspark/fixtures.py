"""Small deterministic vocabularies and pipelines for the registered queries, their SQL and the tests."""

from __future__ import annotations

import string
from typing import Any

from .functions.split import BYTE_CHARS

EMPTY: dict[str, Any] = {
    "truncation": None,
    "padding": None,
    "added_tokens": None,
    "normalizer": None,
    "pre_tokenizer": None,
    "post_processor": None,
    "decoder": None,
    "model": None,
}
#: Stands for a blank at the front of a word.
MARK = "▁"
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
#: Short words and word parts of the corpus's languages.
PARTS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "tion ment ing ed er re es en on an th ou st nt ti ea ha sh wh or ble ly "
    "le la les des que qui une est dans pour eau aux oi ai ier elle ou pa vi ch tre ique "
    "der die das und ein ich ist von mit auf den zu sch ung heit keit lich ver ge be tz pf ach "
    "el los las del por con una se mente cion ado rr ll ez aje ja ra co mi ta bo ci ie ue ar os as"
).split()
MERGES = tuple(
    tuple(m.split(" "))
    for m in (
        "t h|i n|e r|a n|o n|r e|e s|e n|o u|s t|n t|t i|e a|h a|s h|w h|o r|l e|l a|q u|d e|i e|c h|"
        "th e|an d|in g|ti on|en t|Ġ th|Ġ a|Ġ o|Ġ in|Ġ la|Ġ de|Ġ le|le s|qu e|sh er|th er|on es|Ġ the|Ġ and"
    ).split("|")
)
BERT_NORMALIZER = {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": True, "lowercase": True}


def wordpiece_vocab() -> dict[str, int]:
    """Specials, then characters, then word parts; each also as a continuation."""
    heads = list(dict.fromkeys([*string.ascii_lowercase, *string.digits, *string.punctuation, "ß", *PARTS]))
    return {piece: i for i, piece in enumerate([*SPECIALS, *heads, *(f"##{h}" for h in heads)])}


def byte_bpe_vocab() -> dict[str, int]:
    return {piece: i for i, piece in enumerate(dict.fromkeys([*BYTE_CHARS, *("".join(m) for m in MERGES)]))}


def unigram_pieces() -> list[tuple[str, float]]:
    """The unknown token, the word mark, most letters (the rarer are unknown) and word parts; scores are multiples of 1/8, with ties."""
    heads = list(dict.fromkeys([*string.ascii_lowercase.translate({ord(c): None for c in "jkqxz"}), *string.digits, ",", ".", *PARTS]))
    pieces = dict.fromkeys([MARK, *heads, *(MARK + h for h in heads if len(h) > 1)])
    return [("<unk>", 0.0), *((p, -(8 + 5 * len(p) + i % 7) / 8) for i, p in enumerate(pieces))]


def unigram_small(**changes: Any) -> dict[str, Any]:
    return EMPTY | {
        "normalizer": BERT_NORMALIZER,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "BertPreTokenizer"}, {"type": "Metaspace", "replacement": MARK, "prepend_scheme": "always"}]},
        "decoder": {"type": "Metaspace", "replacement": MARK},
        "model": {"type": "Unigram", "unk_id": 0, "vocab": [list(p) for p in unigram_pieces()]},
    } | changes


def template(cls: int = 2, sep: int = 3) -> dict[str, Any]:
    token = lambda name, id: {"id": name, "ids": [id], "tokens": [name]}
    return {
        "type": "TemplateProcessing",
        "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "[SEP]", "type_id": 0}}],
        "pair": [
            {"SpecialToken": {"id": "[CLS]", "type_id": 0}},
            {"Sequence": {"id": "A", "type_id": 0}},
            {"SpecialToken": {"id": "[SEP]", "type_id": 0}},
            {"Sequence": {"id": "B", "type_id": 1}},
            {"SpecialToken": {"id": "[SEP]", "type_id": 1}},
        ],
        "special_tokens": {"[CLS]": token("[CLS]", cls), "[SEP]": token("[SEP]", sep)},
    }


def bert_small(**changes: Any) -> dict[str, Any]:
    return EMPTY | {
        "added_tokens": [{"id": i, "content": s, "special": True, "normalized": False} for i, s in enumerate(SPECIALS)],
        "normalizer": BERT_NORMALIZER,
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": template(),
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "max_input_chars_per_word": 40, "continuing_subword_prefix": "##", "vocab": wordpiece_vocab()},
    } | changes


def byte_bpe_small(**changes: Any) -> dict[str, Any]:
    return EMPTY | {
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
        "post_processor": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True},
        "decoder": {"type": "ByteLevel"},
        "model": {"type": "BPE", "vocab": byte_bpe_vocab(), "merges": [" ".join(m) for m in MERGES], "dropout": None, "unk_token": None},
    } | changes


def trunc_pad(direction: str = "Right", max_length: int = 16, stride: int = 4) -> dict[str, Any]:
    return bert_small(
        truncation={"max_length": max_length, "stride": stride, "strategy": "LongestFirst", "direction": direction},
        padding={"strategy": {"Fixed": max_length}, "direction": direction, "pad_id": 0, "pad_type_id": 0, "pad_token": "[PAD]", "pad_to_multiple_of": None},
    )
