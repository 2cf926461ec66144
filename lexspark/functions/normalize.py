"""Normalizers as Column builders (built-in expressions, but for the Unicode normal forms), and with alignment for offsets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import Part

#: Ranges of ideographs that get blanks around them (fixed values).
IDEOGRAPHS = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B920, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)
DROPPED = r"[\x{0}\x{FFFD}\p{Cc}&&[^\t\n\r]]"
_JAVA_IDEOGRAPHS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in IDEOGRAPHS)

NORMAL_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


#: So many texts at a time are Python's strings; the rest of a batch stays in Arrow's memory.
AT_ONCE = 64


def normal_form(form: str):
    """A vectorised function: the Unicode normal form of a string column."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(texts), AT_ONCE):
            part = texts.slice(at, AT_ONCE)
            made.append(pa.array([None if t is None else unicodedata.normalize(form, t) for t in part.to_pylist()], texts.type))
        return pa.concat_arrays(made) if made else texts

    return apply


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, DROPPED, ""), r"(?U)\s", " ")


def pad_ideographs(text: Column) -> Column:
    return F.regexp_replace(text, f"([{_JAVA_IDEOGRAPHS}])", " $1 ")


def drop_marks(text: Column) -> Column:
    """Decompose, then drop non-spacing marks."""
    return F.regexp_replace(normal_form("NFD")(text), r"\p{Mn}", "")


def strip_accents(text: Column) -> Column:
    """Drop combining diacritical marks; nothing is decomposed."""
    return F.regexp_replace(text, r"[\x{300}-\x{36F}]", "")


def prepend(text: Column, prefix: str) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.lit(prefix), text))


def replace(text: Column, pattern: str, content: str) -> Column:
    return F.replace(text, F.lit(pattern), F.lit(content)) if pattern else text


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    text = F.regexp_replace(text, r"(?U)^\s+", "") if left else text
    return F.regexp_replace(text, r"(?U)\s+\z", "") if right else text


def bert(text: Column, clean: bool = True, chinese: bool = True, accents: bool | None = None, lower: bool = True) -> Column:
    text = clean_text(text) if clean else text
    text = pad_ideographs(text) if chinese else text
    text = drop_marks(text) if accents or lower else text
    return F.lower(text) if lower else text


def bert_options(part: Part) -> dict[str, bool]:
    return {
        "clean": part.get("clean_text", False),
        "chinese": part.get("handle_chinese_chars", False),
        "accents": part.get("strip_accents", False),
        "lower": part.get("lowercase", False),
    }


def literal_pattern(part: Part) -> str:
    return part.options["pattern"]["String"]


def apply_one(text: Column, part: Part) -> Column:
    if part.kind == "BertNormalizer":
        return bert(text, **bert_options(part))
    if part.kind in NORMAL_FORMS:
        return normal_form(part.kind)(text)
    if part.kind == "Prepend":
        return prepend(text, part.options["prepend"])
    if part.kind == "Replace":
        return replace(text, literal_pattern(part), part.options["content"])
    if part.kind == "Strip":
        return strip(text, part.get("strip_left", False), part.get("strip_right", False))
    return strip_accents(text)


def normalize(text: Column, parts: tuple[Part, ...]) -> Column:
    """The left fold of all normalizers; null stays null."""
    for part in parts:
        text = apply_one(text, part)
    return text


@lru_cache
def _spread() -> str:
    """A class of the characters that decomposition without marks, then lower case, turn into more or fewer than one."""
    lone = []
    for point in range(0x80, 0x110000):
        char = chr(point)
        if unicodedata.decomposition(char)[:1] not in ("", "<") or char.lower() != char and len(char.lower()) > 1:
            base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
            if len(base.lower()) != 1:
                lone.append(point)
    ranges: list[list[int]] = [[0xAC00, 0xD7A3]]
    for point in lone:
        if ranges[-1][1] == point - 1 and len(ranges) > 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def moves_one(text: Column, part: Part) -> Column:
    """Whether a normalizer may leave some character of the text elsewhere than it was."""
    if part.kind == "BertNormalizer":
        options, classes = bert_options(part), []
        if options["clean"]:
            classes.append(DROPPED)
        if options["chinese"]:
            classes.append(f"[{_JAVA_IDEOGRAPHS}]")
        if options["accents"] or options["lower"]:
            classes += [r"\p{Mn}", f"[{_spread()}]"]
        return text.rlike("|".join(classes)) if classes else F.lit(False)
    if part.kind == "Prepend":
        return text != ""
    if part.kind == "Replace":
        return F.contains(text, F.lit(literal_pattern(part))) if literal_pattern(part) else F.lit(False)
    if part.kind == "StripAccents":
        return text.rlike(r"[\x{300}-\x{36F}]")
    return apply_one(text, part) != text


def moves(text: Column, parts: tuple[Part, ...]) -> Column:
    moved = F.lit(False)
    for part in parts:
        moved = moved | moves_one(text, part)
        text = apply_one(text, part)
    return moved


# --- with alignment ---------------------------------------------------------------------------------------------------------

#: Text, and for each of its characters the start and the end of the original that it came from.  Ranges where nothing has moved.
Aligned = tuple[str, Sequence[int], Sequence[int]]
_DROPPED = regex.compile(r"[\x00�]|(?![\t\n\r])\p{Cc}")
_SPACE = regex.compile(r"\s")
_MARK = regex.compile(r"\p{Mn}")
_IDEOGRAPH = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS) + "]")


def aligned(text: str, start: int = 0) -> Aligned:
    return text, range(start, start + len(text)), range(start + 1, start + len(text) + 1)


def _each(value: Aligned, change: Callable[[str], str]) -> Aligned:
    """``change`` gives what a character becomes; all of it keeps the character's span."""
    text, starts, ends = value
    table = {ord(c): new for c in set(text) if (new := change(c)) != c}
    if not table:
        return value
    if all(len(new) == 1 for new in table.values()):
        return text.translate(table), starts, ends
    sizes = [len(table.get(ord(c), c)) for c in text]
    return text.translate(table), [s for s, n in zip(starts, sizes) for _ in range(n)], [e for e, n in zip(ends, sizes) for _ in range(n)]


def _normal_form(value: Aligned, form: str) -> Aligned:
    """Without combining characters, decomposition is a matter of single characters.  Otherwise runs of a starter and what joins
    it are normalised together, and each run's result shares the run's span."""
    text, starts, ends = value
    if unicodedata.is_normalized(form, text):
        return value
    if form in ("NFD", "NFKD") and not any(map(unicodedata.combining, set(text))):
        return _each(value, lambda c: unicodedata.normalize(form, c))
    out, first, last, at = [], [], [], 0
    while at < len(text):
        end = at + 1
        made = unicodedata.normalize(form, text[at])
        while end < len(text):
            joined = unicodedata.normalize(form, text[at : end + 1])
            if not unicodedata.combining(text[end]) and joined == made + unicodedata.normalize(form, text[end]):
                break
            made, end = joined, end + 1
        if len(made) == end - at:
            first += starts[at:end]
            last += ends[at:end]
        else:
            first += [starts[at]] * len(made)
            last += [ends[end - 1]] * len(made)
        out.append(made)
        at = end
    return "".join(out), first, last


def _one_aligned(value: Aligned, part: Part) -> Aligned:
    text, starts, ends = value
    if part.kind == "BertNormalizer":
        options = bert_options(part)
        if options["clean"]:
            value = _each(value, lambda c: "" if _DROPPED.match(c) else " " if _SPACE.match(c) else c)
        if options["chinese"]:
            value = _each(value, lambda c: f" {c} " if _IDEOGRAPH.match(c) else c)
        if options["accents"] or options["lower"]:
            value = _each(value, lambda c: _MARK.sub("", unicodedata.normalize("NFD", c)))
        return _each(value, str.lower) if options["lower"] else value
    if part.kind in NORMAL_FORMS:
        return _normal_form(value, part.kind)
    if part.kind == "Prepend":
        prefix = part.options["prepend"]
        return (prefix + text, [starts[0]] * len(prefix) + [*starts], [ends[0]] * len(prefix) + [*ends]) if text else value
    if part.kind == "Replace":
        pattern, content = literal_pattern(part), part.options["content"]
        if not pattern or pattern not in text:
            return value
        out, first, last, at = [], [], [], 0
        while (found := text.find(pattern, at)) >= 0:
            end = found + len(pattern)
            out += [text[at:found], content]
            first += [*starts[at:found], *[starts[found]] * len(content)]
            last += [*ends[at:found], *[ends[end - 1]] * len(content)]
            at = end
        return "".join([*out, text[at:]]), [*first, *starts[at:]], [*last, *ends[at:]]
    if part.kind == "Strip":
        begin = len(text) - len(text.lstrip()) if part.get("strip_left", False) else 0
        end = max(begin, len(text.rstrip()) if part.get("strip_right", False) else len(text))
        return text[begin:end], starts[begin:end], ends[begin:end]
    return _each(value, lambda c: "" if "̀" <= c <= "ͯ" else c)


def normalize_aligned(value: Aligned, parts: tuple[Part, ...]) -> Aligned:
    for part in parts:
        value = _one_aligned(value, part)
    return value


def by_character(parts: tuple[Part, ...]) -> bool:
    """Whether these normalizers take each character on its own."""
    return all(part.kind in ("BertNormalizer", "StripAccents") for part in parts)


class Characters(dict):
    """For ``str.translate``: what a character becomes under normalizers ``by_character``, and then by ``change``; found when it is first met."""

    def __init__(self, parts: tuple[Part, ...], change: Callable[[str], str] = str):
        self.parts, self.change = parts, change

    def __missing__(self, point: int) -> str:
        made = self[point] = self.change(normalize_aligned(aligned(chr(point)), self.parts)[0])
        return made
