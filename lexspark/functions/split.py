"""Pre-tokenizers as Column builders over an array of pieces, and their twins for the fused Arrow path.

A piece is ``struct<text, start, end, token_id>``; one with a token id came from the added vocabulary and is never split again.
Offsets are code points of the text that was split.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import BEHAVIORS, Part

#: The split pattern of byte-level models (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "array<struct<text:string,start:int,end:int,token_id:int>>"


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the others follow from U+0100 in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + extra)
            extra += 1
    return [out[b] for b in range(256)]


BYTE_CHARS = byte_characters()
_LATIN1 = "".join(map(chr, range(256)))
_MAPPED = "".join(BYTE_CHARS)
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def to_byte_characters(text: Column) -> Column:
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _LATIN1, _MAPPED)


def from_byte_characters(text: Column) -> Column:
    """Bytes that are no UTF-8 (a cut character) are replaced.  ``translate`` would drop what it should turn to the zero character."""
    latin = F.replace(F.translate(text, _MAPPED[1:], _LATIN1[1:]), F.lit(BYTE_CHARS[0]), F.lit("\0"))
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def whole(text: Column) -> Column:
    """The text as its only piece; an empty text has none."""
    piece = F.struct(text.alias("text"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(None).cast("int").alias("token_id"))
    return F.when(text.isNotNull(), F.filter(F.array(piece), lambda p: p["text"] != "")).cast(PIECES)


#: Two noncharacters mark the matches; a text that holds one of them is cut without marks.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _cut(text: Column, pattern: str) -> Column:
    """All matches and the gaps between them, in order: array of struct(text, matched)."""
    marked = F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    pieces = F.filter(F.split(marked, f"(?={_OPEN})|{_CLOSE}"), lambda t: (t != "") & (t != _OPEN))

    def unmarked(t: Column) -> Column:
        matched = F.startswith(t, F.lit(_OPEN))
        return F.struct(F.when(matched, F.substring(t, F.lit(2), F.length(t))).otherwise(t).alias("text"), matched.alias("matched"))

    either = F.lit(rf"({pattern})|(?s:.+?)(?={pattern}|\z)")
    whole, match = F.regexp_extract_all(text, either, F.lit(0)), F.regexp_extract_all(text, either, F.lit(1))
    plain = F.zip_with(whole, match, lambda w, m: F.struct(w.alias("text"), (m != "").alias("matched")))
    return F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), plain).otherwise(F.transform(pieces, unmarked))


def placed(cut: Column, base: Column, keep: bool = True, token_id=None, gaps: bool = True) -> Column:
    """Matches and gaps, in order, as pieces: each starts where the one before ends.  Matches or gaps may be left out.

    ``token_id`` may give an id for a matched text.
    """
    begin = F.struct(base.cast("int").alias("at"), F.array().cast(PIECES).alias("out"))

    def step(a: Column, t: Column) -> Column:
        text, matched = t["text"], t["matched"]
        end = a["at"] + F.length(text)
        id = F.lit(None).cast("int") if token_id is None else F.when(matched, token_id(text))
        piece = F.struct(text.alias("text"), a["at"].alias("start"), end.alias("end"), id.alias("token_id"))
        grown = F.array_append(a["out"], piece)
        taken = grown if keep and gaps else F.when(matched if gaps else ~matched, a["out"]).otherwise(grown)
        return F.struct(end.alias("at"), taken.alias("out"))

    return F.aggregate(cut, begin, step, lambda a: a["out"])


def merged(cut: Column, behavior: str, invert: bool = False) -> Column:
    """Matches and gaps after what becomes of matches; ``invert`` takes gaps for matches.

    A match joins the gap before it (MergedWithPrevious) or after it (MergedWithNext), unless another match lies there; neighbours of a
    kind become one piece (Contiguous).  Pieces that join are folded together.
    """
    if invert:
        cut = F.transform(cut, lambda t: F.struct(t["text"].alias("text"), (~t["matched"]).alias("matched")))
    if behavior not in ("MergedWithPrevious", "MergedWithNext", "Contiguous"):
        return cut

    def joins(matched: Column, before: Column) -> Column:
        if behavior == "MergedWithPrevious":
            return matched & ~before
        return before & ~matched if behavior == "MergedWithNext" else matched == before

    kind = "array<struct<text:string,matched:boolean>>"
    begin = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("open"), F.lit(None).cast("boolean").alias("before"))
    closed = lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.array_append(a["out"], F.struct(a["open"].alias("text"), F.lit(False).alias("matched"))))

    def step(a: Column, t: Column) -> Column:
        on = F.coalesce(joins(t["matched"], a["before"]), F.lit(False))
        goes_on = F.struct(a["out"].alias("out"), F.concat(a["open"], t["text"]).alias("open"), t["matched"].alias("before"))
        return F.when(on, goes_on).otherwise(F.struct(closed(a).alias("out"), t["text"].alias("open"), t["matched"].alias("before")))

    return F.aggregate(cut, begin, step, closed)


def split_regex(pieces: Column, pattern: str, keep: bool = True, behavior: str | None = None, invert: bool = False) -> Column:
    """Split unresolved pieces; matches stay as pieces of their own (isolated), go (removed), or join their neighbours (``behavior``)."""
    behavior = behavior or ("Isolated" if keep else "Removed")

    def one(p: Column) -> Column:
        cut = merged(_cut(p["text"], pattern), behavior, invert)
        return F.when(p["token_id"].isNotNull(), F.array(p).cast(PIECES)).otherwise(placed(cut, p["start"], behavior != "Removed"))

    return F.flatten(F.transform(pieces, one))


#: A punctuation character, or a run of others that are no white space (this dialect needs the flag for all white space).
BERT_WORD = r"\p{P}|(?U:[^\s\p{P}]+)"


def split_bert(pieces: Column) -> Column:
    """White space goes, each punctuation character is a piece.  One pass: the words are the matches, the gaps go."""
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(p["token_id"].isNotNull(), F.array(p).cast(PIECES)).otherwise(placed(_cut(p["text"], BERT_WORD), p["start"], True, None, False)),
        )
    )


def bert_words(text: Column) -> Column:
    """Just the words, without places."""
    return F.regexp_extract_all(text, F.lit(BERT_WORD), F.lit(0))


def byte_level_words(text: Column) -> Column:
    """Just the byte-level words, without places."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?U){BYTE_LEVEL_PATTERN}"), F.lit(0)), to_byte_characters)


def split_byte_level(pieces: Column, add_prefix_space: bool = True, use_regex: bool = True) -> Column:
    if add_prefix_space:
        def lead(p: Column, i: Column) -> Column:
            due = (i == 0) & p["token_id"].isNull() & ~p["text"].rlike(r"(?U)^\s")
            return F.when(due, F.struct(F.concat(F.lit(" "), p["text"]).alias("text"), p["start"].alias("start"), (p["end"] + 1).alias("end"), p["token_id"].alias("token_id"))).otherwise(p)

        pieces = F.transform(pieces, lead)
    if use_regex:
        pieces = split_regex(pieces, f"(?U){BYTE_LEVEL_PATTERN}", keep=True)
    return F.transform(
        pieces,
        lambda p: F.struct(F.when(p["token_id"].isNull(), to_byte_characters(p["text"])).otherwise(p["text"]).alias("text"), p["start"].alias("start"), p["end"].alias("end"), p["token_id"].alias("token_id")),
    )


#: Splits by a fixed pattern: what it matches and what becomes of the matches.
PATTERNS = {
    "Digits": (r"\p{N}+", "Isolated"),
    "Punctuation": (r"\p{P}", "Isolated"),
    "Whitespace": (r"\w+|[^\w\s]+", "Words"),
    "WhitespaceSplit": (r"\s+", "Removed"),
}
MARK = "▁"


def rule(part: Part) -> tuple[str, str, bool]:
    """(pattern, behavior, invert) of a pre-tokenizer that splits by a pattern; both regex dialects read it alike."""
    if part.kind == "Split":
        given = part.options["pattern"]
        pattern = given["Regex"] if "Regex" in given else re.escape(given["String"])
        behavior = part.get("behavior", "Removed")
        return pattern, behavior if behavior in BEHAVIORS else "Removed", bool(part.get("invert", False))
    if part.kind == "CharDelimiterSplit":
        return re.escape(part.options["delimiter"]), "Removed", False
    pattern, behavior = PATTERNS[part.kind]
    if part.kind == "Digits" and part.get("individual_digits", False):
        pattern = r"\p{N}"
    if behavior == "Words":
        return pattern, "Removed", True
    return pattern, part.get("behavior", behavior) if part.kind == "Punctuation" else behavior, False


def dialect(pattern: str) -> str:
    """Classes such as \\s and \\w take all of Unicode."""
    return f"(?U:{pattern})"


def metaspace_options(part: Part) -> tuple[str, str, bool]:
    scheme = part.get("prepend_scheme", "always" if part.get("add_prefix_space", True) else "never")
    return part.get("replacement", MARK), scheme, part.get("split", True)


def split_metaspace(pieces: Column, mark: str = MARK, scheme: str = "always", split: bool = True) -> Column:
    """Blanks become marks, one stands before the text ("first": of the first piece only), and each mark begins a piece."""

    def one(p: Column, i: Column) -> Column:
        text = F.replace(p["text"], F.lit(" "), F.lit(mark))
        lead = ~F.startswith(text, F.lit(mark)) & (F.lit(scheme == "always") | (F.lit(scheme == "first") & (i == 0)))
        text = F.when(lead, F.concat(F.lit(mark), text)).otherwise(text)
        made = F.struct(text.alias("text"), p["start"].alias("start"), (p["start"] + F.length(text)).alias("end"), p["token_id"].alias("token_id"))
        return F.when(p["token_id"].isNull(), made).otherwise(p)

    pieces = F.transform(pieces, one)
    return split_regex(pieces, re.escape(mark), behavior="MergedWithNext") if split else pieces


def pre_tokenize(pieces: Column, parts: tuple[Part, ...]) -> Column:
    for part in parts:
        if part.kind == "BertPreTokenizer":
            pieces = split_bert(pieces)
        elif part.kind == "Split":
            pattern, behavior, invert = rule(part)
            pieces = split_regex(pieces, pattern, behavior=behavior, invert=invert)
        elif part.kind == "Metaspace":
            pieces = split_metaspace(pieces, *metaspace_options(part))
        elif part.kind != "ByteLevel":
            pattern, behavior, invert = rule(part)
            pieces = split_regex(pieces, dialect(pattern), behavior=behavior, invert=invert)
        else:
            pieces = split_byte_level(pieces, part.get("add_prefix_space", True), part.get("use_regex", True))
    return pieces


# --- twins for the fused path: pieces are (text, starts, ends, token id) ----------------------------------------------------

_compiled: dict[str, regex.Pattern] = {}


def compiled(pattern: str) -> regex.Pattern:
    if pattern not in _compiled:
        _compiled[pattern] = regex.compile(pattern)
    return _compiled[pattern]


def cut_merged(pieces: list, pattern: regex.Pattern, behavior: str, invert: bool) -> list:
    """``merged`` for pieces in Python: spans of matches and gaps, joined as the behavior says."""
    out = []
    for piece in pieces:
        text, starts, ends, token = piece
        if token is not None:
            out.append(piece)
            continue
        spans, at = [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if a < b:
                spans += [(at, a, invert), (a, b, not invert)] if a > at else [(a, b, not invert)]
                at = b
        if at < len(text):
            spans.append((at, len(text), invert))
        joined: list[list] = []
        for i, (a, b, matched) in enumerate(spans):
            before = spans[i - 1][2] if i else None
            joins = i > 0 and {"MergedWithPrevious": matched and not before, "MergedWithNext": before and not matched, "Contiguous": matched == before}.get(behavior, False)
            if joins:
                joined[-1][1] = b
            elif behavior != "Removed" or not matched:
                joined.append([a, b])
        out += [(text[a:b], starts[a:b], ends[a:b], None) for a, b in joined]
    return out


def cut(pieces: list, pattern: regex.Pattern, keep: bool, token_id=None) -> list:
    """Split unresolved pieces; matches stay, perhaps with a token id, or go."""
    out = []
    for piece in pieces:
        text, starts, ends, token = piece
        if token is not None:
            out.append(piece)
            continue
        at = 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if a == b:
                continue
            if a > at:
                out.append((text[at:a], starts[at:a], ends[at:a], None))
            if keep:
                out.append((m[0], starts[a:b], ends[a:b], None if token_id is None else token_id(m[0])))
            at = b
        if not at:
            out.append(piece)
        elif at < len(text):
            out.append((text[at:], starts[at:], ends[at:], None))
    return out


#: A punctuation character or a run of others that are no white space: both steps of the split at once.
_BERT = regex.compile(r"\p{P}|[^\s\p{P}]+")
_PUNCTUATION, _BLANK = regex.compile(r"\p{P}"), regex.compile(r"\s")


def bert_spaced(text: str) -> str:
    """What ``_BERT`` finds in a text, with blanks around."""
    return "".join(f" {c} " if _PUNCTUATION.match(c) else " " if _BLANK.match(c) else c for c in text)


def _byte_level_text(piece: tuple) -> tuple:
    text, starts, ends, token = piece
    if token is not None:
        return piece
    data = text.encode("utf-8", "surrogatepass")
    if len(data) != len(text):
        sizes = [len(c.encode("utf-8", "surrogatepass")) for c in text]
        starts = [s for s, n in zip(starts, sizes) for _ in range(n)]
        ends = [e for e, n in zip(ends, sizes) for _ in range(n)]
    return data.decode("latin-1").translate(_BYTE_TABLE), starts, ends, None


_BYTE_TABLE = dict(enumerate(BYTE_CHARS))


def pre_tokenize_aligned(pieces: list, parts: tuple[Part, ...]) -> list:
    for part in parts:
        if part.kind == "BertPreTokenizer":
            split = []
            for piece in pieces:
                text, starts, ends, token = piece
                if token is not None:
                    split.append(piece)
                else:
                    split += [(m[0], starts[m.start() : m.end()], ends[m.start() : m.end()], None) for m in _BERT.finditer(text)]
            pieces = split
        elif part.kind == "Metaspace":
            mark, scheme, split = metaspace_options(part)
            made = []
            for i, (text, starts, ends, token) in enumerate(pieces):
                if token is None:
                    text = text.replace(" ", mark)
                    if not text.startswith(mark) and (scheme == "always" or scheme == "first" and i == 0):
                        text, starts, ends = mark + text, [starts[0], *starts], [starts[0], *ends]
                made.append((text, starts, ends, token))
            pieces = cut_merged(made, compiled(regex.escape(mark)), "MergedWithNext", False) if split else made
        elif part.kind != "ByteLevel":
            pattern, behavior, invert = rule(part)
            pieces = cut_merged(pieces, compiled(pattern), behavior, invert)
        else:
            if part.get("add_prefix_space", True) and pieces and pieces[0][3] is None and not pieces[0][0][:1].isspace():
                text, starts, ends, _ = pieces[0]
                pieces = [(f" {text}", [starts[0], *starts], [starts[0], *ends], None), *pieces[1:]]
            if part.get("use_regex", True):
                pieces = cut(pieces, compiled(BYTE_LEVEL_PATTERN), True)
            pieces = [_byte_level_text(p) for p in pieces]
    return pieces
