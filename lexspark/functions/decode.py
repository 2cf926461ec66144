"""Decoders as Column builders: an array of token strings becomes an array of text pieces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.encoding import let
from ..plans.config import Part
from .split import from_byte_characters

#: What the clean-up of a decoded word replaces, in this order (fixed values).
CLEANUP = (
    (" .", "."),
    (" ?", "?"),
    (" !", "!"),
    (" ,", ","),
    (" ' ", "'"),
    (" n't", "n't"),
    (" 'm", "'m"),
    (" do not", " don't"),
    (" 's", "'s"),
    (" 've", "'ve"),
    (" 're", "'re"),
)


def cleanup(text: Column) -> Column:
    for old, new in CLEANUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def wordpiece(tokens: Column, prefix: str = "##", clean: bool = True) -> Column:
    def one(token: Column, i: Column) -> Column:
        joined = F.when(F.startswith(token, F.lit(prefix)), F.substring(token, F.lit(len(prefix) + 1), F.length(token))).otherwise(F.concat(F.lit(" "), token))
        text = F.when(i == 0, token).otherwise(joined)
        return cleanup(text) if clean else text

    return F.transform(tokens, one)


def byte_level(tokens: Column) -> Column:
    return F.array(from_byte_characters(F.array_join(tokens, "")))


def byte_fallback_runs(tokens: list[str]) -> list[str]:
    """Runs of <0xHH> tokens become the text of their bytes; bytes that are no UTF-8 become one replacement character each."""
    out: list[str] = []
    pending = bytearray()

    def flush() -> None:
        if pending:
            try:
                out.append(pending.decode("utf-8"))
            except UnicodeDecodeError:
                out.extend("�" * len(pending))
            pending.clear()

    for token in tokens:
        if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", token):
            pending.append(int(token[3:5], 16))
            continue
        flush()
        out.append(token)
    flush()
    return out


BYTE_TOKEN = r"\A<0x[0-9A-Fa-f]{2}>\z"


def byte_fallback(tokens: Column) -> Column:
    """``byte_fallback_runs`` as an expression: a fold that collects the hexadecimal digits of a run until it ends."""
    kind = "array<string>"
    begin = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("hex"))

    def flushed(a: Column) -> Column:
        text = F.try_validate_utf8(F.unhex(a["hex"]).cast("string"))
        broken = F.array_repeat(F.lit("\ufffd"), (F.length(a["hex"]) / 2).cast("int"))
        return F.when(a["hex"] == "", a["out"]).when(text.isNull(), F.concat(a["out"], broken)).otherwise(F.array_append(a["out"], text))

    def step(a: Column, t: Column) -> Column:
        more = F.struct(a["out"].alias("out"), F.concat(a["hex"], F.substring(t, 4, 2)).alias("hex"))
        other = F.struct(F.array_append(flushed(a), t).alias("out"), F.lit("").alias("hex"))
        return F.when(t.rlike(BYTE_TOKEN), more).otherwise(other)

    folded = lambda all: F.when(F.exists(all, lambda t: t.rlike(BYTE_TOKEN)), F.aggregate(all, begin, step, flushed)).otherwise(all)
    return let(tokens, folded)


def strip(tokens: Column, content: str, start: int, stop: int) -> Column:
    """Up to ``start`` leading and ``stop`` trailing occurrences of the character go from each token."""
    def one(token: Column) -> Column:
        quoted = rf"\Q{content}\E"
        token = F.regexp_replace(token, rf"\A(?:{quoted}){{0,{start}}}", "") if start else token
        return F.regexp_replace(token, rf"(?<!{quoted})(?:{quoted}){{0,{stop}}}\z|(?:{quoted}){{{stop}}}\z", "") if stop else token

    return F.transform(tokens, one)


def bpe_decoder(tokens: Column, suffix: str = "</w>") -> Column:
    """The suffix that ends a word becomes a blank, and nothing at the end."""
    ended = lambda all: F.transform(all, lambda t, i: F.replace(t, F.lit(suffix), F.when(i == F.size(all) - 1, F.lit("")).otherwise(F.lit(" "))))
    return let(tokens, ended)


def metaspace(tokens: Column, mark: str = "▁", drop_first: bool = True) -> Column:
    """Marks become blanks; one that begins the first token goes."""

    def one(token: Column, i: Column) -> Column:
        first = F.when((i == 0) & F.startswith(token, F.lit(mark)), F.substring(token, F.lit(len(mark) + 1), F.length(token))).otherwise(token)
        return F.replace(first if drop_first else token, F.lit(mark), F.lit(" "))

    return F.transform(tokens, one)


def ctc(tokens: Column, pad: str = "<pad>", word: str = "|", clean: bool = True) -> Column:
    """Runs of a token become one; pads, which part runs, go, and so do tokens that are empty afterwards; delimiters become blanks."""
    runs = let(tokens, lambda all: F.filter(all, lambda t, i: (i == 0) | (t != F.get(all, i - 1))))
    plain = F.transform(F.filter(runs, lambda t: t != pad), lambda t: F.replace(cleanup(t), F.lit(word), F.lit(" ")) if clean else t)
    return F.filter(plain, lambda t: t != "")


def apply_one(tokens: Column, part: Part) -> Column:
    if part.kind == "WordPiece":
        return wordpiece(tokens, part.get("prefix", "##"), part.get("cleanup", True))
    if part.kind == "ByteLevel":
        return byte_level(tokens)
    if part.kind == "Replace":
        pattern, content = part.options["pattern"]["String"], part.options["content"]
        return F.transform(tokens, lambda t: F.replace(t, F.lit(pattern), F.lit(content)))
    if part.kind == "ByteFallback":
        return byte_fallback(tokens)
    if part.kind == "Fuse":
        return F.array(F.array_join(tokens, ""))
    if part.kind == "BPEDecoder":
        return bpe_decoder(tokens, part.get("suffix", "</w>"))
    if part.kind == "Metaspace":
        return metaspace(tokens, part.get("replacement", "▁"), part.get("add_prefix_space", part.get("prepend_scheme", "always") != "never"))
    if part.kind == "CTC":
        return ctc(tokens, part.get("pad_token", "<pad>"), part.get("word_delimiter_token", "|"), part.get("cleanup", True))
    return strip(tokens, part.options["content"], part.get("start", 0), part.get("stop", 0))


def decode_tokens(tokens: Column, parts: tuple[Part, ...] | None) -> Column:
    """The text of a token array: the decoder chain, then concatenation; without a decoder, tokens are joined by blanks."""
    if parts is None:
        return F.array_join(tokens, " ")
    for part in parts:
        tokens = apply_one(tokens, part)
    return F.array_join(tokens, "")
