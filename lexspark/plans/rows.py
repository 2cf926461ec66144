"""The engine for single rows: whole encodings' ids and decoded texts in plain Python, for SQL functions.

Twins of the expressions in ``operators.encoding`` and ``functions.decode``; tests hold them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from ..functions.decode import CLEANUP, byte_fallback_runs
from ..functions.split import BYTE_CHARS
from .config import Part

if TYPE_CHECKING:
    from .engine import Engine

_BYTE_OF = {c: b for b, c in enumerate(BYTE_CHARS)}


def row_encoder(engine: "Engine") -> Callable[[str, bool], list[int]]:
    """(text, add_special_tokens) -> ids of the main part: truncated, post-processed and padded.

    ``of_batch`` takes a whole batch; several functions over one batch tokenise it once.
    """
    run, plan = engine.id_tokenizer(), engine.plan
    cut, fill = plan.truncation, plan.padding
    templates = [r for r in plan.post_processor or () if r.kind == "TemplateProcessing"]

    def finished(ids: list[int], add_special_tokens: bool) -> list[int]:
        if cut is not None and cut.max_length and cut.strategy in ("LongestFirst", "OnlyFirst") and len(ids) > cut.max_length:
            ids = ids[: cut.max_length] if cut.direction == "Right" else ids[len(ids) - cut.max_length :]
        for rule in templates:
            made: list[int] = []
            for piece in rule.options["single"]:
                if "Sequence" in piece:
                    made += ids
                elif add_special_tokens:
                    made += rule.options["special_tokens"][piece["SpecialToken"]["id"]]["ids"]
            ids = made
        if fill is not None:
            target = len(ids) if fill.fixed is None else fill.fixed
            if fill.pad_to_multiple_of:
                target = -(-target // fill.pad_to_multiple_of) * fill.pad_to_multiple_of
            extra = [fill.pad_id] * (target - len(ids))
            ids = ids + extra if fill.direction == "Right" else extra + ids
        return ids

    def encode(text: str, add_special_tokens: bool = True) -> list[int]:
        return finished(run(text), add_special_tokens)

    last: list = [None, []]

    def of_batch(texts: Iterable[str | None], flags: Iterable[bool]) -> list[list[int] | None]:
        if last[0] is not texts:
            last[:] = texts, [None if t is None else run(t) for t in texts]
        return [None if ids is None else finished(ids, flag) for ids, flag in zip(last[1], flags)]

    encode.of_batch = of_batch
    return encode


def _strip(token: str, content: str, start: int, stop: int) -> str:
    for _ in range(start):
        token = token.removeprefix(content)
    for _ in range(stop):
        token = token.removesuffix(content)
    return token


def _decode_part(tokens: list[str], part: Part) -> list[str]:
    if part.kind == "WordPiece":
        prefix, out = part.get("prefix", "##"), []
        for i, token in enumerate(tokens):
            text = token if i == 0 else token[len(prefix) :] if token.startswith(prefix) else f" {token}"
            for old, new in CLEANUP if part.get("cleanup", True) else ():
                text = text.replace(old, new)
            out.append(text)
        return out
    if part.kind == "ByteLevel":
        return [b"".join(bytes([_BYTE_OF[c]]) if c in _BYTE_OF else c.encode("utf-8", "surrogatepass") for c in "".join(tokens)).decode("utf-8", "replace")]
    if part.kind == "Replace":
        return [t.replace(part.options["pattern"]["String"], part.options["content"]) for t in tokens]
    if part.kind == "ByteFallback":
        return byte_fallback_runs(tokens)
    if part.kind == "Fuse":
        return ["".join(tokens)]
    if part.kind == "BPEDecoder":
        suffix = part.get("suffix", "</w>")
        return [t.replace(suffix, "" if i == len(tokens) - 1 else " ") for i, t in enumerate(tokens)]
    if part.kind == "Metaspace":
        mark, drop = part.get("replacement", "▁"), part.get("add_prefix_space", part.get("prepend_scheme", "always") != "never")
        return [(t.removeprefix(mark) if i == 0 and drop else t).replace(mark, " ") for i, t in enumerate(tokens)]
    if part.kind == "CTC":
        out = [t for i, t in enumerate(tokens) if (i == 0 or t != tokens[i - 1]) and t != part.get("pad_token", "<pad>")]
        if part.get("cleanup", True):
            for old, new in CLEANUP:
                out = [t.replace(old, new) for t in out]
            out = [t.replace(part.get("word_delimiter_token", "|"), " ") for t in out]
        return [t for t in out if t]
    return [_strip(t, part.options["content"], part.get("start", 0), part.get("stop", 0)) for t in tokens]


def row_decoder(engine: "Engine") -> Callable[[list[int], bool], str]:
    """(ids, skip_special_tokens) -> text; an id without a token raises."""
    names = {i: t for t, i in engine.vocab.items()} | engine.added.by_id
    specials, parts = engine.added.specials, engine.plan.decoder
    if parts is not None and [p.kind for p in parts] == ["WordPiece"]:
        return _wordpiece_decoder(names, {i for i, t in names.items() if t in specials}, parts[0])

    def decode(ids: list[int], skip_special_tokens: bool = True) -> str:
        tokens = [names[int(i)] for i in ids]
        tokens = [t for t in tokens if not (skip_special_tokens and t in specials)]
        if parts is None:
            return " ".join(tokens)
        for part in parts:
            tokens = _decode_part(tokens, part)
        return "".join(tokens)

    return decode


class _Decoded(dict):
    """Texts of single ids, found when an id is first met; there are no more than tokens."""

    def __init__(self, find: Callable[[int], str]):
        self.find = find

    def __missing__(self, i: int) -> str:
        found = self[i] = self.find(i)
        return found


def _wordpiece_decoder(names: dict[int, str], special: set[int], part: Part) -> Callable[[list[int], bool], str]:
    """``row_decoder`` where a token's text depends only on whether it is the first."""
    first = _Decoded(lambda i: _decode_part([names[i]], part)[0])
    later = _Decoded(lambda i: _decode_part(["", names[i]], part)[1])

    def decode(ids: list[int], skip_special_tokens: bool = True) -> str:
        ids = [int(i) for i in ids] if isinstance(ids, list) else ids.tolist()
        if skip_special_tokens:
            ids = [i for i in ids if i not in special]
        return "".join([*map(first.__getitem__, ids[:1]), *map(later.__getitem__, ids[1:])])

    return decode
