"""A pipeline description (JSON) becomes a frozen tree of parts: the logical plan of an engine.

All eight top-level keys must be present, their values may be null.  Names that the format knows but that have no behaviour are
kept out of the plan with a warning (normalizers, pre-tokenizers, post-processors) or refused (models, decoders).
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

KEYS = ("truncation", "padding", "added_tokens", "normalizer", "pre_tokenizer", "post_processor", "decoder", "model")
NORMALIZERS = ("Sequence", "BertNormalizer", "NFC", "NFD", "NFKC", "NFKD", "Prepend", "Replace", "Strip", "StripAccents")
PRE_TOKENIZERS = (
    "Sequence",
    "BertPreTokenizer",
    "Split",
    "ByteLevel",
    "CharDelimiterSplit",
    "Digits",
    "Metaspace",
    "Punctuation",
    "Whitespace",
    "WhitespaceSplit",
)
#: What becomes of the matches of a split: alone, gone, joined to the piece before or after, or to each other.
BEHAVIORS = ("Isolated", "Removed", "MergedWithPrevious", "MergedWithNext", "Contiguous")
POST_PROCESSORS = ("Sequence", "TemplateProcessing", "ByteLevel")
DECODERS = ("Sequence", "WordPiece", "ByteLevel", "Replace", "ByteFallback", "Fuse", "Strip", "BPEDecoder", "CTC", "Metaspace")


class ConfigError(RuntimeError):
    """The description cannot be turned into an engine."""


@dataclass(frozen=True)
class Part:
    """One normalizer, pre-tokenizer, post-processor or decoder; a Sequence has ``parts``."""

    kind: str
    options: dict[str, Any] = field(default_factory=dict)
    parts: tuple["Part", ...] = ()

    def get(self, name: str, default: Any = None) -> Any:
        value = self.options.get(name)
        return default if value is None else value

    def flat(self) -> tuple["Part", ...]:
        """The parts in order, sequences dissolved."""
        return tuple(x for p in self.parts for x in p.flat()) if self.kind == "Sequence" else (self,)


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int | None = None
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False


@dataclass(frozen=True)
class WordPieceModel:
    vocab: dict[str, int]
    unk_token: str = "[UNK]"
    max_input_chars_per_word: int = 100
    continuing_subword_prefix: str = "##"


@dataclass(frozen=True)
class BpeModel:
    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...] = ()
    dropout: float = 0.0
    unk_token: str | None = None
    continuing_subword_prefix: str = ""
    end_of_word_suffix: str = ""
    fuse_unk: bool = False
    byte_fallback: bool = False
    ignore_merges: bool = False


@dataclass(frozen=True)
class WordLevelModel:
    vocab: dict[str, int]
    unk_token: str = "<unk>"


@dataclass(frozen=True)
class UnigramModel:
    """``pieces`` (piece, log-probability); a piece's id is its place.  Characters that no piece of one character covers are unknown."""

    pieces: tuple[tuple[str, float], ...]
    unk_id: int | None = None
    byte_fallback: bool = False
    fuse_unk: bool = True

    #: What an unknown character costs more than the least likely piece (fixed value).
    PENALTY = 10.0

    @cached_property
    def vocab(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for i, (piece, _) in enumerate(self.pieces):
            found.setdefault(piece, i)
        return found

    @property
    def unknown_score(self) -> float:
        return min((score for _, score in self.pieces), default=0.0) - self.PENALTY


Model = WordPieceModel | BpeModel | WordLevelModel | UnigramModel


@dataclass(frozen=True)
class Truncation:
    max_length: int
    stride: int = 0
    strategy: str = "LongestFirst"
    direction: str = "Right"


@dataclass(frozen=True)
class Padding:
    fixed: int | None = None  #: None: the row's own length
    direction: str = "Right"
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    pad_to_multiple_of: int = 0


@dataclass(frozen=True)
class Pipeline:
    truncation: Truncation | None
    padding: Padding | None
    added_tokens: tuple[AddedToken, ...]
    normalizer: tuple[Part, ...]
    pre_tokenizer: tuple[Part, ...]
    model: Model | None
    post_processor: tuple[Part, ...]
    decoder: tuple[Part, ...] | None


def _part(raw: dict | None, known: tuple[str, ...], children: tuple[str, ...], refuse: bool = False) -> Part | None:
    if raw is None:
        return None
    kind = raw["type"]
    if kind not in known:
        if refuse:
            raise NotImplementedError(f"{kind} has no behaviour here")
        warnings.warn(f"{kind} is known by name only and changes nothing", stacklevel=2)
        return None
    if kind != "Sequence":
        return Part(kind, {k: v for k, v in raw.items() if k != "type"})
    listed = next(raw[c] for c in children if c in raw)
    return Part(kind, {}, tuple(p for p in (_part(r, known, children, refuse) for r in listed) if p is not None))


def _flat(part: Part | None) -> tuple[Part, ...]:
    return part.flat() if part is not None else ()


def _truncation(raw: dict | None) -> Truncation | None:
    if raw is None:
        return None
    out = Truncation(raw["max_length"], raw.get("stride") or 0, raw.get("strategy") or "LongestFirst", raw.get("direction") or "Right")
    if out.direction not in ("Left", "Right"):
        raise ConfigError(f"unknown truncation direction {out.direction!r}")
    if out.max_length and out.stride >= out.max_length:
        raise ConfigError("the stride must be smaller than max_length")
    return out


def _padding(raw: dict | None) -> Padding | None:
    if raw is None:
        return None
    strategy = raw.get("strategy", "BatchLongest")
    return Padding(
        strategy["Fixed"] if isinstance(strategy, dict) else None,
        raw.get("direction") or "Right",
        raw.get("pad_id") or 0,
        raw.get("pad_type_id") or 0,
        raw.get("pad_token") or "[PAD]",
        raw.get("pad_to_multiple_of") or 0,
    )


def _model(raw: dict | None) -> Model | None:
    if raw is None:
        return None
    kind = raw.get("type")
    given = {k: v for k, v in raw.items() if v is not None}
    if kind == "WordPiece":
        names = ("unk_token", "max_input_chars_per_word", "continuing_subword_prefix")
        return WordPieceModel(dict(raw["vocab"]), **{k: given[k] for k in names if k in given})
    if kind == "BPE":
        merges = tuple(tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in raw["merges"])
        names = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        return BpeModel(dict(raw["vocab"]), merges, **{k: given[k] for k in names if k in given})
    if kind == "WordLevel":
        return WordLevelModel(dict(raw["vocab"]), **{k: given[k] for k in ("unk_token",) if k in given})
    if kind == "Unigram":
        pieces = tuple((piece, float(score)) for piece, score in raw["vocab"])
        unknown = given.get("unk_id")
        if unknown is not None and not 0 <= unknown < len(pieces):
            raise ConfigError("unk_id is no id of the vocabulary")
        return UnigramModel(pieces, unknown, **{k: given[k] for k in ("byte_fallback", "fuse_unk") if k in given})
    raise NotImplementedError(f"model {kind} has no behaviour here")


def parse(text: str) -> Pipeline:
    """Raises ``ValueError`` for an empty description and ``ConfigError`` for one that cannot be read."""
    if not text:
        raise ValueError("an empty pipeline description")
    try:
        raw = json.loads(text)
        return pipeline_of(raw)
    except (ConfigError, NotImplementedError):
        raise
    except Exception as error:
        raise ConfigError(f"the pipeline description cannot be parsed: {error!r}") from error


def pipeline_of(raw: dict[str, Any]) -> Pipeline:
    missing = [k for k in KEYS if k not in raw]
    if missing:
        raise ConfigError(f"missing keys: {', '.join(missing)}")
    fields = AddedToken.__dataclass_fields__
    added = tuple(AddedToken(**{k: v for k, v in t.items() if k in fields}) for t in raw["added_tokens"] or ())
    decoder = _part(raw["decoder"], DECODERS, ("decoders",), refuse=True)
    return Pipeline(
        _truncation(raw["truncation"]),
        _padding(raw["padding"]),
        added,
        _flat(_part(raw["normalizer"], NORMALIZERS, ("normalizers",))),
        _flat(_part(raw["pre_tokenizer"], PRE_TOKENIZERS, ("pretokenizers", "pre_tokenizers"))),
        _model(raw["model"]),
        _flat(_part(raw["post_processor"], POST_PROCESSORS, ("processors",))),
        None if decoder is None else decoder.flat(),
    )
