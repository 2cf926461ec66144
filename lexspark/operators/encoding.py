"""Encodings as Columns: a struct of seven parallel arrays, truncated, post-processed and padded with built-in functions only.

``ENCODING`` is one part; an engine's result has the further parts of a truncated text, one level deep, in ``overflowing``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import Padding, Part, Truncation

OFFSET = "struct<start:int,end:int>"
FIELDS = {
    "ids": "int",
    "type_ids": "int",
    "tokens": "string",
    "words": "int",
    "offsets": OFFSET,
    "special_tokens_mask": "int",
    "attention_mask": "int",
}
ENCODING = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in FIELDS.items()) + ">"
RESULT = ENCODING[:-1] + f",overflowing:array<{ENCODING}>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def part(arrays: dict[str, Column]) -> Column:
    return F.struct(*[arrays[n].cast(f"array<{t}>").alias(n) for n, t in FIELDS.items()])


def each(encoding: Column, change: Callable[[str, Column], Column]) -> Column:
    return part({n: change(n, encoding[n]) for n in FIELDS})


def from_tokens(tokens: Column) -> Column:
    """Parallel arrays (ids, tokens, words, starts, ends), as the tokenising function gives them, become an encoding."""
    size = F.size(tokens["ids"])
    return part(
        {
            "ids": tokens["ids"],
            "type_ids": F.array_repeat(F.lit(0), size),
            "tokens": tokens["tokens"],
            "words": tokens["words"],
            "offsets": F.zip_with(tokens["starts"], tokens["ends"], lambda s, e: F.struct(s.alias("start"), e.alias("end"))),
            "special_tokens_mask": F.array_repeat(F.lit(0), size),
            "attention_mask": F.array_repeat(F.lit(1), size),
        }
    )


def spans(size: Column, longest: Column, stride: Column, direction: str) -> Column:
    """Zero-based (start, end) of every part, ``longest`` tokens long, of a text of ``size`` tokens that is too long."""
    step = longest - stride
    steps = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), step)
    # a part is due while the one before it has not reached the end
    due = F.filter(steps, lambda s: (s == 0) | (s - step + longest < size))
    if direction == "Right":
        return F.transform(due, lambda s: F.struct(s.alias("start"), F.least(s + longest, size).alias("end")))
    return F.transform(due, lambda s: F.struct(F.greatest(size - s - longest, F.lit(0)).alias("start"), (size - s).alias("end")))


def window_starts(size: Column, rule: Truncation) -> Column:
    """``spans`` under a rule for single texts."""
    return let(size, lambda n: spans(n, F.lit(rule.max_length), F.lit(rule.stride), rule.direction))


def sliced(encoding: Column, windows: Column) -> Column:
    return F.transform(windows, lambda w: each(encoding, lambda n, a: F.slice(a, w["start"] + 1, w["end"] - w["start"])))


def truncate(encoding: Column, rule: Truncation | None) -> Column:
    """Array of parts: one if the text is short enough, the rule does not apply, or its length is zero."""
    if rule is None or rule.max_length == 0 or rule.strategy not in ("LongestFirst", "OnlyFirst"):
        return F.array(encoding)
    size = F.size(encoding["ids"])
    return F.when(size <= rule.max_length, F.array(encoding)).otherwise(sliced(encoding, window_starts(size, rule)))


def pair_lengths(first: Column, second: Column, rule: Truncation) -> Column:
    """struct(first, second): how many tokens each of two texts keeps, so that both have ``max_length`` together.

    LongestFirst takes from the longer one until both are equally long, then from both (an odd token stays with the second of two
    equal texts, else with the longer).  OnlyFirst and OnlySecond leave texts alone where that one is too short to give all.
    """
    most = rule.max_length
    over = first + second - most
    if rule.strategy == "OnlyFirst":
        kept = F.when(first > over, first - over).otherwise(first), second
    elif rule.strategy == "OnlySecond":
        kept = first, F.when(second > over, second - over).otherwise(second)
    elif rule.strategy == "LongestFirst":
        short = F.least(first, second)
        long = F.when(short > most, short).otherwise(F.greatest(short, F.lit(most) - short))
        halved = short + long > most
        short, long = F.when(halved, most // 2).otherwise(short), F.when(halved, most // 2 + most % 2).otherwise(long)
        kept = F.when(first > second, long).otherwise(short), F.when(first > second, short).otherwise(long)
    else:
        kept = first, second
    fits = (over <= 0) | F.lit(most == 0)
    return F.struct(*[F.when(fits, n).otherwise(k).cast("int").alias(name) for n, k, name in ((first, kept[0], "first"), (second, kept[1], "second"))])


def _windows(size: Column, length: Column, rule: Truncation) -> Column:
    """``spans`` of a text of a pair, which may keep fewer tokens than the stride."""
    stride = F.least(F.lit(rule.stride), length - 1)
    return let(F.struct(size.alias("n"), length.alias("m"), stride.alias("s")), lambda x: spans(x["n"], x["m"], x["s"], rule.direction))


def _parts(encoding: Column, length: Column, rule: Truncation, main: bool) -> Column:
    size = F.size(encoding["ids"])
    windows = _windows(size, length, rule)
    cut = sliced(encoding, F.slice(windows, 1, 1) if main else windows)
    return F.when(size <= length, F.array(encoding)).when(length == 0, F.array(each(encoding, lambda n, a: F.slice(a, 1, 0)))).otherwise(cut)


def truncate_pair(first: Column, second: Column, rule: Truncation | None, main: bool = False) -> tuple[Column, Column]:
    """Arrays of parts of two texts that are encoded together; with ``main`` just the first one of each."""
    if rule is None:
        return F.array(first), F.array(second)
    kept = pair_lengths(F.size(first["ids"]), F.size(second["ids"]), rule)
    cut = lambda e, side: let(kept[side], lambda m: _parts(e, m, rule, main))
    return cut(first, "first"), cut(second, "second")


def count_parts(size: Column, rule: Truncation | None) -> Column:
    """How many parts ``truncate`` makes of a text of ``size`` tokens, without making them."""
    if rule is None or rule.max_length == 0 or rule.strategy not in ("LongestFirst", "OnlyFirst"):
        return F.lit(1).cast("bigint")
    return F.when(size <= rule.max_length, 1).otherwise(F.size(window_starts(size, rule))).cast("bigint")


def count_pair_parts(first: Column, second: Column, rule: Truncation | None) -> Column:
    """How many parts a pair of texts of so many tokens gives: each of the first text's with each of the second's."""
    if rule is None:
        return F.lit(1).cast("bigint")
    count = lambda n, m: F.when((n <= m) | (m == 0), 1).otherwise(F.size(_windows(n, m, rule))).cast("bigint")
    return let(pair_lengths(first, second, rule), lambda kept: count(first, kept["first"]) * count(second, kept["second"]))


def _special(named: dict, rule: Part) -> dict[str, Column]:
    token = rule.options["special_tokens"][named["id"]]
    n = len(token["ids"])
    lits = lambda xs, kind: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")
    return {
        "ids": lits(token["ids"], "int"),
        "type_ids": lits([int(named.get("type_id", 0))] * n, "int"),
        "tokens": lits(token["tokens"], "string"),
        "words": lits([None] * n, "int"),
        "offsets": F.array(*[F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))] * n).cast(f"array<{OFFSET}>"),
        "special_tokens_mask": lits([1] * n, "int"),
        "attention_mask": lits([1] * n, "int"),
    }


def template(encoding: Column, rule: Part, add_special_tokens: bool = True, second: Column | None = None) -> Column:
    """The pieces of the single template around the encoding, or those of the pair template around two."""
    pieces: list[dict[str, Column]] = []
    for raw in rule.options["single" if second is None else "pair"]:
        if "Sequence" in raw:
            name = raw["Sequence"].get("id", "A")
            source = encoding if second is None or name == "A" else second
            fields = {n: source[n] for n in FIELDS}
            if name == "A" or second is not None:
                fields["type_ids"] = F.array_repeat(F.lit(int(raw["Sequence"].get("type_id", 0))), F.size(source["ids"]))
            pieces.append(fields)
        elif add_special_tokens:
            pieces.append(_special(raw["SpecialToken"], rule))
    if not pieces:
        return each(encoding, lambda n, a: F.slice(a, 1, 0))
    return part({n: F.concat(*[p[n].cast(f"array<{t}>") for p in pieces]) for n, t in FIELDS.items()})


def templated(ids: Column, rule: Part, add_special_tokens: bool = True) -> Column:
    """``template`` of a single text for its ids alone."""
    pieces = [ids if "Sequence" in raw else _special(raw["SpecialToken"], rule)["ids"] for raw in rule.options["single"] if "Sequence" in raw or add_special_tokens]
    return F.concat(*[p.cast("array<int>") for p in pieces]) if pieces else F.slice(ids, 1, 0)


def joined_pair(first: Column, second: Column, rules: tuple[Part, ...], add_special_tokens: bool = True) -> Column:
    """One part of each text as one encoding: post-processors before a template run on each, those after it on both together.

    Without a template the second text follows the first, with type 1.
    """
    at = next((i for i, r in enumerate(rules) if r.kind == "TemplateProcessing"), None)
    before, after = rules[: len(rules) if at is None else at], () if at is None else rules[at + 1 :]

    def join(a: Column, b: Column) -> Column:
        if at is not None:
            return template(a, rules[at], add_special_tokens, b)
        ones = F.array_repeat(F.lit(1), F.size(b["ids"]))
        return part({n: F.concat(a[n], ones if n == "type_ids" else b[n]) for n in FIELDS})

    whole = let(post_process(first, before), lambda a: let(post_process(second, before), lambda b: join(a, b)))
    return post_process(whole, after, add_special_tokens)


def trim_offsets(encoding: Column, add_prefix_space: bool) -> Column:
    """Offsets of byte-level tokens without the blanks at their ends."""

    def one(offset: Column, i: Column) -> Column:
        token = F.get(encoding["tokens"], i)
        lead = F.length(F.regexp_extract(token, "^Ġ+", 0))
        trail = F.length(F.regexp_extract(token, "Ġ+$", 0))
        own = F.lit(add_prefix_space) & (lead == 1) & ((i == 0) | (offset["start"] == 0))
        start = F.when((lead > 0) & ~own, F.least(offset["start"] + lead, offset["end"])).otherwise(offset["start"])
        end = F.when((trail > 0) & (offset["end"] >= trail), F.greatest(offset["end"] - trail, start)).otherwise(offset["end"])
        return F.struct(start.alias("start"), F.greatest(end, start).alias("end"))

    return each(encoding, lambda n, a: F.transform(a, one) if n == "offsets" else a)


def post_process(encoding: Column, rules: tuple[Part, ...], add_special_tokens: bool = True) -> Column:
    def step(rule: Part) -> Callable[[Column], Column]:
        if rule.kind == "TemplateProcessing":
            return lambda e: template(e, rule, add_special_tokens)
        return lambda e: trim_offsets(e, rule.get("add_prefix_space", True))

    for rule in rules:
        if rule.kind == "TemplateProcessing" or rule.get("trim_offsets", True):
            encoding = let(encoding, step(rule))
    return encoding


def pad(encoding: Column, rule: Padding | None, longest: Column | None = None) -> Column:
    """Up to the fixed size, ``longest`` (a dataset-wide maximum), or the own size; then up to the multiple.  Never shortens."""
    if rule is None:
        return encoding
    size = F.size(encoding["ids"])
    target = F.lit(rule.fixed) if rule.fixed is not None else size if longest is None else longest
    if rule.pad_to_multiple_of:
        target = (F.ceil(target / rule.pad_to_multiple_of) * rule.pad_to_multiple_of).cast("int")
    short = F.greatest(target - size, F.lit(0))
    fill = {
        "ids": F.lit(rule.pad_id),
        "type_ids": F.lit(rule.pad_type_id),
        "tokens": F.lit(rule.pad_token),
        "words": F.lit(0),
        "offsets": F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
        "special_tokens_mask": F.lit(1),
        "attention_mask": F.lit(0),
    }

    def one(n: str, a: Column) -> Column:
        extra = F.array_repeat(fill[n], short)
        return F.concat(a, extra) if rule.direction == "Right" else F.concat(extra, a)

    return each(encoding, one)


def with_overflow(parts: Column) -> Column:
    """The first part, with the others as ``overflowing``."""
    first = F.get(parts, 0)
    return F.struct(*[first[n].alias(n) for n in FIELDS], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("overflowing"))


def token_rows(df: DataFrame, key: list[str], encoding: str = "encoding") -> DataFrame:
    """One row per token: (key, part, pos, id, token, type_id, word, start, end, special, attention); part 0 is the main one."""
    main = F.struct(*[F.col(encoding)[n].alias(n) for n in FIELDS])
    parts = df.select(*key, F.posexplode(F.concat(F.array(main), F.col(encoding)["overflowing"])).alias("part", "e"))
    zipped = F.arrays_zip(*[F.col("e")[n].alias(n) for n in FIELDS])
    rows = parts.select(*key, "part", F.posexplode(zipped).alias("pos", "t"))
    names = {"ids": "id", "tokens": "token", "type_ids": "type_id", "words": "word", "special_tokens_mask": "special", "attention_mask": "attention"}
    return rows.select(
        *key, "part", "pos", *[F.col("t")[old].alias(new) for old, new in names.items()], F.col("t.offsets.start").alias("start"), F.col("t.offsets.end").alias("end")
    )
