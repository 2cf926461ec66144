"""The engine: a pipeline description applied to DataFrames of texts.

``encode`` and ``decode`` add a column and move no rows, so they work on batch tables and on streams alike.  What built-in
expressions cannot do (normalization with alignment, the models) is fused into one Arrow function, so a text crosses to Python
once; a worker keeps the tokens of the words it has met (bounded).  Truncation, post-processing and padding are expressions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode as decoders
from ..functions.normalize import NORMAL_FORMS, Characters, aligned, apply_one, by_character, moves, normalize, normalize_aligned
from ..functions.split import PIECES, bert_spaced, pre_tokenize, pre_tokenize_aligned, whole
from ..operators import added, encoding, words
from ..operators.models import evaluator, id_evaluator
from ..operators.words import WordTable
from ..sources import scratch
from . import config
from .rows import row_decoder, row_encoder
from .ship import ship

TOKENS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)
#: Bound of the tokens, of whole words, that a tokenizer remembers: some 150 bytes each.
MOST_TOKENS = 200_000
#: Longer words, in characters, are not remembered with their ids.
LONGEST_KNOWN = 64
#: So many tokenizers are kept in a worker, those used last.
MOST_MADE = 3
_made: dict[str, Any] = {}


class Made:
    """Goes to the executors as the engine; its tokenizer is made there, once per worker, whatever functions and tasks use it."""

    def __init__(self, engine: "Engine", make=None):
        self.engine, self.make, self.name = engine, make, uuid.uuid4().hex

    def tokenizer(self):
        run = _made.pop(self.name, None)
        if run is None:
            run = self.engine.tokenizer() if self.make is None else self.make(self.engine)
        _made[self.name] = run
        while len(_made) > MOST_MADE:
            del _made[next(iter(_made))]
        return run


class Known(dict):
    """The ids of words: found when a word is first met, and remembered up to a bound of tokens, but for long words.  Words that are
    met again before the bound is reached once more stay."""

    def __init__(self, find):
        self.find, self.held, self.before = find, 0, {}

    def __missing__(self, word: str) -> list[int]:
        found = self.before.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= LONGEST_KNOWN:
            if self.held > MOST_TOKENS:
                self.before, self.held = dict(self), 0
                self.clear()
            self[word] = found
            self.held += len(found) + 1
        return found


@dataclass(frozen=True)
class Engine:
    plan: config.Pipeline
    added: added.AddedVocabulary = field(default_factory=added.AddedVocabulary)
    merge_priority: str = "lowest"
    keep_overflow: bool = True

    # --- construction -----------------------------------------------------------------------------------------------

    @classmethod
    def from_json(cls, text: str | dict[str, Any], **flags: Any) -> "Engine":
        plan = config.pipeline_of(text) if isinstance(text, dict) else config.parse(text)
        vocabulary = added.AddedVocabulary(**{k: flags.pop(k) for k in ("match_only_in_vocab", "encode_special_tokens") if k in flags})
        engine = cls(plan, vocabulary, **flags)
        return engine.add_tokens(*plan.added_tokens)[0]

    @classmethod
    def load(cls, spark: SparkSession | None = None, path: str = "", text: str = "", **flags: Any) -> "Engine":
        """From a folder that holds ``tokenizer.json`` (in any store that Spark reads), or else from a string."""
        from ..sources.config_file import read_config

        if not path and not text:
            raise ValueError("neither a path nor a description is given")
        return cls.from_json(read_config(spark, path) if path else text, **flags)

    @property
    def vocab(self) -> dict[str, int]:
        return self.plan.model.vocab if self.plan.model else {}

    def vocab_size(self) -> int:
        return len(self.vocab)

    def add_tokens(self, *tokens: config.AddedToken | str) -> tuple["Engine", int]:
        """A new engine with these tokens as well, and how many were not ignored."""
        made = tuple(config.AddedToken(t) if isinstance(t, str) else t for t in tokens)
        vocabulary, count = self.added.add(made, self.vocab)
        return replace(self, added=vocabulary), count

    def add_special_tokens(self, *tokens: config.AddedToken | str) -> tuple["Engine", int]:
        return self.add_tokens(*[replace(t, special=True) if isinstance(t, config.AddedToken) else config.AddedToken(t, special=True) for t in tokens])

    # --- columns ------------------------------------------------------------------------------------------------------

    def split_normalized(self, text: Column) -> Column:
        """The normalised text, cut at added tokens: array of (text, start, end, token_id)."""
        raw, normal, ids = self.added.matchable(self.vocab, False), self.added.matchable(self.vocab, True), self.added.by_content
        if not raw:
            split = whole(normalize(text, self.plan.normalizer))
        else:
            held = text.rlike(f"(?U){added.pattern(raw)}")
            plain = whole(normalize(F.when(~held, text), self.plan.normalizer))
            if all(p.kind not in (*NORMAL_FORMS, "BertNormalizer") for p in self.plan.normalizer):
                cut = _normalize_gaps(added.extract(whole(F.when(held, text)), raw, ids), self.plan.normalizer)
            else:
                cut = self._cut_and_normalize(F.when(held, text), raw)
            split = F.when(held, cut).otherwise(plain)
        return added.extract(split, normal, ids)

    def _cut_and_normalize(self, text: Column, raw: list[config.AddedToken]) -> Column:
        """Texts that hold added tokens, whose gaps need a normal form, by a vectorised function; null gives null."""
        ship()
        pattern, ids, parts = added.pattern(raw), self.added.by_content, self.plan.normalizer

        @F.pandas_udf(PIECES)
        def cut(texts: pd.Series) -> pd.Series:
            matcher = regex.compile(pattern)

            def one(text: str) -> list[dict]:
                out, at = [], 0
                for piece in added.extract_aligned([(*aligned(text), None)], ids, matcher):
                    made = piece[0] if piece[3] is not None else normalize_aligned(piece[:3], parts)[0]
                    if made:
                        out.append({"text": made, "start": at, "end": at + len(made), "token_id": piece[3]})
                        at += len(made)
                return out

            return texts.map(one, na_action="ignore")

        return cut(text)

    def pieces(self, text: Column) -> Column:
        """Words of a text as built-in expressions: array of (text, start, end, token_id), offsets in the normalized text."""
        return pre_tokenize(self.split_normalized(text), self.plan.pre_tokenizer)

    def in_text(self, text: Column, tokens: Column) -> Column:
        """Tokens with places in the normalised text, as tokens with places in the text.

        Most texts keep every character in its place under normalisation; only for the others is an alignment made, by a vectorised
        function that gets nulls for the rest.
        """
        raw, ids, parts = self.added.matchable(self.vocab, False), self.added.by_content, self.plan.normalizer
        if not parts:
            return tokens
        ship()
        pattern = added.pattern(raw) if raw else None

        @F.pandas_udf("struct<starts:array<int>,ends:array<int>>")
        def align(texts: pd.Series) -> pd.DataFrame:
            matcher = regex.compile(pattern) if pattern else None
            rows = []
            for text in texts:
                starts, ends = None, None
                if text is not None:
                    pieces = added.extract_aligned([(*aligned(text), None)], ids, matcher)
                    pieces = [normalize_aligned(p[:3], parts) if p[3] is None else p for p in pieces]
                    starts, ends = [i for p in pieces for i in p[1]], [i for p in pieces for i in p[2]]
                rows.append((starts, ends))
            return pd.DataFrame(rows, columns=["starts", "ends"])

        def moved(a: Column) -> Column:
            last = F.size(a["starts"]) - 1
            begin = F.transform(tokens["starts"], lambda s: F.get(a["starts"], F.least(s, last)))
            end = F.zip_with(tokens["starts"], tokens["ends"], lambda s, e: F.when(e > s, F.get(a["ends"], e - 1)).otherwise(F.get(a["starts"], F.least(s, last))))
            return F.struct(tokens["ids"].alias("ids"), tokens["tokens"].alias("tokens"), tokens["words"].alias("words"), begin.alias("starts"), end.alias("ends"))

        here = moves(text, parts)
        return encoding.let(align(F.when(here, text)), lambda a: F.when(a["starts"].isNull(), tokens).otherwise(moved(a)))

    def _words(self):
        """text -> [(word, starts, ends, token id)] with offsets in the original text, for the fused function."""
        vocab, ids, plan = self.vocab, self.added.by_content, self.plan
        raw, normal = self.added.matchable(vocab, False), self.added.matchable(vocab, True)
        raw_pattern = regex.compile(added.pattern(raw)) if raw else None
        normal_pattern = regex.compile(added.pattern(normal)) if normal else None

        def words(text: str) -> list[tuple]:
            pieces = added.extract_aligned([(*aligned(text), None)], ids, raw_pattern)
            pieces = [(*normalize_aligned(p[:3], plan.normalizer), None) if p[3] is None else p for p in pieces]
            pieces = added.extract_aligned([p for p in pieces if p[0]], ids, normal_pattern)
            return pre_tokenize_aligned(pieces, plan.pre_tokenizer)

        return words

    def tokenizer(self):
        """text -> (ids, tokens, words, starts, ends); the reference version of the fused function."""
        words, tokenize = self._words(), evaluator(self.plan.model, self.merge_priority)
        names, known, held = self.added.by_id, {}, 0

        def run(text: str) -> tuple[list, list, list, list, list]:
            nonlocal held
            ids, tokens, numbers, starts, ends = [], [], [], [], []
            for number, (word, first, last, token) in enumerate(words(text)):
                if token is not None:
                    found = [(token, names[token], 0, len(word))]
                else:
                    found = known.get(word)
                    if found is None:
                        found = tokenize(word)
                        if held > MOST_TOKENS:
                            known.clear()
                            held = 0
                        known[word] = found
                        held += len(found) + 1
                for i, value, start, end in found:
                    ids.append(i)
                    tokens.append(value)
                    numbers.append(number)
                    begin = first[min(start, len(first) - 1)]
                    starts.append(begin)
                    ends.append(last[min(end, len(last)) - 1] if end > start else begin)
            return ids, tokens, numbers, starts, ends

        run.known = known
        return run

    def id_tokenizer(self):
        """text -> ids, the first that ``tokenizer`` gives.  Where texts are normalised by character and cut at blanks and punctuation,
        no places are kept: one table of characters makes words with blanks between them.  Texts with added tokens go the long way."""
        run, plan = self.tokenizer(), self.plan
        if not by_character(plan.normalizer) or [p.kind for p in plan.pre_tokenizer] != ["BertPreTokenizer"]:
            return lambda text: run(text)[0]
        raw, normal = self.added.matchable(self.vocab, False), self.added.matchable(self.vocab, True)
        raw_pattern = regex.compile(added.pattern(raw)) if raw else None
        normal_pattern = regex.compile(added.pattern(normal)) if normal else None
        normalized, spaced = Characters(plan.normalizer), Characters(plan.normalizer, bert_spaced)
        known = Known(id_evaluator(plan.model, self.merge_priority))

        def ids(text: str) -> list[int]:
            if raw_pattern is not None and raw_pattern.search(text):
                return run(text)[0]
            if normal_pattern is not None and normal_pattern.search(text.translate(normalized)):
                return run(text)[0]
            return list(chain.from_iterable(map(known.__getitem__, text.translate(spaced).split(" "))))

        ids.known = known
        return ids

    def tokens(self, text: Column) -> Column:
        """Parallel arrays of the model's tokens, by one Arrow function; null gives null."""
        ship()
        made = Made(self)

        @F.pandas_udf(TOKENS)
        def tokenize(texts: pd.Series) -> pd.DataFrame:
            run = made.tokenizer()
            rows = [(None,) * 5 if t is None else run(t) for t in texts]
            return pd.DataFrame(rows, columns=TOKENS.names)

        return tokenize(text)

    def encode_column(self, text: Column, add_special_tokens: bool = True, tokens: Column | None = None, longest: Column | None = None) -> Column:
        made = self.tokens(text) if tokens is None else tokens
        rules = self.plan
        parts = encoding.let(encoding.from_tokens(made), lambda e: encoding.truncate(e, rules.truncation))
        parts = parts if self.keep_overflow else F.slice(parts, 1, 1)
        if rules.post_processor:
            parts = F.transform(parts, lambda p: encoding.post_process(p, rules.post_processor, add_special_tokens))
        if rules.padding:
            parts = F.transform(parts, lambda p: encoding.pad(p, rules.padding, longest))
        result = encoding.let(parts, encoding.with_overflow)
        return F.when(text.isNotNull(), result)

    # --- DataFrames -----------------------------------------------------------------------------------------------------

    def encode(self, df: DataFrame, text: str = "text", into: str = "encoding", add_special_tokens: bool = True, pad_scope: str = "row") -> DataFrame:
        """Adds the encoding.  ``pad_scope="dataset"`` pads all rows to the longest one (one aggregate before)."""
        tokens = free_name(df, "_tokens")
        held = df.withColumn(tokens, self.tokens(F.col(text)))
        encoded = held.withColumn(into, self.encode_column(F.col(text), add_special_tokens, F.col(tokens))).drop(tokens)
        if pad_scope != "dataset" or self.plan.padding is None or self.plan.padding.fixed is not None:
            return encoded
        return self._pad_to_longest(replace(self, plan=replace(self.plan, padding=None)).encode(df, text, into, add_special_tokens), into)

    def encode_by_words(
        self,
        df: DataFrame,
        text: str = "text",
        into: str = "encoding",
        add_special_tokens: bool = True,
        key: str | None = None,
        pad_scope: str = "row",
        table: "WordTable | None" = None,
        batch: str = "0",
    ) -> DataFrame:
        """``encode`` as a relational plan for tables: each distinct word is tokenised once, and its tokens are joined to its places.

        ``key`` is a column that tells rows apart; where none is given, rows get a number, and are written for it.  With a ``table``,
        only words that it lacks are tokenised (under the name ``batch``).  Dropout between 0 and 1, and splits after a byte-level one,
        cannot be planned so (``NotByWords``).  What is written on the way stays in the shared folder while the result is used.
        """
        model = self.plan.model
        if isinstance(model, config.BpeModel) and 0 < model.dropout < 1:
            raise words.NotByWords("dropout draws anew")
        folder, columns = scratch.scratch_folder(df.sparkSession, "encode"), df.columns
        if key is None:
            key = free_name(df, "_key")
            df = scratch.written(df.withColumn(key, F.monotonically_increasing_id()), f"{folder}/rows")
        held = free_name(df, "_tokens")
        found = words.tokens_by_words(self, df, key, text, folder, table, batch).withColumnRenamed("tokens", held)
        none = F.lit(None).cast(TOKENS)
        empty = F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in TOKENS])
        joined = df.join(found, key, "left")
        made = F.coalesce(F.when(F.col(text).isNull(), none).otherwise(F.col(held)), empty)
        placed = joined.withColumn(held, self.in_text(F.col(text), made))
        encoded = placed.withColumn(into, self.encode_column(F.col(text), add_special_tokens, F.col(held)))
        if pad_scope != "dataset" or self.plan.padding is None or self.plan.padding.fixed is not None:
            return encoded.select(*[c for c in columns if c != into], into)
        bare = replace(self, plan=replace(self.plan, padding=None))
        short = scratch.written(placed.withColumn(into, bare.encode_column(F.col(text), add_special_tokens, F.col(held))).select(*[c for c in columns if c != into], into), f"{folder}/encoded")
        return self._pad_to_longest(short, into)

    def ids_by_words(self, df: DataFrame, key: str, text: str = "text", into: str = "ids", add_special_tokens: bool = True) -> DataFrame:
        """Rows (key, ids) for a table whose rows ``key`` tells apart: the ids of ``encode_by_words`` alone.  Neither places nor names of
        tokens are made for them; pipelines that truncate, pad or draw anew go the long way."""
        rules = self.plan
        if rules.truncation or rules.padding or isinstance(rules.model, config.BpeModel) and rules.model.dropout:
            encoded = self.encode_by_words(df.select(key, text), text, "encoding", add_special_tokens, key)
            return encoded.select(key, F.col("encoding.ids").alias(into))
        ids = F.col("ids")
        for rule in rules.post_processor or ():
            if rule.kind == "TemplateProcessing":
                ids = encoding.templated(ids, rule, add_special_tokens)
        found = words.ids_by_words(self, df, key, text, scratch.scratch_folder(df.sparkSession, "ids"))
        return found.select(key, ids.alias(into))

    def pair_column(self, first: Column, second: Column, first_tokens: Column, second_tokens: Column, add_special_tokens: bool = True) -> Column:
        rules = self.plan

        def parts(a: Column, b: Column) -> Column:
            left, right = encoding.truncate_pair(a, b, rules.truncation, main=not self.keep_overflow)
            joined = lambda x, y: encoding.pad(encoding.joined_pair(x, y, rules.post_processor, add_special_tokens), rules.padding)
            return encoding.let(right, lambda all: F.flatten(F.transform(left, lambda x: F.transform(all, lambda y: joined(x, y)))))

        both = encoding.let(encoding.from_tokens(first_tokens), lambda a: encoding.let(encoding.from_tokens(second_tokens), lambda b: parts(a, b)))
        return F.when(first.isNotNull() & second.isNotNull(), encoding.let(both, encoding.with_overflow))

    def encode_pairs(self, df: DataFrame, first: str, second: str, into: str = "encoding", add_special_tokens: bool = True, key: str | None = None, by_words: bool = True, parts: str | None = None) -> DataFrame:
        """Adds the encoding of two texts together: truncated to ``max_length`` in all, in the pair template, padded.

        Further parts are those of the first text, each with all of the second's.  Where the second text is null, the first is encoded
        alone; where the first is null, so is the result.  ``by_words`` plans it by distinct words, as ``encode_by_words``; without
        it no row moves, and streams can be encoded.

        As parts multiply, the overflow of two long texts is far longer than they are.  ``parts`` names a column for the number of all parts;
        the further ones are counted then, and not made.
        """
        columns, texts = df.columns, (first, second)
        held = [free_name(df, "_first"), free_name(df, "_second")]
        if by_words:
            folder = scratch.scratch_folder(df.sparkSession, "pairs")
            if key is None:
                key = free_name(df, "_key")
                df = scratch.written(df.withColumn(key, F.monotonically_increasing_id()), f"{folder}/rows")
            empty = F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in TOKENS])
            source = df
            for name, text in zip(held, texts):
                found = words.tokens_by_words(self, source, key, text, f"{folder}/{name}").withColumnRenamed("tokens", name)
                df = df.join(found, key, "left").withColumn(name, self.in_text(F.col(text), F.coalesce(F.col(name), empty)))
        else:
            for name, text in zip(held, texts):
                df = df.withColumn(name, self.tokens(F.col(text)))
        a, b, made = F.col(first), F.col(second), self if parts is None else replace(self, keep_overflow=False)
        pair = made.pair_column(a, b, F.col(held[0]), F.col(held[1]), add_special_tokens)
        alone = made.encode_column(a, add_special_tokens, F.col(held[0]))
        encoded = df.withColumn(into, F.when(b.isNull(), alone).otherwise(pair))
        if parts is None:
            return encoded.select(*[c for c in columns if c != into], into)
        sizes, rule = [F.size(F.col(h)["ids"]) for h in held], self.plan.truncation
        count = F.when(a.isNotNull(), F.when(b.isNull(), encoding.count_parts(sizes[0], rule)).otherwise(encoding.count_pair_parts(*sizes, rule)))
        return encoded.withColumn(parts, count).select(*[c for c in columns if c not in (into, parts)], into, parts)

    def _pad_to_longest(self, encoded: DataFrame, into: str) -> DataFrame:
        """Pads encodings without padding to the longest of the table, a scalar subquery."""
        size = free_name(encoded, "_longest")
        longest = encoded.agg(F.coalesce(F.max(F.size(F.col(into)["ids"])), F.lit(0)).alias(size)).scalar()
        main = F.struct(*[F.col(into)[n].alias(n) for n in encoding.FIELDS])
        parts = F.transform(F.concat(F.array(main), F.col(into)["overflowing"]), lambda p: encoding.pad(p, self.plan.padding, F.col(size)))
        return encoded.withColumn(size, longest).withColumn(into, F.when(F.col(into).isNotNull(), encoding.with_overflow(parts))).drop(size)

    def counts_by_words(self, df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
        """``token_counts`` as a relational plan: words are counted, distinct ones tokenised, and their tokens' counts summed up."""
        return words.counts_by_words(self, df, text, by, scratch.scratch_folder(df.sparkSession, "counts"))

    def token_counts(self, df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
        """Rows (*by, token, id, n): how often each token of the model stands in the texts of a group.

        A worker asks the model once per distinct word that it remembers; tokens are counted before the shuffle.
        """
        made = df.select(*by, self.tokens(F.col(text)).alias("_t"))
        each = made.select(*by, F.explode(F.arrays_zip(F.col("_t.tokens").alias("token"), F.col("_t.ids").alias("id"))).alias("_t"))
        return each.select(*by, "_t.token", "_t.id").groupBy(*by, "token", "id").agg(F.count(F.lit(1)).alias("n"))

    def id_tokens(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        """The token strings of an array of ids; an id without a token raises.

        Built-in lookup: an array literal in which an id is its own place (folded once).  Ids far beyond the vocabulary's size, which
        would make it long, are few: they are looked up one by one.
        """
        names = {i: t for t, i in self.vocab.items()} | self.added.by_id
        specials = self.added.specials if skip_special_tokens else frozenset()
        dense = 2 * len(names) + 1024
        listed = [names.get(i) for i in range(max((i for i in names if i < dense), default=-1) + 1)]
        table = F.from_json(F.lit(json.dumps(listed)), "array<string>")
        far = sorted(i for i in names if i >= dense)
        unknown = F.raise_error(F.lit("an id has no token")).cast("string")
        distant = F.from_json(F.lit(json.dumps({str(i): names[i] for i in far})), "map<string,string>")

        def name(i: Column) -> Column:
            return F.coalesce(F.get(table, i), *([F.try_element_at(distant, i.cast("string"))] if far else []), unknown)

        tokens = F.transform(ids, name)
        return F.filter(tokens, lambda t: ~t.isin(sorted(specials))) if specials else tokens

    def decode(self, df: DataFrame, ids: str = "ids", into: str = "decoded", skip_special_tokens: bool = True) -> DataFrame:
        held = free_name(df, "_held")
        named = df.withColumn(held, self.id_tokens(F.col(ids), skip_special_tokens))
        return named.withColumn(into, decoders.decode_tokens(F.col(held), self.plan.decoder)).drop(held)

    # --- SQL --------------------------------------------------------------------------------------------------------------

    def register(self, spark: SparkSession, encode: str = "encode_ids", decode: str = "decode_ids", table: str = "tokenize") -> None:
        """SQL functions ``encode_ids(text[, add_special_tokens])`` (no special tokens where the flag is left out) and
        ``decode_ids(ids[, skip_special_tokens])`` (they are skipped where it is), and a table function ``tokenize(text)`` of the
        tokens before truncation and post-processing.  Null gives null."""
        ship(spark)
        made, encoder, decoder = Made(self), Made(self, row_encoder), Made(self, row_decoder)

        @F.pandas_udf("array<int>")
        def encode_ids(texts: pd.Series, *flags: pd.Series) -> pd.Series:
            run, flag = encoder.tokenizer(), _flags(texts, flags, False)
            return pd.Series([None if ids is None else np.array(ids, np.int32) for ids in run.of_batch(texts, flag)], dtype=object)

        @F.pandas_udf("string")
        def decode_ids(rows: pd.Series, *flags: pd.Series) -> pd.Series:
            run, flag = decoder.tokenizer(), _flags(rows, flags, True)
            return pd.Series([None if r is None else run(r, f) for r, f in zip(rows, flag)], dtype=object)

        class Tokenize:
            def eval(self, text: str):
                if text is not None:
                    ids, tokens, words, starts, ends = made.tokenizer()(text)
                    yield from zip(range(len(ids)), ids, tokens, words, starts, ends)

        spark.udf.register(encode, encode_ids)
        spark.udf.register(decode, decode_ids)
        spark.udtf.register(table, F.udtf(Tokenize, returnType="pos int, id int, token string, word int, start int, end int"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def _flags(rows: pd.Series, given: tuple[pd.Series, ...], default: bool) -> list[bool]:
    """The optional flag of an SQL function: the default where it is left out or null."""
    return [default] * len(rows) if not given else [default if f is None or f != f else bool(f) for f in given[0]]


def _one(part: config.Part):
    return lambda text: apply_one(text, part)


def _normalize_gaps(pieces: Column, parts: tuple[config.Part, ...]) -> Column:
    """Normalize each unresolved piece on its own by expressions, in the place that it has; positions are recounted."""
    changed = F.transform(pieces, lambda p: p["text"])
    for p in parts:
        changed = F.transform(changed, _one(p))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int,token_id:int>>").alias("out"))

    def step(a: Column, pair: Column) -> Column:
        text = F.when(pair["p"]["token_id"].isNull(), pair["t"]).otherwise(pair["p"]["text"])
        end = a["at"] + F.length(text)
        made = F.struct(text.alias("text"), a["at"].alias("start"), end.alias("end"), pair["p"]["token_id"].alias("token_id"))
        return F.struct(end.alias("at"), F.when(text == "", a["out"]).otherwise(F.array_append(a["out"], made)).alias("out"))

    pairs = F.zip_with(pieces, changed, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    return F.aggregate(pairs, begin, step, lambda a: a["out"])


def describe(engine: Engine) -> str:
    """The plan as text, for logs."""
    plan = engine.plan
    model = type(plan.model).__name__ if plan.model else None
    return json.dumps(
        {
            "normalizer": [p.kind for p in plan.normalizer],
            "pre_tokenizer": [p.kind for p in plan.pre_tokenizer],
            "model": model,
            "post_processor": [p.kind for p in plan.post_processor],
            "decoder": None if plan.decoder is None else [p.kind for p in plan.decoder],
            "added_tokens": len(engine.added.tokens),
        }
    )
