"""WordPiece, byte-pair, word-level and unigram models: a word becomes tokens (id, value, start, end).

The evaluators below run inside Arrow functions, once per distinct word.  There are plans of built-in operators only as well:
``wordpiece_by_join``, ``unigram_by_join``, ``wordlevel_by_join``, and ``bpe_by_replace`` for a few hundred merge rules.
"""

from __future__ import annotations

import heapq
import json
import random
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import BpeModel, Model, UnigramModel, WordLevelModel, WordPieceModel
from .added import trie

Token = tuple[int, str, int, int]


class WordPiece:
    def __init__(self, model: WordPieceModel):
        self.model, self.vocab = model, model.vocab
        self.unknown = (model.vocab.get(model.unk_token, 0), model.unk_token)
        self.longest = max(map(len, model.vocab), default=0)

    def tokenize(self, word: str) -> list[Token]:
        """Greedy longest pieces from the left; where none fits, or the word is too long, the whole word is unknown."""
        size, prefix = len(word), self.model.continuing_subword_prefix
        unknown = [(*self.unknown, 0, size)]
        if size > self.model.max_input_chars_per_word:
            return unknown
        out: list[Token] = []
        at = 0
        while at < size:
            lead = prefix if at else ""
            for end in range(min(size, at + self.longest), at, -1):
                piece = lead + word[at:end]
                if piece in self.vocab:
                    out.append((self.vocab[piece], piece, at, end))
                    at = end
                    break
            else:
                return unknown
        return out


class WordPieceIds:
    """``WordPiece.tokenize`` without places: a trie of the pieces finds the longest ones."""

    def __init__(self, model: WordPieceModel):
        prefix, self.most = model.continuing_subword_prefix, model.max_input_chars_per_word
        self.first = model.vocab
        self.more = {p.removeprefix(prefix): i for p, i in model.vocab.items() if p.startswith(prefix)}
        self.unknown = [model.vocab.get(model.unk_token, 0)]
        # without any piece, a pattern that matches nowhere
        self.head, self.tail = (re.compile(trie([p for p in pieces if p]) or "(?!)", re.DOTALL) for pieces in (self.first, self.more))

    def __call__(self, word: str) -> list[int]:
        if not word:
            return []
        head = self.head.match(word) if len(word) <= self.most else None
        if head is None:
            return self.unknown
        rest = self.tail.findall(word, head.end())
        if head.end() + sum(map(len, rest)) != len(word):
            return self.unknown
        return [self.first[head[0]], *map(self.more.__getitem__, rest)]


class Bpe:
    def __init__(self, model: BpeModel, merge_priority: str = "lowest", seed: int = 0):
        self.model, self.vocab, self.seed = model, model.vocab, seed
        self.names = {i: t for t, i in model.vocab.items()}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        cut = len(model.continuing_subword_prefix)
        sign = 1 if merge_priority == "lowest" else -1
        for rank, (a, b) in enumerate(model.merges):
            made = self.vocab.get(a + b[cut:] if cut and b.startswith(model.continuing_subword_prefix) else a + b)
            if a in self.vocab and b in self.vocab and made is not None:
                self.rules.setdefault((self.vocab[a], self.vocab[b]), (sign * rank, made))

    def symbols(self, word: str) -> list[tuple[int, int]]:
        """(id, length) of the initial symbols: known characters, byte fallback, unknowns (fused on wish), else dropped."""
        m, out, pending = self.model, [], 0
        unknown = None if m.unk_token is None else self.vocab.get(m.unk_token)
        for i, char in enumerate(word):
            name = (m.continuing_subword_prefix if i else "") + char + (m.end_of_word_suffix if i == len(word) - 1 else "")
            found: list[tuple[int, int]] = []
            if name in self.vocab:
                found = [(self.vocab[name], 1)]
            elif m.byte_fallback:
                data = [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass")]
                if all(d in self.vocab for d in data):
                    found = [(self.vocab[d], int(k == 0)) for k, d in enumerate(data)]
            if found:
                if pending:
                    out.append((unknown, pending))
                    pending = 0
                out += found
            elif unknown is not None:
                if m.fuse_unk:
                    pending += 1
                else:
                    out.append((unknown, 1))
        if pending:
            out.append((unknown, pending))
        return out

    def tokenize(self, word: str) -> list[Token]:
        m = self.model
        if not word:
            return []
        if m.ignore_merges and not m.dropout and word in self.vocab:
            return [(self.vocab[word], word, 0, len(word))]
        symbols = self.merge(self.symbols(word), random.Random(zlib.crc32(word.encode("utf-8", "surrogatepass")) ^ self.seed))
        out, at = [], 0
        for i, size in symbols:
            out.append((i, self.names[i], at, at + size))
            at += size
        return out

    def merge(self, symbols: list[tuple[int, int]], draw: random.Random) -> list[tuple[int, int]]:
        """Apply rules, best rank first and leftmost on ties; a dropped-out rule waits for the next applied one."""
        size, drop = len(symbols), self.model.dropout
        if size < 2 or drop >= 1 or not self.rules:
            return symbols
        ids, sizes = [s[0] for s in symbols], [s[1] for s in symbols]
        after, before, live = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        queue: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            rule = self.rules.get((ids[i], ids[j])) if j < size else None
            if rule:
                heapq.heappush(queue, (rule[0], i, j, rule[1]))

        for i in range(size):
            push(i)
        waiting = []
        while queue:
            rank, i, j, made = heapq.heappop(queue)
            if not live[i] or not live[j] or after[i] != j or self.rules.get((ids[i], ids[j])) != (rank, made):
                continue
            if drop and draw.random() < drop:
                waiting.append((rank, i, j, made))
                continue
            ids[i], sizes[i], live[j], after[i] = made, sizes[i] + sizes[j], False, after[j]
            if after[i] < size:
                before[after[i]] = i
            for entry in waiting:
                heapq.heappush(queue, entry)
            waiting = []
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [(ids[i], sizes[i]) for i in range(size) if live[i]]


class WordLevel:
    def __init__(self, model: WordLevelModel):
        self.model = model

    def tokenize(self, word: str) -> list[Token]:
        """The word as one token; one that is not in the vocabulary is the unknown token, or none if that is missing, too."""
        name = word if word in self.model.vocab else self.model.unk_token
        return [(self.model.vocab[name], name, 0, len(word))] if word and name in self.model.vocab else []


class Unigram:
    def __init__(self, model: UnigramModel):
        self.model, self.vocab = model, model.vocab
        self.scores = {piece: model.pieces[i][1] for piece, i in model.vocab.items()}
        self.longest = max(map(len, model.vocab), default=0)

    def tokenize(self, word: str) -> list[Token]:
        """The likeliest segmentation; of equally likely ones, that whose last piece is longest, and so on backwards."""
        m, size = self.model, len(word)
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
        for end in range(1, size + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                if piece in self.scores:
                    found.append((best[start][0] + self.scores[piece], -start, self.vocab[piece]))
            if word[end - 1] not in self.scores:
                found.append((best[end - 1][0] + m.unknown_score, 1 - end, None))
            best.append(max(found, key=lambda f: f[:2]))
        parts, at = [], size
        while at > 0:
            start, i = -best[at][1], best[at][2]
            if i is None and m.fuse_unk and parts and parts[-1][0] is None:
                parts[-1] = (None, start, parts[-1][2])
            else:
                parts.append((i, start, at))
            at = start
        out: list[Token] = []
        for i, start, end in reversed(parts):
            text = word[start:end]
            names = [f"<0x{b:02X}>" for b in text.encode("utf-8", "surrogatepass")] if i is None and m.byte_fallback else []
            if names and all(n in self.vocab for n in names):
                out += [(self.vocab[n], n, start, end) for n in names]
            elif i is not None or m.unk_id is not None:
                out.append((m.unk_id if i is None else i, text, start, end))
        return out


def evaluator(model: Model | None, merge_priority: str = "lowest"):
    """word -> tokens; no model gives no tokens."""
    if model is None:
        return lambda word: []
    if isinstance(model, BpeModel):
        return Bpe(model, merge_priority).tokenize
    kinds = {WordPieceModel: WordPiece, WordLevelModel: WordLevel, UnigramModel: Unigram}
    return kinds[type(model)](model).tokenize


def id_evaluator(model: Model | None, merge_priority: str = "lowest"):
    """word -> ids, those of ``evaluator``; no word gives none."""
    if isinstance(model, WordPieceModel):
        return WordPieceIds(model)
    tokenize = evaluator(model, merge_priority)
    return lambda word: [t[0] for t in tokenize(word)] if word else []


# --- plans of built-in operators -----------------------------------------------------------------------------------------


TOKEN = "struct<id:int,value:string,start:int,end:int>"
#: Pieces of a vocabulary that is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 2_000_000
#: Pieces of a vocabulary that a pattern is made of.
MOST_MATCHED = 100_000


def any_of(pieces: list[str]) -> str:
    """A pattern for the longest of the pieces; of none, one that never matches."""
    return f"(?:{trie(pieces)})" if pieces else "(?!)"


def vocab_table(spark, vocab: dict[str, int]) -> DataFrame:
    """The vocabulary as a table (piece, id), broadcast in joins up to ``MOST_BROADCAST`` pieces."""
    made = spark.createDataFrame(sorted(vocab.items(), key=lambda x: x[1]) or [("", 0)], "piece string, id int").where(F.col("piece") != "")
    return F.broadcast(made) if len(vocab) <= MOST_BROADCAST else made


def token_to_id(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(vocab.select(F.col("piece").alias(token), "id"), token, "left")


def id_to_token(ids: DataFrame, vocab: DataFrame, id: str = "id") -> DataFrame:
    return ids.join(vocab.select(F.col("id").alias(id), F.col("piece").alias("token")), id, "left")


def wordpiece_by_join(words: DataFrame, model: WordPieceModel, word: str = "word") -> DataFrame:
    """Rows (word, tokens) for each distinct word: its longest pieces from the left, which get their ids by a join with the vocabulary.

    A pattern finds the pieces, each where the one before ended; a word that they do not make up is unknown.  Only pieces become rows,
    and words are read, and move, once.
    """
    if len(model.vocab) > MOST_MATCHED:
        return _wordpiece_by_spans(words, model, word)
    prefix, size = model.continuing_subword_prefix, F.length("word")
    inner = [p[len(prefix) :] for p in model.vocab if p.startswith(prefix) and len(p) > len(prefix)]
    pattern = rf"\A{any_of([p for p in model.vocab if p])}|(?!\A)\G{any_of(inner)}"
    distinct = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    cut = distinct.select("word", F.regexp_extract_all("word", F.lit(pattern), F.lit(0)).alias("cut"))
    piece = lambda id, value, start, end: F.struct(id.cast("int").alias("fixed"), value.alias("piece"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    def found(t: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice("cut", F.lit(1), i), ""))
        return piece(F.lit(None), F.when(i > 0, F.concat(F.lit(prefix), t)).otherwise(t), start, start + F.length(t))

    whole = (size <= model.max_input_chars_per_word) & (F.array_join("cut", "") == F.col("word"))
    unknown = piece(F.lit(model.vocab.get(model.unk_token, 0)), F.lit(model.unk_token), F.lit(0), size)
    rows = cut.select("word", F.explode_outer(F.when(whole, F.transform("cut", found)).otherwise(F.array(unknown))).alias("_p")).select("word", "_p.*")
    met = rows.join(vocab_table(words.sparkSession, model.vocab), "piece", "left")
    token = F.struct("start", F.coalesce("fixed", "id").alias("id"), F.col("piece").alias("value"), "end")
    grouped = met.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), token))).alias("_t"))
    made = lambda t: F.struct(t["id"].alias("id"), t["value"].alias("value"), t["start"].alias("start"), t["end"].alias("end"))
    return grouped.select(F.col("word").alias(word), F.transform("_t", made).cast(f"array<{TOKEN}>").alias("tokens"))


def _wordpiece_by_spans(words: DataFrame, model: WordPieceModel, word: str) -> DataFrame:
    """Every substring that the vocabulary has, longest per start, walked from the left: for vocabularies too large for a pattern."""
    spark, prefix = words.sparkSession, model.continuing_subword_prefix
    longest = max(map(len, model.vocab), default=1)
    distinct = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    fits = distinct.where(F.length("word") <= model.max_input_chars_per_word)
    starts = fits.select("word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))).alias("start"))
    spans = starts.select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("size")
    ).where(F.length("word") > 0)
    named = spans.withColumn(
        "piece", F.concat(F.when(F.col("start") > 1, F.lit(prefix)).otherwise(F.lit("")), F.substring("word", F.col("start"), F.col("size")))
    )
    best = (
        named.join(vocab_table(spark, model.vocab), "piece")
        .groupBy("word", "start")
        .agg(F.max(F.struct("size", "id", "piece")).alias("best"))
        .groupBy("word")
        .agg(F.map_from_entries(F.collect_list(F.struct("start", "best"))).alias("best"))
    )
    begin = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{TOKEN}>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        hit = F.try_element_at(F.col("best"), i)
        made = F.struct(hit["id"].alias("id"), hit["piece"].alias("value"), (i - 1).alias("start"), (i - 1 + hit["size"]).alias("end"))
        here = (a["at"] == i) & hit.isNotNull()
        return F.when(here, F.struct((i + hit["size"]).alias("at"), F.array_append(a["out"], made).alias("out"))).otherwise(a)

    unknown = F.array(F.struct(F.lit(model.vocab.get(model.unk_token, 0)).alias("id"), F.lit(model.unk_token).alias("value"), F.lit(0).alias("start"), F.length("word").alias("end"))).cast(f"array<{TOKEN}>")
    whole = distinct.join(best, "word", "left")
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), begin, step, lambda a: F.when(a["at"] == F.length("word") + 1, a["out"]))
    tokens = F.when(F.length("word") == 0, F.array().cast(f"array<{TOKEN}>")).otherwise(F.coalesce(F.when(F.col("best").isNotNull(), walked), unknown))
    return whole.select(F.col("word").alias(word), tokens.alias("tokens"))


def wordlevel_by_join(words: DataFrame, model: WordLevelModel, word: str = "word") -> DataFrame:
    """Rows (word, tokens) for each distinct word: itself, or the unknown token."""
    distinct = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    met = token_to_id(distinct, vocab_table(words.sparkSession, model.vocab), "word")
    unknown = model.vocab.get(model.unk_token)
    id = F.coalesce("id", F.lit(unknown))
    value = F.when(F.col("id").isNull(), model.unk_token).otherwise(F.col("word"))
    one = F.array(F.struct(id.alias("id"), value.alias("value"), F.lit(0).alias("start"), F.length("word").alias("end")))
    none = id.isNull() | (F.col("word") == "")
    return met.select(F.col("word").alias(word), F.when(none, F.array()).otherwise(one).cast(f"array<{TOKEN}>").alias("tokens"))


def unigram_by_join(words: DataFrame, model: UnigramModel, word: str = "word") -> DataFrame:
    """Rows (word, tokens) for each distinct word: the likeliest segmentation over the lattice of its pieces.

    Substrings are joined with the vocabulary; a word's arcs, ordered by their end, are folded into the best way to each place (Viterbi),
    which is walked back.  All is built-in expressions.
    """
    spark, longest = words.sparkSession, max(map(len, model.vocab), default=1)
    listed = [(piece, i, model.pieces[i][1]) for piece, i in model.vocab.items() if piece]
    vocab = spark.createDataFrame(listed or [("", 0, 0.0)], "piece string, id int, score double")
    vocab = F.broadcast(vocab) if len(listed) <= MOST_BROADCAST else vocab
    distinct = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    # an empty word stays as a row without places, so that words are read once
    starts = distinct.select("word", F.explode_outer(F.when(F.col("word") != "", F.sequence(F.lit(0), F.length("word") - 1))).alias("start"))
    most = F.least(F.lit(longest), F.length("word") - F.col("start"))
    if len(listed) <= MOST_MATCHED:  # no piece that begins here is longer than the longest one that matches
        rest = F.substring("word", F.col("start") + 1, F.lit(longest))
        most = F.greatest(F.length(F.regexp_extract(rest, rf"\A{any_of([p for p, _, _ in listed])}", 0)), F.lit(1))
    spans = starts.select("word", "start", F.explode_outer(F.when(F.col("start").isNotNull(), F.sequence(F.lit(1), most))).alias("size"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("size")))
    met = spans.join(vocab, "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1) | F.col("start").isNull())
    arc = F.struct((F.col("start") + F.col("size")).alias("end"), "start", "id", F.coalesce("score", F.lit(model.unknown_score)).alias("score"))
    arcs = met.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), arc))).alias("arcs"))

    place = "struct<score:double,back:int,id:int>"
    origin = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(None).cast("int").alias("id"))
    begin = F.struct(F.array().cast(f"array<{place}>").alias("done"), origin.alias("best"), F.lit(0).alias("at"))

    def arrive(a: Column, x: Column) -> Column:
        # places before the arc's end are done; of equal scores the arc that begins first is the greater
        before = F.when(x["start"] == a["at"], a["best"]["score"]).otherwise(F.get(a["done"], x["start"])["score"])
        way = F.struct((before + x["score"]).alias("score"), (-x["start"]).alias("back"), x["id"].alias("id"))
        here = F.struct(a["done"].alias("done"), F.greatest(a["best"], way).alias("best"), a["at"].alias("at"))
        return F.when(x["end"] == a["at"], here).otherwise(F.struct(F.array_append(a["done"], a["best"]).alias("done"), way.alias("best"), x["end"].alias("at")))

    ways = F.aggregate("arcs", begin, arrive, lambda a: F.array_append(a["done"], a["best"]))
    part = "struct<id:int,start:int,end:int>"
    last = F.struct(F.length("word").alias("at"), F.array().cast(f"array<{part}>").alias("out"))

    def back(a: Column, end: Column) -> Column:
        way, next = F.get(F.col("ways"), end), F.get(a["out"], 0)
        start = -way["back"]
        one = lambda stop: F.struct(way["id"].alias("id"), start.alias("start"), stop.alias("end"))
        grown = F.array_prepend(a["out"], one(end))
        if model.fuse_unk:
            both = way["id"].isNull() & (F.size(a["out"]) > 0) & next["id"].isNull()
            grown = F.when(both, F.array_prepend(F.slice(a["out"], 2, F.greatest(F.size(a["out"]) - 1, F.lit(0))), one(next["end"]))).otherwise(grown)
        return F.when(end == a["at"], F.struct(start.alias("at"), grown.alias("out"))).otherwise(a)

    parts = F.aggregate(F.sequence(F.greatest(F.length("word"), F.lit(1)), F.lit(1), F.lit(-1)), last, back, lambda a: a["out"])

    def token(p: Column) -> Column:
        text = F.substring("word", p["start"] + 1, p["end"] - p["start"])
        made = F.struct(F.coalesce(p["id"], F.lit(model.unk_id)).alias("id"), text.alias("value"), p["start"].alias("start"), p["end"].alias("end"))
        one = F.array(made).cast(f"array<{TOKEN}>")
        if model.unk_id is None:
            one = F.when(p["id"].isNull(), F.array().cast(f"array<{TOKEN}>")).otherwise(one)
        if not model.byte_fallback:
            return one
        ids = F.from_json(F.lit(json.dumps([model.vocab.get(f"<0x{b:02X}>") for b in range(256)])), "array<int>")
        pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
        each = lambda h: F.struct(F.get(ids, F.conv(h, 16, 10).cast("int")).alias("id"), F.concat(F.lit("<0x"), h, F.lit(">")).alias("value"), p["start"].alias("start"), p["end"].alias("end"))
        made_of_bytes = F.transform(pairs, each).cast(f"array<{TOKEN}>")
        return F.when(p["id"].isNull() & ~F.exists(made_of_bytes, lambda t: t["id"].isNull()), made_of_bytes).otherwise(one)

    return arcs.withColumn("ways", ways).select(F.col("word").alias(word), F.flatten(F.transform(parts, token)).alias("tokens"))


#: Marks around tokens; no token may hold one.  Those that a text holds are tokens of their own.
LEFT, RIGHT = "\ufdd0", "\ufdd1"


def replaceable(model: BpeModel) -> bool:
    """Nested replacement equals merging if what a rule joins is a character, or made only by rules before it."""
    made: dict[str, list[int]] = {}
    for rank, (a, b) in enumerate(model.merges):
        made.setdefault(a + b, []).append(rank)
    plain = not (model.continuing_subword_prefix or model.end_of_word_suffix or model.byte_fallback or model.dropout or model.ignore_merges)
    return plain and all(
        (len(x) == 1 or x in made) and all(r < rank for r in made.get(x, ())) for rank, pair in enumerate(model.merges) for x in pair
    )


def bpe_by_replace(text: Column, model: BpeModel) -> Column:
    """Array of token strings by one literal replacement per rule, in rank order.  For a few hundred rules at most."""
    if not replaceable(model):
        raise ValueError("these rules cannot be applied by replacement; use the evaluator")
    if any(c in x for x in model.vocab for c in (LEFT, RIGHT)):
        raise ValueError("the vocabulary holds the marks of this plan; use the evaluator")
    rules = [(a, b) for a, b in model.merges if a in model.vocab and b in model.vocab and a + b in model.vocab]
    steps = F.array(*[F.struct(F.lit(f"{LEFT}{a}{RIGHT}{LEFT}{b}{RIGHT}").alias("pair"), F.lit(f"{LEFT}{a}{b}{RIGHT}").alias("made")) for a, b in rules])

    def merged(text: Column) -> Column:
        marked = F.regexp_replace(text, r"(?s)(.)", f"{LEFT}$1{RIGHT}")
        joined = F.aggregate(steps, marked, lambda s, m: F.replace(s, m["pair"], m["made"])) if rules else marked
        return F.filter(F.split(F.replace(joined, F.lit(LEFT), F.lit("")), RIGHT), lambda t: t != "")

    either = F.regexp_extract_all(text, F.lit(f"[{LEFT}{RIGHT}]|[^{LEFT}{RIGHT}]+"), F.lit(0))
    apart = F.flatten(F.transform(either, lambda t: F.when(t.isin(LEFT, RIGHT), F.array(t)).otherwise(merged(t))))
    return F.when(text.rlike(f"[{LEFT}{RIGHT}]"), apart).otherwise(merged(text))


def out_of_vocabulary(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Words that the vocabulary lacks, with their frequency."""
    counted = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(vocab.select(F.col("piece").alias(word)), word, "left_anti")


def running_offsets(tokens: DataFrame, by: list[str], order: str, length: str = "length") -> DataFrame:
    """Adds start and end of each token within its word from a running sum of lengths."""
    window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return tokens.withColumn("end", F.sum(length).over(window)).withColumn("start", F.col("end") - F.col(length))
