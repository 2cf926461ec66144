"""Added vocabulary: id assignment, and extraction of added tokens from text before and after normalization."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.split import PIECES, _cut, cut, placed
from ..plans.config import AddedToken


@dataclass(frozen=True)
class AddedVocabulary:
    """Immutable.  ``ids`` of all added contents; ``tokens`` in the order in which they came."""

    tokens: tuple[AddedToken, ...] = ()
    ids: tuple[tuple[str, int], ...] = ()
    match_only_in_vocab: bool = False
    encode_special_tokens: bool = False

    @property
    def by_content(self) -> dict[str, int]:
        return dict(self.ids)

    @property
    def by_id(self) -> dict[int, str]:
        return {i: c for c, i in self.ids}

    @property
    def specials(self) -> frozenset[str]:
        return frozenset(t.content for t in self.tokens if t.special)

    def is_special(self, content: str) -> bool:
        return content in self.specials

    def add(self, tokens: tuple[AddedToken, ...], vocab: dict[str, int]) -> tuple["AddedVocabulary", int]:
        """The vocabulary with these tokens, and how many were not ignored.

        A content keeps the id that it has, takes the model's, or gets the next free one: the model's size, or one more than the
        largest added id once that has reached the model's size.
        """
        ids, known, count = dict(self.ids), {t.content: t for t in self.tokens}, 0
        for token in tokens:
            if not token.content:
                continue
            count += 1
            if token.content not in ids:
                top = max(ids.values(), default=-1)
                ids[token.content] = vocab.get(token.content, top + 1 if top >= len(vocab) else len(vocab))
            known.setdefault(token.content, token)
        return replace(self, tokens=tuple(known.values()), ids=tuple(ids.items())), count

    def matchable(self, vocab: dict[str, int], normalized: bool) -> list[AddedToken]:
        """Tokens to look for in raw (False) or normalized (True) text, longest first."""
        found = [
            t
            for t in self.tokens
            if t.normalized == normalized
            and (t.content in vocab or not self.match_only_in_vocab)
            and not (t.special and self.encode_special_tokens)
        ]
        return sorted(found, key=lambda t: (-len(t.content), t.content))


#: From so many plain tokens on, their contents become a trie instead of a list of alternatives.
MANY = 32


def trie(contents: list[str]) -> str:
    """A pattern that matches the longest of the contents at a place: common beginnings once, and after each what may follow.

    So a place is given up after as many characters as it shares with some content, however many contents there are.
    """
    root: dict = {}
    for content in contents:
        node = root
        for char in content:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends = "" in node
        branches = []
        for char, below in sorted(node.items()):
            if char:
                tail = re.escape(char)
                while len(below) == 1 and "" not in below:  # a single way on
                    (following, below), = below.items()
                    tail += re.escape(following)
                branches.append(tail + (written(below) if set(below) != {""} else ""))
        if not branches:
            return ""
        body = f"(?:{'|'.join(branches)})"
        return f"{body}?" if ends else body

    return written(root)


def pattern(tokens: list[AddedToken]) -> str:
    """One pattern, leftmost match first and of those the longest content.  The same text serves both regex dialects."""
    plain = [t.content for t in tokens if not (t.single_word or t.lstrip or t.rstrip)]
    if len(plain) == len(tokens) >= MANY:
        return trie(plain)
    out = []
    for t in tokens:
        body = re.escape(t.content)
        if t.single_word:
            body = rf"(?<!\w){body}(?!\w)"
        out.append((r"\s*" if t.lstrip else "") + body + (r"\s*" if t.rstrip else ""))
    return "|".join(out)


def id_lookup(ids: dict[str, int]) -> Callable[[Column], Column]:
    """text -> its id, or null, by a hash table of literals: the time does not depend on how many there are."""
    size = max(1, len(ids))
    buckets: list[list] = [[] for _ in range(size)]
    for content, i in ids.items():
        buckets[zlib.crc32(content.encode("utf-8", "surrogatepass")) % size].append({"content": content, "id": i})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<content:string,id:int>>>")

    def find(text: Column) -> Column:
        bucket = F.get(table, (F.crc32(text.cast("binary")) % size).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["content"] == text), 0)["id"]

    return find


def extract(pieces: Column, tokens: list[AddedToken], ids: dict[str, int]) -> Column:
    """Split unresolved pieces at added tokens; matched pieces get their token's id."""
    if not tokens:
        return pieces
    find = id_lookup({t.content: ids[t.content] for t in tokens})
    stripped = any(t.lstrip or t.rstrip for t in tokens)

    def id(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")
        return F.coalesce(find(text), find(bare)) if stripped else find(text)

    def one(piece: Column) -> Column:
        cut = _cut(piece["text"], f"(?U){pattern(tokens)}")
        return F.when(piece["token_id"].isNotNull(), F.array(piece).cast(PIECES)).otherwise(placed(cut, piece["start"], True, id))

    return F.flatten(F.transform(pieces, one))


def occurrences(df: DataFrame, tokens: list[AddedToken], ids: dict[str, int], key: str, text: str = "text") -> DataFrame:
    """Rows (key, place, id, token): where added tokens stand in the texts, in characters; a join instead of arrays of pieces."""
    cut = F.posexplode(_cut(F.col(text), f"(?U){pattern(tokens)}"))
    upto = W.partitionBy(key).orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.select(key, text).repartition(key).select(key, cut.alias("_i", "_p"))
    placed_rows = rows.withColumn("place", (F.sum(F.length("_p.text")).over(upto) - F.length("_p.text")).cast("int"))
    find = id_lookup({t.content: ids[t.content] for t in tokens})
    return placed_rows.where("_p.matched").select(key, "place", find(F.col("_p.text")).alias("id"), F.col("_p.text").alias("token"))


def extract_aligned(pieces: list, ids: dict[str, int], compiled: regex.Pattern | None) -> list:
    """The twin for the fused path: pieces are (text, starts, ends, token id)."""
    return pieces if compiled is None else cut(pieces, compiled, True, lambda t: ids[t] if t in ids else ids[t.strip()])
