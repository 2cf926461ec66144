"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton after folding.

Folding: compatibility normalisation, loose marks removed (accents of a language's own letters tell words apart and stay),
homoglyphs to Latin letters, digits and signs that stand for letters
replaced inside words, everything else than letters to one blank.  The lexicon is learned from labelled rows: word beginnings
(stems) and whole words whose documents are toxic far more often than not, weighted by their log-odds.  A match inside an
exception phrase does not count.  The sum of weights is normalised by the text's length and calibrated to a probability.

Defined results: null, empty and letterless texts have no match and get the smallest score; an empty table gives no rows; with
no labelled rows the lexicon is empty and every score is 0.  Repeated rows get the same score each and count once in the sample,
as equal texts do; very long texts are matched whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows, texts_of

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухкмтвнізјѕԁɡαεορτυνικηβγ", "aeopcyxkmtbhizjsdgaeoptuvikhby"))
#: Digits and signs that stand for letters; applied where a letter stands next to them.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Harmless phrases that hold a listed word; a match inside one does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "sore loser rule", "class clown award")


class _Fold(dict):
    """Character table for str.translate, filled as characters come up."""

    def __missing__(self, point: int):
        char = chr(point)
        out = "".join(
            HOMOGLYPHS.get(c, c)
            for c in unicodedata.normalize("NFKC", char.lower())
            if not unicodedata.combining(c)
        )
        out = "".join(c if c.isalpha() or c in LEET else " " for c in out)
        self[point] = out
        return out


_FOLD = _Fold()
_LEET_TABLE = str.maketrans(LEET)
#: Digits before a letter, one digit after the last letter, and a lone sign before a letter are letters in disguise.
_DISGUISED = re.compile(r"[013457]{1,3}(?=[^\W\d_])|(?<=[^\W\d_])[013457](?![\d])|(?<![@$!|])[@$!|](?=[^\W\d_])")
_words_seen: dict[str, str] = {}


def _letters(word: str) -> str:
    known = _words_seen.get(word)
    if known is None:
        known = _DISGUISED.sub(lambda m: m[0].translate(_LEET_TABLE), word) if any(map(str.isalpha, word)) else " "
        known = "".join([c if c.isalpha() else " " for c in known])
        if len(_words_seen) > 200_000:
            _words_seen.clear()
        _words_seen[word] = known
    return known


def fold(text: str) -> str:
    """Blank-separated folded words, with a blank before the first and after the last."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    words = text.translate(_FOLD).split()
    return " ".join(["", *" ".join([w if w.isalpha() else _letters(w) for w in words]).split(), ""])


@dataclass(frozen=True)
class ToxicityParams:
    sample_per_label: int = 6000  #: bound of the labelled rows that are learned from, per label
    min_documents: int = 4  #: toxic documents that a term must be found in
    min_log_odds: float = 2.5
    min_evidence: float = 20.0  #: likelihood ratio of a term against chance; rare terms are otherwise pure by luck
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)  #: lengths of the word beginnings that are tried
    length_unit: int = 400  #: words per unit of length
    exceptions: tuple[str, ...] = EXCEPTIONS


@dataclass(frozen=True)
class ToxicityModel:
    """Bounded by the sample: a term needs ``min_documents`` of its toxic texts.  ``lexicon`` maps a folded pattern with a leading blank to its weight."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 1.0
    offset: float = 0.0
    params: ToxicityParams = field(default_factory=ToxicityParams)


def automaton(model: ToxicityModel):
    """Aho-Corasick over lexicon patterns (weight) and exception phrases (None)."""
    machine = ahocorasick.Automaton()
    for pattern, weight in model.lexicon.items():
        machine.add_word(pattern, (len(pattern), weight))
    for phrase in model.exceptions:
        machine.add_word(folded := fold(phrase)[:-1], (len(folded), None))
    if len(machine):
        machine.make_automaton()
    return machine


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """First and last places of what the spans cover together, ascending."""
    firsts, lasts = [], []
    for a, b in sorted(spans):
        if lasts and a <= lasts[-1]:
            lasts[-1] = max(lasts[-1], b)
        else:
            firsts.append(a)
            lasts.append(b)
    return firsts, lasts


def weight_of(folded: str, machine) -> tuple[float, int]:
    """The sum of weights and the number of counted matches; at each place the longest term counts once."""
    if not len(machine):
        return 0.0, 0
    shields: list[tuple[int, int]] = []
    starts: dict[int, float] = {}
    for end, (length, weight) in machine.iter(folded):
        if weight is None:
            shields.append((end - length + 1, end))
        else:
            starts[end - length + 1] = weight
    if shields:
        firsts, lasts = _joined(shields)
        starts = {s: w for s, w in starts.items() if s < firsts[0] or s > lasts[bisect_right(firsts, s) - 1]}
    return sum(starts.values()), len(starts)


def strength(total: float, words: int, unit: int) -> float:
    """Weight per length: grows with the matches, falls slowly with the text's length."""
    return math.log1p(total) - 0.25 * math.log1p(words / unit) if total > 0 else -1.0


def _terms(folded: str, stems: tuple[int, ...]) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in stems:
        out.update([f" {w[:n]}" for w in words if len(w) >= n])
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """``docs`` (doc_id, text) must hold only rows that may be learned from.  Term counts are made and summed on the executors."""
    sample = labelled_sample(docs, labels, label, params.sample_per_label)
    stems = params.stems

    def count(batches):
        both: tuple[Counter, Counter] = (Counter(), Counter())
        totals = [0, 0]
        for batch in batches:
            for text, y in zip(texts_of(batch.column("text")), batch.column("_label").to_pylist()):
                both[y > 0].update(_terms(fold(text), stems))
                totals[y > 0] += 1
        terms = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *terms], pa.string()), pa.array([totals[0], *[both[0][t] for t in terms]], pa.int64()), pa.array([totals[1], *[both[1][t] for t in terms]], pa.int64())],
            ["term", "clean", "toxic"],
        )

    summed = map_rows(sample, count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = summed.where(F.col("term") == "").first()
    if totals is None or not totals["toxic"]:
        return ToxicityModel({}, params.exceptions, params=params)
    clean, toxic = totals["clean"], totals["toxic"]
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    both, prior = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    surprise = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    evidence = 2 * (surprise(F.col("toxic"), prior) + surprise(F.col("clean"), max(1 - prior, 1e-9)))
    found = (
        summed.where((F.col("term") != "") & (F.col("toxic") >= params.min_documents))
        .withColumn("odds", odds)
        .where((F.col("odds") >= params.min_log_odds) & (evidence >= params.min_evidence))
        .collect()
    )
    lexicon = choose_terms({r["term"]: (r["toxic"], r["clean"], r["odds"]) for r in found}, stems)
    bare = ToxicityModel(lexicon, params.exceptions, params=params)
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def measure(batches):
        m = shared.value
        machine = automaton(m)
        for batch in batches:
            out = []
            for text in texts_of(batch.column("text")):
                folded = fold(text)
                total, _ = weight_of(folded, machine)
                out.append(strength(total, folded.count(" "), m.params.length_unit))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column("_label").cast(pa.int32())], ["x", "y"])

    points = map_rows(sample, measure, "x double, y int").collect()
    slope, offset = logistic(np.array([p["x"] for p in points]), np.array([float(p["y"] > 0) for p in points]))
    return ToxicityModel(lexicon, params.exceptions, slope, offset, params)


def choose_terms(found: dict[str, tuple[int, int, float]], stems: tuple[int, ...]) -> dict[str, float]:
    """Short stems first; a longer stem or a word is taken only where no stem of it is in, or where it is much purer."""
    lexicon: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        toxic, clean, odds = found[term]
        bare = term.strip()
        shorter = [f" {bare[:n]}" for n in stems if n < len(bare) or (n == len(bare) and term.endswith(" "))]
        if any(s in lexicon for s in shorter):
            continue
        if not term.endswith(" ") and clean > 0.02 * toxic:
            continue  # a stem must be almost pure; its purer continuations follow
        lexicon[term] = float(odds)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a two-parameter logistic regression by Newton's method."""
    if not len(x):
        return 1.0, 0.0
    rows = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        grad = rows.T @ (y - p) - ridge * len(x) * beta * np.array([1.0, 0.0])
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * len(x) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    """Rows (key, score, predicted, matches): probability of the toxic label from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def predict(batches):
        m = shared.value
        machine = automaton(m)
        for batch in batches:
            scores, counts = [], []
            for text in texts_of(batch.column(1)):
                folded = fold(text)
                total, n = weight_of(folded, machine)
                x = m.slope * strength(total, folded.count(" "), m.params.length_unit) + m.offset
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) if m.lexicon else 0.0)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.3) for s in scores], pa.int32()), pa.array(counts, pa.int32())],
                [key, "score", "predicted", "matches"],
            )

    return map_rows(docs.select(key, "text"), predict, f"{key} {kind}, score double, predicted int, matches int")
