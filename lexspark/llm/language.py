"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character 1- to 3-grams, normalised to unit length.  Each language owns several
centroids (spherical k-means on a bounded sample of its labelled texts); a text gets the language of the centroid with the
largest cosine, and is *rejected* where that cosine is under the language's own distance bound.

Defined results: null text or a text without any letter gives ``und`` with score 0; an empty table gives no rows; rows with
null language teach nothing; without any labelled row all texts are ``und``.  Repeated rows get the same result each and count once
in the sample, as equal texts do; very long texts are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced_sample, map_rows, texts_of

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 8192  #: hashed n-grams
    centroids: int = 4  #: clusters per language
    sample_per_language: int = 600  #: bound of the labelled rows that are fitted on, per language
    rounds: int = 12  #: of k-means
    reject_quantile: float = 0.001  #: training cosines under this quantile set a language's rejection bound
    reject_slack: float = 0.5  #: the bound is this share of the quantile


@dataclass(frozen=True)
class LanguageModel:
    """Bounded: ``languages * centroids * buckets`` floats."""

    languages: list[str]
    owner: np.ndarray  # centroid -> language
    centroids: np.ndarray  # (centroids, buckets), unit rows
    idf: np.ndarray
    bound: np.ndarray  # per language
    buckets: int


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text[:64].isalpha() else bool(text)


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams of the lower-cased text; runs of other characters than letters are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(buckets, np.float32)
    low = points < 128
    letter = ~low | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    if not len(points):
        return np.zeros(buckets, np.float32)
    mix = points * np.uint32(2654435761)
    two = (mix[:-1] ^ (points[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (points[2:] * np.uint32(668265263))) * np.uint32(374761393)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = np.bincount(mix >> shift, minlength=buckets) + np.bincount(two >> shift, minlength=buckets)
    return (out + np.bincount(three >> shift, minlength=buckets)).astype(np.float32)


def unit_vectors(texts: list[str], idf: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros((len(texts), buckets), np.float32)
    for i, text in enumerate(texts):
        out[i] = ngram_counts(text, buckets)
    np.log1p(out, out=out)
    out *= idf
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.where(norms > 0, norms, 1)[:, None]
    return out


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Deterministic: the first centre is the mean's nearest row, each next one the row farthest from all centres so far."""
    k = min(k, len(rows))
    start = int(np.argmax(rows @ rows.mean(axis=0)))
    centres = [rows[start]]
    nearest = rows @ rows[start]
    while len(centres) < k:
        far = int(np.argmin(nearest))
        centres.append(rows[far])
        nearest = np.maximum(nearest, rows @ rows[far])
    centre = np.stack(centres)
    for _ in range(rounds):
        owner = np.argmax(rows @ centre.T, axis=1)
        fresh = np.stack([rows[owner == j].sum(axis=0) if np.any(owner == j) else centre[j] for j in range(k)])
        norms = np.linalg.norm(fresh, axis=1, keepdims=True)
        fresh = fresh / np.where(norms > 0, norms, 1)
        if np.allclose(fresh, centre, atol=1e-6):
            break
        centre = fresh
    return centre.astype(np.float32)


def fit_language(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on a bounded sample of (text, lang) rows; n-gram counts are made on the executors, clusters on the driver."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sample = balanced_sample(rows, "lang", params.sample_per_language).select("text", "lang")
    buckets = params.buckets

    def features(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            packed = []
            for text in texts:
                counts = ngram_counts(text, buckets)
                at = np.flatnonzero(counts).astype(np.uint16 if buckets <= 65536 else np.uint32)
                packed.append(at.astype(np.uint32).tobytes() + counts[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["lang", "terms"])

    collected = map_rows(sample, features, "lang string, terms binary").collect()
    collected.sort(key=lambda r: (r["lang"], bytes(r["terms"])))
    languages = sorted({r["lang"] for r in collected})
    sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {language: [] for language in languages}
    seen = np.zeros(buckets, np.int64)
    for r in collected:
        half = len(r["terms"]) // 2
        at, value = np.frombuffer(r["terms"], np.uint32, half // 4), np.frombuffer(r["terms"], np.float32, offset=half)
        sparse[r["lang"]].append((at, value))
        seen[at] += 1
    idf = np.log((1 + len(collected)) / (1 + seen)).astype(np.float32) + np.float32(0.05)
    centres, owner, bound = [], [], []
    for j, language in enumerate(languages):  # one language's sample is dense at a time
        own = np.zeros((len(sparse[language]), buckets), np.float32)
        for i, (at, value) in enumerate(sparse[language]):
            own[i, at] = np.log1p(value) * idf[at]
        norms = np.linalg.norm(own, axis=1, keepdims=True)
        own = (own / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
        if not len(own):
            own = np.zeros((1, buckets), np.float32)
        centre = spherical_kmeans(own, params.centroids, params.rounds)
        best = np.max(own @ centre.T, axis=1)
        centres.append(centre)
        owner += [j] * len(centre)
        bound.append(params.reject_slack * float(np.quantile(best, params.reject_quantile)))
    stacked = np.concatenate(centres) if centres else np.zeros((0, buckets), np.float32)
    return LanguageModel(languages, np.array(owner, np.int64), stacked, idf, np.array(bound), buckets)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score, rejected): the nearest centroid's language, its cosine, and whether that is too far."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def predict(batches):
        m = shared.value
        for whole in batches:
            for batch in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]:
                texts = texts_of(batch.column(1))
                lettered = np.array([has_letter(t) for t in texts])
                if len(m.centroids):
                    cosines = unit_vectors(texts, m.idf, m.buckets) @ m.centroids.T
                    best = np.argmax(cosines, axis=1)
                    value = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
                    owner = m.owner[best]
                    names = [m.languages[o] if ok else UNKNOWN for o, ok in zip(owner, lettered)]
                    rejected = (value < m.bound[owner]) | ~lettered
                    value = np.where(lettered, value, 0.0)
                else:
                    names, value, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(value), pa.array(rejected)],
                    [key, "lang_pred", "score", "rejected"],
                )

    return map_rows(docs.select(key, "text"), predict, f"{key} {kind}, lang_pred string, score double, rejected boolean")
