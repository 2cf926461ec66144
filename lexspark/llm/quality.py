"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are classes of character trigrams (letters by case, digits, blanks, each punctuation mark), hashed words, and
counters of immediate and overall word repetition.  TF-IDF weighted term vectors of a bounded labelled sample are decomposed by
a randomised SVD; the labelled latent vectors (bounded) are broadcast, every text is projected, exact cosines against all
labelled vectors are computed block by block, and the labels of the ``neighbours`` nearest ones vote with their similarity.

Defined results: null and empty texts have no terms and get the sample's prior as score; an empty table gives no rows; without
any labelled row the prior is 0.5.  Ties between neighbours go to the smaller position in the (sorted) sample.  Repeated rows get
the same score each and count once in the sample, as equal texts do; very long texts are read whole, in memory for one text of
some eight times its size; columns of any name are carried along by ``keep``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, map_rows, texts_of

CLASSES = 24
WORD_BUCKETS = 2048
TRIGRAMS = CLASSES**3
COUNTERS = 2
WIDTH = TRIGRAMS + WORD_BUCKETS + COUNTERS


def _byte_classes() -> np.ndarray:
    out = np.full(256, 0, np.uint16)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.islower():
            out[b] = 2
        elif c.isupper():
            out[b] = 3
        elif c.isdigit():
            out[b] = 4
        elif c == "\n":
            out[b] = 5
        elif c.isspace():
            out[b] = 6
    for i, c in enumerate(".,!?#$%&*|'\"<>/-"):
        out[ord(c)] = 7 + i
    return out


BYTE_CLASS = _byte_classes()


@dataclass(frozen=True)
class QualityParams:
    sample_per_label: int = 2000  #: bound of the labelled rows that are fitted on and broadcast, per label
    terms: int = 4096  #: bound of the vocabulary: the terms found in most sampled texts
    dimensions: int = 64  #: of the latent space
    neighbours: int = 25
    block: int = 256  #: texts per block of cosine products
    word_weight: float = 0.3  #: of a hashed word against a character class trigram


@dataclass(frozen=True)
class QualityModel:
    """Bounded: terms x dimensions + labelled rows x dimensions floats."""

    terms: np.ndarray  # columns of the term space that are used
    weight: np.ndarray  # idf of each
    projection: np.ndarray  # (terms, dimensions)
    vectors: np.ndarray  # (labelled, dimensions), unit rows
    labels: np.ndarray
    prior: float
    params: QualityParams


def term_counts(text: str) -> np.ndarray:
    """The counts of all terms of the whole text."""
    out = np.zeros(WIDTH, np.float32)
    raw = text.encode("utf-8", "surrogatepass")
    classes = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    if len(classes) > 2:
        grams = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
        out[:TRIGRAMS] = np.bincount(grams, minlength=TRIGRAMS)
    words = text.split()
    if words:
        distinct = set(words)
        at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in distinct), np.int64, len(distinct))
        out[TRIGRAMS : TRIGRAMS + WORD_BUCKETS] = np.bincount(at, minlength=WORD_BUCKETS)
        out[-2] = sum(map(eq, words, islice(words, 1, None)))
        out[-1] = len(words) - len(distinct)
    return out


def latent(counts: np.ndarray, weight: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space; rows without terms stay zero."""
    rows = (np.log1p(counts) * weight) @ projection
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norms > 0, norms, 1)).astype(np.float32)


def truncated_svd(matrix: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors by a randomised range finder with a fixed seed."""
    rank = max(1, min(rank, *matrix.shape))
    probe = np.random.default_rng(7).standard_normal((matrix.shape[1], min(rank + 16, min(matrix.shape)))).astype(np.float32)
    basis = np.linalg.qr(matrix @ probe)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
    return np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:rank].T.astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """``docs`` (doc_id, text) must hold only rows that may be learned from; the sample is bounded by ``params``."""
    sample = labelled_sample(docs, labels, label, params.sample_per_label)

    def features(batches):
        for batch in batches:
            packed = []
            for text in texts_of(batch.column("text")):
                counts = term_counts(text)
                at = np.flatnonzero(counts).astype(np.uint32)
                packed.append(at.tobytes() + counts[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int32()), pa.array(packed, pa.binary())], ["label", "terms"])

    rows = map_rows(sample, features, "label int, terms binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["terms"])))
    sparse = []
    seen = np.zeros(WIDTH, np.int64)
    for r in rows:
        half = len(r["terms"]) // 2
        at, value = np.frombuffer(r["terms"], np.uint32, half // 4), np.frombuffer(r["terms"], np.float32, offset=half)
        sparse.append((at, value))
        seen[at] += 1
    terms = np.sort(np.lexsort((np.arange(WIDTH), -seen))[: params.terms])
    terms = terms[seen[terms] > 0]
    column = np.full(WIDTH, -1, np.int64)
    column[terms] = np.arange(len(terms))
    counts = np.zeros((len(rows), len(terms)), np.float32)
    for i, (at, value) in enumerate(sparse):
        use = column[at] >= 0
        counts[i, column[at[use]]] = value[use]
    weight = (np.log((1 + len(rows)) / (1 + seen[terms])) + 0.1).astype(np.float32)
    weight[(terms >= TRIGRAMS) & (terms < TRIGRAMS + WORD_BUCKETS)] *= params.word_weight
    labelled = np.array([float(r["label"] > 0) for r in rows], np.float32)
    prior = float(labelled.mean()) if len(rows) else 0.5
    if not len(rows) or not len(terms):
        empty = np.zeros((0, 1), np.float32)
        return QualityModel(terms, weight, np.zeros((len(terms), 1), np.float32), empty, labelled[:0], prior, params)
    weighted = np.log1p(counts) * weight
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    projection = truncated_svd(weighted / np.where(norms > 0, norms, 1), params.dimensions)
    return QualityModel(terms, weight, projection, latent(counts, weight, projection), labelled, prior, params)


def vote(rows: np.ndarray, model: QualityModel) -> np.ndarray:
    """Similarity-weighted label vote of the nearest labelled vectors, for one block of latent rows."""
    if not len(model.labels):
        return np.full(len(rows), model.prior)
    cosines = rows @ model.vectors.T
    count = cosines.shape[1]
    k = min(model.params.neighbours, count)
    least = np.partition(cosines, count - k, axis=1)[:, count - k : count - k + 1]
    above, tied = cosines > least, cosines == least
    room = k - above.sum(axis=1, keepdims=True)
    near = above | (tied & (np.cumsum(tied, axis=1) <= room))
    weight = np.where(near, np.clip(cosines, 0, None), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    share = weight @ model.labels / np.where(total > 0, total, 1)
    return np.where(total > 0, share, model.prior)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score (0 to 1) and whether it is 0.5 at least, under the names ``into``, to the columns ``keep`` (default: doc_id)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.select(*keep).schema]
    clash = set(into) & {f.name for f in fields}
    if clash:
        raise ValueError(f"columns to keep clash with the results: {sorted(clash)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{into[0]}` double, `{into[1]}` int"
    has_text = "text" in keep

    def predict(batches):
        m = shared.value
        for whole in batches:
            for batch in [whole.slice(i, m.params.block) for i in range(0, whole.num_rows, m.params.block)]:
                counts = np.zeros((batch.num_rows, len(m.terms)), np.float32)
                for i, text in enumerate(texts_of(batch.column("text"))):
                    counts[i] = term_counts(text)[m.terms]
                score = np.clip(vote(latent(counts, m.weight, m.projection), m), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    [*keep, *into],
                )

    return map_rows(docs.select(*keep, *([] if has_text else ["text"])), predict, schema)
