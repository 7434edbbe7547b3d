"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import fold, pieces, read, sample_ids

BITS = 20
MAX_TRAIN = 10_000  # labelled documents that the weights are fitted on, chosen by hash of their id
EPOCHS = 6
MIN_DOCS = 8  # training documents that a feature must occur in to be learned
THRESHOLD = 0.7
STEMS = (4, 5)  # lengths of word beginnings, which stand for words that training has not seen

_WORD = re.compile(r"[^\W_]+")


class Features:
    """Hashed features of texts: words, word beginnings, bigrams, and skip-grams over one word."""

    def __init__(self, bits: int = BITS, most: int = 200_000):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}
        self.hashes = np.empty((most, 1 + len(STEMS)), np.uint64)  # of the known words and their beginnings

    def _new(self, word: str) -> int:
        import xxhash

        k = len(self.known)
        if k == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        own = xxhash.xxh3_64_intdigest(word)
        self.hashes[k] = (own, *(xxhash.xxh3_64_intdigest(f"{word[:n]}*") if len(word) > n else own for n in STEMS))
        self.known[word] = k
        return k

    def of(self, texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs, each once, in order; only features that are wanted, where that is given."""
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > len(self.hashes) // 2:
            self.known.clear()
        get, new = self.known.get, self._new
        ids = np.array([k if (k := get(w)) is not None else new(w) for f in found for w in f], np.int64)
        if not len(ids):
            return ids, ids
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(f) for f in found])
        h = self.hashes[ids]
        out = []

        def add(doc: np.ndarray, feature: np.ndarray) -> None:
            if wanted is not None:
                kept = wanted[feature.view(np.int64)]
                doc, feature = doc[kept], feature[kept]
            out.append(doc << np.uint64(32) | feature)

        for k in range(h.shape[1]):
            add(doc, h[:, k] & self.mask)
        for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            pair = h[:-gap, 0] * np.uint64(odd) + (h[gap:, 0] ^ np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15)
            same = doc[:-gap] == doc[gap:]
            add(doc[:-gap][same], (pair >> np.uint64(40) & self.mask)[same])
        both = np.unique(np.concatenate(out))
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression: each coordinate has its own rate, and L1 keeps weights at 0."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def fit(texts: list[str | None], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the coordinates that L1 leaves; the last feature, 1 << bits, is the intercept."""
    features, model, docs = Features(bits), Ftrl(bits), []
    for at in range(0, len(texts), 200):
        doc, feature = features.of(texts[at : at + 200])
        cut = np.searchsorted(doc, np.arange(len(texts[at : at + 200]) + 1))
        docs += [np.append(feature[a:b], 1 << bits).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    seen = np.zeros((1 << bits) + 1, np.int64)
    for d in docs:
        seen[d] += 1
    for k, d in enumerate(docs):
        docs[k] = d[(seen[d] >= min_docs) | (d == 1 << bits)]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(docs)):
            model.learn(docs[k], labels[k])
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on at most max_train labelled documents; empty where there is no label.

    The documents are those whose hashed ids are smallest. Null labels are left out; of several labels of
    an id, the largest counts; of several rows of an id, each is learned from. One task fits the weights.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    chosen = sample_ids(chosen, key, max_train)
    # at most max_train pairs of integers
    rows = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(chosen), key).orderBy(F.xxhash64(key), key, "_t").limit(2 * max_train).select("_t", "_y").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column("_t").to_pylist()
            ys += b.column("_y").to_pylist()
        at, w = fit(texts, [1.0 if y > 0 else 0.0 for y in ys])
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "w": pa.array([w.astype("<f8").tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "at binary, w binary").collect()
    at = np.concatenate([np.frombuffer(r["at"], "<i4") for r in found]) if found else np.empty(0, np.int32)
    return at, np.concatenate([np.frombuffer(r["w"], "<f8") for r in found]) if found else np.empty(0)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null and empty texts get the intercept's score.

    The weights, at most 2**bits + 1 numbers, are broadcast. A column of the score's name is replaced.
    """
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[weights[0]] = weights[1]
    sent = docs.sparkSession.sparkContext.broadcast(dense)
    docs = docs.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, features = sent.value, Features(bits)
        wanted = w != 0
        for b in pieces(batches, text, 1 << 20):
            doc, feature = features.of(b.column(text).to_pylist(), wanted)
            sums = np.bincount(doc, w[feature], b.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def training_rows(key: str = "doc_id") -> Column:
    return fold(key, 3) != 1


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = train(docs.where(training_rows()), labels.where(training_rows()))
    found = score(docs.select("doc_id", "text"), weights)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
