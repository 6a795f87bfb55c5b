"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

A text's features are hashes of its words, word pairs, the words' shapes (case,
digits and signs, letters collapsed) and shape pairs, and of what repeats: a
word after itself, a pair seen before in the text.  Each kind's occurrences are
averaged, so a score is a sparse dot product that needs no counting.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label at
most, and ``TRAIN_BYTES`` of text) in one task; scoring is a narrow map with the
weights broadcast (2^``BITS`` doubles, a fixed size).

Edge cases: null and empty texts have the bias as their only feature; without
usable labels every score is 0.5; with one class only every score is that of
log odds of 4 for it (0.982 for label 1, 0.018 for label 0).  Labels of ids that
no document has train nothing.  Only the id, the text and the labels' target are
read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .common import byte_texts, text_blocks
from .labelled import bounded, labelled_sample

BITS = 18
SAMPLE = {0: 4000, 1: 8000}
TRAIN_BYTES = 128 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.02, 0.5
CACHED_WORDS, CACHED_BYTES = 500_000, 64

_K = np.uint64(0x9E3779B97F4A7C15)
_SHAPES = ((re.compile(r"[a-zà-öø-ÿœ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-ÞŒ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1+"))


def shape(word: str) -> str:
    """The word with runs of letters, digits and equal signs collapsed, whole."""
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return word


class Features:
    """Hashed features of texts; (word hash, shape hash) are remembered."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            digest = xxhash.xxh3_64_intdigest
            new = {w for w in words if w not in known}
            for w in new:
                known[w] = (digest(w.lower()), digest(shape(w.decode("utf-8", "replace")).encode(), 1))
            out = np.array([known[w] for w in words], dtype=np.uint64)
            for w in new:
                if len(w) > CACHED_BYTES:
                    del known[w]
            return out

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values), occurrences not merged."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        h = self._hashes(words)
        word, form = h[:, 0], h[:, 1]
        pair = word[:-1] * _K + word[1:]
        kinds = [(word, 1), (form, 2)]
        if len(pair):
            _, first = np.unique(pair, return_index=True)
            again = np.ones(len(pair), dtype=np.uint64)
            again[first] = 0
            kinds += [(pair, 3), (form[:-1] * _K + form[1:], 4), (again, 5), ((word[:-1] == word[1:]).astype(np.uint64), 6)]
        at, value = [], []
        for codes, kind in kinds:
            x = (codes + np.uint64(kind)) * _K
            at.append((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40) & self.mask)
            value.append(np.full(len(codes), 1.0 / len(codes)))
        return np.concatenate(at).astype(np.int64), np.concatenate(value)


def train(samples: list[tuple[bytes, int, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all features and, last, the bias, from (text, label, weight)."""
    features = Features(bits)
    size = 1 << bits
    data = []
    for text, label, weight in samples:
        at, value = features(text)
        kinds, inverse = np.unique(at, return_inverse=True)
        data.append((np.append(kinds, size), np.append(np.bincount(inverse, value, len(kinds)), 1.0), label, weight))
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for at, value, label, weight in data:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1 * (at < size), 0.0, -(zi - np.sign(zi) * L1 * (at < size)) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * (at < size)))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ value, -30, 30)))
            g = weight * (p - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - step * wi
            n[at] += g * g
    regular = L1 * (np.arange(size + 1) < size)
    w = np.where(np.abs(z) <= regular, 0.0, -(z - np.sign(z) * regular) / ((BETA + np.sqrt(n)) / ALPHA + L2 * (np.arange(size + 1) < size)))
    return w


def fit(docs: DataFrame, labels: DataFrame, target: str, usable, sample=SAMPLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights trained in one task on the bounded sample, rows in the order of a hash of their ids."""
    chosen = labelled_sample(docs, labels, target, usable, sample, id_col, text_col)

    def run(batches):
        rows, priors = [], {}
        for batch in batches:
            for doc, text, label, prior in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                priors[label] = prior
                rows.append((xxhash.xxh3_64_intdigest(repr(doc).encode() + text), text, label))
        rows.sort()
        rows = bounded(rows, TRAIN_BYTES)
        seen = Counter(label for _, _, label in rows)
        weight = {c: priors[c] * len(rows) / n for c, n in seen.items()}
        kept = [(text, label, weight[label]) for _, text, label in rows]
        if len({label for _, label, _ in kept}) < 2:  # one class or none: a fixed score
            w = np.zeros((1 << bits) + 1)
            w[-1] = 0.0 if not kept else (4.0 if kept[0][1] else -4.0)
        else:
            w = train(kept, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], type=pa.binary())], names=["weights"])

    row = chosen.repartition(1).mapInArrow(run, "weights binary").first()
    return np.zeros((1 << bits) + 1) if row is None else np.frombuffer(row["weights"], "<f8")


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score): the probability of label 1."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        w, features = shared.value, Features(bits)
        for batch in batches:
            for block in text_blocks(batch):
                scores = []
                for text in byte_texts(block.column(1)):
                    at, value = features(text)
                    scores.append(1.0 / (1.0 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30))))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(scores, type=pa.float64())], names=[id_col, "score"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, score double")
