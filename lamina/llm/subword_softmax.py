"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character 3- to 5-grams (with its
edges) and of itself; a text is the mean of its words, repeats of a word damped
(n times it weigh as the root of n), and of ``NEUTRAL`` words without meaning; a linear softmax on the
text's vector gives the classes.  Vectors and softmax are trained jointly in
numpy with Adagrad, so an unseen misspelling takes most of its vector from
n-grams it shares.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label, and
``TRAIN_BYTES`` of text) in one task.  With two classes a bucket adds its
vector times the difference of the class weights to the log odds, so scoring
needs one number for each bucket: 2^``BITS`` floats are broadcast.

Texts of any length are scored alike: one above ``BLOCK_CHARS`` characters is
read in pieces that end between words, its words are counted over all pieces,
and only then damped; a word longer than a piece is hashed in overlapping slices.

Edge cases: null texts and texts without letters or digits have the bias alone;
without usable labels every score is 0.5, with one class only that of log odds
of 4 for it (0.982 for label 1, 0.018 for label 0).  Only the id, the text and
the labels' target are read, so other columns may have any name.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .common import segment_sums
from .labelled import bounded, labelled_sample

BITS, DIM = 18, 10
GRAMS = (3, 4, 5)
SAMPLE = {0: 10000, 1: 2500}
TRAIN_BYTES = 48 << 20
#: Passes over the sample: so many that about STEPS_TEXTS texts are seen, within bounds.
EPOCHS, STEPS_TEXTS = (8, 30), 100_000
BATCH, RATE, START = 32, 1.0, 1e-4
#: A subword is used if so many training texts hold it (fewer where there are few texts).
MIN_TEXTS = 5
#: Words without meaning that every text is taken to hold, so a few words make no certainty.
NEUTRAL = 100.0
#: Characters that are worked on at a time (about 100 bytes of arrays each).
BLOCK_CHARS = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def grams(lower: list[str], bits: int = BITS):
    """(bucket, word) of every subword, and (doc, hash) of each word, of texts in lower case.

    Words are runs of letters and digits.
    """
    joined = "\0" + "\0".join(lower) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    inside = _is_letter()[points]
    kept = inside.copy()
    kept[:-1] |= inside[1:]  # of the other characters, one on each side of a word stays
    kept[1:] |= inside[:-1]
    at = np.flatnonzero(kept)
    code = np.where(inside[at], points[at], 0).astype(np.uint64)
    # Two neighbours of different words may both stay: an edge after an edge goes.
    if len(code):
        double = np.zeros(len(code), dtype=bool)
        double[1:] = (code[1:] == 0) & (code[:-1] == 0)
        at, code = at[~double], code[~double]
    edge = code == 0
    word_of = np.cumsum(edge) - 1
    n_words = int(edge.sum()) - 1
    if n_words < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buckets, words = [], []
    for n in GRAMS:
        m = len(code) - n + 1
        if m < 1:
            continue
        ok = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            ok &= ~edge[j : m + j]
        buckets.append(_gram_hashes(code, n)[ok])
        words.append(word_of[:m][ok])
    starts = np.flatnonzero(edge)[:-1]
    place = np.arange(len(code)) - np.repeat(np.append(starts, len(code) - 1), np.diff(np.append(np.append(starts, len(code) - 1), len(code))))
    powers = np.cumprod(np.full(int(place.max()) + 1, _K))
    letters = _mix(code + np.uint64(7)) * powers[place]
    letters[-1] = 0  # the edge after the last word begins no word
    whole = _mix(np.add.reduceat(letters, starts))
    buckets.append(whole)
    words.append(np.arange(n_words))
    # A word begins after its edge; the edge may be the last text's separator.
    return _bucket(np.concatenate(buckets), bits), np.concatenate(words), np.searchsorted(ends, at[starts + 1], side="right"), whole


def _gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` codes."""
    m = len(code) - n + 1
    h = code[:m] + np.uint64(n)
    for j in range(1, n):
        h = h * _K + code[j : m + j]
    return _mix(h)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def subwords(texts: list[str], bits: int = BITS):
    """(bucket, weight, word) of every subword, and (doc, share) of each word.

    A word's weights sum to its share: n times the same word in a text weigh as
    much as the root of n words.
    """
    bucket, word, doc, whole = grams([t.lower() for t in texts], bits)
    if not len(whole):
        return bucket, np.zeros(0), word, doc, np.zeros(0)
    _, same, times = np.unique(whole + doc.astype(np.uint64) * _K, return_inverse=True, return_counts=True)
    share = 1.0 / np.sqrt(times[same])
    return bucket, share[word] / np.bincount(word, minlength=len(whole))[word], word, doc, share


def log_odds(texts: list[str], table: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Scores before the softmax: the mean over a text's words of their subwords' mean."""
    out, start = np.full(len(texts), bias), 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_CHARS):
            size += len(texts[stop])
            stop += 1
        if size > BLOCK_CHARS:  # one long text
            out[start] += _long_odds(texts[start].lower(), table, bits)
        else:
            bucket, weight, word, doc, share = subwords(texts[start:stop], bits)
            n = np.bincount(doc, share, stop - start)
            sums = np.bincount(doc[word], table[bucket] * weight, stop - start)
            out[start:stop] += sums / (NEUTRAL + n)
        start = stop
    return out


def _long_odds(lower: str, table: np.ndarray, bits: int) -> float:
    """The same for one text of any length: every distinct word's number and score, then the damped mean."""
    held: dict[int, list] = {}
    for start, stop in _pieces(lower):
        if stop - start > BLOCK_CHARS:
            sums: list[float] = []
            key, count = _long_word(lower, start, stop, bits, lambda b: sums.append(float(table[b].sum())))  # noqa: B023
            found = [(key, sum(sums) / count, 1)]
        else:
            bucket, word, _, whole = grams([lower[start:stop]], bits)
            if not len(whole):
                continue
            mean = np.bincount(word, table[bucket], len(whole)) / np.bincount(word, minlength=len(whole))
            kinds, first, times = np.unique(whole, return_index=True, return_counts=True)
            found = list(zip(kinds.tolist(), mean[first].tolist(), times.tolist()))
        for key, score, times in found:
            held.setdefault(key, [score, 0])[1] += times
    scores, times = np.array([v[0] for v in held.values()]), np.sqrt([v[1] for v in held.values()])
    return float(scores @ times) / (NEUTRAL + float(times.sum())) if held else 0.0


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text for training; a long one is taken in pieces, as it is scored."""
    if len(text) <= BLOCK_CHARS:
        bucket, weight, _, _, share = subwords([text], bits)
        total = share.sum()
    else:
        bucket, weight, total = _long_features(text.lower(), bits)
    kinds, inverse = np.unique(bucket, return_inverse=True)
    return kinds.astype(np.int32), (np.bincount(inverse, weight, len(kinds)) / (NEUTRAL + total)).astype(np.float32)


def _long_features(lower: str, bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket, weight, sum of all shares): of each distinct word its buckets once, weighed by the root of its number."""
    held: dict[int, list] = {}
    for start, stop in _pieces(lower):
        if stop - start > BLOCK_CHARS:
            table = np.zeros(1 << bits)
            key, count = _long_word(lower, start, stop, bits, lambda b: np.add.at(table, b, 1.0))  # noqa: B023
            kinds = np.flatnonzero(table)
            held.setdefault(key, [kinds.astype(np.int32), table[kinds] / count, 0])[2] += 1
            continue
        bucket, word, _, whole = grams([lower[start:stop]], bits)
        if not len(whole):
            continue
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(whole) + 1))
        kinds, first, times = np.unique(whole, return_index=True, return_counts=True)
        for key, k, n in zip(kinds.tolist(), first.tolist(), times.tolist()):
            if key not in held:
                own = bucket[order[ends[k] : ends[k + 1]]].astype(np.int32)
                held[key] = [own, np.full(len(own), 1.0 / len(own)), 0]
            held[key][2] += n
    if not held:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.concatenate([b for b, _, _ in held.values()]), np.concatenate([w * np.sqrt(n) for _, w, n in held.values()]), float(sum(np.sqrt(n) for _, _, n in held.values()))


def _long_word(lower: str, start: int, stop: int, bits: int, take) -> tuple[int, int]:
    """(hash, number of subwords) of a word, in slices, each slice's buckets being given to ``take``."""
    count, whole, power = 0, np.zeros(1, np.uint64), np.ones(1, np.uint64)
    most = max(GRAMS)
    size = stop - start + 2  # with its edges
    for low in range(0, size, BLOCK_CHARS):
        high = min(size, low + BLOCK_CHARS + most - 1)
        part = ("\0" * (low == 0)) + lower[start + max(0, low - 1) : start + min(stop - start, high - 1)] + ("\0" * (high == size))
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        for n in GRAMS:
            m = min(BLOCK_CHARS, len(code) - n + 1)  # runs that begin in this slice
            if m > 0:
                take(_bucket(_gram_hashes(code, n)[:m], bits))
                count += m
        own = code[: min(BLOCK_CHARS, size - 1 - low)]  # all but the last edge
        if len(own):
            powers = np.cumprod(np.append(power * _K, np.full(len(own) - 1, _K)))
            whole, power = whole + (_mix(own + np.uint64(7)) * powers).sum(dtype=np.uint64), powers[-1:]
    key = _mix(whole)
    take(_bucket(key, bits))
    return int(key[0]), count + 1


def _pieces(text: str):
    """(start, stop) of pieces that end between words: of ``BLOCK_CHARS`` characters at most, or one longer word."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + BLOCK_CHARS)
        cut = stop
        while start < cut < len(text) and text[cut].isalnum() and text[cut - 1].isalnum():
            cut -= 1
        if cut == start:  # the word goes on beyond the piece
            cut = stop
            while cut < len(text) and text[cut].isalnum():
                cut += 1
        yield start, cut
        start = cut


def train(samples: list[tuple[str, int]], bits: int = BITS, dim: int = DIM, epochs: int | None = None) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias) of the log odds, from (text, label)."""
    rng = np.random.default_rng(7)
    data = []
    for text, label in samples:
        data.append((*features(text, bits), label))
    # What too few texts hold says more about those texts than about the classes.
    held = np.zeros(1 << bits, np.int64)
    for kinds, _, _ in data:
        held[kinds] += 1
    known = held >= min(MIN_TEXTS, len(data) // 50)
    data = [(kinds[known[kinds]], value[known[kinds]], label) for kinds, value, label in data]
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << bits, dim)).astype(np.float32)
    classes, offsets = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    seen, seen_classes, seen_offsets = np.full(1 << bits, START), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(epochs or min(EPOCHS[1], max(EPOCHS[0], STEPS_TEXTS // len(data)))):
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH):
            rows = [data[i] for i in order[start : start + BATCH]]
            at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
            lengths = np.array([len(r[0]) for r in rows])
            doc = np.repeat(np.arange(len(rows)), lengths)
            mean = np.stack([segment_sums(vectors[at, k] * value, lengths) for k in range(dim)], axis=1)
            logits = mean @ classes + offsets
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), [r[2] for r in rows]] -= 1.0
            # With two classes the gradient of a text's vector is a number times (w1 - w0).
            slope = p[:, 1]
            kinds, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, value * slope[doc], len(kinds))
            apart = classes[:, 1] - classes[:, 0]
            seen[kinds] += g * g * float(apart @ apart) / dim
            step = (g / np.sqrt(seen[kinds]))[:, None] * apart[None, :]
            g_classes, g_offsets = mean.T @ p, p.sum(axis=0)
            vectors[kinds] -= (RATE * step).astype(np.float32)
            seen_classes += g_classes**2
            seen_offsets += g_offsets**2
            classes -= 0.1 * g_classes / np.sqrt(seen_classes)
            offsets -= 0.1 * g_offsets / np.sqrt(seen_offsets)
    return np.where(known, vectors.astype(np.float64) @ (classes[:, 1] - classes[:, 0]), 0.0), float(offsets[1] - offsets[0])


def fit(docs: DataFrame, labels: DataFrame, target: str, usable, sample=SAMPLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    chosen = labelled_sample(docs, labels, target, usable, sample, id_col, text_col)

    def run(batches):
        rows, priors = [], {}
        for batch in batches:
            for doc, text, label, prior in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                priors[label] = prior
                rows.append((xxhash.xxh3_64_intdigest(f"{doc} {text}".encode()), text, label))
        rows.sort()
        kept = [(text, label) for _, text, label in bounded(rows, TRAIN_BYTES)]
        if len({label for _, label in kept}) < 2:
            table, bias = np.zeros(1 << bits), 0.0 if not kept else (4.0 if kept[0][1] else -4.0)
        else:
            table, bias = train(kept, bits)
            shift = {c: np.log(max(priors[c], 1e-6) / n) for c, n in Counter(label for _, label in kept).items()}
            bias += shift[1] - shift[0]  # the sample's class shares are not the table's
        yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()], type=pa.binary()), pa.array([bias])], names=["table", "bias"])

    row = chosen.repartition(1).mapInArrow(run, "table binary, bias double").first()
    return (np.zeros(1 << bits, "<f4"), 0.0) if row is None else (np.frombuffer(row["table"], "<f4"), row["bias"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score): the probability of label 1."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        table, bias = shared.value
        table = table.astype(np.float64)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            z = np.clip(log_odds(texts, table, bias, bits), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-z)), type=pa.float64())], names=[id_col, "score"])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, score double")
