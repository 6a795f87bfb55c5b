"""Quality rules: zstandard compression bands.

The ratio (compressed / raw UTF-8 bytes) of a text depends on its length, so
limits are length-specific.  A document is rejected when its whole ratio leaves
the band of its length (too low: repetitive; too high: incompressible), or when
more than ``max_bad_chunks`` of its fixed chunks leave theirs, which the whole
ratio would average away.

The limits are the narrower of two:

* ``BANDS``, absolute ones: what no text should pass;
* those of the corpus: around the median ratio of the texts of like length and
  like script (bytes a code point), ``LOW`` robust deviations down and ``HIGH``
  up.  They come from a histogram of *all* documents past the base rule, by
  ``CELLS`` length cells to the octave; no cell weighs more than the typical one
  of its band, so a large group of copies can't shift a limit.  Bands with fewer
  than ``MIN_FIT`` texts have absolute limits only.

Edge cases: null and empty texts have a null ratio, no words and pass the
bands (the base rule rejects them for length); rows with equal ids are judged
one by one; an empty table gives an empty result; other columns of the input
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .common import byte_texts, materialize, text_blocks

#: (bytes from, lowest ratio kept, highest ratio kept); the frame header alone
#: makes ratios above 1 normal for very short texts.  From 512 bytes on the upper
#: limits lie just below what base64, random letters and digits, printable noise
#: and random ideographs come to, which is above prose of all scripts.
BANDS = ((0, 0.0, 9.0), (128, 0.22, 1.25), (512, 0.25, 0.79), (640, 0.25, 0.76), (1024, 0.25, 0.74), (2048, 0.25, 0.72), (4096, 0.22, 0.715), (16384, 0.20, 0.71))
CHUNK_BYTES = 1024
MAX_BAD_CHUNKS = 0.34
LEVEL = 3
WINDOW = 5
#: Robust deviations (1.4826 x the median absolute one) that the corpus' limits lie below and above the median.
LOW, HIGH = 3.0, 6.0
LEAST_SPREAD = 0.006
#: Corpus bands to the octave of length, cells to the octave, bins to the unit of ratio, and texts that make a band.
PER_OCTAVE, CELLS, BINS, MIN_FIT = 2, 32, 1024, 64
#: Shorter texts are mostly frame header; ratios of this size and more are one bin.
LEAST_BYTES, MOST_RATIO = 64, 2.0
#: Bytes a code point that part the scripts.
SCRIPTS = (1.2, 1.7, 2.5)

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double"
SCHEMA = f"{COUNTS}, bad_chunks double, in_band boolean"
MEASURED = f"{COUNTS}, script int, chunk_ratios array<double>"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POINT = (np.arange(256) & 0xC0) != 0x80
#: Bytes that begin a code point of a word.
_WORD_POINT = ~_SPACE & _POINT
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur at least twice, by exact comparison."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    code, distinct = ids[:n], len(numbers)
    for k in range(1, width):
        if distinct * len(numbers) >= 1 << 62:  # renumber before the code would overflow
            kinds, code = np.unique(code, return_inverse=True)
            distinct = len(kinds)
        code = code * len(numbers) + ids[k : n + k]
        distinct *= len(numbers)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[width : n + width] -= twice
    return int((np.cumsum(edges) > 0).sum())


def band(n_bytes: int, bands) -> tuple[float, float]:
    low, high = bands[0][1:]
    for start, lo, hi in bands:
        if n_bytes >= start:
            low, high = lo, hi
    return low, high


def script(text: bytes) -> int:
    """The class of a text by its bytes a code point: 0 (mostly ASCII) to 3."""
    points = int(np.count_nonzero(_POINT[np.frombuffer(text, dtype=np.uint8)]))
    return int(np.searchsorted(SCRIPTS, len(text) / max(1, points), side="right"))


def ratios(text: bytes, compressor, chunk_bytes: int) -> tuple[float | None, list[float]]:
    """The whole ratio (null for an empty text) and those of the fixed chunks; the last one takes the remainder.

    A text of fewer than two chunks has none.
    """
    n = len(text)
    if not n:
        return None, []
    chunks = n // chunk_bytes
    out = []
    for k in range(chunks if chunks > 1 else 0):
        part = text[k * chunk_bytes : (k + 1) * chunk_bytes if k + 1 < chunks else n]
        out.append(len(compressor.compress(part)) / len(part))
    return len(compressor.compress(text)) / n, out


class Limits:
    """Limits by length: absolute bands, narrowed by the corpus' own where it has enough texts."""

    def __init__(self, bands=BANDS, histogram=(), low: float = LOW, high: float = HIGH, min_fit: int = MIN_FIT):
        """``histogram``: (kind, script, cell, bin, n) rows; kind 0 are whole texts, 1 chunks."""
        self.bands, self.low, self.high, self.fitted = bands, low, high, {}
        rows = np.array([tuple(r) for r in histogram], dtype=np.int64).reshape(-1, 5)
        for kind, of in {(int(k), int(s)) for k, s in rows[:, :2]}:
            own = rows[(rows[:, 0] == kind) & (rows[:, 1] == of)]
            found = self._fit(own[:, 2], (own[:, 3] + 0.5) / BINS, own[:, 4], min_fit)
            if found:
                self.fitted[kind, of] = found

    @staticmethod
    def _fit(cell: np.ndarray, ratio: np.ndarray, n: np.ndarray, min_fit: int):
        """(centres, medians, spreads) of the bands with enough texts, by position on the octave scale."""
        place = cell * PER_OCTAVE // CELLS
        weight = np.zeros(len(cell))
        for b in np.unique(place):
            own = place == b
            _, at = np.unique(cell[own], return_inverse=True)
            held = np.bincount(at, n[own])
            weight[own] = n[own] * np.minimum(1.0, np.median(held) / held)[at]
        good = [int(b) for b in np.unique(place) if n[place == b].sum() >= min_fit]
        if not good:
            return None
        centres = np.array(good) + 0.5
        medians = np.array([weighted_median(ratio[place == b], weight[place == b]) for b in good])
        off = np.abs(ratio - np.interp((cell + 0.5) * PER_OCTAVE / CELLS, centres, medians))
        spreads = np.array([1.4826 * weighted_median(off[place == b], weight[place == b]) for b in good])
        return centres, medians, np.maximum(spreads, LEAST_SPREAD), frozenset(good)

    def of(self, kind: int, of: int, n_bytes: int) -> tuple[float, float]:
        """(lowest, highest) ratio that stays."""
        low, high = band(n_bytes, self.bands)
        found = self.fitted.get((kind, of))
        if found and n_bytes >= LEAST_BYTES:
            centres, medians, spreads, good = found
            at = PER_OCTAVE * math.log2(n_bytes)
            if int(at) in good:
                middle, spread = float(np.interp(at, centres, medians)), float(np.interp(at, centres, spreads))
                low, high = max(low, middle - self.low * spread), min(high, middle + self.high * spread)
        return low, high

    def verdict(self, n_bytes: int, of: int, ratio: float | None, chunk_ratios: list[float], chunk_bytes: int, max_bad_chunks: float) -> tuple[float, bool]:
        """(share of chunks out of band, whether the text stays)."""
        if ratio is None:
            return 0.0, True
        low, high = self.of(0, of, n_bytes)
        if not chunk_ratios:
            return 0.0, low <= ratio <= high
        lo, hi = self.of(1, of, chunk_bytes)
        bad = sum(not lo <= r <= hi for r in chunk_ratios[:-1])
        lo, hi = self.of(1, of, n_bytes - chunk_bytes * (len(chunk_ratios) - 1))
        share = (bad + (not lo <= chunk_ratios[-1] <= hi)) / len(chunk_ratios)
        return share, low <= ratio <= high and share <= max_bad_chunks


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def judge(text: bytes, compressor, bands, chunk_bytes: int, max_bad_chunks: float):
    """(ratio, share of chunks out of band, verdict) of one text; ``bands``: absolute ones, or ``Limits``."""
    limits = bands if isinstance(bands, Limits) else Limits(bands)
    ratio, parts = ratios(text, compressor, chunk_bytes)
    return ratio, *limits.verdict(len(text), script(text), ratio, parts, chunk_bytes, max_bad_chunks)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """(id, ``MEASURED``): surface counts, ratios and script of every document.

    A narrow map over Arrow batches: no shuffle, memory bounded by a block of texts.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = chosen.schema[0].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio", "script", "chunk_ratios"]

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for block in text_blocks(batch):
                rows = []
                for text in byte_texts(block.column(1)):
                    words = text.split()
                    raw = np.frombuffer(text, dtype=np.uint8)
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    ratio, parts = ratios(text, compressor, chunk_bytes)
                    surface = int(np.count_nonzero(_WORD_POINT[raw])), int(np.count_nonzero(_SYMBOL[raw])), len(lines) - len(set(lines))
                    rows.append((len(words), *surface, repeated_window_words(words), len(text), ratio, script(text), parts))
                kinds = [pa.int64()] * 6 + [pa.float64(), pa.int32(), pa.list_(pa.float64())]
                columns = [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=[id_col, *names])

    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, {MEASURED}")


def fit(measured: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, **options) -> Limits:
    """The limits of a measured corpus, from all its documents past the base rule.

    The histogram is aggregated before its shuffle and has at most one row for
    each (kind, script, length cell, ratio bin), whatever the corpus' size.
    """
    one = lambda kind, n, ratio: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), ratio.alias("ratio"))
    last = F.size("chunk_ratios") - 1
    size = lambda i: F.when(i < last, F.lit(chunk_bytes)).otherwise(F.col("n_bytes") - last * chunk_bytes)
    items = F.concat(F.array(one(0, F.col("n_bytes"), F.col("ratio"))), F.transform("chunk_ratios", lambda r, i: one(1, size(i), r)))
    rows = measured.where(~base_failed() & (F.col("n_bytes") >= LEAST_BYTES)).select("script", F.explode(items).alias("x")).where(f"x.n >= {LEAST_BYTES}")
    cell = F.floor(F.log2("x.n") * CELLS).cast("int").alias("cell")
    place = F.floor(F.least("x.ratio", F.lit(MOST_RATIO)) * BINS).cast("int").alias("bin")
    histogram = rows.select("x.kind", "script", cell, place).groupBy("kind", "script", "cell", "bin").count()
    return Limits(bands, histogram.collect(), **options)


def compression_bands(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_chunks: float = MAX_BAD_CHUNKS, level: int = LEVEL, **options
) -> DataFrame:
    """One row per document: id, surface counts, whole ratio, chunk share and ``in_band``.

    Texts are read once; their measures are written, and judged when the limits
    are known.  ``options`` (low, high, min_fit) go to :class:`Limits`.
    """
    rows = materialize(measure(docs, id_col, text_col, chunk_bytes, level), "measured")
    limits = fit(rows, bands, chunk_bytes, **options)
    kept = [id_col, *[c.split()[0] for c in COUNTS.split(", ")]]

    def run(batches):
        for batch in batches:
            facts = zip(*[batch.column(c).to_pylist() for c in ("n_bytes", "script", "ratio", "chunk_ratios")])
            found = [limits.verdict(*f, chunk_bytes, max_bad_chunks) for f in facts]
            added = [pa.array([f[0] for f in found], type=pa.float64()), pa.array([f[1] for f in found], type=pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], names=[*kept, "bad_chunks", "in_band"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def base_failed() -> F.Column:
    """The base rule on the counts: too short, or too many words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def keep_documents(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_chunks: float = MAX_BAD_CHUNKS, level: int = LEVEL, **options) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the bands, all columns kept.

    A first pass over the texts gives the limits; the verdict is then computed
    beside the row in a map, so documents are never joined back to their verdicts.
    """
    texts = docs.select(F.lit(0).alias("of"), F.col(text_col).alias("text"))
    limits = fit(measure(texts, "of", "text", chunk_bytes, level), bands, chunk_bytes, **options)
    at = docs.columns.index(text_col)

    def keep(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for block in text_blocks(batch, at):
                flags = []
                for text in byte_texts(block.column(at)):
                    words = text.split()
                    failed = len(words) < 10 or 100 * repeated_window_words(words) > 20 * len(words)
                    flags.append(not failed and judge(text, compressor, limits, chunk_bytes, max_bad_chunks)[2])
                yield block.filter(pa.array(flags, type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
