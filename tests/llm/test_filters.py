import base64
import math
import random
import re
import string

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from lamina.llm import compression_bands as cb
from tests.llm.helpers import clashing, corpus, edited, empty, prose, table


def brute_repeats(words, width=5):
    places: dict = {}
    for i in range(len(words) - width + 1):
        places.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(width)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(1, 6))
def test_repeated_windows(words, width):
    assert cb.repeated_window_words(words, width) == brute_repeats(words, width)


def test_renumbering_is_exact():
    rng = np.random.default_rng(0)
    words = [str(x).encode() for x in rng.integers(0, 200_000, 60_000)] * 2
    assert cb.repeated_window_words(words) == len(words)


def test_counts_match_brute_force(spark):
    got = {}
    for r in cb.compression_bands(table(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in corpus():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), brute_repeats(words), len(text.encode()))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_bytes) for r in got[doc_id]]
        if text:
            ratio = len(zstandard.ZstdCompressor(level=3).compress(text.encode())) / len(text.encode())
            assert any(r.ratio == ratio for r in got[doc_id])


def test_bands(spark):
    c = zstandard.ZstdCompressor(level=3)
    kept = lambda t: cb.judge(t, c, cb.BANDS, 4096, 0.34)[2]
    assert not kept(b"the same words again " * 400)
    assert not kept(np.random.default_rng(3).bytes(20_000))
    good = prose(random.Random(4), 3000).encode()
    assert kept(good)
    # Half noise, half repetition: the whole ratio is ordinary, the chunks aren't.
    mixed = np.random.default_rng(5).bytes(20_000) + b"ab" * 20_000
    ratio, share, verdict = cb.judge(mixed, c, cb.BANDS, 4096, 0.34)
    assert 0.2 <= ratio <= 0.8 and share == 1.0 and not verdict


@pytest.mark.parametrize("size", (512, 600, 639, 640, 800, 1023, 1024, 1500, 2047, 2048, 4095, 4096, 6000, 8191, 16383, 16384, 30_000, 60_000))
def test_incompressible_text_is_rejected(size):
    rng, c = np.random.default_rng(size), zstandard.ZstdCompressor(level=3)
    letters = np.frombuffer((string.ascii_letters + string.digits).encode(), dtype=np.uint8)
    kept = lambda t: cb.judge(t, c, cb.BANDS, cb.CHUNK_BYTES, cb.MAX_BAD_CHUNKS)[2]
    for _ in range(20):
        assert not kept(base64.b64encode(rng.bytes(size))[:size])
        assert not kept(base64.encodebytes(rng.bytes(size))[:size])
        assert not kept(rng.choice(letters, size).tobytes())
        assert not kept(rng.integers(32, 127, size, dtype=np.uint8).tobytes())
        ideographs = "".join(map(chr, rng.integers(0x4E00, 0x9FA6, size // 3))).encode()
        assert len(ideographs) < 512 or not kept(ideographs)
    # A text of which most chunks are noise, while the whole ratio is ordinary.
    assert size < 16384 or not kept(rng.integers(32, 127, size, dtype=np.uint8).tobytes() + b"the same words again " * (size // 42))


@pytest.mark.parametrize("size", (512, 640, 1024, 2048, 4096, 16384))
def test_prose_stays(size):
    import random

    from tests.llm.helpers import prose

    c = zstandard.ZstdCompressor(level=3)
    for seed in range(20):
        assert cb.judge(prose(random.Random(seed), size // 2).encode()[:size], c, cb.BANDS, cb.CHUNK_BYTES, cb.MAX_BAD_CHUNKS)[2]


def test_edges(spark):
    assert cb.compression_bands(empty(spark)).count() == 0 and cb.keep_documents(empty(spark)).count() == 0
    rows = {r.n_words: r for r in cb.compression_bands(table(spark)).collect() if r.n_bytes == 0}
    assert rows[0].ratio is None and rows[0].in_band
    kept = cb.keep_documents(clashing(table(spark)))
    judged = cb.compression_bands(clashing(table(spark))).where(~cb.base_failed() & cb.F.col("in_band"))
    assert kept.count() == judged.count() > 20 and kept.columns == clashing(table(spark)).columns


def middle(values, weights):
    """The least value up to which half of the weight lies."""
    pairs, upto = sorted(zip(values, weights)), 0.0
    for v, w in pairs:
        upto += w
        if upto >= sum(weights) / 2:
            return v


def brute_verdicts(texts, chunk=cb.CHUNK_BYTES, least=cb.MIN_FIT):
    """Verdicts by plain loops: every text's ratio, the limits of all, then each text against them."""
    c = zstandard.ZstdCompressor(level=3)
    shrunk = lambda b: len(c.compress(b)) / len(b)
    pieces = lambda b: [b[k * chunk : (k + 1) * chunk if k + 1 < len(b) // chunk else len(b)] for k in range(len(b) // chunk)] if len(b) >= 2 * chunk else []
    base = lambda b: len(b.split()) < 10 or 100 * brute_repeats(b.split()) > 20 * len(b.split())
    held: dict = {}
    for b in texts:
        if not base(b) and len(b) >= 64:
            for kind, part in [(0, b), *[(1, x) for x in pieces(b)]]:
                cell = math.floor(32 * math.log2(len(part)))
                held.setdefault((kind, cb.script(b)), {}).setdefault(cell // 16, {}).setdefault(cell, []).append((math.floor(shrunk(part) * 1024) + 0.5) / 1024)
    limits = {}
    for key, bands in held.items():
        bands = {k: v for k, v in bands.items() if sum(map(len, v.values())) >= least}
        weights = {k: {cell: min(1.0, float(np.median([len(x) for x in v.values()])) / len(rs)) for cell, rs in v.items()} for k, v in bands.items()}
        flat = {k: [(cell, r, weights[k][cell]) for cell, rs in v.items() for r in rs] for k, v in bands.items()}
        at = sorted(flat)
        mid = [middle([r for _, r, _ in flat[k]], [w for *_, w in flat[k]]) for k in at]
        off = [1.4826 * middle([abs(r - np.interp((cell + 0.5) / 16, [x + 0.5 for x in at], mid)) for cell, r, _ in flat[k]], [w for *_, w in flat[k]]) for k in at]
        limits[key] = at, mid, [max(x, cb.LEAST_SPREAD) for x in off]

    def stays(kind, of, part):
        r, (low, high) = shrunk(part), cb.band(len(part), cb.BANDS)
        at, mid, off = limits.get((kind, of), ([], [], []))
        if len(part) >= 64 and math.floor(2 * math.log2(len(part))) in at:
            m, s = [np.interp(2 * math.log2(len(part)), [x + 0.5 for x in at], v) for v in (mid, off)]
            low, high = max(low, m - 3 * s), min(high, m + 6 * s)
        return low <= r <= high

    out = []
    for b in texts:
        bad = [not stays(1, cb.script(b), x) for x in pieces(b)]
        out.append(not b or (stays(0, cb.script(b), b) and sum(bad) <= 0.34 * len(bad)))
    return out


def planted(seed=9, n=900):
    """(text, junk): prose of all lengths, a third of it copies of one text, with repetitive and random ones among it."""
    rng = random.Random(seed)
    out = [(prose(rng, rng.choice([40, 80, 150, 300, 600, 900])), False) for _ in range(n)]
    out += [(out[3][0], False)] * (n // 3) + [(edited(rng, out[4][0], 1), False) for _ in range(n // 6)]
    for _ in range(20):
        out.append((" ".join(w + "***" for w in prose(rng, 300).split()), True))
        out.append((" | ".join(prose(rng, 300).split()), True))
        out.append((base64.b64encode(rng.randbytes(1500)).decode() + " " + prose(rng, 60), True))
    return out


def test_verdict_brute(spark):
    texts = [t for t, _ in planted()] + ["", "漢字 " * 40, "x"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.in_band for r in cb.compression_bands(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_verdicts([t.encode() for t in texts])


def test_planted_junk_goes_and_prose_stays(spark):
    """The limits of the corpus catch what the absolute ones let pass; a group of a third of all rows shifts nothing."""
    docs = planted()
    rows = [(i, t, None, None, None) for i, (t, _) in enumerate(docs)]
    got = {r.doc_id: r for r in cb.compression_bands(table(spark, rows)).where(~cb.base_failed()).collect()}
    junk = [r.in_band for i, r in got.items() if docs[i][1]]
    clean = [r.in_band for i, r in got.items() if not docs[i][1]]
    assert np.mean(junk) < 0.1 and np.mean(clean) > 0.98 and len(junk) > 40


def test_bands_reject_labelled_junk(spark):
    """On the given table: beyond the base rule a good part of what is labelled bad, hardly any of the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left")
    got = cb.compression_bands(docs).where(~cb.base_failed()).join(docs.select("doc_id", "quality"), "doc_id").toPandas()
    assert got[got.quality == 0].in_band.mean() < 0.5 and got[got.quality == 1].in_band.mean() > 0.98
