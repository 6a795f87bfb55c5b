"""Held-out accuracy on the given labels, and edge cases."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import ftrl, queries, subword_softmax as sub
from lamina.llm.labelled import bounded
from tests.llm.helpers import clashing, empty, prose, table

SF = "/root/testdata/sf0.1"


def held_out(spark, name: str, target: str):
    rows = queries.queries()[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(target).alias("label"))
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.count() == total
    return rows.join(labels, "doc_id").where("held_out").select("label", "score", "predicted").toPandas()


def auc(label, score) -> float:
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality(spark):
    f = held_out(spark, "op8_ftrl_quality", "quality")
    assert auc(f.label.to_numpy(), f.score.to_numpy()) > 0.99 and (f.label == f.predicted).mean() > 0.97


def test_toxicity(spark):
    f = held_out(spark, "op9_subword_toxicity", "toxic")
    assert auc(f.label.to_numpy(), f.score.to_numpy()) > 0.93 and (f.label == f.predicted).mean() > 0.95


def test_unseen_misspelling_shares_ngrams():
    rng = random.Random(1)
    clean = [prose(rng, 40) for _ in range(150)]
    toxic = [" ".join(t.split(" ")[:20] + [rng.choice(["worthless", "disgusting", "pathetic"])] * 2 + t.split(" ")[20:]) for t in (prose(rng, 40) for _ in range(150))]
    table_, bias = sub.train([(t, 0) for t in clean] + [(t, 1) for t in toxic], bits=14, epochs=8)
    odds = sub.log_odds(["mi der wrthless sta", "mi der disgustng sta", "mi der verlon sta", ""], table_, bias, 14)
    assert min(odds[:2]) > odds[2] and odds[3] == bias


def naive(texts, bits):
    """Subwords by plain loops: the buckets' weights of each text."""
    out = []
    for text in texts:
        words, word = [], ""
        for c in text.lower() + " ":
            if c.isalnum():
                word += c
            elif word:
                words.append(word)
                word = ""
        out.append([len(words), sum(sum(len(w) + 2 - n + 1 for n in sub.GRAMS if len(w) + 2 >= n) + 1 for w in words)])
    return out


def test_subwords_counts():
    texts = ["Hello, wörld a", "", "...", "a-b  c1", "漢字 x́y", "one"]
    bucket, weight, word, doc, share = sub.subwords(texts, 16)
    for k, (n_words, n_grams) in enumerate(naive(texts, 16)):
        assert (doc == k).sum() == n_words and (doc[word] == k).sum() == n_grams
    assert np.allclose(np.bincount(word, weight), share)
    whole = sub.subwords(["x y x"], 16)
    assert np.allclose(sorted(whole[4]), sorted([1 / np.sqrt(2), 1 / np.sqrt(2), 1.0]))


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(2)
    text, table_ = prose(rng, 4000), np.random.default_rng(0).normal(size=1 << 12)
    distinct = " ".join(dict.fromkeys(text.lower().replace(".", "").split()))
    want = sub.log_odds([distinct], table_, 0.5, 12)
    monkeypatch.setattr(sub, "BLOCK_CHARS", 500)
    assert np.allclose(sub.log_odds([distinct], table_, 0.5, 12), want)


@pytest.mark.parametrize("block", (7, 100, 901, 4096))
def test_size_changes_no_score(monkeypatch, block):
    """Repeated words, a word longer than a piece, no gaps at all, long runs of signs: the same score in any pieces."""
    rng = random.Random(2)
    texts = [prose(rng, 1500) + " " + "abcé" * 700 + "! " + prose(rng, 400) + " z", "x" * 5000, "漢" * 3000, "a b " * 900, "-" * 3000 + "worthless", "Σας " * 1200, ""]
    table_ = np.random.default_rng(0).normal(size=1 << 12)
    want = sub.log_odds(texts, table_, 0.5, 12)
    monkeypatch.setattr(sub, "BLOCK_CHARS", block)
    assert np.allclose(sub.log_odds(texts, table_, 0.5, 12), want, rtol=1e-9)
    assert all(b - a <= block or texts[0][a:b].isalnum() for a, b in sub._pieces(texts[0]))


WRAP = (1 << 64) - 1
K = 0x9E3779B97F4A7C15


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & WRAP
    return x ^ (x >> 27)


def plain_subwords(text, bits):
    """{bucket: weight} and the number of damped words of a text, by loops over its characters."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    out: dict = {}
    for w in set(words):
        code = [0, *map(ord, w), 0]
        hashes = []
        for n in sub.GRAMS:
            for i in range(len(code) - n + 1):
                h = code[i] + n
                for c in code[i + 1 : i + n]:
                    h = (h * K + c) & WRAP
                hashes.append(plain_mix(h))
        whole, power = 0, 1
        for c in code[:-1]:
            power = power * K & WRAP
            whole = (whole + plain_mix(c + 7) * power) & WRAP
        hashes.append(plain_mix(whole))
        for h in hashes:
            b = h & ((1 << bits) - 1)
            out[b] = out.get(b, 0.0) + math.sqrt(words.count(w)) / len(hashes)
    return out, sum(math.sqrt(words.count(w)) for w in set(words))


def test_subwords_brute():
    for text in ("Hello, wörld a", "x y x", "", "...", "漢字 x́y one one one", "a-b  c1 " * 3):
        bucket, weight, *_, share = sub.subwords([text], 10)
        want, n = plain_subwords(text, 10)
        got = np.bincount(bucket, weight, 1 << 10)
        assert np.allclose(got, [want.get(b, 0.0) for b in range(1 << 10)]) and share.sum() == pytest.approx(n)


def test_softmax_training_brute():
    """Vectors and classes after two passes, by loops over texts, subwords and dimensions."""
    bits, dim, rng = 8, 3, random.Random(4)
    texts = [(prose(rng, 12) + (" worthless" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(50)]
    got, bias = sub.train(texts, bits, dim, epochs=2)
    values = []
    for text, _ in texts:
        held, n = plain_subwords(text, bits)
        values.append({b: v / (sub.NEUTRAL + n) for b, v in held.items()})
    known = {b for b in range(1 << bits) if sum(b in v for v in values) >= 1}
    draw = np.random.default_rng(7)
    vectors = draw.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float)
    classes, offsets = draw.normal(0, 0.3, (dim, 2)), [0.0, 0.0]
    seen, seen_c, seen_o = [sub.START] * (1 << bits), [[1e-8] * 2 for _ in range(dim)], [1e-8] * 2
    for _ in range(2):
        order = draw.permutation(len(texts)).tolist()
        for start in range(0, len(order), sub.BATCH):
            batch, g, g_c, g_o = order[start : start + sub.BATCH], {}, [[0.0] * 2 for _ in range(dim)], [0.0, 0.0]
            for i in batch:
                mean = [sum(vectors[b][k] * v for b, v in values[i].items()) for k in range(dim)]
                z = [sum(mean[k] * classes[k][c] for k in range(dim)) + offsets[c] for c in (0, 1)]
                p = [math.exp(x) / (math.exp(z[0]) + math.exp(z[1])) for x in z]
                p[texts[i][1]] -= 1.0
                for b, v in values[i].items():
                    g[b] = g.get(b, 0.0) + v * p[1]
                for c in (0, 1):
                    g_o[c] += p[c]
                    for k in range(dim):
                        g_c[k][c] += mean[k] * p[c]
            apart = [classes[k][1] - classes[k][0] for k in range(dim)]
            for b, x in g.items():
                seen[b] += x * x * sum(a * a for a in apart) / dim
                for k in range(dim):
                    vectors[b][k] -= sub.RATE * x / math.sqrt(seen[b]) * apart[k]
            for c in (0, 1):
                seen_o[c] += g_o[c] ** 2
                offsets[c] -= 0.1 * g_o[c] / math.sqrt(seen_o[c])
                for k in range(dim):
                    seen_c[k][c] += g_c[k][c] ** 2
                    classes[k][c] -= 0.1 * g_c[k][c] / math.sqrt(seen_c[k][c])
    want = [sum(vectors[b][k] * (classes[k][1] - classes[k][0]) for k in range(dim)) if b in known else 0.0 for b in range(1 << bits)]
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4) and bias == pytest.approx(offsets[1] - offsets[0], rel=1e-3)


def plain_features(text, bits):
    """{feature: value} of a text by loops, numbers wrapped by hand."""
    words = text.split()
    if not words:
        return {}
    digest = xxhash.xxh3_64_intdigest
    h = [digest(w.lower()) for w in words]
    f = [digest(ftrl.shape(w.decode("utf-8", "replace")).encode(), 1) for w in words]
    pairs, forms = [(a * K + b) & WRAP for a, b in zip(h, h[1:])], [(a * K + b) & WRAP for a, b in zip(f, f[1:])]
    again = [int(p in pairs[:i]) for i, p in enumerate(pairs)]
    out: dict = {}
    for codes, kind in [(h, 1), (f, 2), *([(pairs, 3), (forms, 4), (again, 5), ([int(a == b) for a, b in zip(h, h[1:])], 6)] if pairs else [])]:
        for c in codes:
            x = (c + kind) * K & WRAP
            at = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & WRAP) >> 40 & ((1 << bits) - 1)
            out[at] = out.get(at, 0.0) + 1.0 / len(codes)
    return out


def test_features_brute():
    for text in (b"", b"one", b"the The ### the the end", b"A1 " * 9, "Éa ß 漢字 x".encode(), b"q" * 3000 + b"9!!!" * 500 + b" w"):
        at, value = ftrl.Features(12)(text)
        want = plain_features(text, 12)
        assert np.allclose(np.bincount(at, value, 1 << 12), [want.get(b, 0.0) for b in range(1 << 12)])
    assert len(ftrl.shape("a1-" * 40)) == 120 and ftrl.shape("a1-" * 40) != ftrl.shape("a1-" * 41)


def test_ftrl_brute():
    """The weights by the textbook loop: one coordinate at a time, in dictionaries."""
    rng, bits = random.Random(6), 10
    rows = [((prose(rng, 12) + (" ###" if k % 2 else "")).encode(), k % 2, 1.0 + k % 3) for k in range(24)]
    z: dict = {}
    n: dict = {}

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 1 << bits else (ftrl.L1, ftrl.L2)
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((ftrl.BETA + math.sqrt(n.get(i, 0.0))) / ftrl.ALPHA + l2)

    for _ in range(ftrl.EPOCHS):
        for text, label, importance in rows:
            x = {**plain_features(text, bits), 1 << bits: 1.0}
            w = {i: weight(i) for i in x}
            p = 1.0 / (1.0 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = importance * (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / ftrl.ALPHA * w[i]
                n[i] = before + g * g
    assert np.allclose(ftrl.train(rows, bits), [weight(i) for i in range((1 << bits) + 1)], atol=1e-9)


@pytest.mark.parametrize("module", (ftrl, sub))
def test_edges(spark, module):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(table(spark), labels, "quality", F.lit(True), {0: 5, 1: 5})
    got = module.score(clashing(table(spark)), model)
    assert got.count() == table(spark).count() and got.columns == ["doc_id", "score"]
    assert {round(r.score, 6) for r in got.collect()} == {0.5}
    assert module.score(empty(spark), model).count() == 0
    one = spark.createDataFrame([(1, 1, None), (2, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    sure = module.score(table(spark), module.fit(table(spark), one, "quality", F.lit(True), {0: 5, 1: 5}))
    assert sure.agg(F.min("score")).first()[0] > 0.9


def test_ftrl_separates(spark):
    rng = random.Random(3)
    good = [(prose(rng, 50).encode(), 1, 1.0) for _ in range(80)]
    bad = [(" ".join(w + "###" for w in prose(rng, 50).split()).encode(), 0, 1.0) for _ in range(80)]
    w = ftrl.train(good[:60] + bad[:60], bits=14)
    features = ftrl.Features(14)
    odds = [w[a] @ v + w[-1] for a, v in (features(t) for t, _, _ in good[60:] + bad[60:])]
    assert min(odds[:20]) > max(odds[20:])
    assert features(b"")[0].size == 0


def test_bounded_passes_over():
    rows = [(k, "x" * n, c) for k, (n, c) in enumerate([(50, 0), (3, 0), (4, 1), (5, 0), (30, 1), (2, 1)])]
    assert bounded(rows, 94) == rows
    assert [r[0] for r in bounded(rows, 20)] == [1, 2, 3, 5]
    assert [r[0] for r in bounded(rows[:2] + rows[2:3], 50)] == [1, 2] and bounded([], 5) == []


@pytest.mark.parametrize("module", (ftrl, sub))
def test_long_labelled_texts_leave_the_others(spark, monkeypatch, module):
    """Texts over the bound, four in five of each label, are passed over; the rest is trained on."""
    monkeypatch.setattr(module, "TRAIN_BYTES", 24_000)
    rng = random.Random(7)
    text = lambda label, n: " ".join(w if label else w + "### worthless" for w in prose(rng, n).split())
    rows = [(i, text(i % 2, 50 if i % 10 < 2 else 4000), None, None, None) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    model = module.fit(table(spark, rows), labels, "quality", F.lit(True), {0: 50, 1: 50})
    fresh = [(i, text(i % 2, 50), None, None, None) for i in range(20)]
    scores = {r.doc_id: r.score for r in module.score(table(spark, fresh), model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_training_takes_long_texts_in_pieces(monkeypatch):
    """The features of a text don't depend on the pieces it is taken in, whatever its words' lengths."""
    import random

    import numpy as np

    from lamina.llm import subword_softmax as ss
    from tests.llm.helpers import words

    rng = random.Random(3)
    texts = [" ".join(words(rng, 400)), "x" * 700 + " y " + "x" * 700, "...", "ab" * 300, "É ﬁ " * 90, " , ".join(rng.choices(["one", "two", "three"], k=300))]
    whole = [ss.features(t) for t in texts]
    for size in (40, 128, 611):
        monkeypatch.setattr(ss, "BLOCK_CHARS", size)
        for (a, x), (b, y) in zip(whole, [ss.features(t) for t in texts]):
            assert a.tolist() == b.tolist() and np.allclose(x, y, rtol=1e-5)
