"""MinHash fingerprints and fill-in-the-middle texts against plain loops."""

import hashlib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from lamina.llm import infill, minhash
from tests.llm.helpers import clashing, corpus, empty, table
from tests.llm.test_native import plan_of


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_fingerprint(text, bins, bits):
    shift = 60 - (bins.bit_length() - 1)
    least = {}
    for s in shingles(text):
        h = int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
        least[h >> shift] = min(h, least.get(h >> shift, h))
    if not least:
        return ""
    lows = []
    for i in range(bins):
        d = hashlib.md5(f"bin:{i}".encode()).hexdigest()
        start, step, factor, add = int(d[:8], 16) % bins, int(d[8:16], 16) % (bins // 2) * 2 + 1, int(d[16:24], 16) % (2**31 - 2) + 1, int(d[24:], 16) % (2**31 - 1)
        at = i if i in least else next(j for t in range(bins) if (j := (start + t * step) % bins) in least)
        lows.append((least[at] % (2**31 - 1) * factor + add) % (2**31 - 1) % 2**bits)
    if bits >= 4:
        return "".join(f"{x:0{bits // 4}x}" for x in lows)
    group = 4 // bits
    return "".join(f"{sum(x << (bits * j) for j, x in enumerate(lows[k : k + group])):x}" for k in range(0, bins, group))


def brute_likeness(a, b, bins, bits):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    fields = lambda s: [int(s[i : i + bits // 4], 16) for i in range(0, len(s), bits // 4)] if bits >= 4 else [int(c, 16) >> (bits * j) & (2**bits - 1) for c in s for j in range(4 // bits)]
    same = sum(x == y for x, y in zip(fields(a), fields(b)))
    return max(0.0, (same / bins - 2**-bits) / (1 - 2**-bits))


@pytest.mark.parametrize("bins,bits", [(256, 8), (64, 4), (128, 1), (32, 2), (16, 16)])
def test_fingerprint(spark, bins, bits):
    rows = corpus(seed=5, n=20)
    got = table(spark, rows).select("text", minhash.fingerprint(F.col("text"), bins=bins, bits=bits).alias("f")).collect()
    for r in got:
        assert r.f == brute_fingerprint(r.text or "", bins, bits)
    prints = [r.f for r in got]
    pairs = spark.createDataFrame([(a, b) for a in prints[:6] + prints[-12:] for b in prints[::3]], "a string, b string")
    for r in pairs.select("a", "b", minhash.likeness(F.col("a"), F.col("b"), bins, bits).alias("s")).collect():
        assert r.s == pytest.approx(brute_likeness(r.a, r.b, bins, bits))


def test_fingerprint_settings():
    for bins, bits in ((100, 8), (8, 8), (256, 3)):
        with pytest.raises(ValueError):
            minhash.fingerprint(None, bins=bins, bits=bits)


def test_edited_pairs(spark):
    rows = corpus(seed=6, n=40)
    got = minhash.edited_pairs(clashing(table(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = [(r[0], r[1] or "") for r in rows]
    key = lambda x: hashlib.md5(f"{'null' if x[0] is None else x[0]}:{x[1]}".encode()).hexdigest()
    order = sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0, key(x)), reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    left = {x: texts.count(x) for x in texts}
    known = {(x[0], minhash_edit(x[1], after[x][1])): x for x in left}
    for r in got:
        own = known[r.id, r.edited]
        left[own] -= 1
        assert r.n_chars == len(own[1])
        assert (r.fingerprint, r.edited_fingerprint) == (brute_fingerprint(own[1], 256, 8), brute_fingerprint(r.edited, 256, 8))
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint, 256, 8))
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, brute_fingerprint(after[own][1], 256, 8), 256, 8))
    assert not any(left.values())


def minhash_edit(text, other):
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def test_likeness_is_near_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    below = sorted(texts)
    errors = []
    for r in minhash.edited_pairs(docs).collect():
        a, b, c = shingles(texts[r.id]), shingles(r.edited), shingles(texts[below[below.index(r.id) - 1]])
        errors += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.035


def test_successors_do_not_depend_on_ranges(spark):
    docs, out = table(spark), []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, minhash.successors(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_fingerprints_are_native_and_empty_tables_pass(spark):
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan_of(minhash.edited_pairs(table(spark))))
    assert minhash.edited_pairs(empty(spark)).count() == 0 and infill.infill(empty(spark)).count() == 0


def test_one_document_follows_itself(spark):
    r = minhash.edited_pairs(table(spark, [(1, "a b c d e f", None, None, None)] * 2)).collect()
    assert [x.edited for x in r] == ["a b c d a b"] * 2 and all(x.near_next == 1.0 for x in r)


TEXTS = ["a😀b\n漢字 x", "", None, "a<P>b", "x y  z", "hello world, this is. Fine! ok" * 20, "<<S", "<S", "á😀😀👩‍👩‍👧", "\n\n", " ", "no marks here < P > ", "ends in <"]


def test_infill(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS * 30)] + [(None, "null id", None, None, None)] + corpus(n=20)
    got = infill.infill(clashing(table(spark, rows))).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        s = hashlib.sha256(f"1:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(text)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        assert (r.n_units, r.form, r.output, r.back) == (n, form, output, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (a, b - a))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def brute_units(text, grammar):
    """Units by a walk over neighbouring code points."""
    space, word = lambda c: c in " \t\n\x0b\f\r", lambda c: c.isascii() and (c.isalnum() or c == "_")
    ends = {
        "code_point": lambda a, b: True, "word": lambda a, b: space(a) and not space(b), "line": lambda a, b: a == "\n",
        "run": lambda a, b: word(a) != word(b), "sentence": lambda a, b: a in ".!?。！？" and space(b),
    }[grammar]
    out = [text[:1]] if text else []
    for a, b in zip(text, text[1:]):
        if ends(a, b):
            out.append(b)
        else:
            out[-1] += b
    return out


@pytest.mark.parametrize("grammar", list(infill.UNITS))
def test_units(spark, grammar):
    texts = [t or "" for t in TEXTS] + [r[1] or "" for r in corpus(n=10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", infill.units(F.col("text"), grammar).alias("u")).collect():
        assert r.u == brute_units(r.text, grammar)


def test_infill_by_words(spark):
    for r in infill.infill(table(spark), grammar="word", transformed=100, spm=50).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        assert r.back == (r.text or "") and r.n_units == len(brute_units(r.text or "", "word"))
        assert (r.form == "plain") == (not r.text or any(m in r.text for m in infill.MARKS.values()))
