import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lamina.llm import piece_scan, token_bits
from lamina.llm.common import fresh_path
from tests.llm.helpers import clashing, corpus, empty, table

public = pytest.importorskip("public_tokenizers")
WORDS, PIECES = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 5))
def test_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    packed = token_bits.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8) and (token_bits.unpack(packed, n, bits) == ids).all()


@pytest.mark.parametrize("bits", (7, 16, 17))
def test_file_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 3, 5000, 1, 700, 0, 12000)]
    buffer = io.BytesIO()
    packer = token_bits.Packer(buffer, bits, block_ids=512)
    for i, d in enumerate(docs):
        packer.add(None if i == 0 else i * 10, d)
    assert packer.close() == (len(docs), sum(map(len, docs)))
    file = token_bits.IdFile(pa.PythonFile(io.BytesIO(buffer.getvalue()), mode="r"))
    for k in (6, 2, 0, 4):
        assert (file.document(k) == docs[k]).all()
    assert [(k, len(d)) for k, d in file.documents(1000)] == [(k, len(d)) for k, d in enumerate(docs)]
    assert file.nulls[0] and list(file.docs[1:]) == [10, 20, 30, 40, 50, 60] and (file.ids(100, 4000) == np.concatenate(docs)[100:4000]).all()
    with pytest.raises(ValueError):
        token_bits.Packer(io.BytesIO(), bits).add(1, np.array([1 << bits], np.uint32))


def test_ids_match_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = token_bits.id_files(clashing(table(spark)), WORDS, with_ids=True, file_bytes=4000).collect()
    assert sorted(map(repr, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got))) == sorted(map(repr, want))
    assert token_bits.id_files(empty(spark), WORDS).count() == 0


def test_written_files_are_whole(spark):
    out = fresh_path(spark, "ids")
    manifest = token_bits.write_ids(table(spark), WORDS, out, n_files=3).collect()
    files = sorted(os.listdir(out.removeprefix("file:").replace("//", "/")))
    assert files == sorted(m.file.rsplit("/")[-1] for m in manifest) and sum(m.n_docs for m in manifest) == len(corpus())


def test_case_and_sign_shortcuts():
    from tokenizers import Tokenizer

    rng, t = random.Random(2), Tokenizer.from_file(WORDS)
    parts = ["A", "Σ", "É", "é", " ", "\n", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "1", "漢", "İ", "😀", "́", "ﬁ", ".", ",", "!?", "ΑΣ", "Å", "K", "...", ".a"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    got = token_bits.WordEncoder(WORDS).encode([x.encode() for x in texts])
    assert [list(g) for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """A cased vocabulary that keeps white space, and the word vocabulary with any step changed, take no short cut."""
    import json

    from tokenizers import Tokenizer

    cased = public.path("byte_bpe_50k.json")
    assert token_bits.WordEncoder(WORDS).by_words and not token_bits.WordEncoder(cased).by_words
    t, rows = Tokenizer.from_file(cased), corpus()
    got = token_bits.id_files(table(spark, rows), cased, end_id=None, with_ids=True, file_bytes=4000).collect()
    want = sorted((repr(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == want
    base = json.load(open(WORDS))
    changes = [
        lambda c: c["normalizer"]["normalizers"].pop(), lambda c: c["normalizer"]["normalizers"].append({"type": "NFKC"}), lambda c: c.update(pre_tokenizer=None),
        lambda c: c["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\\S+"), lambda c: c["model"].update(dropout=0.1), lambda c: c["added_tokens"][0].update(lstrip=True),
        lambda c: c["added_tokens"][0].update(content="a b"), lambda c: c.update(truncation={"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}),
    ]
    for change in changes:
        config = json.loads(json.dumps(base))
        change(config)
        assert not token_bits.allows_words(config)


def test_words_are_those_of_the_texts():
    """Every white space character, long words, runs of letters whose lower case is longer, and repeats over blocks."""
    from tokenizers import Tokenizer

    rng, t, enc = random.Random(5), Tokenizer.from_file(WORDS), token_bits.WordEncoder(WORDS)
    parts = ["a", "Bc", "the", "İ", "ǅ", "ᄒ", "ᅡ", "ᆫ", "e", "́", "’", "'", "s", "1", "漢字", ".", "x" * 60, "y" * 70 + "!", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u2003", " ", " ", "\n"]
    for _ in range(6):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)] + ["", " ", "\n\n"]
        got = enc.encode([x.encode() for x in texts])
        assert [list(g) for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, enc.known)) <= token_bits.CACHED_CHARS


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_match_library(library):
    rng, vocab = random.Random(3), piece_scan.pieces(PIECES)
    parts = ["a", "s", "the", " ", "  ", "\n", "é", "漢", "😀", "\x00", "in", "on", "er", "22", "{", "\t", "ﬁ", "ing", "<s>", "<0x0A>", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["".join(rng.choices("abcdeghilnorstu", k=40)) for _ in range(500)]
    for x in texts:
        ids = np.frombuffer(vocab.encode(piece_scan.mark(x)), "<i4").tolist()
        assert ids == library.encode(x) and vocab.decode(ids) == x == library.decode(ids)


def test_new_words_are_solved_together(library, monkeypatch):
    """No walk for each new word, no edge found twice (not even in the next task), and the library's ids all the same."""
    rng, vocab = random.Random(8), piece_scan.Pieces(PIECES)
    parts = ["a", "the", "ing", "tion", "é", "漢", "😀", "\n", "\x00", "{", "s.", "###", "Zw", "ou"]
    words = list({"".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)} - {""})
    texts = [" ".join(words[:2000]), " ".join(words[2000:]) + " ", "  ".join(words[::7]), "", " ", "   ", "x" * 90 + " " + "thing{" * 30, "é" * 50 + "\n" * 50]
    walks, merges, walk, merge = [], [], piece_scan.Pieces.walk, piece_scan.Pieces.merge
    monkeypatch.setattr(piece_scan.Pieces, "walk", lambda self, *a: walks.append(a) or walk(self, *a))
    monkeypatch.setattr(piece_scan.Pieces, "merge", lambda self, text: merges.append(text) or merge(self, text))
    for _ in range(2):
        got = [np.frombuffer(vocab.encode(piece_scan.mark(x)), "<i4").tolist() for x in texts]
        assert got == [library.encode(x) for x in texts] and len(walks) < len(words) / 10
        tried, merges[:] = len(merges), []
        vocab.forget()
    assert tried < 200  # the second time
    got = vocab.encode_all([piece_scan.mark(x) for x in texts])
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [library.encode(x) for x in texts]


def test_edges_stay_right_when_their_table_is_full(monkeypatch):
    monkeypatch.setattr(piece_scan, "EDGE_SLOTS", 64)
    edges, rng = piece_scan.Edges(lambda a, b: (a * b) % 3 == 1), np.random.default_rng(2)
    for size in (1, 20, 300, 5, 40):
        left, right = rng.integers(0, 40, size).astype(np.int32), rng.integers(0, 40, size).astype(np.int32)
        assert (edges(left, right) == ((left * right) % 3 == 1)).all() and edges.used <= 32


@pytest.mark.parametrize("chunk", (40, 64, 257))
def test_scan_matches_library(library, chunk):
    rng, vocab = random.Random(chunk), piece_scan.pieces(PIECES)
    texts = ["".join(rng.choices("abcdefghilmnoprstuwy", k=2000)), "".join(rng.choices(["the", "in", " ", "a", "\n", "es", "漢"], k=900)), "a" * 500, " " * 200, "ab" * 300, "e" * 41]
    for x in texts:
        assert np.frombuffer(vocab.scan(piece_scan.mark(x), chunk), "<i4").tolist() == library.encode(x)


def test_other_models_are_refused(tmp_path, monkeypatch):
    """Unigram models, normalisers and the like would get wrong ids, so they raise."""
    import sentencepiece

    proto = sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto()
    piece_scan.check_model(proto)
    part = lambda number, data: bytes([number << 3 | 2]) + bytes([len(data) & 127 | 128, len(data) >> 7]) + data
    trainer, normalizer = (piece_scan.fields(proto)[k][0] for k in (2, 3))
    # Of a field that comes twice the reader takes the first, so the change leads.
    changed = {"type is not BPE": part(2, b"\x18\x01" + trainer) + part(3, normalizer), "byte fallback": part(2, b"\x98\x02\x00" + trainer) + part(3, normalizer)}
    changed |= {"normalises": part(2, trainer) + part(3, b"\x12\x01x" + normalizer), "in front": part(2, trainer) + part(3, b"\x18\x00" + normalizer), "drops white": part(2, trainer) + part(3, b"\x20\x01" + normalizer)}
    changed |= {"user-defined": part(1, b"\x0a\x01a\x18\x04") + part(2, trainer) + part(3, normalizer)}
    piece_scan.check_model(part(2, trainer) + part(3, normalizer))
    for why, data in changed.items():
        with pytest.raises(ValueError, match=why):
            piece_scan.check_model(data)
    monkeypatch.setattr(piece_scan, "CONTEXT", 31)
    with pytest.raises(ValueError, match="pieces of 16"):
        piece_scan.Pieces(PIECES)


def test_prefix_products_are_associative():
    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(7)]
    acc = ms[0]
    for k, p in enumerate(piece_scan.prefixes(ms, piece_scan.product)):
        acc = ms[0] if k == 0 else piece_scan.product(acc, ms[k])
        assert (p == acc).all()


def test_encode_decode_table(spark, library):
    rows = corpus() + [(900, "word " * 900 + "z" * 3000, "en", "s1", None)] * 2
    df = clashing(table(spark, rows))
    got = piece_scan.encode(df, PIECES, chunk_chars=700)
    want = sorted((repr(r[0]), library.encode(r[1] or "")) for r in rows)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got.collect()) == want
    back = piece_scan.decode(got, PIECES)
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((repr(r[0]), (r[1] or "").replace("▁", " ")) for r in rows)
    assert piece_scan.encode(empty(spark), PIECES).count() == 0
    assert piece_scan.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECES).first().text is None
