"""Token ids in fixed-width bit-packed files.

Each id takes the minimum bits of the vocabulary.  A file holds whole documents
in ascending id order; its ids are cut into blocks of ``BLOCK_IDS``, each packed
on its own and found by an offset, so numpy unpacks a block at once and any
document can be read without the rest.

File layout (little endian), see :func:`write_file` and :class:`IdFile`::

    packed blocks | block offsets u64[n_blocks + 1] | document starts u64[n_docs + 1]
    | document ids i64[n_docs] | null flags u8[n_docs] | footer

    footer: 8-byte magic, u32 bits, u32 block_ids, u64 n_ids, u64 n_docs, u64 n_blocks

Files go to the shared folder through the file system of its scheme; a task
writes under a name of its attempt and renames when complete, so a lost
executor leaves no partial file under a final name.

Edge cases: a null or empty text holds the end id only; null document ids come
first; rows with equal ids keep every copy, ordered by a hash of the text.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import ship
from .common import fresh_path, materialize, text_blocks

MAGIC = b"LAMIDS01"
FOOTER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: Bytes of text for each file; beyond so many files they grow, up to the bytes of the largest.
FILE_BYTES, MANY_FILES, LARGEST_FILE = 24 << 20, 4096, 1 << 30
#: Words whose ids a Python worker remembers, the longest such word, and words that go to the tokenizer at once.
CACHED_WORDS, CACHED_CHARS, RUN_WORDS = 1_000_000, 48, 512
SIGNS = ".,;:!?"
#: Files of a group in the running sum over the manifest.
GROUP_FILES = 1024


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a big-endian bit string of ``bits`` each."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class Packer:
    """Takes the ids of one document after another; writes a block whenever one is full."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.offsets, self.starts, self.docs, self.nulls = [0], [0], [], bytearray()
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)]))

    def extend(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Several documents: their ids in turn, and how many each has."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.docs += [0 if i is None else i for i in doc_ids]
        self.nulls += bytes(i is None for i in doc_ids)
        self.starts += (self.starts[-1] + np.cumsum(sizes)).tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 64 * self.block_ids:
            self._flush(self.n_waiting - self.n_waiting % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for start in range(0, n, self.block_ids):
            data = pack(ids[start : min(start + self.block_ids, n)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.n_waiting)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + bytes(self.nulls))
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.block_ids, self.starts[-1], len(self.docs), len(self.offsets) - 1))
        return len(self.docs), self.starts[-1]


class IdFile:
    """Random access to a file: only the index and the blocks asked for are read."""

    def __init__(self, source):
        self.source, size = source, source.size()
        magic, self.bits, self.block_ids, self.n_ids, self.n_docs, n_blocks = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        width = 8 * (n_blocks + 1) + 8 * (self.n_docs + 1) + 9 * self.n_docs
        index = source.read_at(width, size - FOOTER.size - width)
        at = 8 * (n_blocks + 1)
        self.offsets = np.frombuffer(index, "<u8", n_blocks + 1).astype(np.int64)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, at).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", self.n_docs, at + 8 * (self.n_docs + 1))
        self.nulls = np.frombuffer(index, "u1", self.n_docs, at + 8 * (2 * self.n_docs + 1))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            a = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[a : a + int(self.offsets[b + 1] - self.offsets[b])], n, self.bits))
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 20):
        """(position, ids) of every document, read in runs of about ``at_once`` ids."""
        k = 0
        while k < self.n_docs:
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, side="right")) - 1)
            run, base = self.ids(int(self.starts[k]), int(self.starts[stop])), int(self.starts[k])
            for d in range(k, stop):
                yield d, run[int(self.starts[d]) - base : int(self.starts[d + 1]) - base]
            k = stop


#: Pre-tokenizer patterns by which letters, digits and signs never share a token, nor a token with white space.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def allows_words(config: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its lower-case words in turn.

    So it is where every step is known to work word by word: no truncation or
    padding, plain added tokens without white space, normalisers that look at no
    neighbour, a split that drops white space and parts signs from letters, and a
    BPE model without dropout that marks word ends.
    """
    steps = lambda part, many: [] if part is None else part[many] if part["type"] == "Sequence" else [part]
    normal = [x["type"] for x in steps(config.get("normalizer"), "normalizers")]
    replaced = [(x["pattern"], x["content"]) for x in steps(config.get("normalizer"), "normalizers") if x["type"] == "Replace"]
    splits, model = steps(config.get("pre_tokenizer"), "pretokenizers"), config["model"]
    added = config.get("added_tokens") or []
    return (
        config.get("truncation") is None and config.get("padding") is None and config.get("post_processor") is None
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in added)
        and set(normal) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in normal and all(x == ({"Regex": r"\s+"}, " ") for x in replaced)
        and len(splits) == 2 and splits[0]["type"] == "Split" and splits[0]["pattern"].get("Regex") in SPLITS and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and model["type"] == "BPE" and not model.get("dropout") and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges")
    )


class WordEncoder:
    """Whole-text ids of a tokenizer file.

    Where the tokenizer allows it (:func:`allows_words`), texts are split and
    their words numbered by Arrow, so Python sees each distinct word of a block
    once; the ids of short words are remembered, up to a fixed number of words.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocab.values(), default=0).bit_length())
        self.by_words, self.known = allows_words(config), {}
        if self.by_words:
            suffix = config["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, sizes = self.encode_block(pa.array(texts, type=pa.binary()).cast(pa.string()))
        return np.split(flat, np.cumsum(sizes)[:-1]) if texts else []

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each); null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            return np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(sizes.sum())), sizes
        # ASCII case is dropped by the vocabulary; it shows only in added tokens, which begin with "<|".
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        place = np.asarray(words.indices)
        known = self.known
        distinct = words.dictionary.to_pylist()
        found = list(map(known.get, distinct))
        if None in found:
            new = [w for w, f in zip(distinct, found) if f is None]
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = distinct
            self._learn(new)
            found = list(map(known.get, distinct))
            for w in new:
                if len(w) > CACHED_CHARS:
                    known.pop(w, None)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        table, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[place]
        upto = np.cumsum(n)
        flat = table[np.repeat(starts[place] - upto + n, n) + np.arange(int(n.sum()))]
        ends = np.append(0, upto)[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return flat, np.diff(ends)

    def _learn(self, new: list[str]) -> None:
        known = self.known
        # A word that ends in signs after a letter (also in lower case) is the word without them, then the signs.
        cut = {w: (c, w[len(c) :]) for w in new if w and w[-1] in SIGNS and len(c := w.rstrip(SIGNS)) and c[-1].lower()[-1].isalpha()}
        order = [w for w in dict.fromkeys([w for w in new if w not in cut] + [p for c in cut.values() for p in c]) if w not in known]
        # Words of letters alone go to the tokenizer in runs: each ends in one token that marks a word's end.
        letters = [w for w in order if w.isalpha()]
        rest = [w for w in order if not w.isalpha()]
        for start in range(0, len(letters), RUN_WORDS):
            run = letters[start : start + RUN_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(run):
                data, at = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
                known.update((w, data[a:b]) for w, a, b in zip(run, at, at[1:]))
            else:  # lower case or composition has parted one of them
                rest += run
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, found))
        known.update((w, known[c] + known[t]) for w, (c, t) in cut.items())
        for p in {p for c in cut.values() for p in c if len(p) > CACHED_CHARS}.difference(new):
            known.pop(p)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, n_files: int = 8) -> DataFrame:
    """Encode all documents into files under ``out``; returns the written manifest.

    manifest: (part int, file string, n_docs long, n_ids long, first_id long),
    parts in ascending document order.  Texts are range-partitioned by id, so
    the shuffle carries each text once.
    """

    def write(batches):
        part = TaskContext.get().partitionId()
        enc, packer, sink, first = encoder(tokenizer_path), None, None, None
        files, folder = pafs.FileSystem.from_uri(out)
        name = f"part-{part:06d}.ids"
        mine = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for block in text_blocks(batch):
                if packer is None:
                    files.create_dir(folder, recursive=True)
                    sink = files.open_output_stream(mine)
                    packer = Packer(sink, enc.bits)
                    first = block.column(0)[0].as_py()
                tokens, sizes = enc.encode_block(block.column(1))
                if end_id is not None:
                    tokens, sizes = np.insert(tokens, np.cumsum(sizes), end_id), sizes + 1
                packer.extend(block.column(0).to_pylist(), tokens, sizes)
        if packer is not None:
            n_docs, n_ids = packer.close()
            sink.close()
            files.move(mine, f"{folder}/{name}")
            row = {"part": part, "file": f"{out}/{name}", "n_docs": n_docs, "n_ids": n_ids, "first_id": first}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64())]))

    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Rows that share an id, or have none, are told apart by a hash, so they fill several files where they are many.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(n_files, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return materialize(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long, first_id long"), "manifest")


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files: (doc_id, start, n_tokens, ids_crc32[, ids]).

    ``start`` counts the ids of all documents before: a running sum inside groups
    of files and one over the groups' totals, so no task takes all files.
    """
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumn("set", F.expr(f"part div {GROUP_FILES}"))
    sets = rows.groupBy("set").agg(F.sum("n_ids").alias("n_ids")).select("set", earlier(Window.orderBy("set")).alias("before"))
    within = rows.withColumn("within", earlier(Window.partitionBy("set").orderBy("part")))
    listed = within.join(sets, "set").select("file", (F.col("before") + F.col("within")).alias("base"))
    n_files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(row["file"])
                with files.open_input_file(path) as source:
                    held, rows, size = IdFile(source), [], 0
                    for k, ids in held.documents():
                        doc = None if held.nulls[k] else int(held.docs[k])
                        rows.append((doc, row["base"] + int(held.starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids.astype(np.int32)] * with_ids))
                        size += len(ids)
                        if size > 1 << 20:
                            yield _rows(rows, with_ids)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    return listed.repartition(n_files, "file").mapInArrow(read, schema)


def _rows(rows: list, with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def id_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, with_ids: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' ids to the shared folder and return them as read back."""
    volume = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    out = fresh_path(docs.sparkSession, "ids")
    n_files = max(1, -(-volume // LARGEST_FILE), min(-(-volume // file_bytes), MANY_FILES))
    manifest = write_ids(docs, tokenizer_path, out, id_col, text_col, end_id, n_files)
    return read_ids(manifest, with_ids)
