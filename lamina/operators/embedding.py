"""Embedders: a protocol, a registry, and their use over a table of texts.

A backend is created once in each Python worker from a plain configuration.
The hashing embedder needs no model; the others import theirs when used.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import release, ship
from .service import post


#: Words that a hashing embedder remembers, within a task.
CACHED_WORDS = 100_000


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words, unit length; equal texts have equal vectors everywhere."""

    def __init__(self, dimension: int = 256):
        self.dimension, self.known = dimension, {}

    def forget(self) -> None:
        self.known.clear()

    def _place(self, word: str) -> int:
        """The word's dimension, plus the number of dimensions where its sign is minus; remembered."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        h = xxhash.xxh3_64_intdigest(word.encode())
        self.known[word] = at = h % self.dimension + (0 if h >> 63 else self.dimension)
        return at

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, known = np.zeros((len(texts), self.dimension)), self.known
        for row, text in zip(out, texts):
            places = [known[w] if w in known else self._place(w) for w in text.lower().split()]
            counts = np.bincount(np.array(places, dtype=np.int64), minlength=2 * self.dimension)
            row += counts[: self.dimension] - counts[self.dimension :]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0).tolist()


class SentenceTransformersEmbedder:
    def __init__(self, model: str = "all-MiniLM-L6-v2", device: str | None = None, batch_size: int = 32, normalize: bool = True):
        from sentence_transformers import SentenceTransformer

        self.model, self.batch_size, self.normalize = SentenceTransformer(model, device=device), batch_size, normalize
        self.dimension = self.model.get_sentence_embedding_dimension()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.model.encode(texts, batch_size=self.batch_size, normalize_embeddings=self.normalize).tolist()


class TransformersEmbedder:
    """Hidden states of a transformer pooled by 'cls', 'last' or 'mean', unit length."""

    def __init__(self, model: str, pooling: str = "mean", device: str = "cpu", batch_size: int = 16, max_length: int = 512):
        import torch
        from transformers import AutoModel, AutoTokenizer

        if pooling not in ("cls", "last", "mean"):
            raise ValueError(f"unknown pooling: {pooling}")
        self.torch, self.pooling, self.device, self.batch_size, self.max_length = torch, pooling, device, batch_size, max_length
        self.tokenizer, self.model = AutoTokenizer.from_pretrained(model), AutoModel.from_pretrained(model).to(device).eval()
        self.dimension = self.model.config.hidden_size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), self.batch_size):
            given = self.tokenizer(texts[i : i + self.batch_size], padding=True, truncation=True, max_length=self.max_length, return_tensors="pt").to(self.device)
            with self.torch.no_grad():
                states = self.model(**given).last_hidden_state.cpu().numpy()
            out += pool(states, given["attention_mask"].cpu().numpy(), self.pooling).tolist()
        return out


class HttpEmbedder:
    """A service with the public embeddings protocol: POST {url}/embeddings, results in the order of their numbers."""

    def __init__(self, url: str, model: str = "text-embedding-ada-002", key: str | None = None, dimension: int = 1536, batch_size: int = 32, timeout: float = 60.0, tries: int = 4, pause: float = 1.0):
        self.url, self.model, self.key, self.dimension, self.batch_size, self.timeout = url.rstrip("/"), model, key, dimension, batch_size, timeout
        self.tries, self.pause = tries, pause

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for i in range(0, len(texts), self.batch_size):
            part = texts[i : i + self.batch_size]
            found = post(f"{self.url}/embeddings", {"model": self.model, "input": part}, self.key, self.timeout, self.tries, self.pause)["data"]
            if len(found) != len(part):
                raise ValueError(f"{len(found)} vectors for {len(part)} texts")
            out += [x["embedding"] for x in sorted(found, key=lambda x: x.get("index", 0))]
        return out


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder, "sentence_transformers": SentenceTransformersEmbedder, "huggingface": TransformersEmbedder, "openai": HttpEmbedder}


def create_embedder(kind: str = "hashing", **config) -> Embedder:
    if kind not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {kind}")
    return EMBEDDERS[kind](**config)


def pool(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Pooled unit vectors of states [batch, tokens, dims] under a mask [batch, tokens]."""
    if how == "cls":
        out = states[:, 0]
    elif how == "last":
        out = states[np.arange(len(states)), mask.sum(axis=1).astype(int) - 1]
    else:
        out = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


_made: dict[str, Embedder] = {}


def embed_column(rows: DataFrame, text_col: str = "text", kind: str = "hashing", batch: int = 512, **config) -> DataFrame:
    """``rows`` with ``embedding array<float>``; a null text has a null embedding."""
    ship(rows.sparkSession)
    key = f"{kind} {sorted(config.items())}"
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batches):
        if key not in _made:
            _made[key] = create_embedder(kind, **config)
        model = _made[key]
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(at).to_pylist()
                vectors = iter(model.embed([t for t in texts if t is not None]))
                column = pa.array([None if t is None else next(vectors) for t in texts], type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*names, "embedding"])
        # Idle workers share the executor's memory with what follows.
        if hasattr(model, "forget"):
            model.forget()
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>")


def checked(rows: DataFrame, dimension: int) -> DataFrame:
    """``rows``, failing at run time where an embedding has another dimension."""
    good = F.col("embedding").isNull() | (F.size("embedding") == dimension)
    return rows.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding dimension is not {dimension}")).cast("array<float>")))
