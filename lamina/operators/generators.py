"""Text generators: a protocol, a registry, and their use over a column of prompts."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from .service import post


class Generator(Protocol):
    def generate(self, prompt: str, max_tokens: int, temperature: float, stops: list[str]) -> str: ...


class ExtractiveGenerator:
    """The context's first lines: an answer without a model, the same everywhere."""

    def __init__(self, lines: int = 1):
        self.lines = lines

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.0, stops: list[str] = ()) -> str:
        body = prompt.partition("Context:\n")[2].rpartition("\n\nQuestion: ")[0]
        return "\n".join(body.split("\n")[: self.lines])


class HttpGenerator:
    """A completion service: 'openai' (POST {url}/completions) or 'llamacpp' (POST {url}/completion)."""

    def __init__(self, url: str, protocol: str = "openai", model: str | None = None, key: str | None = None, timeout: float = 120.0, tries: int = 4, pause: float = 1.0, at_once: int = 8):
        if protocol not in ("openai", "llamacpp"):
            raise ValueError(f"unknown protocol: {protocol}")
        self.url, self.protocol, self.model, self.key, self.timeout = url.rstrip("/"), protocol, model, key, timeout
        self.tries, self.pause, self.at_once = tries, pause, at_once

    def _post(self, path: str, body: dict) -> dict:
        return post(self.url + path, body, self.key, self.timeout, self.tries, self.pause)

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, stops: list[str] = ()) -> str:
        if self.protocol == "llamacpp":
            return self._post("/completion", {"prompt": prompt, "n_predict": max_tokens, "temperature": temperature, "stop": list(stops)})["content"].strip()
        body = {"model": self.model, "prompt": prompt, "max_tokens": max_tokens, "temperature": temperature} | ({"stop": list(stops)} if stops else {})
        return self._post("/completions", body)["choices"][0]["text"].strip()

    def healthy(self) -> bool:
        """Whether the service answers at all; for a warning, never a failure."""
        try:
            with urllib.request.urlopen(self.url + ("/health" if self.protocol == "llamacpp" else "/models"), timeout=5):
                return True
        except (urllib.error.URLError, OSError):
            return False


class TransformersGenerator:
    """A local causal model; sampling only above temperature 0."""

    def __init__(self, model: str, device: str = "cpu"):
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.tokenizer, self.model, self.device = AutoTokenizer.from_pretrained(model), AutoModelForCausalLM.from_pretrained(model).to(device).eval(), device

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, stops: list[str] = ()) -> str:
        given = self.tokenizer(prompt, return_tensors="pt").to(self.device)
        sampling = {"do_sample": True, "temperature": temperature} if temperature > 0 else {"do_sample": False}
        extra = {"stop_strings": list(stops), "tokenizer": self.tokenizer} if stops else {}
        out = self.model.generate(**given, max_new_tokens=max_tokens, **sampling, **extra)
        text = self.tokenizer.decode(out[0][given["input_ids"].shape[1] :], skip_special_tokens=True)
        for stop in stops:
            text = text.removesuffix(stop)
        return text.strip()


GENERATORS: dict[str, Callable[..., Generator]] = {"extractive": ExtractiveGenerator, "openai": lambda **c: HttpGenerator(protocol="openai", **c), "llamacpp": lambda **c: HttpGenerator(protocol="llamacpp", **c), "transformers": TransformersGenerator}


def create_generator(kind: str = "extractive", **config) -> Generator:
    if kind not in GENERATORS:
        raise ValueError(f"unknown generator: {kind}")
    return GENERATORS[kind](**config)


def generate_column(rows: DataFrame, prompt_col: str = "prompt", kind: str = "extractive", max_tokens: int = 512, temperature: float = 0.7, stops: tuple[str, ...] = (), **config) -> DataFrame:
    """``rows`` with ``answer``; a null prompt has a null answer."""
    ship(rows.sparkSession)
    names, at = rows.columns, rows.columns.index(prompt_col)

    def run(batches):
        model = create_generator(kind, **config)
        for b in batches:
            one = lambda p: None if p is None else model.generate(p, max_tokens, temperature, list(stops))
            given = b.column(at).to_pylist()
            if getattr(model, "at_once", 1) > 1:  # a service takes several requests at a time
                with ThreadPoolExecutor(model.at_once) as pool:
                    answers = list(pool.map(one, given))
            else:
                answers = [one(p) for p in given]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, type=pa.string())], names=[*names, "answer"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, answer string")
