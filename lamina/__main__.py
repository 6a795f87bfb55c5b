"""python -m lamina {process,query,stats} ...: a thin command line over the engine."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.chunking import STRATEGIES, Chunker
from .plans.engine import Engine


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lamina")
    p.add_argument("action", choices=("process", "query", "stats"))
    p.add_argument("--folder", default="./lamina-data", help="where stage tables and vectors are kept")
    p.add_argument("--input", help="file or folder to process")
    p.add_argument("--question")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--strategy", choices=STRATEGIES, default="semantic")
    p.add_argument("--chunk-size", type=int, default=500)
    p.add_argument("--chunk-overlap", type=int, default=50)
    p.add_argument("--embedder", default="hashing")
    p.add_argument("--generator", default="extractive")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lamina").getOrCreate()
    engine = Engine(spark, a.folder, Chunker(a.strategy, a.chunk_size, a.chunk_overlap), a.embedder, generator=a.generator)
    if a.action == "process":
        if not a.input:
            p.error("process needs --input")
        result = engine.ingest(a.input)
    elif a.action == "query":
        if not a.question:
            p.error("query needs --question")
        result = engine.ask_one(a.question, top_k=a.top_k)
    else:
        result = engine.statistics().first().asDict()
    print(json.dumps(result, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
