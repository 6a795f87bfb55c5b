"""Batch job: for a stated set of questions, the passages nearest to each and the prompt that asks a model about them.

    python -m jobs.answer_prompts --documents D --embeddings E --output OUT [--config FILE]

Every document whose id is divisible by ``every`` and that has a vector asks what
else is said about its first line.  Its vector is searched against all others, the
``top_k`` nearest documents other than itself become the context, whole, and the
prompt is written with its sources, partitioned by the asking document's language.  A run replaces the
partitions that it writes (dynamic partition overwrite), so running again gives
the same table; a language that has no questions any more keeps what an earlier
run left.

Defined cases: documents or vectors without an id take no part; a null text asks
with an empty line and gives an empty passage; a hit without a document gives no
passage, and a question without hits has an empty context and no sources; of
rows that share an id the least text, and the least vector, is taken.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.operators import rag, store

from .common import config, prepared, read, said, started

DEFAULTS = {"every": 100, "top_k": 3, "style": "plain"}
PROMPTS = "query_id long, question string, prompt string, source_ids array<long>, scores array<double>, retrieved_chunks long, lang string"


def one_each(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """One row for each id, that of the least values."""
    least = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*columns)).alias("r"))
    return least.select(id_col, "r.*")


def prompts(documents: DataFrame, embeddings: DataFrame, settings: dict) -> DataFrame:
    """The rows of ``PROMPTS`` for every question."""
    docs = one_each(documents.select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    vectors = one_each(embeddings.where(F.col("embedding").isNotNull()), "vec_id", "embedding")
    asking = lambda c: F.pmod(F.col(c), F.lit(settings["every"])) == 0
    asked = vectors.where(asking("vec_id")).join(docs.where(asking("doc_id")).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    hits = store.top_k_batch(vectors, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), settings["top_k"] + 1, "vec_id")
    # A document may be its own nearest one: the rest moves up.
    other = hits.where("query_id <> vec_id").groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))), 1, settings["top_k"]).alias("h"))
    other = other.select("query_id", F.posexplode("h").alias("rank", "x")).select("query_id", "rank", "x.vec_id", F.col("x.score").alias("score"))
    found = rag.contexts(other, docs.select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text")), "query_id", "vec_id")
    first = F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    questions = docs.where(asking("doc_id")).join(asked.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("What else is said about: "), first).alias("question"), "lang")
    rows = rag.prompts(questions, found, settings["style"]).join(questions.select("query_id", "lang"), "query_id")
    none = F.array().cast("array<struct<score:double,chunk_id:string,source:string,page_range:string>>")
    sources = F.coalesce("sources", none)
    return rows.select("query_id", "question", "prompt", F.transform(sources, lambda s: s["chunk_id"].cast("long")).alias("source_ids"), F.transform(sources, lambda s: s["score"]).alias("scores"), "retrieved_chunks", "lang")


def run(spark: SparkSession, documents: str, embeddings: str, output: str, settings: dict | None = None) -> dict:
    """Write the prompts of all questions; returns how many there are."""
    settings = DEFAULTS | (settings or {})
    said("start", documents=documents, embeddings=embeddings, output=output, settings=settings)
    prepared(spark, output, PROMPTS, ["lang"])
    rows = prompts(spark.read.parquet(documents), spark.read.parquet(embeddings), settings)
    # A language's questions go to as many files as they need, and each file holds one language.
    rows.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(output)
    counts = read(spark, output, PROMPTS).agg(F.count("*").alias("prompts"), F.count_if(F.col("retrieved_chunks") > 0).alias("with_context")).first()
    return said("end", written=output, **counts.asDict())


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="answer_prompts", description=__doc__.splitlines()[0])
    for name in ("documents", "embeddings", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file of settings")
    given, spark = started(p, args, "answer_prompts")
    try:
        run(spark, given.documents, given.embeddings, given.output, config(spark, given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
