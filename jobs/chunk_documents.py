"""Incremental job: a chunk and vector table that keeps up with a growing folder of documents.

    python -m jobs.chunk_documents --documents IN --output OUT --checkpoint MARK [--config FILE]

A file stream (availableNow, with a checkpoint) takes the Parquet files that were
not taken before.  Of their documents (doc_id, text, lang, ...), those that are new
or whose text has changed since they were last taken are cut into chunks,
embedded, and written:

- ``OUT/chunks``: (doc_id, chunk_no, chunk_id, heading, text, n_tokens, page_start,
  page_end, embedding), partitioned by (batch, lang);
- ``OUT/documents``: (doc_id, text_key, n_chunks), partitioned by batch: which
  document was taken when.

Both are written by dynamic partition overwrite, the ledger after the chunks, and
what is new is judged by the ledger of earlier batches alone; so a batch that is
run again after a failure writes the same partitions.  ``current`` gives the chunks
of each document's last text.

Defined cases: null texts are taken as empty (no chunks); a document without an
id is named after its text; rows equal in id and text are one document; of
different new texts of one id in one batch the one of the highest hash is taken; a
null language is Spark's default partition and comes back null.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lamina.functions.text import token_count
from lamina.operators import layout
from lamina.operators.chunking import Chunker
from lamina.operators.embedding import embed_column
from lamina.sources.text import text_elements

from .common import config, prepared, read, said, started

DEFAULTS = {"strategy": "semantic", "chunk_size": 300, "chunk_overlap": 2, "embedder": "hashing", "dimension": 64, "files_per_batch": 64}
CHUNKS = "doc_id string, chunk_no int, chunk_id string, heading string, text string, n_tokens long, page_start int, page_end int, embedding array<float>, batch long, lang string"
LEDGER = "doc_id string, text_key string, n_chunks long, batch long"


def as_glob(path: str) -> str:
    """A path that a file stream takes though it may name one file: it wants a folder or a glob, so the last character becomes one."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, lang) of every row, ids and texts never null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(text)))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(own.alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"), lang.alias("lang"))


def one_each(rows: DataFrame) -> DataFrame:
    """One of the ``named`` rows of each id."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("text_key"), F.asc_nulls_last("lang"))
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def last_taken(ledger: DataFrame) -> DataFrame:
    """(doc_id, text_key, batch) of each document's last batch."""
    last = ledger.groupBy("doc_id").agg(F.max(F.struct("batch", "text_key")).alias("last"))
    return last.select("doc_id", F.col("last.text_key").alias("text_key"), F.col("last.batch").alias("batch"))


def chunked(docs: DataFrame, settings: dict) -> DataFrame:
    """The chunk rows of ``named`` documents, without their batch."""
    elements = layout.single_line_order(text_elements(docs, special=False))
    chunks = Chunker(settings["strategy"], settings["chunk_size"], settings["chunk_overlap"]).chunks(elements)
    rows = chunks.withColumn("n_tokens", token_count(F.col("text")).cast("long")).join(docs.select("doc_id", "lang"), "doc_id")
    return embed_column(rows, "text", settings["embedder"], dimension=settings["dimension"])


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Take what is new below ``documents``; returns the numbers of batches, documents and chunks."""
    settings = DEFAULTS | (settings or {})
    output, sums = output.rstrip("/"), {"batches": 0, "documents": 0, "chunks": 0}
    prepared(spark, f"{output}/chunks", CHUNKS, ["batch", "lang"])
    prepared(spark, f"{output}/documents", LEDGER, ["batch"])

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger = read(session, f"{output}/documents", LEDGER)
        earlier = last_taken(ledger.where(F.col("batch") < number)).select("doc_id", "text_key")
        new = one_each(named(batch).join(earlier, ["doc_id", "text_key"], "left_anti")).persist(StorageLevel.DISK_ONLY)

        def put(rows: DataFrame, name: str, schema: str, by: list[str]) -> None:
            rows = rows.withColumn("batch", F.lit(number).cast("long")).select(*read(session, f"{output}/{name}", schema).columns)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")

        try:
            put(chunked(new, settings), "chunks", CHUNKS, ["batch", "lang"])
            made = read(session, f"{output}/chunks", CHUNKS).where(F.col("batch") == number).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
            put(new.join(made, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long"))), "documents", LEDGER, ["batch"])
        finally:
            new.unpersist()
        taken = read(session, f"{output}/documents", LEDGER).where(F.col("batch") == number).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
        said("batch", batch=number, read=batch.count(), documents=taken["documents"], chunks=taken["chunks"], written=output)
        sums.update(batches=sums["batches"] + 1, documents=sums["documents"] + taken["documents"], chunks=sums["chunks"] + taken["chunks"])

    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(as_glob(documents))
    said("start", documents=documents, output=output, checkpoint=checkpoint, settings=settings)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return said("end", **sums)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of each document's last text."""
    output = output.rstrip("/")
    last = last_taken(read(spark, f"{output}/documents", LEDGER)).select("doc_id", "batch")
    return read(spark, f"{output}/chunks", CHUNKS).join(last, ["doc_id", "batch"], "left_semi")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chunk_documents", description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file of settings")
    given, spark = started(p, args, "chunk_documents")
    try:
        run(spark, given.documents, given.output, given.checkpoint, config(spark, given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
