"""From raw documents to encoded training text, one operator to a stage.

Stages: compression-band quality rules, line dedup, n-gram Jaccard join, source
mix, SentencePiece encoding.  Each takes (spark, docs, sf_dir); its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import compression_bands, line_chunks, piece_scan, signature_tree, source_mix
from lamina.llm.common import forget, materialize, written
from lamina.llm.queries import vocabulary

#: Some stages (zstandard ratios, piece encoding) have no SQL; brute force tests them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their compression bands.

    Null and empty texts go (too few words); rows are judged one by one, repeated
    ones alike; columns are kept whatever their names.
    """
    judged = compression_bands.keep_documents(docs)
    return judged.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines removed; documents of which nothing is left go.

    Null and empty texts stay; rows equal in id and text keep the same lines;
    ``n_chars`` follows the text, other columns are kept whatever their names.
    """
    count = "n_lines_removed"
    while count in docs.columns:
        count += "_"
    out = line_chunks.line_dedup(docs, count_col=count, make=line_chunks.passages)
    left = (F.col(count) == 0) | (F.length("text") > 0)
    out = out.where(left).drop(count)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least id (rows without an id all stay)."""
    return signature_tree.one_per_component(docs, width=5, percent=80).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time (3 at most).

    Texts without words are never taken; a null source is one of its own; rows
    that share id, source and size share their copies evenly.
    """
    return source_mix.repeat_documents(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces): the piece ids of each document of the mix.

    Null and empty texts have no pieces; every row gives one, repeated or not.
    """
    out = piece_scan.encode(docs, vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mixed), ("piece encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last ends in a written table.

    What led to a table, its stage's input too, is deleted once it is written.
    """
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(written())
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        forget(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
