"""The whole way: files or texts to chunks and vectors, and questions to answers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import export, layout, rag
from ..operators.chunking import Chunker
from ..operators.embedding import create_embedder, embed_column
from ..operators.generators import generate_column
from ..operators.store import VectorStore
from ..sources import files as file_source
from ..sources.text import ordered_text_elements


class Engine:
    """Ingest documents into a vector store and answer questions from it.

    Everything is a lazy DataFrame up to the stage tables in ``folder``; stage
    seconds are those of the writes.
    """

    def __init__(self, spark: SparkSession, folder: str, chunker: Chunker | None = None, embedder: str = "hashing", embedder_config: dict | None = None, generator: str = "extractive", generator_config: dict | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.chunker = chunker or Chunker()
        self.embedder, self.embedder_config = embedder, embedder_config or {}
        self.generator, self.generator_config = generator, generator_config or {}
        self.dimension = create_embedder(embedder, **self.embedder_config).dimension
        self.store = VectorStore(spark, f"{self.folder}/vectors", self.dimension)

    def _stage(self, rows: DataFrame, name: str, stats: dict, batch: str) -> DataFrame:
        """Write a stage's rows of this ingest beside those of earlier ones; returns the rows written."""
        began, path = time.time(), f"{self.folder}/{name}/batch={batch}"
        rows.write.option("compression", "zstd").parquet(path)
        stats[f"{name}_seconds"] = time.time() - began
        return self.spark.read.schema(rows.schema).parquet(path)

    def stage(self, name: str) -> DataFrame:
        """The rows of a stage ('documents', 'elements', 'chunks') from the last ingest of each document."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
        last = self.spark.read.parquet(f"{self.folder}/documents").groupBy("doc_id").agg(F.max(F.col("batch").cast("string")).alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")

    def ingest(self, path: str) -> dict:
        """Parse, chunk, embed and store a file or every file of a folder; failed files are counted, not raised."""
        documents, elements = file_source.parse_path(self.spark, path)
        return self._ingest(documents, layout.reading_order(elements))

    def ingest_texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """The same for a table of texts."""
        documents = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.lit("text").alias("file_type"), F.lit("text").alias("parser_used"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<string>").alias("errors"))
        return self._ingest(documents, ordered_text_elements(docs, id_col, text_col))

    def _ingest(self, documents: DataFrame, ordered: DataFrame) -> dict:
        stats: dict = {}
        failed = F.coalesce(F.size("errors") > 0, F.lit(False))
        batch = f"b{time.time_ns():020d}"  # later ingests sort behind earlier ones
        documents = self._stage(documents, "documents", stats, batch)
        elements = self._stage(ordered, "elements", stats, batch)
        chunks = self._stage(self.chunker.chunks(elements, documents.where(~failed)), "chunks", stats, batch)
        data = F.create_map(F.lit("source"), F.col("doc_id"), F.lit("page_range"), F.concat_ws("-", "page_start", "page_end"), F.lit("heading"), F.coalesce("heading", F.lit("")))
        rows = chunks.select("chunk_id", "text", data.alias("metadata"))
        began = time.time()
        # A chunk's id holds its document's and its number there, so no two are alike.
        self.store.add(embed_column(rows, "text", self.embedder, **self.embedder_config), distinct=True)
        # Chunks that these documents had before and have no more.
        earlier = self.spark.read.parquet(f"{self.folder}/chunks").where(F.col("batch").cast("string") != batch).join(documents.select("doc_id"), "doc_id", "left_semi")
        self.store.delete(earlier.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
        stats["store_seconds"] = time.time() - began
        counts = documents.agg(F.count("*").alias("documents"), F.count_if(failed).alias("failed")).first()
        return stats | {"documents": counts["documents"], "failed": counts["failed"], "elements": elements.count(), "chunks": chunks.count()}

    def ask(self, questions: DataFrame, top_k: int = 5, filters: dict | None = None, style: str = "plain", temperature: float = 0.7, max_tokens: int = 512) -> DataFrame:
        """(query_id, question, answer, sources, retrieved_chunks) for questions(query_id, question)."""
        asked = embed_column(questions, "question", self.embedder, **self.embedder_config).withColumnRenamed("embedding", "query_embedding")
        hits = self.store.query_batch(asked, top_k, filters)
        found = rag.contexts(hits, self.store.read().select("chunk_id", "text", "metadata"))
        rows = rag.prompts(questions, found, style)
        answers = generate_column(rows, "prompt", self.generator, max_tokens, temperature, **self.generator_config)
        return answers.select("query_id", "question", "answer", "sources", "retrieved_chunks")

    def ask_one(self, question: str, **options) -> dict:
        row = self.ask(self.spark.createDataFrame([("q", question)], "query_id string, question string"), **options).first()
        return {"query": question, "answer": row["answer"], "sources": [s.asDict() for s in row["sources"] or []], "retrieved_chunks": row["retrieved_chunks"], "timestamp": time.time()}

    def statistics(self) -> DataFrame:
        """One row of settings and the number of stored chunks."""
        return self.store.read().agg(F.count("*").alias("document_count")).select(
            "document_count", F.lit(self.embedder).alias("embedder"), F.lit(self.dimension).alias("dimension"), F.lit("parquet").alias("vector_store"), F.lit(self.generator).alias("generator"),
            F.lit(self.chunker.strategy).alias("strategy"), F.lit(self.chunker.chunk_size).alias("chunk_size"), F.lit(self.chunker.chunk_overlap).alias("chunk_overlap"),
        )

    def clear(self) -> None:
        self.store.clear()

    def file_status(self) -> DataFrame:
        """(doc_id, file_type, status, errors, n_elements, n_chunks): what became of each document, 'ok' or 'failed'."""
        count = lambda name, to: self.stage(name).groupBy("doc_id").agg(F.count("*").alias(to))
        rows = self.stage("documents").join(count("elements", "n_elements"), "doc_id", "left").join(count("chunks", "n_chunks"), "doc_id", "left")
        failed = F.coalesce(F.size("errors") > 0, F.lit(False))
        none = F.lit(0).cast("long")
        return rows.select("doc_id", "file_type", F.when(failed, "failed").otherwise("ok").alias("status"), "errors", F.coalesce("n_elements", none).alias("n_elements"), F.coalesce("n_chunks", none).alias("n_chunks"))

    def export_documents(self, folder: str) -> DataFrame:
        """A JSON file for each ingested document and its chunks: ``parsed/<stem>.json`` and ``chunks/<stem>_chunks.json``; returns (doc_id, file)."""
        parsed = export.json_column(export.positioned(self.stage("documents"), self.stage("elements").drop("ro_pos")))
        parts = self.stage("chunks").groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "heading", "text", "page_start", "page_end")))).alias("json"))
        return export.write_files(parsed, f"{folder}/parsed", ".json").unionByName(export.write_files(parts, f"{folder}/chunks", "_chunks.json"))

    def export_layout(self, path: str, form: str = "json") -> None:
        """The ingested documents' layout as JSON lines or HTML texts."""
        elements = self.stage("elements").drop("ro_pos")
        if form == "json":
            export.write_json(export.positioned(self.stage("documents"), elements), path)
        elif form == "html":
            export.html_pages(elements).select("html").write.mode("overwrite").text(path, lineSep="\n")
        else:
            raise ValueError(f"unknown export format: {form}")

    def stage_statistics(self) -> DataFrame:
        """(doc_id, n_elements, n_chunks) of all ingested documents."""
        e = self.stage("elements").groupBy("doc_id").agg(F.count("*").alias("n_elements"))
        c = self.stage("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        return e.join(c, "doc_id", "left").select("doc_id", "n_elements", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"))
