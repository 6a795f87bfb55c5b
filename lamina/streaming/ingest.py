"""Continuous ingest of new text rows into a chunk table (beyond what is asked of batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import layout
from ..operators.chunking import Chunker
from ..operators.embedding import embed_column
from ..sources.text import text_elements


def stream_chunks(docs: DataFrame, out: str, checkpoint: str, chunker: Chunker | None = None, id_col: str = "doc_id", text_col: str = "text", embedder: str = "hashing", once: bool = False) -> StreamingQuery:
    """Append chunks and vectors of each micro-batch's documents under ``out``/batch=<n>.

    A batch overwrites its own folder, so a replay after a failure writes the same rows once.
    """
    made = chunker or Chunker()

    def write(batch: DataFrame, number: int) -> None:
        chunks = made.chunks(layout.single_line_order(text_elements(batch, id_col, text_col, special=False)))
        embed_column(chunks, "text", embedder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
