"""The jobs as registered queries: each runs twice into a new folder and gives the whole output after the second run."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.operators.rag import INSTRUCTION
from lamina.queries import COSINE, SEMANTIC, _fold_sql
from lamina.runtime import shared_dir

from . import answer_prompts, chunk_documents


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the one that the cluster shares; its files stay."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


@contextmanager
def same_settings(spark: SparkSession):
    """The session's settings are afterwards what they were."""
    before = dict(spark.conf.getAll)
    try:
        yield
    finally:
        now = dict(spark.conf.getAll)
        for name in now.keys() | before.keys():
            if name not in before:
                spark.conf.unset(name)
            elif now.get(name) != before[name]:
                spark.conf.set(name, before[name])


def job1_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "chunk_documents")
    with same_settings(spark):
        for _ in range(2):
            chunk_documents.run(spark, f"{sf_dir}/documents.parquet", f"{out}/table", f"{out}/checkpoint")
    return chunk_documents.current(spark, f"{out}/table").select("doc_id", "lang", "chunk_no", "chunk_id", "text", "n_tokens", F.size("embedding").cast("long").alias("dimension"))


def job2_answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "answer_prompts")
    with same_settings(spark):
        for _ in range(2):
            answer_prompts.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", out)
    rows = answer_prompts.read(spark, out, answer_prompts.PROMPTS)
    return rows.select("query_id", "lang", "question", "prompt", "source_ids", F.transform("scores", lambda s: F.round(s, 6)).alias("scores"), "retrieved_chunks")


QUERIES = {f.__name__: f for f in (job1_chunk_documents, job2_answer_prompts)}

_QUOTED = INSTRUCTION.replace("'", "''").replace("\n", "' || chr(10) || '")

SQL = {
    "job1_chunk_documents": _fold_sql(SEMANTIC, 300, 2, True) + r""" , t AS (SELECT p.g, part, string_agg(el.content, chr(10) ORDER BY el.i) AS text FROM p JOIN el ON el.g = p.g AND el.i >= p.lo AND el.i < p.hi GROUP BY p.g, part)
SELECT t.g::VARCHAR AS doc_id, d.lang, part AS chunk_no, t.g || '-chunk-' || part AS chunk_id, t.text, len(regexp_extract_all(t.text, '\S+')) AS n_tokens, 64 AS dimension FROM t JOIN documents d ON d.doc_id = t.g""",
    "job2_answer_prompts": f"""WITH h AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 12) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
), c AS (
  SELECT query_id, string_agg(coalesce(d.text, ''), chr(10) || chr(10) ORDER BY rank) AS context,
    list(h.vec_id ORDER BY rank) AS source_ids, list(round(score, 6) ORDER BY rank) AS scores, count(*) AS n
  FROM h JOIN documents d ON d.doc_id = h.vec_id WHERE rank <= 3 GROUP BY query_id
), q AS (
  SELECT d.doc_id AS query_id, d.lang, 'What else is said about: ' || trim(split_part(coalesce(d.text, ''), chr(10), 1), ' ') AS question FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 100 = 0
)
SELECT q.query_id, q.lang, question, '{_QUOTED}Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' AS prompt,
  coalesce(source_ids, []) AS source_ids, coalesce(scores, []) AS scores, coalesce(n, 0) AS retrieved_chunks
FROM q LEFT JOIN c USING (query_id)""",
}
