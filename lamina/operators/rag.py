"""Retrieval answers: contexts, prompts, sources, and post-processing of what a model says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The wording of the prompts.
INSTRUCTION = (
    "You are an intelligent assistant that provides accurate information "
    "based on the provided context. Answer the question using only the information "
    "from the context. If you cannot find the answer in the context, say 'I don't have "
    "enough information to answer this question.' Don't make up information that "
    "isn't directly supported by the context.\n\n"
)


def prompt(question: Column, context: Column, style: str = "plain") -> Column:
    """A prompt with its context: 'plain', or 'inst' with instruction marks."""
    if style == "plain":
        return F.concat(F.lit(INSTRUCTION + "Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer: "))
    if style == "inst":
        return F.concat(F.lit("<s>[INST] " + INSTRUCTION + "Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit(" [/INST]"))
    raise ValueError(f"unknown prompt style: {style}")


def contexts(hits: DataFrame, texts: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, context, sources, retrieved_chunks) of ranked hits; texts(id, text[, metadata]) are joined on.

    Of texts that share an id the least one is taken, so a hit is never told twice.
    """
    data = F.col("metadata") if "metadata" in texts.columns else F.create_map().cast("map<string,string>")
    known = texts.join(hits.select(id_col).distinct(), id_col, "left_semi")
    known = known.groupBy(id_col).agg(F.min("text").alias("text"), F.min_by(data, "text").alias("metadata"))
    rows, data = hits.join(known, id_col), F.col("metadata")
    each = F.struct("rank", F.col("text"), F.col("score"), F.col(id_col).cast("string").alias("chunk_id"), data["source"].alias("source"), data["page_range"].alias("page_range"))
    grouped = rows.groupBy(query_id).agg(F.array_sort(F.collect_list(each)).alias("h"))
    return grouped.select(
        query_id, F.array_join(F.transform("h", lambda x: x["text"]), "\n\n").alias("context"),
        F.transform("h", lambda x: F.struct(x["score"], x["chunk_id"], x["source"], x["page_range"])).alias("sources"), F.size("h").cast("long").alias("retrieved_chunks"),
    )


def prompts(questions: DataFrame, found: DataFrame, style: str = "plain", query_id: str = "query_id", question: str = "question") -> DataFrame:
    """(query_id, question, prompt, sources, retrieved_chunks); a question without hits has an empty context."""
    rows = questions.join(found, query_id, "left")
    context = F.coalesce("context", F.lit(""))
    return rows.select(query_id, question, prompt(F.col(question), context, style).alias("prompt"), "sources", F.coalesce("retrieved_chunks", F.lit(0).cast("long")).alias("retrieved_chunks"))


def trimmed_answer(raw: Column, given: Column | None = None, stops: tuple[str, ...] = ()) -> Column:
    """An answer without the prompt in front, without the stop sequence it ends in, stripped."""
    from ..functions.text import strip

    out = raw
    if given is not None:
        out = F.when(F.startswith(raw, given), F.substring(raw, F.length(given) + 1, F.length(raw))).otherwise(raw)
    for stop in stops:
        out = F.when(out.endswith(stop), F.left(out, F.length(out) - F.lit(len(stop)))).otherwise(out)
    return strip(out)
