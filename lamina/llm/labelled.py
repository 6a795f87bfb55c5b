"""A bounded, deterministic sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, prior): of each label, the rows whose id has the least hashes.

    ``per_class`` bounds the rows of each label; ``prior`` is the share of the
    label among all usable rows.  Rows with a null id, label or text are no use;
    an id with several labels takes its largest, with several texts each.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(*per_class) & usable)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(target).cast("int").alias("label"))
    counts = dict(rows.groupBy("label").count().collect())
    total = max(1, sum(counts.values()))
    parts = [
        rows.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(n).withColumn("prior", F.lit(counts.get(c, 0) / total))
        for c, n in sorted(per_class.items())
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most sum(per_class) rows of four small columns: a broadcast of a fixed bound.
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label", "prior")


def bounded(rows: list[tuple], most: int) -> list[tuple]:
    """The (order, text, label) of ``rows`` whose texts fit into ``most``; one that doesn't is passed over.

    Each label has an equal share of ``most``, and what others leave of theirs.
    """
    sizes: dict = {}
    for _, text, label in rows:
        sizes[label] = sizes.get(label, 0) + len(text)
    room, left = {}, most
    for k, (size, label) in enumerate(sorted((n, c) for c, n in sizes.items())):
        room[label] = min(size, left // (len(sizes) - k))
        left -= room[label]
    kept = []
    for row in rows:
        if len(row[1]) <= room[row[2]]:
            room[row[2]] -= len(row[1])
            kept.append(row)
    return kept
