"""Mixing sources to target weights by a low-discrepancy schedule (native).

The mix is a sequence of slots of ``block`` words.  Slot i's golden-ratio point
falls into one source's share of [0, 1); the source's slots are ranked, and rank
r takes its block ``r mod blocks``.  A source's documents, in the order of a hash
of their id, form one stream of words that the blocks cut evenly.  Only integers
enter the schedule, so reruns agree.

Ranks and stream offsets are running sums in two levels (inside buckets, then
over the buckets' totals), so no source is ever gathered in one task.

Edge cases: a null text has size 0 and is never taken; a null source is a source
of its own, last in order; rows with equal ids are documents of their own; an
empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import ship
from .common import WORD, materialize

BLOCK_WORDS = 1024
#: At most so many uses of a document.
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: 2^31 / golden ratio, made odd: slot i's point is (i * STEP mod 2^31) / 2^31.
STEP, MODULUS = 1327217885, 1 << 31
CELLS = 4096
SLOT_CHUNK = 8192


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, place): words of each document, and its place in the shuffled order."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    place = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), place.alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_no, source_size, target) by water-filling.

    A source's target is ``min(repeats * size, level * weight)``; the level comes
    from the sources in the order of size per weight.  One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    # The level if just the sources before this one stop at their caps.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    per = per.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # Levels rise up to the first source that doesn't stop, and fall from there.
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.withColumn("target", target).select("source", F.col("source_no").cast("long").alias("source_no"), "source_size", "target", "cap")


def slots(table: DataFrame, n_slots: int, block: int = BLOCK_WORDS, repeats: int = REPEATS) -> DataFrame:
    """(slot, source_no, rank, block_no): the schedule of ``n_slots`` slots.

    Shares become integer bounds on the points' scale; points and shares meet by
    an equi-join on cells of that scale.
    """
    spark = table.sparkSession
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    ends = table.where(F.col("target") > 0).withColumn("high", F.round(F.sum("target").over(upto) / total * MODULUS).cast("long"))
    ends = ends.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0).cast("long")))
    ends = ends.withColumn("blocks", F.ceil(F.col("source_size") / block)).where(F.col("high") > F.col("low"))
    width = MODULUS // CELLS
    cells = ends.select("source_no", "blocks", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"((id % {MODULUS}) * {STEP}) % {MODULUS}").alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    hit = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    hit = hit.select("slot", "source_no", "blocks", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = hit.withColumn("within", F.row_number().over(inner) - 1).join(counts, ["source_no", "chunk"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within"))
    # A share's points exceed it by a few at most; what would be a use too many is left out.
    return ranked.where(F.col("rank") < repeats * F.col("blocks")).select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"))


def pieces(sizes: DataFrame, table: DataFrame, block: int = BLOCK_WORDS, digits: int = 2) -> DataFrame:
    """(source_no, block_no, doc_id, size, start, from_word, n_words): documents cut at block ends.

    ``start`` is the document's first word in its source's stream, so
    (source_no, start) names a row even where ids repeat.
    """
    rows = sizes.where(F.col("size") > 0).join(table.select("source", "source_no"), sizes.source.eqNullSafe(table.source)).select("source_no", "doc_id", "size", "place")
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("source_no").orderBy("bucket"))), F.lit(0)).alias("base"))
    inner = earlier(Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size"))
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(buckets, ["source_no", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("within"))
    cut = rows.select("source_no", "doc_id", "size", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block_no"))
    low, high = F.greatest(F.col("start"), F.col("block_no") * block), F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    return cut.select("source_no", "block_no", "doc_id", "size", "start", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, repeats: int = REPEATS, weights=WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(slots, pieces, sizes, targets) of the mix; the block defaults to a hundred-thousandth of all words, 16 to 1024."""
    ship(docs.sparkSession)
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    table = materialize(targets(sizes, weights, repeats), "targets")
    words, rows = table.agg(F.sum("source_size")).first()[0] or 0, sizes.count()
    block = block or max(16, min(BLOCK_WORDS, words // 100_000))
    digits = max(1, min(8, (rows // 2000).bit_length() // 4 + 1))  # about 2,000 documents a bucket, if one source had all
    return slots(table, -(-words // block), block, repeats), pieces(sizes, table, block, digits), sizes, table


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (slot, source_no, rank, block_no, doc_id, size, start, from_word, n_words).

    A row for every piece of a document in every slot that takes it; read in the
    order (slot, start).
    """
    order, cut, _, _ = schedule(docs, **options)
    return order.join(cut, ["source_no", "block_no"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words the mix takes of each document."""
    order, cut, sizes, table = schedule(docs, **options)
    uses = order.groupBy("source_no", "block_no").agg(F.count("*").alias("uses"))
    held = cut.join(uses, ["source_no", "block_no"], "left")
    held = held.groupBy("source_no", "start", "doc_id", "size").agg(F.sum(F.col("n_words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    facts = table.select("source", "source_no", "source_size", "target")
    with_words = held.join(facts, "source_no").select("doc_id", "source", "size", "source_size", "target", "taken")
    empty = sizes.where(F.col("size") == 0)
    without = empty.join(facts, empty.source.eqNullSafe(facts.source)).select("doc_id", empty.source, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without)


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = REPEATS, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, to the nearest whole time.

    Rows equal in id, source and size share their copies evenly.
    """
    sums = taken(docs, id_col=id_col, text_col=text_col, source_col=source_col, repeats=repeats, **options)
    sums = sums.groupBy(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size")).agg((F.sum("taken") / F.count("*")).alias("taken"))
    sums = materialize(sums.where((F.col("of_size") > 0) & (F.col("taken") * 2 >= F.col("of_size"))), "taken")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    hit = rows.join(sums, rows.id.eqNullSafe(sums.of_id) & rows.source.eqNullSafe(sums.of_source) & (rows["size"] == sums.of_size))
    times = F.least(F.lit(repeats), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    return hit.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
