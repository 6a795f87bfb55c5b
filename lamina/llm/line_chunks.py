"""Line dedup by content-defined line chunks (native).

1. Lines (``\\n``-split, whole) are hashed; those that stand in the corpus once
   only can be in no repeated chunk, so runs of repeated lines end there.
2. A rolling hash runs over the hashes of every two neighbouring lines of a run.
   A chunk ends between two lines whose pair stands in the corpus once; whose
   pair is rarer than another pair that either line is in; or whose rolling hash
   is divisible by ``divisor``.  All three depend on the two lines and the corpus
   alone, never on what else surrounds them, so a passage has the same ends in
   every document, shifted, quoted in part or beside other repeated lines.
3. Chunks of at least ``min_lines`` lines with a word and ``min_words`` words, or
   of ``line_words`` words, are compared byte for byte, grouped on their text; a
   shorter one is compared joined to the chunk after it, and to that before it.
   Of each, the first occurrence (least id, then position) stays; the lines of
   the others go.

``make=passages`` compares all short passages of repeated lines in place of the
chunks of step 2: the shortest from each line on, and back from each line, that
are long enough by step 3.  They cover every longer passage, so each line of a
repeated passage goes from all places but the first.

Minima are aggregated before each shuffle and joined back to a written table,
so a line or chunk of very many documents is split over tasks.

Edge cases: null texts come back null, empty ones empty; lines without a word
end no run, count for nothing and stay at a chunk's edges; rows equal in id and text are one
document and all keep the same lines; rows that share an id only are documents
of their own; null ids sort first; other columns are kept as they are, but one
that has the name of the count (``count_col``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import ship
from .common import WORD, bound, materialize

DIVISOR = 8
MIN_LINES, MIN_WORDS = 2, 10
#: Words on one line that make it a passage of its own.
LINE_WORDS = 50
#: Tasks that share the pairs of one line.
SALTS = 16
#: Line hashes: 31 bits of MD5, so SQL can follow them.
MODULUS = 1 << 31
FACTOR = 31


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % MODULUS


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, pos, line) of every document; identical rows once."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.select("id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(id, text_key, pos, words, hash, line_key): the lines that stand in the corpus at least twice."""
    words = F.regexp_count("line", F.lit(WORD))
    keyed = lines.select("id", "text_key", "pos", F.xxhash64("line", F.lit(1)).alias("line_key"), line_hash(F.col("line")).alias("hash"), words.alias("words"))
    # Written, as the texts would else be cut into lines twice.
    keyed = materialize(keyed, "lines")
    counts = keyed.where("words > 0").groupBy("line_key").agg(F.count("*").alias("n"))
    common = materialize(counts.where("n > 1").select("line_key"), "common")
    blank = keyed.where(F.col("words") == 0)
    return keyed.where(F.col("words") > 0).join(common, "line_key", "left_semi").unionByName(blank)


def runs(lines: DataFrame) -> DataFrame:
    """The repeated lines with a word, each with the ``run`` of its document that it stands in."""
    in_doc = Window.partitionBy("id", "text_key").orderBy("pos")
    rows = lines.dropDuplicates(["id", "text_key", "pos"])
    rows = rows.withColumn("gap", F.coalesce((F.col("pos") - F.lag("pos").over(in_doc) > 1), F.lit(False)))
    return rows.withColumn("run", F.sum(F.col("gap").cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0))).where("words > 0")


def pair_ends(rows: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(pair, ends): the pairs of neighbouring lines that stand in the corpus twice, and whether a chunk ends between them."""
    rolled = (F.col("hash") * FACTOR + F.col("before_hash")) % MODULUS % divisor == 0
    pairs = rows.where("before is not null").groupBy("pair").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("line_key").alias("line_key"), F.first(rolled).alias("rolled"))
    pairs = materialize(pairs.where("n > 1"), "pairs")
    most = pairs.select(F.explode(F.array("before", "line_key")).alias("line"), "n").groupBy("line").agg(F.max("n").alias("most"))
    # A common line is in very many pairs, so its maximum goes to SALTS tasks.
    most = most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    side = lambda c: most.select(F.col("line").alias(c), "salt", F.col("most").alias(f"most_{c}"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("pair", F.lit(3)), F.lit(SALTS)).cast("int"))
    both = salted.join(side("before"), ["before", "salt"]).join(side("line_key"), ["line_key", "salt"])
    return both.select("pair", (F.col("rolled") | (F.col("n") < F.greatest("most_before", "most_line_key"))).alias("ends"))


def chunks(lines: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(id, text_key, first, last, chunk_key): chunks of runs of repeated lines."""
    in_run = Window.partitionBy("id", "text_key", "run").orderBy("pos")
    rows = runs(lines).withColumns({"before": F.lag("line_key").over(in_run), "before_hash": F.lag("hash").over(in_run)})
    # The first line of a run gets a key of its own, so such lines don't meet in one task.
    rows = materialize(rows.withColumn("pair", F.coalesce(F.when(F.col("before").isNotNull(), F.xxhash64("before", "line_key")), F.xxhash64("id", "text_key", "pos", F.lit(2)))), "runs")
    known = materialize(pair_ends(rows, divisor), "ends")
    rows = rows.select("id", "text_key", "run", "pos", "words", "line_key", "pair").join(known, "pair", "left")
    upto = in_run.rowsBetween(Window.unboundedPreceding, 0)
    # A stretch ends where a pair stands once; only inside it are chunks joined.
    rows = rows.withColumns({"stretch": F.sum(F.col("ends").isNull().cast("int")).over(upto), "part": F.sum(F.coalesce("ends", F.lit(True)).cast("int")).over(upto)})
    parts = rows.groupBy("id", "text_key", "run", "stretch", "part").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.sum("words").alias("words"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line_key"))), lambda x: x["line_key"]).alias("keys"),
    )
    held = F.struct("first", "last", "n", "words", "keys")
    in_stretch = Window.partitionBy("id", "text_key", "run", "stretch").orderBy("part")
    parts = parts.select("id", "text_key", held.alias("own"), F.lag(held).over(in_stretch).alias("prior"), F.lead(held).over(in_stretch).alias("next"))
    long_enough = lambda n, words: ((n >= min_lines) & (words >= min_words)) | (words >= line_words)
    chunk = lambda a, b, keys: F.struct(a["first"].alias("first"), b["last"].alias("last"), F.xxhash64(keys).alias("chunk_key"))
    both = lambda a, b: F.when(long_enough(a["n"] + b["n"], a["words"] + b["words"]), chunk(a, b, F.concat(a["keys"], b["keys"])))
    own, prior, later = F.col("own"), F.col("prior"), F.col("next")
    made = F.when(long_enough(own["n"], own["words"]), F.array(chunk(own, own, own["keys"]))).otherwise(F.array(both(own, later), both(prior, own)))
    return parts.select("id", "text_key", F.explode(made).alias("c")).where("c is not null").select("id", "text_key", "c.*")


def passages(lines: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(id, text_key, first, last, chunk_key): the shortest passages from and back from each repeated line."""
    in_run = Window.partitionBy("id", "text_key", "run").orderBy("pos")
    rows = runs(lines).withColumn("upto", F.sum("words").over(in_run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("no", F.row_number().over(in_run))
    # Every line has a word, so no shortest passage has more lines than this.
    most = max(min_lines, min_words)
    rows = rows.withColumn("next", F.collect_list(F.struct("pos", "no", "upto", "line_key")).over(in_run.rowsBetween(0, most - 1)))
    words = lambda x: x["upto"] - F.col("upto") + F.col("words")
    whole = lambda x: (words(x) >= line_words) | ((x["no"] - F.col("no") + 1 >= min_lines) & (words(x) >= min_words))
    rows = rows.withColumn("end", F.get(F.filter("next", whole), F.lit(0))["no"])
    # Back from a line the shortest passage begins at the last line whose own passage ends by then.
    rows = rows.withColumn("later", F.lead("end").over(in_run)).where("end is not null")
    ends = F.filter("next", lambda x: (x["no"] == F.col("end")) | ((x["no"] > F.col("end")) & (F.col("later").isNull() | (x["no"] < F.col("later")))))
    found = rows.select("id", "text_key", F.col("pos").alias("first"), "no", "next", F.explode(ends).alias("x"))
    keys = F.transform(F.slice("next", F.lit(1), F.col("x.no") - F.col("no") + 1), lambda x: x["line_key"])
    return found.select("id", "text_key", "first", F.col("x.pos").alias("last"), F.xxhash64(keys).alias("chunk_key"))


def merged(spans: DataFrame) -> DataFrame:
    """(id, text_key, first, last): line ranges that overlap or touch as one."""
    in_doc = Window.partitionBy("id", "text_key").orderBy("first", "last")
    rows = spans.withColumn("reach", F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.coalesce((F.col("first") > F.col("reach") + 1).cast("int"), F.lit(0))).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("id", "text_key", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make=chunks, **options) -> DataFrame:
    """(id, text_key, first, last): the line ranges to remove, after byte comparison."""
    found = materialize(make(repeated_lines(document_lines(docs, id_col, text_col)), **options), "chunks")
    often = found.groupBy("chunk_key").agg(F.count("*").alias("n")).where("n > 1").select("chunk_key")
    again = found.join(materialize(often, "often"), "chunk_key", "left_semi")
    spans = again.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last", "chunk_key")).alias("spans"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    # The marked documents have no bound, so texts meet them by a shuffle at every size.
    joined = texts.join(spans.hint("merge"), texts.id.eqNullSafe(spans.id) & (texts.text_key == spans.text_key)).select(texts.id, texts.text_key, F.split("text", "\n", -1).alias("lines"), "spans")
    body = joined.select("id", "text_key", "lines", F.explode("spans").alias("s")).select(
        "id", "text_key", "s.first", "s.last", "s.chunk_key",
        F.array_join(F.slice("lines", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1), "\n").alias("body"),
    )
    body = materialize(body, "bodies")
    place = F.struct("id", "text_key", "first")
    kept = body.groupBy("chunk_key", "body").agg(F.min(place).alias("keep"), F.max(place).alias("top"))
    kept = materialize(kept.where("keep <> top").select("chunk_key", "body", "keep"), "kept")
    hit = body.join(kept, ["chunk_key", "body"]).where(~F.struct("id", "text_key", "first").eqNullSafe(F.col("keep")))
    return merged(hit.select("id", "text_key", "first", "last"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_lines_removed", **options) -> DataFrame:
    """``docs`` with the repeated chunks' lines taken out of the text, and ``count_col`` (long), the lines taken out."""
    ship(docs.sparkSession)
    gone = repeated_chunks(docs, id_col, text_col, **options)
    flat = gone.distinct().groupBy(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone_spans"))
    flat = materialize(flat, "gone")
    # The input's columns travel in one struct, so none of their names can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    joined = keyed.join(flat.hint("merge"), keyed.id.eqNullSafe(flat.gone_id) & (keyed.text_key == flat.gone_key), "left").select("row", "gone_spans")
    text = F.col("row").getField(text_col)
    # The ranges are apart and in order, so what stays are the slices between them.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone_spans", lambda s: s["last"] + 1))
    stops = lambda lines: F.concat(F.transform("gone_spans", lambda s: s["first"]), F.array(F.size(lines)))
    between = lambda lines: F.flatten(F.zip_with(starts, stops(lines), lambda a, b: F.slice(lines, a + 1, b - a)))
    left = F.array_join(bound(F.split(text, "\n", -1), between), "\n")
    removed = F.aggregate("gone_spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"] + 1).cast("long"))
    none = F.col("gone_spans").isNull()
    columns = [F.when(none, text).otherwise(left).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != count_col]
    return joined.select(*columns, F.when(none, F.lit(0).cast("long")).otherwise(removed).alias(count_col))
