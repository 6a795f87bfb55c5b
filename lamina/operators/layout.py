"""Layout: reading order, sections, columns, clusters, alignment and relations of boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import boxes
from ..runtime import ship
from .ordered import sorted_documents, spans, whole_documents

LINE_TOLERANCE, CLUSTER_GAP, BINS = 5.0, 50.0, 50
#: Boxes or questions of one place that travel as one row.
GATHERED = 256


def reading_order(elements: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """``elements`` with ro_pos: per page from top to bottom in lines, and along each line.

    A line takes boxes, by (y0, x0), whose centre is within the tolerance of the
    centre of the line's first box.  A box whose centre lies more than that below
    all centres before it on its page starts a line for certain; where all boxes
    up to the next such start are near it, they are its line, and windows number
    the document.  Only documents that hold other boxes are folded, one box after
    the other.  Rows equal in place and ``pos`` are numbered each.
    """
    names = [c for c in elements.columns if c != "ro_pos"]
    # One exchange serves both ways; the columns travel in a struct, so none of their names can clash.
    rows = elements.select(F.struct(*names).alias("row"), "doc_id", "page", "y0", "x0", "pos", boxes.center_y().alias("cy")).repartition("doc_id")
    on_page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "pos")
    before = on_page.rowsBetween(Window.unboundedPreceding, -1)
    upto = on_page.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.col("cy").isNull() | F.lag("cy").over(on_page).isNull() | (F.col("cy") > F.max("cy").over(before) + tolerance)
    rows = rows.withColumn("apart", apart)
    start = F.last(F.when(F.col("apart"), F.struct("cy")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"line": F.sum(F.col("apart").cast("int")).over(upto), "start": start})
    loose = F.coalesce(F.abs(F.col("cy") - F.col("start.cy")) > tolerance, F.lit(False))
    rows = rows.withColumn("loose", F.max(loose).over(Window.partitionBy("doc_id")))
    along = Window.partitionBy("doc_id").orderBy("page", "line", "x0", "y0", "pos")
    plain = rows.where(~F.col("loose")).select("row.*", (F.row_number().over(along) - 1).cast("int").alias("ro_pos"))
    return plain.unionByName(_folded_order(rows.where("loose"), names, elements, tolerance))


def _folded_order(rows: DataFrame, names: list[str], elements: DataFrame, tolerance: float) -> DataFrame:
    """The same by a fold over whole documents in Arrow batches, in time linear in their boxes."""
    ship(elements.sparkSession)
    keys = sorted_documents(rows.select("row", "doc_id", "page", "y0", "x0", "pos", "cy"), "page", "y0", "x0", "pos", dealt=True)

    def run(batches):
        for batch in whole_documents(batches, 1):
            ids, pages, tops, lefts, places, centres = [batch.column(k).to_pylist() for k in range(1, 7)]
            ranks = np.empty(len(ids), dtype=np.int32)
            for a, b in spans(ids):
                start = a
                for k in range(a + 1, b + 1):
                    if k < b and pages[k] == pages[start] and None not in (centres[k], centres[start]) and abs(centres[k] - centres[start]) <= tolerance:
                        continue
                    line = range(start, k) if k - start < 2 else sorted(range(start, k), key=lambda i: [(v is not None, v) for v in (lefts[i], tops[i], places[i])])  # noqa: B023
                    ranks[line] = np.arange(start - a, k - a)
                    start = k
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(ranks)], names=[*names, "ro_pos"])

    kinds = ", ".join(f"`{c}` {elements.schema[c].dataType.simpleString()}" for c in names)
    return keys.mapInArrow(run, f"{kinds}, ro_pos int")


def single_line_order(elements: DataFrame) -> DataFrame:
    """The same for sources that put one element on a line (no two centres within the tolerance): a window alone."""
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "pos")
    return elements.withColumn("ro_pos", (F.row_number().over(w) - 1).cast("int"))


def relationships(elements: DataFrame) -> DataFrame:
    """(doc_id, parent_id, child_id, child_ord): what follows each heading up to the next, by (page, y0, x0)."""
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "pos")
    heading = F.col("element_type") == "heading"
    rows = _with_heading(elements, w, heading)
    return rows.where(~heading & F.col("parent").isNotNull()).select("doc_id", F.col("parent").alias("parent_id"), F.col("element_id").alias("child_id"), (F.col("place") - F.col("top") - 1).cast("int").alias("child_ord"))


def _with_heading(elements: DataFrame, w, heading) -> DataFrame:
    placed = elements.withColumn("place", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({"parent": F.last(F.when(heading, F.col("element_id")), ignorenulls=True).over(upto), "top": F.last(F.when(heading, F.col("place")), ignorenulls=True).over(upto)})


def sections(ordered: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, page, x0, y0, x1, y1, n_parts, content): headings with the texts that follow, in reading order."""
    w = Window.partitionBy("doc_id").orderBy("ro_pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("element_type") == "heading"
    rows = ordered.where(F.col("ro_pos").isNotNull()).withColumn("section_no", F.sum(heading.cast("int")).over(w)).where("section_no > 0")
    head = F.max(F.when(heading, F.struct("content", "page", "x0", "y0", "x1", "y1")))
    body = F.array_sort(F.collect_list(F.when(F.col("element_type").isin("text", "paragraph"), F.struct("ro_pos", "content"))))
    out = rows.groupBy("doc_id", "section_no").agg(head.alias("h"), F.transform(body, lambda x: x["content"]).alias("parts"))
    return out.select("doc_id", (F.col("section_no") - 1).cast("int").alias("section_no"), F.col("h.content").alias("title"), "h.page", "h.x0", "h.y0", "h.x1", "h.y1", F.size("parts").cast("long").alias("n_parts"), F.array_join("parts", "\n").alias("content"))


def titles(elements: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading in document order."""
    rows = elements.where(F.col("element_type") == "heading").groupBy("doc_id").agg(F.min(F.struct("pos", "content")).alias("h"))
    return rows.select("doc_id", F.col("h.content").alias("title"))


def _gathered(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, block, members): ``member`` of rows equal in ``keys``, about ``GATHERED`` in an array; more of them have several blocks."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / GATHERED).alias("parts"))
    dealt = rows.join(parts, keys).withColumn("block", F.pmod(F.xxhash64(member), F.col("parts")))
    return dealt.groupBy(*keys, "block").agg(F.collect_list(member).alias("members"))


def pairs(elements: DataFrame, kind: str | None = None) -> DataFrame:
    """Pairs of a page's boxes (a before b in document order): overlap, nesting and adjacency, each where it holds.

    ``kind`` (overlapping, nested or adjacent): pairs of that kind alone.

    Boxes of one place are compared once: they travel as blocks of a bounded number
    of boxes, and a pair of blocks becomes pairs of boxes where it is given out, so
    copies cost the rows that they give and no more.  A box can relate only to boxes near it.
    It has a level, the power of two above its longer side, and on the grid of its
    level it lies in four cells at most.  Blocks meet level by level, by an equi-join
    on (doc_id, page, level, cell): the larger one holds its own cells, the smaller
    one looks up those it lies in on each coarser grid that its page has.  So a table
    as wide as a sheet costs four cells, whatever stands inside it.  Boxes without a
    place take no part.
    """
    reach, least = 10.0, 6  # cells of 64 units at least
    sides = ("x0", "y0", "x1", "y1")
    rows = elements.select("doc_id", "page", *sides, F.struct("pos", "element_id").alias("member")).where(" and ".join(f"{c} is not null" for c in (*sides, "pos")))
    rows = _gathered(rows, ["doc_id", "page", *sides], "member")
    longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * reach
    level = F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(longest, F.lit(1.0))))).cast("int")
    rows = rows.withColumn("level", level)
    present = rows.groupBy("doc_id", "page").agg(F.collect_set("level").alias("levels"))
    cells = lambda lo, hi, pad, at: F.sequence(F.floor((F.col(lo) - pad) / at), F.floor((F.greatest(F.col(lo), F.col(hi)) + pad) / at))

    def side(prefix: str, df: DataFrame, pad: float) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col("on"))
        df = df.withColumn("cx", F.explode(cells("x0", "x1", pad, size))).withColumn("cy", F.explode(cells("y0", "y1", pad, size)))
        return df.select("doc_id", "page", "on", "cx", "cy", *[F.col(c).alias(prefix + c) for c in ("members", "block", "level", *sides)])

    large = side("l_", rows.withColumn("on", F.col("level")), reach)
    small = side("s_", rows.join(present, ["doc_id", "page"]).withColumn("on", F.explode(F.filter("levels", lambda x: x >= F.col("level")))), 0.0)
    # Of blocks of one level the lesser one holds, each its own; a pair is taken in the first cell that both lie in.
    place = lambda p: F.struct(*[F.col(p + c) for c in (*sides, "block")])
    order = (F.col("s_level") < F.col("l_level")) | (place("l_") <= place("s_"))
    first = lambda lo, c: F.floor(F.greatest(F.col(f"l_{lo}") - reach, F.col(f"s_{lo}")) / F.pow(F.lit(2.0), F.col("on"))) == F.col(c)
    met = large.join(small, ["doc_id", "page", "on", "cx", "cy"]).where(order & first("x0", "cx") & first("y0", "cy"))
    met = met.select(
        "doc_id", "page", "l_members", "s_members", (place("l_") == place("s_")).alias("own"), boxes.overlaps("l_", "s_").alias("overlapping"), boxes.adjacent("l_", "s_", reach).alias("adjacent"),
        boxes.contains("l_", "s_").alias("l_nested"), boxes.contains("s_", "l_").alias("s_nested"), boxes.adjacency_type("l_", "s_").alias("l_type"), boxes.adjacency_type("s_", "l_").alias("s_type"),
    )
    wanted = {"overlapping": "overlapping", "nested": "l_nested or s_nested", "adjacent": "adjacent"}
    met = met.where(wanted[kind] if kind else " or ".join(wanted.values()))
    each = met.withColumn("l", F.explode("l_members")).drop("l_members").withColumn("s", F.explode("s_members")).drop("s_members")
    ahead = F.col("l.pos") < F.col("s.pos")
    each = each.where(ahead | ((F.col("l.pos") > F.col("s.pos")) & ~F.col("own")))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    out = each.select("doc_id", "page", pick("l.element_id", "s.element_id").alias("element1"), pick("s.element_id", "l.element_id").alias("element2"), pick("l.pos", "s.pos").alias("pos1"), pick("s.pos", "l.pos").alias("pos2"), "overlapping", pick("l_nested", "s_nested").alias("nested"), "adjacent", pick("l_type", "s_type").alias("adjacency_type"))
    return out.where(kind or "overlapping or nested or adjacent")


def overlapping(elements: DataFrame) -> DataFrame:
    kind = F.when(F.col("nested"), "contains").otherwise("intersects")
    return pairs(elements, "overlapping").select("doc_id", "page", "element1", "element2", kind.alias("overlap_type"))


def nested(elements: DataFrame) -> DataFrame:
    return pairs(elements, "nested").select("doc_id", "page", F.col("element1").alias("parent"), F.col("element2").alias("child"))


def adjacent(elements: DataFrame) -> DataFrame:
    return pairs(elements, "adjacent").select("doc_id", "page", "element1", "element2", "adjacency_type")


def alignment_groups(elements: DataFrame) -> DataFrame:
    """(doc_id, alignment, coordinate, element_ids): centres that snap to one multiple of 5, across pages, two or more."""

    def one(name: str, center) -> DataFrame:
        rows = elements.groupBy("doc_id", boxes.snapped(center).alias("coordinate")).agg(F.array_sort(F.collect_list(F.struct("pos", "element_id"))).alias("g"))
        return rows.where(F.size("g") > 1).select("doc_id", F.lit(name).alias("alignment"), "coordinate", F.transform("g", lambda x: x["element_id"]).alias("element_ids"))

    return one("horizontal", boxes.center_y()).unionByName(one("vertical", boxes.center_x()))


def x_clusters(elements: DataFrame, gap: float = CLUSTER_GAP) -> DataFrame:
    """(doc_id, page, cluster, n, low, high): centres in x, a new cluster where the gap to the one before is above ``gap``."""
    rows = elements.select("doc_id", "page", "pos", boxes.center_x().alias("cx"))
    w = Window.partitionBy("doc_id", "page").orderBy("cx", "pos")
    rows = rows.withColumn("new", F.coalesce((F.col("cx") - F.lag("cx").over(w) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "page", "cluster").agg(F.count("*").alias("n"), F.min("cx").alias("low"), F.max("cx").alias("high"))


def reading_flow(elements: DataFrame) -> DataFrame:
    """(doc_id, page, flow_type, confidence) from the number of clusters; unknown below three elements."""
    rows = x_clusters(elements).groupBy("doc_id", "page").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    kind = F.when(F.col("n") < 3, "unknown").when(F.col("k") == 1, "single_column").when(F.col("k") == 2, "two_column").otherwise("multi_column")
    sure = F.when(F.col("n") < 3, 0.0).when(F.col("k") == 1, 0.9).when(F.col("k") == 2, 0.8).otherwise(0.7)
    return rows.select("doc_id", "page", kind.alias("flow_type"), sure.alias("confidence"))


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """(keys, bin, n, edge): equal bins over each group's range, the last closed, empty ones included; a single value gets +-0.5."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = values.join(ends, keys).select(*keys, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int").alias("bin"))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / bins)
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), edge.alias("edge"))


def detect_columns(elements: DataFrame) -> DataFrame:
    """(doc_id, page, column, n): elements by column; columns lie between peaks of the histogram of left and right edges.

    A peak is a bin above both neighbours and above the mean; below two peaks
    a page is one column.  Columns without elements are left out, the others numbered from 0.
    """
    keys = ["doc_id", "page"]
    ends = elements.select(*keys, F.explode(F.array("x0", "x1")).alias("x"))
    w = Window.partitionBy(*keys).orderBy("bin")
    bars = histogram(ends, keys, "x").withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w), "mean": F.avg("n").over(Window.partitionBy(*keys))})
    peaks = bars.where((F.col("n") > F.col("before")) & (F.col("n") > F.col("after")) & (F.col("n") > F.col("mean"))).groupBy(*keys).agg(F.array_sort(F.collect_list("edge")).alias("peaks"))
    rows = elements.select(*keys, boxes.center_x().alias("cx")).join(peaks, keys, "left")
    place = F.when(F.size("peaks") >= 2, F.size(F.filter("peaks", lambda p: p < F.col("cx")))).otherwise(0)
    counts = rows.groupBy(*keys, F.coalesce(place, F.lit(0)).alias("place")).agg(F.count("*").alias("n"))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1).cast("int")
    return counts.select(*keys, number.alias("column"), "n")


def spatial_context(elements: DataFrame, regions: DataFrame, radius: float = 100.0) -> DataFrame:
    """(query_id, doc_id, element_id, pos, distance, rank) of elements whose centres lie within ``radius`` of a region's.

    regions(query_id, doc_id, page, x0, y0, x1, y1); centres meet by an
    equi-join on grid cells of the radius.  Queries whose centres are the same are
    asked and ranked once for a bounded number of them, and given out last.
    """
    e = elements.select("doc_id", "page", "element_id", "pos", *[F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")])
    e = e.withColumn("gx", F.floor(boxes.center_x("e_") / radius)).withColumn("gy", F.floor(boxes.center_y("e_") / radius))
    at = F.struct("doc_id", "page", *[F.col(c).alias(f"q_{c}") for c in ("x0", "y0", "x1", "y1")])
    asked = regions.groupBy("query_id").agg(F.array_sort(F.collect_list(at)).alias("places"))
    # Ids may be null, so they are wrapped; a block is known by its least one.
    asked = _gathered(asked.withColumn("asker", F.struct("query_id")), ["places"], "asker").withColumn("first", F.array_min("members"))
    q = asked.select("first", F.explode("places").alias("at")).select("first", "at.*")
    near = lambda c: F.sequence(F.floor(c / radius) - 1, F.floor(c / radius) + 1)
    q = q.withColumn("gx", F.explode(near(boxes.center_x("q_")))).withColumn("gy", F.explode(near(boxes.center_y("q_"))))
    hit = q.join(e, ["doc_id", "page", "gx", "gy"]).withColumn("distance", boxes.distance("e_", "q_")).where(F.col("distance") <= radius)
    w = Window.partitionBy("first").orderBy("distance", "pos")
    ranked = hit.select("first", "doc_id", "element_id", "pos", "distance", F.row_number().over(w).alias("rank"))
    return ranked.join(asked.select("first", "members"), "first").withColumn("asker", F.explode("members")).select("asker.query_id", "doc_id", "element_id", "pos", "distance", "rank")


def layout_analysis(elements: DataFrame) -> DataFrame:
    """(doc_id, total_elements, pages, element_types, reading_flow, columns): a document's layout in one row."""
    from .elements import totals, type_counts

    types = type_counts(elements).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n")))).alias("element_types"))
    flow = reading_flow(elements).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "flow_type", "confidence"))).alias("reading_flow"))
    per_page = detect_columns(elements).groupBy("doc_id", "page").agg(F.count("*").alias("column_count"), F.transform(F.array_sort(F.collect_list(F.struct("column", "n"))), lambda x: x["n"]).alias("elements_per_column"))
    columns = per_page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "column_count", "elements_per_column"))).alias("columns"))
    return totals(elements).join(types, "doc_id").join(flow, "doc_id", "left").join(columns, "doc_id", "left")
