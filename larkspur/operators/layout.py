"""Layout reconstruction by windows and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import band_key, is_page_number

#: Fixed values.
LINE_JUMP, MIN_GAP, DEFAULT_SIZE = 1.5, 7.0, 10.0
PEAK, FEWEST_LINES, WIDTH_SHARE, NEAR, EDGE, MARGIN = 3, 8, 0.25, 6.0, 4.0, 3.0


def body_font_size(spans: DataFrame) -> DataFrame:
    """The size, to a tenth, with the most characters; of equals the one seen first."""
    by = spans.groupBy("doc", F.bround("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min("ord").alias("first"))
    return by.groupBy("doc").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_size"))


def running_bands(lines: DataFrame, pages: DataFrame, share: float = 0.4) -> DataFrame:
    """Texts, digits masked, that stand in the bands of at least max(2, 40 %) of a document's pages. pages: doc, n_pages."""
    keys = lines.where("in_band").select("doc", "page", band_key(F.col("text")).alias("band")).where("band <> ''")
    seen = keys.groupBy("doc", "band").agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.floor(share * F.col("n_pages")))).select("doc", "band", "n")


def drop_running(lines: DataFrame, bands: DataFrame) -> DataFrame:
    keyed = lines.select("*", band_key(F.col("text")).alias("band"))
    kept = keyed.join(bands.select("doc", "band", F.lit(True).alias("hit")), ["doc", "band"], "left")
    return kept.where(~(F.col("in_band") & (F.coalesce("hit", F.lit(False)) | is_page_number(F.col("text"))))).drop("band", "hit")


def column_histogram(lines: DataFrame, width: float = 2.0) -> DataFrame:
    """Column starts by bins; halves round to even."""
    return lines.groupBy("doc", "page", (F.bround(F.col("x0") / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def column_split(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page and split: where the right of two columns begins, or null for a page of one column. pages: doc, page, width. Columns
    start at bins with PEAK lines or more, the right one over a quarter of the width to the right; both have PEAK lines within NEAR."""
    hist = column_histogram(lines).groupBy("doc", "page").agg(F.sum("n").alias("lines"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    peaks = F.transform(F.filter("bins", lambda b: b["n"] >= PEAK), lambda b: b["bin"])
    df = hist.join(pages, ["doc", "page"]).select("doc", "page", "lines", "bins", "width", peaks.alias("peaks"), F.array_min(peaks).alias("first"))
    df = df.select("*", F.array_min(F.filter("peaks", lambda p: p - F.col("first") > WIDTH_SHARE * F.col("width"))).alias("second"))
    near = lambda c: F.aggregate(F.filter("bins", lambda b: F.abs(b["bin"] - F.col(c)) <= NEAR), F.lit(0).cast("long"), lambda a, b: a + b["n"])
    both = (F.col("lines") >= FEWEST_LINES) & (near("first") >= PEAK) & (near("second") >= PEAK)
    return df.select("doc", "page", F.when(both, F.col("second") - EDGE).alias("split"))


def sides(lines: DataFrame, split: DataFrame) -> DataFrame:
    """Lines with is_full and is_left, as reading_order wants them; on a page of one column all are full."""
    met = lines.join(split, ["doc", "page"], "left")
    left, right = F.col("x1") <= F.col("split") + MARGIN, F.col("x0") >= F.col("split") - MARGIN
    return met.select(*lines.columns, F.coalesce(~(left | right), F.lit(True)).alias("is_full"), F.coalesce(left, F.lit(False)).alias("is_left"))


def line_groups(words: DataFrame) -> DataFrame:
    """Words in order of (y0, x0); a jump of more than LINE_JUMP from the word before starts a new line."""
    w = Window.partitionBy("doc", "page").orderBy("y0", "x0", "ord")
    new = F.coalesce(F.col("y0") - F.lag("y0").over(w) > LINE_JUMP, F.lit(True)).cast("int")
    return words.select("*", new.alias("new")).select("*", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("line")).drop("new")


def reading_order(lines: DataFrame) -> DataFrame:
    """Full-width lines cut a page into segments; in each the left column comes before the right."""
    w = Window.partitionBy("doc", "page").orderBy("y0", "x0", "ord")
    side = F.when(F.col("is_full"), 0).when(F.col("is_left"), 1).otherwise(2)
    df = lines.select("*", F.sum(F.col("is_full").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"), side.alias("side"))
    return df.select("*", F.row_number().over(Window.partitionBy("doc", "page").orderBy("segment", "side", "y0", "x0", "ord")).alias("position")).drop("side")


def whitespace_gaps(spans: DataFrame, extents: DataFrame, min_gap: float = MIN_GAP) -> DataFrame:
    """What the intervals (x0, x1) of a page leave uncovered of its extent (lo, hi), where it is at least min_gap wide, before the first and
    after the last as well. A last interval of no width at the end of the extent closes the page."""
    inside = spans.join(extents, ["doc", "page"]).select("doc", "page", "lo", F.greatest("x0", "lo").alias("x0"), F.least("x1", "hi").alias("x1")).where("x0 < x1")
    closed = inside.union(extents.select("doc", "page", "lo", F.col("hi").alias("x0"), F.col("hi").alias("x1")))
    w = Window.partitionBy("doc", "page").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return closed.select("doc", "page", F.coalesce(reach, F.col("lo")).alias("gap_start"), F.col("x0").alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") >= min_gap)


def carry_section(blocks: DataFrame) -> DataFrame:
    """Each block with the text of the last heading at or before it."""
    w = Window.partitionBy("doc").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("*", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w).alias("section"))


def outside_regions(lines: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines with at most half of their area inside any region of their page."""
    r = regions.select("doc", "page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    across = F.greatest(F.lit(0.0), F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
    down = F.greatest(F.lit(0.0), F.least("y1", "r_y1") - F.greatest("y0", "r_y0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    on = (lines["doc"] == r["doc"]) & (lines["page"] == r["page"]) & (across * down > share * area) & (area > 0)
    return lines.join(r, on, "left_anti")


def nearest_caption(tables: DataFrame, captions: DataFrame, reach: float = 15.0) -> DataFrame:
    """The caption with the least vertical gap below reach, and whether it isn't a table's."""
    c = captions.select("doc", "page", F.col("y0").alias("c_y0"), F.col("y1").alias("c_y1"), F.col("text").alias("caption"))
    gap = F.greatest(F.lit(0.0), F.col("c_y0") - F.col("y1"), F.col("y0") - F.col("c_y1"))
    near = tables.join(c, ["doc", "page"]).select("doc", "page", "table_id", "caption", gap.alias("gap"), "c_y0").where(F.col("gap") < reach)
    best = near.groupBy("doc", "page", "table_id").agg(F.min_by("caption", F.struct("gap", "c_y0")).alias("caption"))
    return best.select("*", (~F.lower("caption").startswith("table")).alias("is_figure"))
