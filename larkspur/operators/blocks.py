"""Lines to blocks: headings, captions and paragraphs, by windows over the lines of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.layout import carry_section

#: Fixed values.
BIGGER, FOLD_GAP, STEP_UP, STEP_DOWN, SHIFT = 0.8, 6.0, -4.0, 8.0, 25.0
BOX = ["x0", "y0", "x1", "y1"]


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks (doc, page, ord, kind, box, text, section) of lines (doc, page, ord, box, size, body_size, text) in reading order.

    A large line that is only a number goes in front of the line after it; at the end of a page it has none and is left out. A heading that
    wraps (large, without number, close below a heading) continues it. A caption takes in the lines that follow on; so does a
    paragraph. What a line follows on from is the line before it, and what is open there is what the last line that did not follow
    on began: so the whole fold is windows by page. A heading's box is that of its first line."""
    page = Window.partitionBy("doc", "page").orderBy("ord")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("size") > F.col("body_size") + BIGGER
    df = lines.select("doc", "page", "ord", *BOX, "text", large.alias("large"), (large & T.is_number(F.col("text"))).alias("number"))
    held = F.when(F.lag("number").over(page), F.lag("text").over(page))
    df = df.select("*", F.concat_ws(" ", held, "text").alias("whole")).select("*", (F.col("large") & (F.col("page") > 1)).alias("big"))
    df = df.select("*", (~F.col("number") & T.looks_like_heading(F.col("whole"), F.col("big"))).alias("heading"))
    gap, shift = F.col("y0") - F.lag("y1").over(page), F.abs(F.col("x0") - F.lag("x0").over(page))
    plain_before = ~F.lag(F.col("heading") | F.col("number")).over(page)
    near = F.coalesce(plain_before & (gap >= STEP_UP) & (gap < STEP_DOWN) & (shift < SHIFT), F.lit(False))
    folds = F.coalesce(F.col("heading") & F.lag("heading").over(page) & F.col("big") & ~F.col("whole").rlike(T.NUMBER_PREFIX) & (gap < FOLD_GAP), F.lit(False))
    df = df.select("*", near.alias("near"), folds.alias("folds"))
    begins = F.when(F.col("number"), "number").when(F.col("heading"), "heading").when(T.is_caption(F.col("whole")), "caption").when(~F.col("near"), "prose")
    df = df.select("*", begins.alias("begins"))
    df = df.select("*", F.last("begins", ignorenulls=True).over(before).alias("open"))
    goes_on = F.col("begins").isNull() | F.col("folds") | ((F.col("begins") == "caption") & F.coalesce(F.col("open") == "caption", F.lit(False)))
    df = df.select("*", F.sum((~goes_on).cast("int")).over(upto).alias("run"))
    rows = df.where("not number").groupBy("doc", "page", "run")
    first = lambda c: F.min_by(c, "ord")
    heads = first("heading")
    reach = lambda c, f: F.when(heads, first(c)).otherwise(f(c)).alias(c)
    parts = F.sort_array(F.collect_list(F.struct("ord", "whole")))
    blocks = rows.agg(F.min("ord").alias("ord"), first("begins").alias("kind"), reach("x0", F.min), reach("y0", F.min), reach("x1", F.max), reach("y1", F.max), F.array_join(F.transform(parts, lambda p: p["whole"]), " ").alias("text"))
    return carry_section(blocks.drop("run"))

