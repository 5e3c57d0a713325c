"""Extraction quality rules: one row for each violation, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.layout import whitespace_gaps

#: Fixed values.
MIN_DENSE, MIN_ALNUM = 200, 0.55
MAX_LOST, MIN_COVERED = 120, 0.92
MAX_RAGGED = 0.34
MIN_TABLE_ALNUM, MIN_CROSSING = 0.4, 200
SENTENCE_END = r"[.!?:;”\"')\]]$"


def _flag(rows: DataFrame, name: str, severity: str, detail: Column) -> DataFrame:
    return rows.select("doc", "page", F.lit(name).alias("check_name"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def _in_context(c: Column, pattern: str, before: int, after: int) -> Column:
    """Each match with up to so many characters before and after it. The text between matches comes from a split; as no match is empty, the
    last few pieces and matches hold what stands before one."""
    pieces, found = F.split(c, pattern), T.extract_all(c, pattern)
    turns = F.flatten(F.zip_with(pieces, found, lambda p, m: F.array(p, F.coalesce(m, F.lit("")))))

    def around(parts: Column) -> Column:
        span = lambda i, n: F.array_join(F.slice(parts, i, n), "")
        back = lambda i: F.least(2 * i + 1, F.lit(2 * before + 1))
        return F.transform(found, lambda m, i: F.concat(F.right(span(2 * i + 2 - back(i), back(i)), F.lit(before)), m, F.left(span(2 * i + 3, F.lit(2 * after + 1)), F.lit(after))))

    return F.get(F.transform(F.array(turns), around), F.lit(0))


def page_flags(pages: DataFrame) -> DataFrame:
    """cid_garble, low_alnum_ratio, broken_measurement and misencoded_unit over (doc, page, text): one scan for all four."""
    t = F.col("text")
    dense = F.length(F.regexp_replace(t, r"\s", ""))
    ratio = T.alnum_ratio(t)  # rounded as a number times 100, as SQL does: 0.145, of which that is 14.499..., gives 0.14
    entry = lambda name, severity, detail: F.struct(F.lit(name).alias("check_name"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))
    none = F.lit(None).cast("struct<check_name:string,detail:string,severity:string>")
    cids = F.regexp_count(t, F.lit(T.CID))
    single = F.array(
        F.when(cids > 0, entry("cid_garble", "blocker", cids)).otherwise(none),
        F.when((dense >= MIN_DENSE) & (ratio < MIN_ALNUM), entry("low_alnum_ratio", "blocker", F.round(ratio * 100) / 100)).otherwise(none),
    )

    def each(name: str, severity: str, pattern: str, before: int, after: int) -> Column:
        return F.transform(_in_context(t, pattern, before, after), lambda m: entry(name, severity, m))

    flags = F.concat(F.filter(single, lambda x: x.isNotNull()), each("broken_measurement", "review", T.BROKEN, 25, 25), each("misencoded_unit", "blocker", T.MISENCODED, 40, 30))
    return pages.select("doc", "page", F.inline(flags))


def coverage_gaps(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    alnum = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    held = blocks.groupBy("doc", "page").agg(F.sum(alnum(F.col("text"))).alias("held"))
    both = pages.select("doc", "page", alnum(F.col("text")).alias("raw")).join(held, ["doc", "page"], "left").select("doc", "page", "raw", F.coalesce("held", F.lit(0)).alias("held"))
    gap = both.where((F.col("raw") - F.col("held") > MAX_LOST) & (F.col("held") < MIN_COVERED * F.col("raw")))
    return _flag(gap, "coverage_gap", "review", F.col("raw") - F.col("held"))


def table_flags(tables: DataFrame) -> DataFrame:
    """table_ragged_rows and table_empty_row over (doc, page, rows)."""
    filled = F.transform("rows", lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")))
    df = tables.select("doc", "page", filled.alias("filled"))
    most = F.array_max(F.transform(F.array_distinct("filled"), lambda v: F.struct(F.size(F.filter("filled", lambda x: x == v)).alias("n"), (-F.array_position("filled", v)).alias("first"), v.alias("v"))))["v"]
    df = df.select("*", most.alias("modal"))
    ragged = F.size(F.filter("filled", lambda x: x < F.greatest(F.lit(1), F.col("modal") - 1)))
    one = _flag(df.where((F.size("filled") >= 3) & (ragged > MAX_RAGGED * F.size("filled"))), "table_ragged_rows", "review", ragged)
    return one.union(_flag(df.where(F.array_contains("filled", 0)), "table_empty_row", "review", F.lit("empty")))


def split_paragraphs(blocks: DataFrame) -> DataFrame:
    """Prose and the next prose of its page, in one column and below it, where the upper ends without punctuation and the lower starts small."""
    w = Window.partitionBy("doc", "page").orderBy("ord")
    prose = blocks.where("kind = 'prose'").select("doc", "page", "ord", "x0", "y0", "y1", F.rtrim("text").alias("upper"), F.ltrim("text").alias("lower"))
    nxt = lambda c: F.lead(c).over(w).alias(f"n_{c}")
    df = prose.select("*", nxt("lower"), nxt("x0"), nxt("y0"))
    column = (F.abs(F.col("x0") - F.col("n_x0")) < 25) & (F.col("n_y0") >= F.col("y1") - 2)
    cut = (F.col("upper") != "") & ~F.col("upper").rlike(SENTENCE_END) & F.col("n_lower").rlike(r"^\p{Ll}")
    detail = F.concat(F.lit("..."), F.right("upper", F.lit(40)), F.lit(" || "), F.left("n_lower", F.lit(40)), F.lit("..."))
    return _flag(df.where(column & cut), "paragraph_split_mid_sentence", "info", detail)


def table_parse_flags(tables: DataFrame) -> DataFrame:
    """Over (doc, page, quality_flag): what the parser said about a table."""
    return _flag(tables.where("quality_flag is not null"), "table_parse_flag", "review", F.concat(F.lit("parser flagged this table: "), "quality_flag"))


def parse_flag(text: Column, is_figure: Column) -> Column:
    """The parser's own flag of a table: hardly any letters or digits, else a figure's caption next to it."""
    dense = F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"\s", "")))
    ratio = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / dense
    return F.when(ratio < MIN_TABLE_ALNUM, "low_alnum_ratio_possible_cid_garble").when(is_figure, "near_figure_caption_possibly_not_a_table")


def gutter_flags(blocks: DataFrame, holes: bool = False) -> DataFrame:
    """bbox_crosses_gutter over (doc, page, ord, kind, x0, x1, text): long prose across the page's middle gap. The gap is one between the
    boxes of all prose and headings, so none of them can cross it: the rule as it stands never fires. With holes, a block is held against the gaps that the
    others leave, which is what the rule means."""
    text = blocks.where("kind in ('prose', 'heading')").select("doc", "page", "ord", "kind", "x0", "x1", "text")
    box = Window.partitionBy("doc", "page")
    text = text.select("*", F.min("x0").over(box).alias("lo"), F.max("x1").over(box).alias("hi"), F.count("*").over(box).alias("n")).where("n >= 4")
    covers = text.where(F.length("text") <= MIN_CROSSING) if holes else text
    extents = text.select("doc", "page", F.col("lo"), F.col("hi")).distinct()
    gaps = whitespace_gaps(covers.select("doc", "page", "x0", "x1"), extents, 15.0).join(extents, ["doc", "page"])
    edge = (F.col("hi") - F.col("lo")) * 0.25
    central = gaps.where((F.col("gap_start") > F.col("lo") + edge) & (F.col("gap_start") < F.col("hi") - edge))
    off = F.abs((F.col("gap_start") + F.col("gap_end")) / 2 - (F.col("lo") + F.col("hi")) / 2)
    best = central.groupBy("doc", "page").agg(F.min(F.struct(off.alias("off"), "gap_start", "gap_end")).alias("g"))
    hit = text.join(best, ["doc", "page"]).where((F.col("x0") < F.col("g.gap_start") - 2) & (F.col("x1") > F.col("g.gap_end") + 2) & (F.length("text") > MIN_CROSSING))
    return _flag(hit, "bbox_crosses_gutter", "review", F.left("text", F.lit(60)))


def report(flags: DataFrame) -> DataFrame:
    """By check, from the most flags to the fewest."""
    by = flags.groupBy("check_name", "severity").agg(F.count("*").alias("n_flags"), F.count_distinct("doc", "page").alias("n_pages"))
    return by.orderBy(F.desc("n_flags"), "check_name", "severity")


def totals(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages in all, pages with a flag that is more than info, and their share to four places."""
    flagged = flags.where("severity <> 'info'").agg(F.count_distinct("doc", "page").alias("pages_flagged"))
    both = pages.agg(F.count("*").alias("pages_total")).crossJoin(F.broadcast(flagged))
    return both.select("*", F.round(F.col("pages_flagged") / F.greatest(F.col("pages_total"), F.lit(1)), 4).alias("flag_rate"))


def review_pages(flags: DataFrame, table_pages: DataFrame) -> DataFrame:
    return flags.where("severity <> 'info'").select("doc", "page").union(table_pages.select("doc", "page")).distinct()
