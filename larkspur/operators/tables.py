"""The table layer: cells found by column and value patterns, and completeness against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import collapse_units, without_citations


def cells(tables: DataFrame) -> DataFrame:
    """One row for each cell under a header: the table's own columns, row_no, row, label, col_no, column, value. Cells beyond the header are not searched."""
    own = [c for c in tables.columns if c not in ("header", "rows", "all_rows")]
    rows = tables.select(*own, "header", F.posexplode("rows").alias("row_no", "row"))
    each = rows.select(*own, "header", "row_no", "row", F.posexplode(F.slice("row", 1, F.size("header"))).alias("col_no", "value"))
    return each.select(*own, "row_no", "row", F.get("row", F.lit(0)).alias("label"), "col_no", F.get("header", F.col("col_no")).alias("column"), "value")


def _hit(pattern: str, normalize: bool) -> Column:
    """The pattern is not anchored and knows no case; it is tried on the cell as it is, and on the cell with its units collapsed and no spaces."""
    cell = F.replace(collapse_units(F.lower("value")), F.lit(" "), F.lit(""))
    own = F.col("value").rlike(f"(?i){pattern}")
    return own | cell.rlike(f"(?i){pattern}") if normalize else own


def query_tables(tables: DataFrame, pattern: str, column: str | None = None, doc: str | None = None, tier: int | None = None, normalize: bool = True) -> DataFrame:
    """Each row with its first matching cell, with the table's own columns (of which doc and tier may be filtered on)."""
    if doc is not None:
        tables = tables.where(F.col("doc") == doc)
    if tier is not None:
        tables = tables.where(F.col("tier") == tier)
    found = cells(tables).where(_hit(pattern, normalize) & (F.col("column").rlike(f"(?i){column}") if column else F.lit(True)))
    own = [c for c in tables.columns if c not in ("header", "rows", "all_rows", "table_id")]
    first = F.min(F.struct("col_no", "column", "value", "row", *own)).alias("c")
    return found.groupBy("table_id", "row_no", "label").agg(first).select("table_id", "row_no", "label", "c.column", "c.value", "c.row", *[f"c.{x}" for x in own])


def set_query(tables: DataFrame, pattern: str, column: str) -> DataFrame:
    """label (without citations), value and table_id, with doc and page where the tables have them; the last match of a label wins."""
    found = query_tables(tables, pattern, column)
    place = [c for c in ("doc", "page") if c in found.columns]
    last = F.max(F.struct(*place, "table_id", "row_no", "value")).alias("c")
    return found.groupBy(without_citations(F.col("label")).alias("label")).agg(last).select("label", "c.value", "c.table_id", *[f"c.{x}" for x in place])


def completeness(found: DataFrame, expected: DataFrame) -> DataFrame:
    """missing and extra labels; passes if none is missing."""
    both = found.select("label", F.lit(1).alias("f"), F.lit(0).alias("e")).union(expected.select("label", F.lit(0), F.lit(1))).groupBy("label").agg(F.max("f").alias("f"), F.max("e").alias("e"))
    return both.agg(F.count_if(F.col("f") == 0).alias("missing"), F.count_if(F.col("e") == 0).alias("extra")).select("*", (F.col("missing") == 0).alias("passed"))
