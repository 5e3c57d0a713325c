"""Tables and formulas from positioned words and spans.

Each is an ordered fold over one table or one page, which Spark's operators cannot say. Tables are folded as arrays, in time that grows with
their words; pages come in batches of many, as a frame of its own for each small page costs far more than its fold. What belongs to which table is a
join with page and box in Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T

#: Fixed values.
PAD = (-2.0, -10.0, 2.0, 2.0)
COLUMN_GAP, LINE_JUMP = 7.0, 1.5
CLOSE, TALLEST, MOST_SPANS, BAR_WIDTH, BAR_HEIGHT, BAR_REACH = 15.0, 45.0, 15, 8.0, 2.0, 3.0
SMALL, RAISED, SAME_SIZE = 0.9, 1.5, 0.5
OPERATORS = "=+−×÷∙≤≥≈→±/"
_MATH = str.maketrans(T.MATH_FROM, T.MATH_TO)


# --- tables -----------------------------------------------------------------------------------------------------
def words_in_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words (doc, page, box, text) wholly in the padded box of a table (doc, page, table_id, box, width, height of the page)."""
    sides = [F.greatest(F.lit(0.0), F.col("x0") + PAD[0]), F.greatest(F.lit(0.0), F.col("y0") + PAD[1]), F.least("width", F.col("x1") + PAD[2]), F.least("height", F.col("y1") + PAD[3])]
    t = tables.select("doc", "page", "table_id", *[s.alias(n) for s, n in zip(sides, ("left", "top", "right", "bottom"), strict=True)])
    inside = (F.col("x0") >= F.col("left")) & (F.col("y0") >= F.col("top")) & (F.col("x1") <= F.col("right")) & (F.col("y1") <= F.col("bottom"))
    return words.join(t, ["doc", "page"]).where(inside).select("doc", "page", "table_id", "x0", "y0", "x1", "y1", "text")


def hyphen_join(words) -> str:
    out = ""
    for w in words:
        out += w if not out or out.endswith("-") else " " + w
    return out


def inner_bounds(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Midpoints of the gaps between columns: where no word of the table stands for COLUMN_GAP or more."""
    order = np.argsort(x0, kind="stable")
    start, reach = x0[order][1:], np.maximum.accumulate(x1[order])[:-1]
    wide = start - reach >= COLUMN_GAP
    return (start[wide] + reach[wide]) / 2


def mend(column: list[str]) -> list[str]:
    """Brings back what slipped into the cell below: the rest of an open bracket, or of a hyphenated word."""
    cells = list(column)
    for i in range(len(cells) - 1):
        upper, lower = cells[i], cells[i + 1]
        rest = re.match(r"(\S*\))\s*(.*)$", lower) if upper.count("(") > upper.count(")") else None
        if rest:
            cells[i], cells[i + 1] = f"{upper} {rest[1]}".strip(), rest[2]
        elif upper.endswith("-") and (rest := re.match(r"(\S+)\s*(.*)$", lower)):
            cells[i], cells[i + 1] = upper[:-1] + rest[1], rest[2]
    return cells


def table_rows(words: pd.DataFrame) -> list[list[str]]:
    """The cells by rows; none without two columns and two rows. Rows begin where the first column has a line other than a bare
    number in brackets; they part halfway between such lines."""
    x0, y0, x1, text = (words[c].to_numpy() for c in ("x0", "y0", "x1", "text"))
    order = np.lexsort((x0, y0))
    x0, y0, x1, text = x0[order], y0[order], x1[order], text[order]
    inner = inner_bounds(x0, x1)
    if not len(inner):
        return []
    col = np.searchsorted(inner, (x0 + x1) / 2, side="right")
    jumps = np.diff(y0) > LINE_JUMP
    line = np.concatenate([[0], jumps.cumsum()])
    line_y = y0[np.concatenate([[0], np.flatnonzero(jumps) + 1])][line]
    first = np.flatnonzero(col == 0)
    anchors = [(y0[own].min(), hyphen_join(text[own[np.argsort(x0[own], kind="stable")]]).strip()) for own in _runs(first, line[first])]
    tops = [y for y, t in anchors if not re.match(T.FRAGMENT, t)]
    if len(tops) < 2:
        tops = sorted({y for y, _ in anchors})
    if len(tops) < 2:
        return []
    row = np.searchsorted((np.array(tops[1:]) + np.array(tops[:-1])) / 2, line_y, side="right")
    cell = row * (len(inner) + 1) + col
    by_cell = np.argsort(cell, kind="stable")
    held = {cell[own[0]]: hyphen_join(text[own]) for own in _runs(by_cell, cell[by_cell])}
    columns = [mend([held.get(r * (len(inner) + 1) + c, "") for r in range(len(tops))]) for c in range(len(inner) + 1)]
    return [list(row) for row in zip(*columns, strict=True)]


def _runs(places: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """The places, cut where the key changes."""
    return np.split(places, np.flatnonzero(np.diff(keys)) + 1) if len(places) else []


def reconstruct_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """doc, page, table_id and rows (array of arrays of cells) for each table that has two columns and rows."""

    def fold(key, group: pd.DataFrame) -> pd.DataFrame:
        rows = table_rows(group)
        return pd.DataFrame([(*key, rows)] if rows else [], columns=["doc", "page", "table_id", "rows"])

    return words_in_tables(words, tables).groupBy("doc", "page", "table_id").applyInPandas(fold, "doc string, page long, table_id string, rows array<array<string>>")


# --- formulas ---------------------------------------------------------------------------------------------------
def components(boxes: np.ndarray, close: float = CLOSE) -> np.ndarray:
    """The number of its group for each box (x0, y0, x1, y1); boxes within `close` of one another are one group. Found by a
    sweep from left to right over the boxes that still reach the current one."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    active: list[int] = []
    for i in np.argsort(boxes[:, 0], kind="stable"):
        x0, y0, _, y1 = boxes[i]
        active = [j for j in active if boxes[j][2] >= x0 - close]
        for j in active:
            if boxes[j][1] <= y1 + close and y0 <= boxes[j][3] + close:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        active.append(int(i))
    return np.array([root(i) for i in range(len(boxes))])


class Span(NamedTuple):
    """A span of a page; drawings are spans without size and text."""

    ord: int
    x0: float
    y0: float
    x1: float
    y1: float
    size: float | None
    text: str | None


def render(spans: Sequence[Span]) -> str:
    """Left to right; smaller spans off the middle line of the common size get a mark for below or above."""
    if not spans:
        return ""
    s = sorted(spans, key=lambda x: x.x0)
    base = Counter(round(x.size, 1) for x in s).most_common(1)[0][0]
    common = [(x.y0 + x.y1) / 2 for x in s if abs(x.size - base) < SAME_SIZE]
    line = sum(common) / len(common)
    out = ""
    for x in s:
        mark, at = "", (x.y0 + x.y1) / 2
        if x.size < SMALL * base and abs(at - line) > RAISED:
            mark = "_" if at > line else "^"
        out += ("" if not out or mark or out.endswith("-") else " ") + mark + x.text.translate(_MATH)
    return out.strip()


def tidy(text: str) -> str:
    for pattern, to in T.TIDY:
        text = re.sub(pattern, to, text)
    return text.strip()


def formula(spans: Sequence[Span], bars: Sequence[Span]) -> str | None:
    """The text of one group of spans, or none where it is no formula. bars: filled drawings in their order."""
    x0, y0, x1, y1 = outline(spans)
    if y1 - y0 > TALLEST or len(spans) > MOST_SPANS:
        return None
    thin = (b for b in bars if b.x1 - b.x0 > BAR_WIDTH and b.y1 - b.y0 < BAR_HEIGHT)
    bar = next((b for b in thin if b.x0 < x1 and b.x1 > x0 and b.y0 < y1 and b.y1 > y0), None)
    if bar is None:
        if len(spans) < 2 or not any(c in OPERATORS for x in spans for c in x.text):
            return None
        out = tidy(render(spans))
    else:
        beside = lambda x: x.x1 > bar.x0 - BAR_REACH and x.x0 < bar.x1 + BAR_REACH
        over = lambda x: (x.y0 + x.y1) / 2 < (bar.y0 + bar.y1) / 2
        above, below = (render([x for x in spans if beside(x) and over(x) == up]) for up in (True, False))
        rest = render([x for x in spans if not beside(x)])
        fraction = f"{above} / ({below})" if above or below else ""
        out = tidy(f"{rest} {fraction}")
    return out if any(c.isalnum() for c in out) else None


def outline(spans: Sequence[Span]) -> tuple[float, float, float, float]:
    return min(x.x0 for x in spans), min(x.y0 for x in spans), max(x.x1 for x in spans), max(x.y1 for x in spans)


def formulas(spans: Sequence[Span], bars: Sequence[Span]) -> Iterator[tuple]:
    """Box and text of the formulas of one page, both sides in order of `ord`."""
    if not spans:
        return
    of = components(np.array([x[1:5] for x in spans], dtype=float))
    for _, own in groupby(sorted(range(len(spans)), key=of.__getitem__), key=of.__getitem__):
        group = [spans[i] for i in own]
        if (text := formula(group, bars)) is not None:
            yield *outline(group), text


def _spans(column: pa.ListArray) -> list[list[Span]]:
    """The spans of each row of a column of arrays."""
    flat = column.flatten()
    each = [Span(*x) for x in zip(*[flat.field(i).to_pylist() for i in range(len(Span._fields))], strict=True)]
    ends = np.concatenate([[0], np.diff(column.offsets.to_numpy()).cumsum()])
    return [each[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


FORMULAS = "doc string, page long, x0 double, y0 double, x1 double, y1 double, text string"


def reconstruct_formulas(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """doc, page, box and text of the formulas among math spans (doc, page, ord, box, size, text); bars: filled drawings
    (doc, page, ord, box). One shuffle brings a page's spans and drawings to one row."""

    def fold(batches):
        for batch in batches:
            doc, page = batch.column("doc").to_pylist(), batch.column("page").to_pylist()
            found = [(d, p, *f) for d, p, own, drawn in zip(doc, page, _spans(batch.column("own")), _spans(batch.column("drawn")), strict=True) for f in formulas(own, drawn)]
            columns = list(zip(*found, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "page", "x0", "y0", "x1", "y1", "text"])

    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    part = lambda df, size, text, drawn: df.select("doc", F.col("page").cast("long").alias("page"), F.struct(F.col("ord").cast("long").alias("ord"), *box, size.cast("double").alias("size"), text.alias("text")).alias("s"), F.lit(drawn).alias("is_drawn"))
    both = part(spans, F.col("size"), F.col("text"), False).union(part(bars, F.lit(None), F.lit(None).cast("string"), True))
    # so many partitions, whatever their bytes: pages are small, but their folds take time
    dealt = both.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "page")
    held = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("s"))))
    pages = dealt.groupBy("doc", "page").agg(held(~F.col("is_drawn")).alias("own"), held(F.col("is_drawn")).alias("drawn"))
    return pages.mapInArrow(fold, FORMULAS)
