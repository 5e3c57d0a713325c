import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import blocks, chunking, geometry, layout, tables, vision
from larkspur.session import Session
from larkspur.sources import registry as R


def table(*words):
    return pd.DataFrame(words, columns=["x0", "y0", "x1", "y1", "text"])


def test_table_rows():
    grid = table((10, 10, 40, 20, "Name"), (60, 10, 90, 20, "Size"), (10, 30, 40, 40, "mem-"), (10, 42, 30, 52, "[2]"), (60, 30, 90, 40, "(2"), (60, 50, 90, 60, "MB)"), (10, 55, 40, 65, "Alto"), (92, 50, 99, 60, "4"))
    assert geometry.table_rows(grid) == [["Name", "Size"], ["mem-[2]", "(2 MB)"], ["Alto", "4"]]
    assert geometry.table_rows(grid[grid["x0"] < 50]) == []
    assert geometry.mend(["(a", "b) c", "x-", "y z"]) == ["(a b)", "c", "xy", "z"]


def test_large_table_in_linear_time():
    import time

    n, began = 60_000, time.process_time()
    words = pd.DataFrame({"x0": [10.0, 200.0] * n, "y0": np.repeat(np.arange(n) * 12.0, 2), "text": [f"t{i}" for i in range(2 * n)]})
    rows = geometry.table_rows(words.assign(x1=words["x0"] + 20, y1=words["y0"] + 10))
    assert rows == [[f"t{2 * i}", f"t{2 * i + 1}"] for i in range(n)]
    assert time.process_time() - began < 12


def test_formulas_of_many_pages(spark):
    """Pages are folded in batches, not one frame each; a page of drawings alone has none."""
    spans = [("d", p, o, x, 100.0, x + 6, 110.0, 10.0, t) for p in range(3000) for o, (x, t) in enumerate([(10.0, "a"), (20.0, "+"), (30.0, f"b{p}")])]
    bars = [("d", p, 0, 8.0, 300.0, 45.0, 301.0) for p in (1, 5000)]
    box = "doc string, page long, ord int, x0 double, y0 double, x1 double, y1 double"
    out = geometry.reconstruct_formulas(spark.createDataFrame(spans, box + ", size double, text string"), spark.createDataFrame(bars, box))
    assert sorted((r["page"], r["text"]) for r in out.collect()) == [(p, f"a + b{p}") for p in range(3000)]
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_components_against_all_pairs():
    rng = random.Random(7)
    for n in (1, 2, 30, 80):
        low = np.array([[rng.uniform(0, 300), rng.uniform(0, 300)] for _ in range(n)])
        boxes = np.hstack([low, low + 8])
        group = list(range(n))
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if (boxes[i, :2] - 15 <= boxes[j, 2:]).all() and (boxes[j, :2] - 15 <= boxes[i, 2:]).all():
                        group[i] = group[j] = min(group[i], group[j])
        assert geometry.components(boxes).tolist() == group


def fold_lines(lines):
    """The blocks of one page, line by line."""
    out, held, before, big_page = [], "", None, lines[0]["page"] > 1
    import re

    from larkspur.functions import text as T

    for n in lines:
        large = n["size"] > n["body_size"] + 0.8
        if large and re.search(T.NUMBER_ONLY, n["text"]):
            held, before = n["text"] + " ", ("number", n)
            continue
        text, held = held + n["text"], ""
        near = before is not None and before[0] == "line" and -4 <= n["y0"] - before[1]["y1"] < 8 and abs(n["x0"] - before[1]["x0"]) < 25
        if n["heads"](text, large and big_page):
            if before and before[0] == "heading" and large and big_page and not re.search(T.NUMBER_PREFIX, text) and n["y0"] - before[1]["y1"] < 6:
                out[-1][1] += " " + text
            else:
                out.append(["heading", text])
            before = ("heading", n)
            continue
        fresh = before is None or before[0] != "line"
        if re.search(T.CAPTION, text):
            goes_on = not fresh and out[-1][0] == "caption"
            kind = "caption"
        else:
            goes_on, kind = near, "prose"
        if goes_on:
            out[-1][1] += " " + text
        else:
            out.append([kind, text])
        before = ("line", n)
    return [tuple(b) for b in out]


@pytest.mark.parametrize("seed", range(3))
def test_line_blocks(spark, seed):
    rng = random.Random(seed)
    texts = ["2", "Background", "and more of it goes on", "Figure 3: The plan", "3 Design", "a line, of prose;", "Counting", "it ends."]
    pages = {}
    for page in (1, 2, 3):
        y, rows = 0.0, []
        for i in range(60):
            y += rng.choice([2, 4, 25, -30]) + 10
            rows.append({"doc": "d", "page": page, "ord": i, "x0": rng.choice([50.0, 60.0, 300.0]), "y0": y, "size": rng.choice([10.0, 14.0]), "body_size": 10.0, "text": rng.choice(texts)})
        pages[page] = rows
    flat = [(r["doc"], r["page"], r["ord"], r["x0"], r["y0"], r["x0"] + 100, r["y0"] + 10, r["size"], r["body_size"], r["text"]) for rows in pages.values() for r in rows]
    lines = spark.createDataFrame(flat, "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, body_size double, text string")
    got = blocks.line_blocks(lines).orderBy("page", "ord").collect()
    heading = {"Background": (False, True), "Counting": (False, True), "3 Design": (True, True), "2 Background": (True, True), "2 Counting": (True, True)}
    for page, rows in pages.items():
        for r in rows:
            r["y1"] = r["y0"] + 10
            r["heads"] = lambda t, big: heading.get(t, (False, None))[0] or (big and len(t) <= 80 and len(t.split()) <= 9 and t[-1] not in ",;.")
        want = fold_lines(rows)
        assert [(b["kind"], b["text"]) for b in got if b["page"] == page] == want


def test_columns_and_sides(spark):
    rows = [("d", 1, i, 50.0 if i % 2 else 320.0, 280.0 if i % 2 else 560.0) for i in range(10)] + [("d", 1, 10, 50.0, 560.0), ("d", 2, 0, 50.0, 60.0)]
    lines = spark.createDataFrame(rows, "doc string, page int, ord int, x0 double, x1 double")
    split = layout.column_split(lines, lines.select("doc", "page", F.lit(612.0).alias("width")).distinct())
    assert {r["page"]: r["split"] for r in split.collect()} == {1: 316.0, 2: None}
    got = {(r["page"], r["ord"]): (r["is_full"], r["is_left"]) for r in layout.sides(lines, split).collect()}
    assert got[1, 1] == (False, True) and got[1, 2] == (False, False) and got[1, 10] == (True, False) and got[2, 0] == (True, False)


def test_vision_records_of_bad_replies(spark):
    rows = [("d", 1, "T", None), ("d", 2, "T", "no json"), ("d", 3, "T", '{"image_token": "t"}'), ("d", 4, None, '{"image_token": "t"}')]
    got = vision.normalize_records(spark.createDataFrame(rows, "doc string, page int, image_token string, reply string")).orderBy("page").collect()
    assert [r["status"] for r in got] == ["channel_failed_needs_human"] * 2 + ["clean", "channel_failed_needs_human"]
    assert got[2]["max_severity"] == "none" and got[0]["max_severity"] is None


def test_pieces():
    assert chunking.bounded_pieces("a" * 10, 20) == ["a" * 10]
    assert chunking.bounded_pieces("One two. Three four. Five", 20) == ["One two. Three four.", "Five"]
    assert chunking.bounded_pieces("x" * 45, 20) == ["x" * 20, "x" * 20, "x" * 5]
    assert chunking.bounded_pieces("aaaa bbbb cccc dddd eeee\nf", 20) == ["aaaa bbbb cccc dddd", "eeee\nf"]


def test_sources(spark):
    titles = [("a", "Tiered Memory Systems"), ("b", "Page Migration for Tiered Memory"), ("c", "Unrelated Things")]
    cited = {2: "J. Doe. Tiered memory systems. 2020", 1: "Page migration for tiered memory, OSDI", 3: "Nothing here"}
    assert R.assign(cited, titles) == {1: "b", 2: "a"}
    entries = spark.createDataFrame([("x", k, v) for k, v in cited.items()], "bib string, ref int, entry string")
    known = spark.createDataFrame([("x", *t) for t in titles], "bib string, doc_id string, title string")
    assert {tuple(r) for r in R.match_bibliographies(entries, known).collect()} == {("x", 1, "b"), ("x", 2, "a")}
    assert R.propose_doc_id("The Page Migration of Tiers", "OSDI", 2024, "f", set()) == "page_migration_tiers_osdi24"
    assert R.propose_doc_id("The Page Migration of Tiers", "OSDI", 2024, "f", {"page_migration_tiers_osdi24"}) == "page_migration_tiers_osdi24_2"


def test_session(spark):
    chunks = spark.createDataFrame([(i, f"doc_{i % 2}", i % 2, 1, 2, t) for i, t in enumerate(["tiered memory", "page size of 2 MB", "tiered pages", "none", "other", "more"])], "chunk_id int, doc string, tier int, page_start int, page_end int, text string")
    registry = spark.createDataFrame([(1, "doc_0", "zero"), (2, "doc_1", "one")], "ref int, doc_id string, short string")
    layer = spark.createDataFrame([("t", ["name", "size"], [["a", "2 MB"]])], "table_id string, header array<string>, rows array<array<string>>")
    s = Session(chunks, layer, registry)
    assert {r["doc"] for r in s.line("tiered page").collect()} == {"doc_0", "doc_1"}
    assert s.line("/doc zero") == "doc=doc_0" and {r["doc"] for r in s.line("tiered page").collect()} == {"doc_0"}
    assert s.line("/doc off") == "all documents" and s.line("/k 1") == "k=1" and s.line("tiered").count() == 1
    assert s.line("/k x") == "/k wants a number" and s.line("/tables 2mb in size").first()["value"] == "2 MB"
    assert s.line("/docs").count() == 2 and s.line("/quit") is None and s.line("/what").startswith("/tables")
    assert tables.query_tables(layer, "3mb").count() == 0
