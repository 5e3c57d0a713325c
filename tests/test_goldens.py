"""Cases that the model's descriptions state literally."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import units as U
from larkspur.operators import audit, evalkit, layout, rules, search, tables
from larkspur.sources import index as I
from larkspur.sources import registry as R


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}").orderBy("i").select(*columns).collect()]


def test_quantities(spark):
    cases = [("54 µs", "0.054 ms", True), ("54 µs", "54 ms", False), ("90%", "90 percent", True), ("1.01-1.76x", "1.5x", True), ("1.01-1.76x", "2.4x", False), ("2 MB", "2048 KB", True), ("47%", "47 % ", True), ("54 µs", "90%", False), ("170 ns", "0.17 µs", True),
             ("54 microseconds", "0.054 ms", True), ("1 PB", "1024 TB", True), ("2 h", "2", True), ("90", "90%", True), ("none", "1", None), ("0", "0 ms", True), ("1,024 B", "1 KB", True)]
    found = values(spark, [c[:2] for c in cases], "a string, b string", U.quantities_match(F.col("a"), F.col("b")))
    assert [x for (x,) in found] == [c[2] for c in cases]
    assert sum(map(len, U.SCALES.values())) == len(U.UNITS) == 37
    q = values(spark, [("7 ms, 1-2 x or 3 GB/s",)], "t string", F.transform(U.find_quantities(F.col("t")), lambda x: x["lo"]).alias("lo"))
    assert q[0][0] == pytest.approx([1.0, 0.007, 3e9])


def test_headings(spark):
    yes = ["3.1 Simulation Framework", "I. INTRODUCTION", "§ 3", "Abstract", "2 Design"]
    no = ["5.0 can offer the same bandwidth", "1 while (true) {", "2020. Sketching Algorithms for all", "2020 Sketching Algorithms", "2 Design: Overview of the System", "5. Composability works. Alto [4] + Colloid [3] outperforms Colloid by 10%; more", "3 CXL layer, and 4", "3 One two three four five six seven eight nine ten"]
    assert [x for (x,) in values(spark, [(t,) for t in yes + no], "t string", T.is_heading(F.col("t")))] == [True] * len(yes) + [False] * len(no)


def test_letters_and_labels(spark):
    cases = [("\U0001D434\u210e\u2102\u211d", "AhCR"), ("\U0001D44D\U0001D440 \U0001D7D8\U0001D6C6", "ZM 0ε"), ("\u212f\U0001D6C1", "\u212f\U0001D6C1"), ("plain", "plain")]
    assert [x for (x,) in values(spark, [(a,) for a, _ in cases], "t string", T.normalize_math(F.col("t")))] == [b for _, b in cases]
    assert values(spark, [("NOMAD [3] v2",)], "t string", T.without_citations(F.col("t"))) == [("NOMADv2",)]
    assert values(spark, [("A Study of or Memory via CXL as",)], "t string", T.normalize_math(F.concat_ws(" ", R.title_words(F.col("t"))))) == [("study memory cxl",)]
    assert values(spark, [("CMMI10", "x"), (None, "\U0001D434"), ("Times", "x")], "f string, t string", T.is_math_span(F.col("f"), F.col("t"))) == [(True,), (True,), (False,)]


def test_set_query(spark):
    header = ["System", "Granularity"]
    rows = [["MTM", "2 MB (THP)"], ["NOMAD [3]", "4 KB / 2 MB"], ["NeoMem", "4 KB / 2 MB"], ["Other", "12 MB"], ["Big", "512 MB"], ["None", "4 KB"], []]
    layer = spark.createDataFrame([("t1", "d", 1, 3, header, rows), ("t2", "e", 0, 4, header, [["MTM", "2MB"]])], "table_id string, doc string, tier int, page int, header array<string>, rows array<array<string>>")
    found = {r["label"]: (r["value"], r["table_id"], r["page"]) for r in tables.set_query(layer, "2mb", "granularity").collect()}
    assert found == {"MTM": ("2MB", "t2", 4), "NOMAD": ("4 KB / 2 MB", "t1", 3), "NeoMem": ("4 KB / 2 MB", "t1", 3), "Other": ("12 MB", "t1", 3), "Big": ("512 MB", "t1", 3)}
    labels = lambda **k: sorted(r["label"] for r in tables.query_tables(layer, "4kb/2MB", **k).collect())
    assert labels() == ["NOMAD [3]", "NeoMem"] and labels(normalize=False) == [] and labels(doc="e") == [] and labels(tier=1, column="gran") == ["NOMAD [3]", "NeoMem"]


def test_gaps_and_gutter(spark):
    spans = spark.createDataFrame([("d", 1, 20.0, 30.0), ("d", 1, 25.0, 60.0), ("d", 1, 66.0, 70.0), ("d", 1, 90.0, 120.0)], "doc string, page int, x0 double, x1 double")
    pages = spark.createDataFrame([("d", 1, 0.0, 100.0), ("d", 2, 0.0, 50.0)], "doc string, page int, lo double, hi double")
    gaps = sorted((r["page"], r["gap_start"], r["gap_end"]) for r in layout.whitespace_gaps(spans, pages).collect())
    assert gaps == [(1, 0.0, 20.0), (1, 70.0, 90.0), (2, 0.0, 50.0)]
    blocks = [("d", 1, i, "prose", x, x + 200.0, "t") for i, x in enumerate([50.0, 50.0, 350.0, 350.0])] + [("d", 1, 9, "prose", 60.0, 540.0, "long " * 60)]
    frame = spark.createDataFrame(blocks, "doc string, page int, ord int, kind string, x0 double, x1 double, text string")
    assert rules.gutter_flags(frame).count() == 0 and rules.gutter_flags(frame, holes=True).count() == 1


def test_contexts(spark):
    text = "a" * 60 + " 12. 5 ms " + "b" * 60 + " 7 .5 GB"
    found = {r["check_name"]: r for r in rules.page_flags(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")).orderBy("detail").collect()}
    details = sorted(r["detail"] for r in rules.page_flags(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string")).collect())
    assert set(found) == {"broken_measurement"} and details == ["a" * 24 + " 12. 5 ms " + "b" * 24, "b" * 24 + " 7 .5 GB"]


CHUNKS = [(i, f"d{i % 2}", i % 2, [["prose"], ["caption", "prose"]][i % 2], t) for i, t in enumerate(["tiered memory pages", "page size of 2 MB here", "tiered pages again", "nothing", "other text", "more text", "latency of 54 ms", "54 KB"])]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id int, doc string, tier int, block_types array<string>, text string")


def test_search(spark, chunks):
    index = I.index_of(chunks, "test search")
    assert I.index_of(chunks, "test search") is index
    best = search.search(index, "tiered pages", k=3).collect()
    assert [r["chunk_id"] for r in best] == [0, 2] or [r["chunk_id"] for r in best] == [2, 0]
    assert [r["chunk_id"] for r in search.search(index, "2MB page", block_types=["caption"]).collect()] == [1]
    assert search.search(index, "tiered", doc_ids=["d1"]).count() == 0 and search.search(index, "tiered", tiers=[]).count() == 0 and search.search(index, "?!").count() == 0
    texts = chunks.select("chunk_id", "text")
    turned = search.search(index, "tiered pages", scorer=lambda t: -F.length(t), texts=texts, k=1).collect()
    assert [r["chunk_id"] for r in turned] == [2]
    vectors = spark.createDataFrame([(i, [float(i == 3), 1.0], f"d{i % 2}", i % 2) for i in range(8)], "chunk_id int, embedding array<float>, doc string, tier int")
    both = {r["chunk_id"]: (r["first_rank"], r["second_rank"]) for r in search.search(index, "nothing", vectors, 3).collect()}
    assert both[3] == (0, 0)


def test_audit(spark, chunks):
    """Claims from citation to verdict."""
    index = I.index_of(chunks, "test audit")
    registry = spark.createDataFrame([(1, "d0"), (2, "d1")], "ref int, doc string")
    claims = spark.createDataFrame(
        [(1, ["1"], False, "54 ms", "latency of 54 ms"), (2, ["2"], False, "60 ms", "54 KB page"), (3, ["9"], False, "1", "x"), (4, [], True, "1", "x"), (5, [], False, "2 MB", "page size 2 MB"), (6, ["1"], False, "5", "zzz")],
        "claim_id int, cited_ref array<string>, is_own_result boolean, claimed string, query string",
    )
    replies = spark.createDataFrame([(1, "supported", "Latency  of 54 ms"), (2, "not_found", None), (5, "supported", "size of 2 MB"), (6, "supported", "x")], "claim_id int, verdict string, span string")
    texts = chunks.select("chunk_id", "doc", F.lit(3).cast("long").alias("page"), "text")
    found = {r["claim_id"]: r for r in audit.audit(claims, registry, index, texts, replies).collect()}
    assert {k: r["verdict"] for k, r in found.items()} == {1: "supported", 2: "underspecified", 3: "unresolvable_reference", 4: "skipped_own_result", 5: "possibly_missing_citation", 6: "not_found"}
    assert found[2]["needs_visual_check"] and not found[1]["needs_visual_check"] and found[1]["matched"].strip() == "54 ms" and not found[2]["reliable"]
    lines = [r["line"] for r in audit.report_lines(audit.audit(claims, registry, index, texts, replies)).orderBy("place").collect()]
    assert [x.split("]")[0] for x in lines] == ["[UNRESOLVABLE_REFERENCE", "[NOT_FOUND", "[POSSIBLY_MISSING_CITATION", "[UNDERSPECIFIED"]
    assert values(spark, [(True, "as [S2]"), (True, "as [S9]"), (False, "[S1]"), (True, None)], "a boolean, t string", audit.grounded(F.col("a"), F.col("t"), F.lit(3))) == [(True,), (False,), (False,), (False,)]


def test_evaluation_items(spark):
    src = lambda d, t, p, q: (d, t, p, q)
    items = [
        ("A1", "A", "q", "t", "answer", src("d", 1, 2, "The Quote, here")), ("A2", "A", "q", "t", "answer", None), ("A3", "A", "q", "t", "answer", src("x", 1, 1, "q")), ("A4", "A", "q", "t", "answer", src("d", 0, 9, "q")),
        ("A5", "A", "q", "t", "answer", src("d", 1, 1, "the quote here")), ("A6", "A", "q", "t", "answer", src("d", 1, 1, "never said")), ("A7", "A", "q", "t", "answer", src("d", 1, 1, None)),
        ("B1", "B", "q", None, "refuse", None), ("B2", "B", "q", "t", "answer", src("d", 1, 1, "q")), ("C1", "C", "q", "t", "flag", None), ("C1", "C", "q", "t", "odd", None), ("Z", "Z", None, "t", "answer", None),
    ]
    frame = spark.createDataFrame(items, "id string, class string, question string, ground_truth string, expected_behavior string, source struct<doc_id:string,tier:int,page:int,quote:string>")
    pages = spark.createDataFrame([("d", 1, "nothing"), ("d", 2, "so the quote here is")], "doc string, page int, text string")
    found = sorted((r["id"], r["level"], r["problem"]) for r in evalkit.item_problems(frame, spark.createDataFrame([("d", 1)], "doc string, tier int"), pages).collect())
    assert found == sorted([
        ("A2", "error", "class needs a source"), ("A3", "error", "source not in the registry"), ("A4", "error", "source tier differs from the registry's"), ("A4", "error", "page out of range"),
        ("A5", "warning", "quote found on pages 2"), ("A6", "warning", "quote not located"), ("A7", "warning", "no quote to verify"), ("B2", "error", "B-class must have null ground_truth"), ("B2", "error", "B-class must have null source"),
        ("B2", "error", "B-class must expect refusal"), ("C1", "error", "duplicate id"), ("C1", "error", "unknown expected_behavior"), ("Z", "error", "missing fields"),
    ])
    assert {r["class"]: r["n"] for r in evalkit.composition(frame).collect()}["A"] == 7
    assert evalkit.runs(evalkit.items_in(frame, ["B"]), ["none", "scoped"], 3).count() == 12
    rec = [("C", "scoped", "it is Colloid", "Alto wins", "Colloid wins", [("d", 1, 2)]), ("A", "none", "90%", "90 percent", None, []), ("B", "scoped", "not stated", None, None, [])]
    rows = spark.createDataFrame([(*r[:3], True, None, 1.0, *r[3:5], "d", 2, r[5]) for r in rec], "class string, arm string, answer string, answered boolean, error string, elapsed double, ground_truth string, trap_answer string, doc string, page int, evidence array<struct<doc:string,page_start:int,page_end:int>>")
    got = {r["class"]: r for r in evalkit.run_records(rows).collect()}
    assert got["C"]["misattributed"] and got["C"]["context_hit"] and got["A"]["numeric_match"] and got["A"]["context_hit"] is None and got["B"]["refused"] and got["B"]["context_hit"] is None and got["B"]["numeric_match"] is None
