import json

from pyspark.sql import functions as F

from larkspur.operators import answers, audit, providers
from larkspur.session import Session
from larkspur.sources import index, registry

SOURCES = [(0, "a", 1, 3, 4, "Design", "A page of 2 MB moves in 54 us."), (1, "s", 0, 1, 1, None, "The survey says 54 us for a page.")]


def maker():
    class Model:
        """Stands for a model: the prompt's last words tell it what to say."""

        def complete(self, prompt):
            import json

            from larkspur.operators.providers import ProviderError

            if "--- PASSAGE ---" in prompt:
                one = {"subject": "page move", "value": "54 us", "cited_ref": [1, "09"], "source_span": "moves in 54 us", "is_own_result": False}
                return json.dumps({"claims": [one, "noise", {"subject": "page survey", "cited_ref": 7, "source_span": "elsewhere"}, {"subject": "own", "is_own_result": True}]})
            if "--- CLAIM ---" in prompt:
                return json.dumps({"verdict": " Supported ", "evidence_span": "A page of 2 MB  moves in 54 US."})
            if prompt.endswith("broken"):
                raise ProviderError("no such model", 400)
            if prompt.endswith("cited"):
                return '{"answered": true, "answer": " 54 us [ S2 ], [S1] [S9] ", "used_sources": ["s1"]}'
            if prompt.endswith("listed"):
                return '{"answered": true, "answer": "54 us", "used_sources": ["[s2] ", "S02", "x"]}'
            if prompt.endswith("bare"):
                return '{"answered": true, "answer": "54 us [S99999999999999]"}'
            return '{"answered": false, "answer": "", "unsupported_note": "no figure"}'

    return Model()


def test_ask(spark):
    asked = ["cited", "listed", "bare", "broken", "silent", "nothing"]
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    hits = spark.createDataFrame([(q, i, f"c{i}", *s[1:]) for q in range(5) for i, s in enumerate(SOURCES)], "query_id int, rank int, chunk_id string, doc string, tier int, page_start int, page_end int, section string, text string")
    got = {r["question"]: r for r in answers.ask(questions, hits, maker).collect()}
    assert sorted(got) == sorted(asked)
    marks = {q: [c["marker"] for c in r["citations"]] for q, r in got.items()}
    assert marks == {"cited": ["S1", "S2"], "listed": ["S2"], "bare": [], "broken": [], "silent": [], "nothing": []}
    assert got["cited"]["answer"] == "54 us [ S2 ], [S1] [S9]" and got["cited"]["not_stated"] is None and got["listed"]["answered"]
    assert got["cited"]["citations"][0]["doc"] == "a" and got["cited"]["citations"][0]["page_end"] == 4
    assert {q: got[q]["note"] for q in ("bare", "broken", "silent", "nothing")} == {"bare": answers.UNCITED, "broken": "no such model", "silent": "no figure", "nothing": answers.NO_HITS}
    assert all(not got[q]["answered"] and got[q]["answer"] == "" and got[q]["not_stated"] == answers.NOT_STATED for q in asked[2:])
    prompt = answers.prompts(questions, hits).where("query_id = 0").first()["prompt"]
    assert "[S1] (TIER-1, original paper) a p3-4, section: Design\nA page" in prompt and "[S2] (TIER-0, the survey's own paraphrase) s p1, section: (no section heading)" in prompt


def test_claims_of_replies(spark):
    rows = spark.createDataFrame([(1, "It moves in 54 us.", maker().complete("--- PASSAGE ---")), (2, "x", "no JSON"), (3, "x", None), (4, "x", json.dumps({"claims": [{"cited_ref": "[3, 9]", "value": 5}]}))], "n int, passage string, reply string")
    got = [(r["n"], r["at"], r["subject"], r["value"], r["cited_ref"], r["span_in_passage"], r["is_own_result"]) for r in audit.extracted_claims(rows).orderBy("n", "at").collect()]
    assert got == [
        (1, 0, "page move", "54 us", ["1", "9"], True, False),
        (1, 1, "page survey", None, ["7"], False, False),
        (1, 2, "own", None, [], False, True),
        (4, 0, None, "5", ["3", "9"], False, False),
    ]


def test_audit_of_drafts(spark):
    chunks = spark.createDataFrame([(f"c{i}", *s[1:]) for i, s in enumerate([*SOURCES, *[(0, "b", 1, 1, 1, None, f"other {i}") for i in range(6)]])], "chunk_id string, doc string, tier int, page_start int, page_end int, section string, text string")
    sources = spark.createDataFrame([(1, "a")], "ref int, doc string")
    drafts = spark.createDataFrame([("d", f"A draft says that it moves in 54 us. {'More words follow here. ' * 4}")], "name string, text string")
    got = {r["claim_id"]: r for r in audit.audit_drafts(drafts, "name", sources, index.index_of(chunks, "drafts"), chunks, maker).collect()}
    assert {k: (r["action"], r["verdict"], r["ref_status"]) for k, r in got.items()} == {
        "d-1-0": ("verify", "supported", "partially_resolved:[9]"),
        "d-1-1": ("flag", "unresolvable_reference", "unresolvable_ref:[7]"),
        "d-1-2": ("skip", "skipped_own_result", "no_citation"),
    }
    first = got["d-1-0"]
    assert first["found"] and first["matched"] == "54 us" and first["span_verified"] and first["span_in_passage"] and first["n_hits"] == 1


def test_session_asks_and_checks(spark):
    chunks = spark.createDataFrame([(i, f"doc_{i % 2}", i % 2, 1, 2, t) for i, t in enumerate(["tiered memory", "A page of 2 MB moves in 54 us.", "tiered pages", "none", "other", "more"])], "chunk_id int, doc string, tier int, page_start int, page_end int, text string")
    sources = spark.createDataFrame([(1, "doc_0", "zero"), (9, "doc_1", "one")], "ref int, doc_id string, short string")
    layer = spark.createDataFrame([("t", "doc_0", 0, ["name", "size"], [["a", "2 MB"]]), ("u", "doc_1", 1, ["name", "size"], [["b", "2 MB"]])], "table_id string, doc string, tier int, header array<string>, rows array<array<string>>")
    mute, s = Session(chunks, layer, sources), Session(chunks, layer, sources, make=maker)
    assert mute.line("/ask page") == mute.line("/check page") == "/ask and /check want a model"
    assert s.line("/ask moves cited").first()["citations"][0]["doc"] == "doc_1"
    assert {r["verdict"] for r in s.line("/check A page moves in 54 us.").collect()} == {"supported", "unresolvable_reference", "skipped_own_result"}
    assert s.line("/tables 2mb").count() == 2 and s.line(r"/tables ^\S mb in size").count() == 2
    assert s.line("/tier 1") == "tier=1 k=6" and [r["label"] for r in s.line("/tables 2mb").collect()] == ["b"]
    assert s.line("/tier 7") == "/tier wants 0, 1 or off" and s.line("/tier -") == "k=6" and s.line("/doc none") == "all documents"
    assert s.line("/k 0") == "k=1" and s.line("/k 99") == "k=20"


def test_metadata(spark):
    lines = [
        ("a", 1, 0, 20.0, "Proceedings of the 1st OSDI"), ("a", 1, 1, 14.0, "A Title that Wraps"), ("a", 1, 2, 14.2, "to the  Next Line"), ("a", 1, 3, 14.3, "Larger, but not by enough"), ("a", 2, 0, 30.0, "Later pages do not count"),
        ("b", 1, 0, 9.0, "short"), ("b", 1, 1, 9.0, ""), ("b", 2, 0, 10.0, "Title of the Second Page"), ("b", 2, 1, 10.0, "which is not joined"),
        ("c", 1, 0, 12.0, "Title before a Sentence"), ("c", 1, 1, 12.0, "It ends here."),
    ]
    lines = spark.createDataFrame(lines, "doc string, page int, ord int, size double, text string")
    pages = spark.createDataFrame([("a", 1, "Of 2019"), ("a", 2, "OSDI 2030"), ("b", 1, "x"), ("b", 3, "arXiv: 2401.01234"), ("b", 4, "SOSP"), ("d", 1, "2001")], "doc string, page int, text string")
    assert {r["doc"]: r["title"] for r in registry.titles(lines).collect()} == {"a": "A Title that Wraps to the Next Line", "b": "Title of the Second Page", "c": "Title before a Sentence"}
    got = {r["doc"]: (r["title"], r["venue"], r["year"]) for r in registry.metadata(lines, pages).collect()}
    assert got == {"a": ("A Title that Wraps to the Next Line", "OSDI", 2019), "b": ("Title of the Second Page", "arXiv:2401.01234", 2024), "d": ("d", None, 2001)}


def test_calls_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cited"), (2, "broken")], "n int, p string")
    kept = providers.complete_once(rows, "p", maker, str(tmp_path / "replies"))
    assert kept.where(F.col("error").isNull()).count() == 1 and "larkspur" not in kept.inputFiles()[0]
