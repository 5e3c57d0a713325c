import pytest
from pyspark.sql import functions as F

from larkspur.operators import providers
from larkspur.sources import readers, registry
from larkspur.streaming import logs


def test_reply_and_retries(spark):
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"a": 2} done', "none"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [x[0] for x in rows.orderBy("i").select(providers.parse_reply(F.col("r"), "a int")["a"]).collect()] == [1, 2, None]
    calls = []

    def call(status):
        calls.append(status)
        raise providers.ProviderError("no", status)

    for status, n in ((503, 3), (400, 1)):
        calls.clear()
        with pytest.raises(providers.ProviderError):
            providers.with_retries(lambda status=status: call(status), sleep=lambda s: None)
        assert len(calls) == n


def test_logs_and_blocks(spark, tmp_path):
    log = spark.createDataFrame([("d", 1, "failed", 1), ("d", 1, "clean", 2), ("d", 2, "failed", 3)], "doc string, page int, status string, ord int")
    logs.append(log, str(tmp_path / "log"))
    logs.mirror(logs.follow(spark, str(tmp_path / "log"), "doc string, page int, status string, ord int"), str(tmp_path / "copy"), str(tmp_path / "state")).awaitTermination()
    copy = spark.read.parquet(str(tmp_path / "copy"))
    queue = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc string, page int")
    pages = lambda **kw: sorted(r["page"] for r in logs.pending(queue, copy, ["doc", "page"], "ord", **kw).collect())
    assert pages() == [2, 3] and pages(retry_failed=True) == [2]
    blocks = spark.createDataFrame([("d", 1, 7, "t")], "doc_id string, page int, block_ord long, text string")
    readers.write_blocks(blocks, str(tmp_path / "blocks"))
    assert readers.read_blocks(spark, str(tmp_path / "blocks")).first()["block_id"] == "d:p1:7"


def test_registry_file(spark, tmp_path):
    (tmp_path / "corpus.yaml").write_text("- {ref: 1, doc_id: a, tier: 0, title: A}\n- {ref: 1, doc_id: b, tier: 1}\n")
    path = registry.discover(str(tmp_path))
    found = {tuple(r) for r in registry.problems(registry.load(spark, path)).collect()}
    assert found == {("duplicate_ref", "1"), ("missing_title", "b")}


def test_bibliography_marks(spark):
    texts = [
        ("1. body\nReferences\n[1] One cross references in two\n[2] Two", {1: "One cross references in two", 2: "Two"}),
        ("9. body\nBibliography\n1) One", {1: "One"}),
        ("9. body\n參考文獻\n1. One", {1: "One"}),
        ("9. body\nREFERENCES\n3. Three\nBibliography\n4. Four", {3: "Three Bibliography", 4: "Four"}),
        ("References\n1. One\nBibliography\n2. Two\nReferences\n5. Five", {5: "Five"}),
        ("no mark\n7. Seven", {7: "Seven"}),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(registry.bibliography(F.col("t"))).collect()] == [m for _, m in texts]


def test_bibliography_by_position(spark):
    by_year = "[MTM] J. Ren,  a long enough title of a paper, 2024"
    by_venue = "L. Xiang, another long enough title, in proceedings of it"
    text = f"Body of 2019, a line of more than forty characters\nReferences of 2020, a line of more than forty characters\n{by_year}\nShort, 2021\nA line of more than forty characters without either\n{by_venue}\n{'x' * 700} arXiv"
    rows = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "i int, t string")
    found = [r[0] for r in rows.orderBy("i").select(registry.bibliography(F.col("t"))).collect()]
    assert found == [{1: by_year.replace("  ", " "), 2: by_venue, 3: "x" * 600}, {}, None]


def test_services(monkeypatch):
    from larkspur.operators import providers as P

    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(P.ProviderError):
        P.require_ready(P.service("openai"))
    with pytest.raises(P.ProviderError):
        P.service("nobody")
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setenv("LARKSPUR_PROVIDER", "ollama")
    P.require_ready(P.service("openai"), vision=True)
    with pytest.raises(P.ProviderError):
        P.require_ready(P.service("deepseek")._replace(key_env=None), vision=True)
    sent = []
    post = lambda url, headers, body: sent.append((url, headers, body)) or {"response": "a", "choices": [{"message": {"content": "b"}}]}
    assert P.HttpCompleter(P.service(), post).complete("p") == "a" and P.HttpCompleter(P.service("openai"), post).complete("p", b"png") == "b"
    assert sent[0][2]["prompt"] == "p" and sent[0][1] == {} and sent[1][1] == {"Authorization": "Bearer k"} and sent[1][2]["messages"][0]["content"][1]["type"] == "image_url"


def test_registry_files(spark, tmp_path):
    rows = [(None, "survey", 0, "s.pdf", "A Survey", "survey", None, 2024), (3, "a", 1, "a.pdf", "A", "a", "OSDI", 2020), (None, "b", 1, "b.pdf", "B: c", "b", None, None)]
    path = str(tmp_path / "corpus.yaml")
    assert registry.load_checks(path) == {"set_queries": [], "retrieval": {}, "self_audit": []}
    registry.bootstrap(spark.createDataFrame(rows, registry.SCHEMA), path)
    assert sorted(map(tuple, registry.load(spark, path).collect()), key=repr) == sorted(rows, key=repr) and open(path).read().count("NEEDS ATTENTION") == 1
    (tmp_path / "checks.yaml").write_text("set_queries: [{name: n, pattern: 2mb, column: c, expect: [x]}]")
    assert registry.load_checks(path)["set_queries"][0]["expect"] == ["x"]


def test_readers(spark, tmp_path):
    from larkspur.sources import readers as S

    (tmp_path / "items.jsonl").write_text('{"id": "A1", "class": "A", "question": "q", "source": {"doc_id": "d", "page": 2}}\n\n{"id": "B1", "class": "B"}\n')
    assert sorted((r["id"], r["source"] and r["source"]["page"]) for r in S.read_items(spark, str(tmp_path / "items.jsonl")).collect()) == [("A1", 2), ("B1", None)]
    blocks = spark.createDataFrame([("d", "prose"), ("d", "table"), ("e", "caption")], "doc_id string, block_type string")
    assert S.text_blocks(blocks).count() == 2 and S.text_blocks(blocks, ["d"]).count() == 1
    S.write_report(blocks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def _chunks(spark):
    words = "the of kiln glaze ash 2 mb cone firing raku slip clay".split()
    rows = [(i, f"d{i % 5}" if i % 11 else None, i % 3 if i % 13 else None, " ".join(words[(i * j + j) % 12] for j in range(i % 9))) for i in range(200)]
    return spark.createDataFrame(rows, "chunk_id long, doc string, tier int, text string").repartition(3)


def test_batch_in_place(spark, monkeypatch):
    """Chunks are scored where they lie: no join with the postings, and the same ranks as by the join."""
    from larkspur.operators import search
    from larkspur.sources.index import index_of

    index = index_of(_chunks(spark), "batch in place")
    queries = spark.createDataFrame([(1, "ash of kiln", ["d1", "d2"], None), (2, "2 MB glaze ash ash", [], 1), (3, "clay", None, 0), (4, "nothing known", None, None), (5, None, None, None), (6, "cone", [None, "d9"], 2)], "query_id int, text string, doc_ids array<string>, exclude_tier int")
    out = search.bm25_batch(index, queries, 4)
    found = sorted(map(tuple, out.collect()))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "MOST_QUERIES", 0)
    assert found == sorted(map(tuple, search.bm25_batch(index, queries, 4).collect())) and len(found) > 12


def test_postings_in_runs(spark, monkeypatch):
    """Postings are those of the chunks, unshuffled: each run is in order of the token."""
    import pyarrow as pa

    from larkspur.sources import index as I

    index = I.index_of(_chunks(spark), "postings in runs")
    each = lambda df: sorted(df.select("token", "chunk_id", "doc", "tier", "dl").collect(), key=str)
    from pyspark.sql import functions as F

    assert each(index.postings) == each(index.cut.select("*", F.explode("tokens").alias("token")))
    monkeypatch.setattr(I, "RUN", 4)
    batch = lambda *t: pa.RecordBatch.from_pydict({"chunk_id": list(range(len(t))), "tokens": list(t)})
    runs = [r.to_pydict() for r in I.sorted_runs([batch(["b", "a"], ["a"]), batch(["c"]), batch(["z", "a"])])]
    assert runs == [{"token": ["a", "a", "b", "c"], "chunk_id": [0, 1, 0, 0]}, {"token": ["a", "z"], "chunk_id": [0, 0]}]


def test_raw_bm25_keeps_chunks_in_place(spark):
    """Neither texts nor their tokens by chunk are shuffled."""
    from larkspur.operators import search

    plan = search.raw_bm25(_chunks(spark), "the ash of 2 MB")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [chunk_id" not in plan
