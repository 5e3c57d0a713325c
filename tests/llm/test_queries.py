import pytest

import corpus_pipeline
from larkspur.llm import bpe, decontaminate, pii, quality
from larkspur.llm.queries import oracle_sql, queries, vocabulary
from tests.llm import brute
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, queries()[name], oracle_sql()[name], SF)


def test_pipeline(spark):
    """Against plain Python, but for the quality verdicts, which op4's SQL holds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], brute.plain_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in quality.judge_quality(docs, ["doc_id"]).where("kept").collect()}
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    ids, _ = brute.components(left)
    left = [(d, t) for (d, t), c in zip(left, ids) if d == c]
    left = [(d, t) for d, t in left if not brute.hits(brute.plain_words(t), items)[0]]
    c = bpe.codec(vocabulary("word_bpe_49k.json"))
    want = {d: c.library.encode(pii.redact(t, pii.find_spans(t)), add_special_tokens=False).ids for d, t in left}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_pipeline_drops_what_holds_one_item(spark):
    """One window of one item is enough for the stage; the query's own rule wants two items."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()
    rows = [(1, "well " + bench["text"] + " and on", "en", "s", 1), (2, "nothing of it here", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()) == [2, 3]
    assert not decontaminate.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stage_edges(spark, stage):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, more columns with clashing names."""
    word = "the sea of " + " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n ", word, word, "one two", "x" * 300_000, "no good " * 20_000, word + " end"]
    own = [(None if i == 0 else i, t, [None, "en", "xx"][i % 3], None, None, "a", "b", "c", i) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, words string, kept string, token string, n int"
    docs = spark.createDataFrame([*own, own[3], own[0]], kind).repartition(3)
    out = stage(spark, docs, SF)
    found = [r["doc_id"] for r in out.collect()]
    assert set(found) <= {None, *range(1, 9)} and stage(spark, docs.where("false"), SF).count() == 0
    if stage is corpus_pipeline.encoding:
        assert len(found) == 11 and out.columns[0] == "doc_id"
    else:
        assert out.columns == docs.columns and 8 in found or 3 in found
    if stage in (corpus_pipeline.personal_data, corpus_pipeline.decontamination):
        assert len(found) == 11
