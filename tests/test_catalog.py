import os

import pytest

from larkspur.plans import catalog
from tests.oracle import TABLES, assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


ODD = ["Aonedé bé oned éoned oned% 9. 5 %a", "oned kſ 12. 5 mſa 12. 5 \u212aiBa 3 .4 GB/sß", "5 ABÉ 6 CDé 7 EF_ 8 GH. The 9 IJKLM", "a" * 29 + "-" * 171, "a" * 57 + "." * 143, "ß2 mbé 2 mb é2 mb 2 mb_ of 2 mbthe", "", None]


def odd_tables(spark, folder):
    """The small tables, but documents with letters beside numbers and units and with ratios on a border."""
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    own = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    own.toPandas().to_parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["quality_flags", "quality_report", "quality_totals", "token_stats", "bm25_topk"])
def test_odd_texts_against_sql(spark, tmp_path, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], odd_tables(spark, tmp_path))


def test_suspect_sites_beside_letters(spark, tmp_path):
    folder = odd_tables(spark, tmp_path)
    whole = lambda df: df.where("claim_id < 6")
    assert_same(spark, lambda s, d: whole(catalog.queries()["suspect_sites"](s, d)), f"SELECT * FROM ({catalog.oracle_sql()['suspect_sites']}) WHERE claim_id < 6", folder)


def test_bibliography_whole(spark, tmp_path):
    """All characters but white space come back in order, of long lines and of more lines than numbers with three digits, too."""
    own = spark.createDataFrame([(1, "x" * 1500 + " end\n\nlast"), (2, "\n".join(f"line {i}" for i in range(2100))), (3, " \n"), (4, None)], "doc_id long, text string")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), SF):
        found = {}
        for r in sorted(catalog.queries()["bibliography_parse"](spark, folder).collect()):
            found[r["doc_id"]] = found.get(r["doc_id"], "") + "".join(r["entry"].split())
        texts = {r["doc_id"]: "".join((r["text"] or "").split()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert found == {k: t for k, t in texts.items() if t}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
