"""The entities of the data model as views over the star-schema tables, with the same text on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.index import Index, index_of

#: A table in fewer splits than this and than the cores is dealt out anew, so that small files keep all cores busy.
FEWEST_SPLITS = 32
LONG_TEXTS = ["documents", "conversations", "pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    least = min(spark.sparkContext.defaultParallelism, FEWEST_SPLITS)
    return rows.repartition(least) if name in LONG_TEXTS and rows.rdd.getNumPartitions() < least else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document; its source is the document, tier 0 for src0."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.when(F.col("source") == "src0", 0).otherwise(1).alias("tier"), "text")


def index(spark: SparkSession, sf_dir: str) -> Index:
    return index_of(chunks(spark, sf_dir), sf_dir)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents: source, page (the document), place, kind and made-up coordinates."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.when(F.length("text") <= 40, "heading").otherwise("prose")
    x0 = (F.when(F.col("ord") % 12 < 6, 50).otherwise(310) + F.col("ord") % 3).cast("double")
    return d.where(F.length("text") > 0).select("*", kind.alias("kind"), x0.alias("x0"), (F.col("ord") * 12).cast("double").alias("y0"))


BLOCKS_SQL = """
  SELECT doc, page, ord, text, CASE WHEN length(text) <= 40 THEN 'heading' ELSE 'prose' END AS kind,
         CAST((CASE WHEN ord % 12 < 6 THEN 50 ELSE 310 END) + ord % 3 AS DOUBLE) AS x0, CAST(ord * 12 AS DOUBLE) AS y0
  FROM (SELECT source AS doc, doc_id AS page, generate_subscripts(lines, 1) - 1 AS ord, unnest(lines) AS text
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))
  WHERE length(text) > 0"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each brand of parts: name, brand, type, granularity."""
    p = table(spark, sf_dir, "part")
    mb = F.concat(F.col("p_size").cast("string"), F.lit(" MB"))
    row = F.struct("p_partkey", F.array(F.concat("p_name", F.lit(" ["), F.col("p_partkey").cast("string"), F.lit("]")), "p_brand", "p_type", F.when(F.col("p_partkey") % 2 == 0, mb).otherwise(F.concat(F.lit("4 KB / "), mb))).alias("cells"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"])
    return p.groupBy(F.col("p_brand").alias("table_id")).agg(rows.alias("rows")).select("table_id", F.array(*map(F.lit, ["name", "brand", "type", "granularity"])).alias("header"), "rows")


CELLS_SQL = """
  SELECT p_brand AS table_id, p_partkey, trim(p_name) AS label,
         CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '4 KB / ' END || p_size || ' MB' AS value FROM part"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each order: a value in ms against its source in us, and a citation of which some are unknown."""
    k = F.col("o_orderkey")
    q = k % 50 + 1
    refs = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("o_custkey") % 25).cast("string"), F.expr("cast(o_custkey div 25 % 40 as string)")))
    return table(spark, sf_dir, "orders").select(
        k.alias("claim_id"),
        F.concat(q.cast("string"), F.lit(" ms")).alias("claimed"),
        F.concat((q * F.when(k % 3 == 0, 1100).otherwise(1000)).cast("string"), F.lit(" us")).alias("source"),
        refs.alias("cited_ref"),
        (k % 14 == 0).alias("is_own_result"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("doc"))
