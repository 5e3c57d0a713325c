"""Readers of drafts, blocks and tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "doc_id string, tier int, page int, section string, block_type string, bbox array<double>, text string, table_rows array<array<string>>, quality_flag string, block_ord long"


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text documents, one row each: path and text. Other formats come through `read_binary` and an extractor."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the stored ordinal, not a place in a file, names a block."""
    rows = spark.read.schema(BLOCKS).json(path)
    return rows.select("*", F.concat_ws(":", "doc_id", F.concat(F.lit("p"), F.col("page").cast("string")), F.col("block_ord").cast("string")).alias("block_id"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.drop("block_id").write.mode("overwrite").json(path)


def write_tables(tables: DataFrame, path: str) -> None:
    """A folder for each document, so that a filter on doc_id reads that document alone."""
    tables.write.mode("overwrite").partitionBy("doc_id").parquet(path)


def read_tables(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("doc_id") == doc_id) if doc_id else rows


def chunk_manifest(chunks: DataFrame, tables: DataFrame, formulas: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(chunks, "n_chunks").crossJoin(n(tables, "n_tables")).crossJoin(n(formulas, "n_formulas"))


def write_report(records: DataFrame, path: str) -> None:
    """JSON lines, one for each record."""
    records.write.mode("overwrite").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of an evaluation, JSON lines; blank lines are no items."""
    source = "struct<doc_id:string,tier:int,page:int,section:string,quote:string>"
    kind = f"id string, class string, question string, ground_truth string, expected_behavior string, trap_answer string, expected_verdict string, source {source}, note string"
    return spark.read.schema(kind).json(path).where("id is not null or class is not null or question is not null")


def text_blocks(blocks: DataFrame, docs: list[str] | None = None) -> DataFrame:
    """The blocks that become chunks: prose, headings and captions, of some documents where these are named."""
    kept = blocks.where(F.col("block_type").isin("prose", "heading", "caption"))
    return kept.where(F.col("doc_id").isin(docs)) if docs else kept
