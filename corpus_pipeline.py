"""A corpus from documents to tokens: quality rules, near duplicates, benchmark passages, personal data, BPE.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents and holds all that the stage before kept. All but the
last return these columns; the last returns doc_id with the token ids and their digests. No stage reads anything but its input
and, for decontamination, the benchmark. Where the results of a stage are written is the caller's affair, but for run(), which writes
each to the shared folder that the cluster names in spark.checkpoint.dir and removes it once the next one is written.

In every stage an empty table gives an empty one with the same columns, and more columns than those of documents pass through, whatever their
names (but for the last, which returns its own).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import bpe, decontaminate, jaccard, pii, quality
from larkspur.llm.common import shared_folder, table
from larkspur.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null and empty texts among them, as they have too few words. A null language is judged
    like an unknown one. Repeated rows are judged alike."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of linked ones, and one of repeated rows. Texts without words, null or empty, are
    linked with nothing and stay; a document without id stays only where its group has no id at all."""
    return jaccard.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of any benchmark item. Null and empty texts hold none and stay; repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; no document goes. A null text stays null, repeated rows stay."""
    return pii.redact_pii(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each text; one row for each row. A null text has no tokens, like an empty one."""
    return bpe.encode_documents(docs, ["doc_id"], vocabulary("word_bpe_49k.json"), full=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("bpe encoding", encoding),
]

#: SQL cannot express BPE; tests hold run() against plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """By Spark's own file system, as the folder may be in any store."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    folder = os.path.join(shared_folder(spark), f"larkspur-pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs
