"""The stored search index: postings in runs in order of the token, one row of statistics for each token, and one row of totals. Chunks are cut into tokens
once, when the index is written, and their postings stay with them, so that none are shuffled; a query reads the pages of its own tokens in each run, which the
Parquet files' statistics find."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import tokens

#: Fixed value: the share of the mean idf that tokens in more than half of the chunks get.
EPSILON = 0.25


class Index(NamedTuple):
    """postings: token, chunk_id, dl and the columns that scopes filter on; stats: token, df, idf; totals: n, avgdl, floor; chunks: the
    scope's columns and dl of each chunk; cut: chunks with their distinct tokens."""

    postings: DataFrame
    stats: DataFrame
    totals: DataFrame
    chunks: DataFrame
    cut: DataFrame


SCOPE = ["doc", "tier", "block_types"]


#: A run of postings closes once it has so many; a batch of so many rows goes back to Spark.
RUN, BATCH = 1_000_000, 50_000


def sorted_runs(batches):
    """Batches of chunks to their postings, in runs in order of the token."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(pc.list_flatten(batch.column("tokens")))
        if n >= RUN:
            yield from _run(held)
            held, n = [], 0
    if held:
        yield from _run(held)


def _run(held: list[pa.RecordBatch]):
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    flat, chunk = pc.list_flatten(rows.column("tokens")).dictionary_encode(), pc.list_parent_indices(rows.column("tokens"))
    place = np.empty(len(flat.dictionary), dtype=np.int64)
    place[pc.sort_indices(flat.dictionary).to_numpy()] = np.arange(len(place))
    order = np.argsort(place[flat.indices.to_numpy()], kind="stable")
    own = [c for c in rows.schema.names if c != "tokens"]
    for begin in range(0, len(order), BATCH):
        at = pa.array(order[begin : begin + BATCH])
        of = chunk.take(at)
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(flat.indices.take(at)), *[rows.column(c).take(of) for c in own]], names=["token", *own])


def write_index(chunks: DataFrame, path: str) -> None:
    """chunks: chunk_id, text, and those of SCOPE that they have."""
    own = ["chunk_id", *[c for c in SCOPE if c in chunks.columns]]
    cut = chunks.select(*own, tokens(F.col("text")).alias("tokens"))
    cut.select(*own, F.size("tokens").alias("dl"), "tokens").write.parquet(f"{path}/cut")
    spark = chunks.sparkSession
    cut = spark.read.parquet(f"{path}/cut")
    full = cut.where(F.size("tokens") > 0).select(*own, "dl", "tokens")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema if f.name != "tokens")
    full.mapInArrow(sorted_runs, f"token string, {kinds}").write.parquet(f"{path}/postings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = cut.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(size["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df.select("token", "df", idf.alias("idf")).repartitionByRange(parts, "token").sortWithinPartitions("token").write.parquet(f"{path}/stats")
    floor = spark.read.parquet(f"{path}/stats").agg((EPSILON * F.avg("idf")).alias("floor"))
    floor.select(F.lit(size["n"]).alias("n"), F.lit(size["avgdl"]).alias("avgdl"), "floor").coalesce(1).write.parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> Index:
    read = spark.read.parquet
    cut = read(f"{path}/cut")
    return Index(read(f"{path}/postings"), read(f"{path}/stats"), read(f"{path}/totals"), cut.drop("tokens"), cut)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.gettempdir()


_held: dict[tuple[str, str], Index] = {}


def index_of(chunks: DataFrame, name: str) -> Index:
    """The index of these chunks, written at the first call of an application and read at each further one. name tells one set of chunks from another."""
    spark = chunks.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _held:
        path = os.path.join(shared_folder(spark), f"larkspur-index-{uuid.uuid4().hex}")
        write_index(chunks, path)
        _held[key] = read_index(spark, path)
    return _held[key]
