"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words everywhere here: space and \t \n \v \f \r.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A table in fewer splits than this and than the cores is dealt out anew, so that small files keep all cores busy.
FEWEST_SPLITS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    least = min(spark.sparkContext.defaultParallelism, FEWEST_SPLITS)
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only in local mode, where driver and executors are one process, a
    temporary folder may stand in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "larkspur-checkpoints")


#: Seconds between two collections that `materialize` asks for.
TIDY_SECONDS = 10.0
_tidied = [0.0]


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder. What led to it, shuffle files above all, is of no more use then; Spark's
    cleaner removes it (and, where spark.cleaner.referenceTracking.cleanCheckpoints is set, older checkpoints) once the driver's
    heap is collected, which a job of many steps on small driver tables hardly ever causes by itself."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Collects the driver's heaps at once: for callers that have just let go of large shuffles or checkpoints, which `materialize`, called
    while they are held, cannot see."""
    gc.collect()  # Python's objects hold the JVM's
    spark.sparkContext._jvm.System.gc()
    _tidied[0] = time.monotonic()


#: About so many bytes go to a Python worker at once (at least one row). The JVM holds a batch outside its heap, the worker the same and what it
#: makes of it; Spark's own bound of 64 MB makes that some hundred MB an executor.
BATCH_BYTES = 4 << 20
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: malloc's fixed size from which arrays are mapped on their own, so that they go back at once; by itself it grows up to 32 MB.
MAPPED_BYTES = 1 << 20
_M_MMAP_THRESHOLD = -3


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind) -> DataFrame:
    """mapInArrow for the pipeline's operators: batches have BATCH_BYTES, if the session sets no bound of its own, and a worker gives its free memory back when its
    task is done, as it lives on beside later tasks of the JVM."""
    session = df.sparkSession
    if not session._jsparkSession.sessionState().conf().contains(BATCH_BYTES_KEY):
        session.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: _given_back(work, batches), kind)


def _given_back(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
    try:
        yield from work(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle whose rows were cut by hand."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, names: list[str] | None = None) -> Column:
    """The columns as one struct, so that no working column can clash with them; "row.*" unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if names is None else names)])


def held(condition: Column) -> Column:
    """The condition, to be evaluated where it stands. A filter on a long chain of columns would otherwise be pushed through the chain, and
    each step would copy the expressions of the one before. Partition numbers are never negative."""
    return condition & (F.spark_partition_id() >= 0)


def words_of(text: str) -> Column:
    """The words of a text column that holds no null."""
    bare = F.trim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def text_key(*more: str) -> Column:
    """With doc_id, tells rows apart: rows that agree in both have the same text (but for a hash collision). `more` names further columns
    that a decision rests on."""
    return F.xxhash64(whole_text(), *[F.col(c) for c in more])


# --- bitmaps over hashes ----------------------------------------------------------------------------------------------
def bitmap(hashes: DataFrame, bits: int) -> Column:
    """A constant array of longs with a bit for each hash (the only column of `hashes`, longs); at most `bits` numbers go to the driver."""
    longs = [0] * (bits // 64)
    for (b,) in hashes.select(F.pmod(hashes[hashes.columns[0]], F.lit(bits)).cast("int")).distinct().collect():
        longs[b // 64] |= 1 << (b % 64)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in longs]
    return F.from_json(F.lit(json.dumps(signed)), "array<bigint>")


def listed(marks: Column, bits: int, h: Column) -> Column:
    """Whether the bit of a hash is set: false proves that the hash is none of those that the bitmap was made of."""
    at = F.pmod(h, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return F.get(marks, F.shiftright(at, 6).cast("int")).bitwiseAND(one) != 0


#: A side of at most so many rows of two longs (16 bytes each) is broadcast.
BROADCAST_ROWS = 500_000
#: Bits of the map that keeps rows out of a shuffle beyond that: 512 kB, whatever the number of keys.
KEY_BITS = 1 << 22


def _key(*columns) -> Column:
    return F.xxhash64(*columns)


def without(docs: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """docs but for the rows whose (doc_id, text_key(*more)) stands in keys (materialized, columns k_id and k_text).

    Up to BROADCAST_ROWS keys are broadcast. Beyond that, rows whose key misses a bitmap of the keys stay where they are, and only the others are
    shuffled to meet the keys; so what moves is what is likely to go."""
    on = docs["doc_id"].eqNullSafe(keys["k_id"]) & (text_key(*more) == keys["k_text"])
    if keys.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(keys), on, "left_anti")
    hit = listed(bitmap(keys.select(_key("k_id", "k_text")), KEY_BITS), KEY_BITS, _key("doc_id", text_key(*more)))
    return docs.where(~hit).unionByName(docs.where(hit).join(keys, on, "left_anti"))


def among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_key) stands in keys; the others are kept out of any shuffle as in `without`."""
    on = docs["doc_id"].eqNullSafe(keys["k_id"]) & (text_key() == keys["k_text"])
    if keys.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(keys), on, "left_semi")
    hit = listed(bitmap(keys.select(_key("k_id", "k_text")), KEY_BITS), KEY_BITS, _key("doc_id", text_key()))
    return docs.where(hit).join(keys, on, "left_semi")
