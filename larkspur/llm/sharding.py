"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters are known,
then one exchange. The law is `bytes`: shards of near equal size.

Every document has a key: md5 of its text, md5 of its id, and the number of its row, as hex digits, so equal texts stand side by side and no
two rows have the same key. The
histogram counts rows and bytes of key prefixes over all partitions; prefixes that hold too many rows (a hot group
of copies among them) are refined by further digits, past the text's digits into the id's, until
each leaf is small. So the bytes below every leaf are exact, the exchange deals leaves, and
a running sum inside a leaf places each row.

A group of equal texts of at most TOLERANCE of a shard's bytes is never split: it goes where its middle falls, so a
splitter is off by at most half of that. A larger group is split by row, each row going where its middle falls.
Shards are ranges of the key; slots number a shard's rows from 0 in key order.

The driver gets at most 4,096 bins for each hot prefix, of which there are at most as many as leaves; each round reads the small
table of keys, not the texts.

Edge cases: a null text has size 1 and the key of an empty one. Null ids have the key of an empty one.
Repeated rows stand side by side and get slots of their own, in any order. An empty table gives an
empty one. Columns other than those asked for are left out; those named like an output column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, packed, spread, whole_text

SHARDS = 16
TOLERANCE = 0.02
#: Leaves aimed at: four for each partition of a shuffle, within these bounds. A prefix is refined if it holds more than its share of the rows
#: and MIN_LEAF_ROWS.
LEAVES, MOST_LEAVES = 512, 16_384
MIN_LEAF_ROWS = 256
TEXT_DIGITS = 32
#: Prefix lengths in hex digits: 4,096 bins at first, then finer; 12 digits nearly always hold one text.
LEVELS = [3, 6, 9, 12, TEXT_DIGITS, *range(TEXT_DIGITS + 3, 2 * TEXT_DIGITS, 3), *range(2 * TEXT_DIGITS, 80, 3), 80]
OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def text_size() -> Column:
    return (F.octet_length(whole_text()) + 1).cast("long")


def sort_key() -> Column:
    return F.concat(F.md5(whole_text()), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _leaves(keyed: DataFrame) -> tuple[list[dict], int]:
    """Leaves in key order: lo, the rows and bytes before, and for a part of a large group what lies before the group
    and its bytes. Also all bytes."""

    def bins(level: int, parents: list[str], up: int) -> list:
        rows = keyed.where(F.substring("key", 1, up).isin(parents)) if parents else keyed
        return rows.groupBy(F.substring("key", 1, level).alias("lo")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()

    done: list[dict] = []
    groups: dict[str, int] = {}
    hot: list[str] = []
    most = up = 0
    for level in LEVELS:
        found = [r.asDict() for r in bins(level, hot, up)]
        most = most or max(MIN_LEAF_ROWS, sum(r["rows"] for r in found) // max(LEAVES, min(MOST_LEAVES, 4 * spread(keyed))))
        last = level == LEVELS[-1]
        hot = [] if last else [r["lo"] for r in found if r["rows"] > most]
        if level == TEXT_DIGITS:
            groups = {r["lo"]: r["bytes"] for r in found if r["rows"] > most}
        held = set(hot)
        done += [r for r in found if r["lo"] not in held]
        up = level
        if not hot:
            break
    done.sort(key=lambda r: r["lo"])
    out: list[dict] = []
    rows = total = 0
    for r in done:
        group = r["lo"][:TEXT_DIGITS] if len(r["lo"]) > TEXT_DIGITS else None
        if group is None and out and out[-1]["group"] is None and out[-1]["rows"] + r["rows"] <= most:
            out[-1]["rows"] += r["rows"]  # neighbours share a leaf
        else:
            before = next((x["group_before"] for x in out[-1:] if x["group"] == group), total)
            out.append({"lo": r["lo"], "rows": r["rows"], "rows_before": rows, "bytes_before": total, "group": group, "group_before": before, "group_bytes": groups.get(group, 0)})
        rows += r["rows"]
        total += r["bytes"]
    return out, total


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _leaf_of(lows: list[str]) -> Column:
    """Binary search in a constant: the last leaf whose lower bound is not above the key."""
    bounds, steps = _constant(lows, "string"), F.sequence(F.lit(1), F.lit(max(1, len(lows).bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(lows) - 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        above = F.get(bounds, mid) <= F.col("key")
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(F.greatest(mid - 1, F.lit(0))).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def assign_shards(docs: DataFrame, keep: list[str], shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The columns `keep` of docs with key and OUT."""
    keep = [c for c in keep if c not in OUT]
    row = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    keyed = materialize(docs.select(packed(docs, keep).alias("row"), text_size().alias("size"), F.crc32(whole_text().cast("binary")).alias("text_crc32"), F.concat(sort_key(), row).alias("key")))
    leaves, total = _leaves(keyed)
    if not leaves:
        leaves, total = [{"lo": "", "rows_before": 0, "bytes_before": 0, "group_before": 0, "group_bytes": 0}], 1
    at = lambda name: F.get(_constant([x[name] for x in leaves], "bigint"), F.col("leaf"))
    dealt = keyed.select("*", _leaf_of([x["lo"] for x in leaves]).alias("leaf")).repartition(max(spread(docs), min(len(leaves), 4 * spread(docs))), "leaf")
    in_leaf = Window.partitionBy("leaf").orderBy("key")
    in_group = Window.partitionBy("leaf", F.substring("key", 1, TEXT_DIGITS))
    placed = dealt.select("*", (at("rows_before") + F.row_number().over(in_leaf) - 1).alias("place"), (at("bytes_before") + F.sum("size").over(in_leaf.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    split = at("group_bytes") > 0
    placed = placed.select("*", F.when(split, at("group_before")).otherwise(F.min("before").over(in_group)).alias("g_before"), F.when(split, at("group_bytes")).otherwise(F.sum("size").over(in_group)).alias("g_bytes"))
    whole = F.col("g_bytes") <= F.lit(int(tolerance * total / shards))
    twice = F.when(whole, 2 * F.col("g_before") + F.col("g_bytes")).otherwise(2 * F.col("before") + F.col("size"))
    placed = materialize(placed.select("row", "size", "text_crc32", "key", "place", twice.alias("twice")).select("*", F.least(F.lit(shards - 1).cast("long"), F.expr(f"twice * {shards}L div {2 * total}L")).cast("int").alias("shard")).drop("twice"))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = _constant([first.get(i, 0) for i in range(shards)], "bigint")
    return placed.select("row.*", "key", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents with their own columns as Parquet, shard=0 and so on, in key order inside a file. The splitters are the
    least keys of the shards; texts are exchanged once, by ranges of the key."""
    firsts = {r["shard"]: r["k"] for r in assign_shards(docs, []).groupBy("shard").agg(F.min(F.substring("key", 1, 2 * TEXT_DIGITS)).alias("k")).collect()}
    bounds = [firsts[i] for i in sorted(firsts)]
    keyed = docs.select("*", sort_key().alias("key"))
    keyed = keyed.select("*", F.get(_constant(sorted(firsts), "int"), _leaf_of(bounds or [""])).alias("shard"))
    keyed.repartitionByRange(spread(docs), "key").sortWithinPartitions("key").drop("key").write.partitionBy("shard").parquet(path)
