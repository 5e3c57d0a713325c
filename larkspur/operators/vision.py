"""Records of visual review: what a model said about a page, and whether it saw the page at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<location: string, extracted: string, image_shows: string, severity: string>"
REPLY = f"struct<image_token: string, page_summary: string, discrepancies: array<{FINDING}>>"
#: Fixed values.
SEVERITIES = ["ok", "minor", "major", "cannot_verify"]
WORST_FIRST = ["major", "minor", "cannot_verify", "ok"]
LONGEST = 300


def _finding(d: Column) -> Column:
    cut = lambda n: F.substring(F.coalesce(d[n], F.lit("")), 1, LONGEST).alias(n)
    said = F.lower(F.trim(d["severity"]))
    return F.struct(cut("location"), cut("extracted"), cut("image_shows"), F.when(said.isin(SEVERITIES), said).otherwise("cannot_verify").alias("severity"))


def normalize_records(replies: DataFrame) -> DataFrame:
    """doc, page, image_token and reply (JSON) to the record of the page. A wrong token means that the image was not seen: then
    no finding counts. Findings whose two texts agree, outer space aside, are counted and dropped. A reply that is no JSON has no token."""
    df = replies.select("doc", "page", F.col("image_token").alias("token_expected"), F.from_json("reply", REPLY).alias("r"))
    token = F.upper(F.trim(F.coalesce("r.image_token", F.lit(""))))
    df = df.select("doc", "page", "token_expected", token.alias("token_reported"), F.coalesce("r.page_summary", F.lit("")).alias("page_summary"), F.coalesce("r.discrepancies", F.array().cast(f"array<{FINDING}>")).alias("found"))
    seen = F.coalesce(F.col("token_reported") == F.col("token_expected"), F.lit(False))
    every = F.when(seen, F.transform("found", _finding)).otherwise(F.array().cast(f"array<{FINDING}>"))
    df = df.select("doc", "page", "token_expected", "token_reported", "page_summary", seen.alias("channel_ok"), every.alias("every"))
    agrees = lambda d: (F.trim(d["extracted"]) != "") & (F.trim(d["extracted"]) == F.trim(d["image_shows"]))
    df = df.select("*", F.filter("every", lambda d: ~agrees(d)).alias("discrepancies"))
    has = lambda s: F.exists("discrepancies", lambda d: d["severity"] == s)
    worst = F.coalesce(*[F.when(has(s), s) for s in WORST_FIRST], F.lit("none"))
    status = F.when(~F.col("channel_ok"), "channel_failed_needs_human").when(F.size("discrepancies") > 0, "discrepancies_found").otherwise("clean")
    return df.select("doc", "page", "token_expected", "token_reported", "channel_ok", "page_summary", "discrepancies", (F.size("every") - F.size("discrepancies")).alias("self_agreeing_dropped"), status.alias("status"), F.when(F.col("channel_ok"), worst).alias("max_severity"))
