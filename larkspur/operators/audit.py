"""Claim checking: citations, scopes, evidence, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import END, compose_query, normalize_span
from larkspur.functions.units import numbers_in, quantities_match
from larkspur.operators.chunking import split_passages
from larkspur.operators.providers import Completer, complete_once, parse_reply
from larkspur.operators.search import bm25_batch, evidence
from larkspur.sources.index import Index

#: Fixed values.
PRIORITY = ["contradicted", "unresolvable_reference", "not_found", "possibly_missing_citation", "underspecified", "partially_supported", "supported", "skipped_own_result"]
PROBLEMS = PRIORITY[:6]


def resolve_references(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """claims (claim_id, cited_ref array<string>, is_own_result) with doc_ids, unknown refs and ref_status. The registry has a row for each source and is
    small; citations explode to narrow rows."""
    each = claims.select("claim_id", "is_own_result", F.posexplode_outer("cited_ref").alias("at", "ref"))
    met = each.join(registry.select(F.col("ref").cast("string").alias("ref"), "doc"), "ref", "left")
    docs = F.transform(F.sort_array(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("at", "doc")))), lambda x: x["doc"])
    unknown = F.transform(F.sort_array(F.collect_list(F.when(F.col("ref").isNotNull() & F.col("doc").isNull(), F.struct("at", "ref")))), lambda x: x["ref"])
    out = met.groupBy("claim_id", "is_own_result").agg(F.count("ref").alias("n_refs"), F.array_distinct(docs).alias("doc_ids"), unknown.alias("unknown"))
    listed = F.concat(F.lit(":["), F.array_join("unknown", ","), F.lit("]"))
    status = F.when(F.col("n_refs") == 0, "no_citation").when(F.size("unknown") == 0, "resolved").when(F.size("doc_ids") > 0, F.concat(F.lit("partially_resolved"), listed)).otherwise(F.concat(F.lit("unresolvable_ref"), listed))
    return out.select("*", status.alias("ref_status"))


def decide_scope(resolved: DataFrame) -> DataFrame:
    action = F.when(F.size("doc_ids") > 0, "verify").when(F.col("n_refs") > 0, "flag").when(F.col("is_own_result"), "skip").otherwise("verify_uncited")
    return resolved.select("*", action.alias("action")).select("*", F.when(F.col("action") == "verify_uncited", 0).alias("exclude_tier"))


def span_verified(texts: Column, span: Column) -> Column:
    """Whether the span, white space and case aside, stands in any of the texts."""
    return (F.length(normalize_span(span)) > 0) & F.exists(texts, lambda t: normalize_span(t).contains(normalize_span(span)))


def numeric_prescreen(pairs: DataFrame) -> DataFrame:
    """(claim_id, claimed, hit, text): the first number, in the order of hits, that matches the claimed quantity."""
    each = pairs.select("claim_id", "claimed", "hit", F.posexplode(numbers_in(F.col("text"))).alias("at", "number"))
    found = each.where(quantities_match(F.col("claimed"), F.col("number"))).groupBy("claim_id").agg(F.min(F.struct("hit", "at", "number")).alias("m"))
    return pairs.select("claim_id").distinct().join(found, "claim_id", "left").select("claim_id", F.col("m").isNotNull().alias("found"), F.col("m.number").alias("matched"))


#: Fixed value: a digit and what may have been a unit before a font lost it.
SUSPECT = rf"\d\s*(?:[\x{{1D400}}-\x{{1D7FF}}]{{1,4}}|[A-Z]{{2,4}}{END})"


def suspect_sites(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(claim_id, hit, doc, page, text) to claim_id, n_sites and the first sites in order of the hits."""
    each = pairs.select("claim_id", "hit", "doc", "page", F.posexplode(F.regexp_extract_all("text", F.lit(SUSPECT), F.lit(0))).alias("at", "site"))
    sites = F.sort_array(F.collect_list(F.struct("hit", "at", "doc", "page", "site")))
    found = each.groupBy("claim_id").agg(F.count("*").alias("n_sites"), F.transform(F.slice(sites, 1, most), lambda s: F.struct(s["doc"].alias("doc"), s["page"].alias("page"), s["site"].alias("site"))).alias("sites"))
    return pairs.select("claim_id").distinct().join(found, "claim_id", "left").select("claim_id", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("sites", F.array().cast("array<struct<doc:string,page:bigint,site:string>>")).alias("sites"))


def prescreen(pairs: DataFrame) -> DataFrame:
    """numeric_prescreen with `reliable`: false where no number was found and some number's unit may have been lost."""
    return numeric_prescreen(pairs).join(suspect_sites(pairs), "claim_id").select("*", (F.col("found") | (F.col("n_sites") == 0)).alias("reliable"))


CLAIMS = "claims array<string>"
#: Of a claim; what may be a number, a list or a flag is read as it is written.
CLAIM = "subject string, metric string, value string, unit string, relation string, condition string, cited_ref string, source_span string, is_own_result string"
PARTS = ["subject", "metric", "value", "unit", "relation", "condition"]
EXTRACT = """List every claim of the passage that states a measured or quantified fact, and what it says of other works.
For each: subject, metric, value (as written, or null), unit, relation, condition (each one that the passage states, or null), cited_ref (the number in
brackets, or null), source_span (copied from the passage letter by letter), is_own_result (true if the authors report it of their own work).
Reply with one JSON object: {"claims": [...]}"""
ADJUDICATE = """Judge the claim by the retrieved passages alone. verdict is one of: supported, partially_supported, contradicted, not_found, underspecified.
evidence_span is copied from a passage letter by letter, or empty.
Reply with one JSON object: {"verdict": "...", "evidence_span": "...", "confidence": "high, medium or low", "explanation": "..."}"""


def extracted_claims(replied: DataFrame) -> DataFrame:
    """Passages with the model's `reply` to a row for each claim, numbered by `at` in its passage. What is no object is no claim; a reply that cannot be
    read has none. span_in_passage: whether the passage holds the span as it is."""
    own = [c for c in replied.columns if c not in ("reply", "error", "prompt")]
    listed = F.filter(parse_reply(F.col("reply"), CLAIMS)["claims"], lambda c: c.startswith("{"))
    rows = replied.select(*own, F.posexplode(listed).alias("at", "json")).select(*own, "at", F.from_json("json", CLAIM).alias("c"))
    span = F.trim(F.coalesce("c.source_span", F.lit("")))
    refs = F.transform(F.split(F.regexp_replace("c.cited_ref", r'[\[\]"]', ""), ","), lambda r: F.regexp_replace(F.trim(r), r"^0+(?=\d)", ""))
    cited = F.coalesce(F.filter(refs, lambda r: r != ""), F.array().cast("array<string>"))
    is_own = F.coalesce(F.lower("c.is_own_result").isin("true", "1"), F.lit(False))
    return rows.select(*own, "at", *[f"c.{p}" for p in PARTS], cited.alias("cited_ref"), is_own.alias("is_own_result"), span.alias("source_span"), ((span != "") & F.col("passage").contains(span)).alias("span_in_passage"))


def adjudicated(claims: DataFrame, pairs: DataFrame, make: Callable[[], Completer]) -> DataFrame:
    """claim_id, verdict and span: the model's word on each claim that has hits."""
    shown = evidence(pairs.withColumnRenamed("hit", "rank"), ["claim_id"]).join(claims, "claim_id")
    prompt = F.concat(F.lit(ADJUDICATE + "\n\n--- CLAIM ---\n"), F.to_json(F.struct(*PARTS)), F.lit("\nAs written: "), "source_span", F.lit("\n\n--- PASSAGES ---\n"), "context")
    r = parse_reply(F.col("reply"), "verdict string, evidence_span string")
    return complete_once(shown.select("claim_id", prompt.alias("prompt")), "prompt", make).select("claim_id", F.lower(F.trim(r["verdict"])).alias("verdict"), F.trim(r["evidence_span"]).alias("span"))


def audit_passages(passages: DataFrame, registry: DataFrame, index: Index, chunks: DataFrame, make: Callable[[], Completer], k: int = 6) -> DataFrame:
    """passages: their key columns and `passage`. Claims are drawn by the model and checked together; claim_id is the key and the claim's number. chunks:
    chunk_id, doc, page_start, page_end, section, text. A passage whose call fails has no claims."""
    keys = [c for c in passages.columns if c != "passage"]
    asked = passages.select("*", F.concat(F.lit(EXTRACT + "\n\n--- PASSAGE ---\n"), "passage").alias("prompt"))
    drawn = extracted_claims(complete_once(asked, "prompt", make))
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in [*keys, "at"]])
    claims = drawn.select(name.alias("claim_id"), "*", F.col("value").alias("claimed"), compose_query(F.col("subject"), F.col("metric"), F.col("value"), F.col("condition")).alias("query"))
    checked = audit(claims, registry, index, chunks.withColumn("page", F.col("page_start")), lambda pairs: adjudicated(claims, pairs, make), k)
    return claims.select("claim_id", *keys, "passage", "source_span", "span_in_passage").join(checked, "claim_id")


def audit_drafts(drafts: DataFrame, key: str, registry: DataFrame, index: Index, chunks: DataFrame, make: Callable[[], Completer], k: int = 6) -> DataFrame:
    """The check of whole drafts (key, text), all their paragraphs with numbers in one job."""
    return audit_passages(split_passages(drafts, key), registry, index, chunks, make, k)


def audit(claims: DataFrame, registry: DataFrame, index: Index, texts: DataFrame, replies: DataFrame | Callable[[DataFrame], DataFrame], k: int = 6) -> DataFrame:
    """The whole check of claims as one job: references, scope, the k best chunks of each claim in its scope, the prescreen of their numbers, and the
    verdict on the reply. claims: claim_id, cited_ref, is_own_result, claimed, query; texts: chunk_id, doc, page, text; replies: claim_id, verdict, span, or
    what makes them of the claims' hits."""
    scoped = decide_scope(resolve_references(claims, registry))
    asked = scoped.where(F.col("action").isin("verify", "verify_uncited")).join(claims.select("claim_id", "claimed", "query"), "claim_id")
    hits = bm25_batch(index, asked.select(F.col("claim_id").alias("query_id"), F.col("query").alias("text"), "doc_ids", "exclude_tier"), k)
    pairs = hits.select(F.col("query_id").alias("claim_id"), "chunk_id", F.col("rank").alias("hit")).join(texts, "chunk_id").join(claims.select("claim_id", "claimed"), "claim_id")
    replies = replies(pairs) if callable(replies) else replies
    checked = prescreen(pairs)
    seen = pairs.groupBy("claim_id").agg(F.count("*").alias("n_hits"), F.collect_list("text").alias("texts"))
    rows = scoped.select("claim_id", "action", "ref_status").join(seen, "claim_id", "left").join(checked, "claim_id", "left").join(replies, "claim_id", "left")
    verified = F.coalesce(span_verified(F.col("texts"), F.col("span")), F.lit(False))
    n, found, reliable = F.coalesce("n_hits", F.lit(0)), F.coalesce("found", F.lit(False)), F.coalesce("reliable", F.lit(True))
    said = F.coalesce(F.col("verdict"), F.lit(""))
    out = verdict(F.col("action"), n, said, verified, found, reliable)
    return rows.select("claim_id", "action", "ref_status", n.alias("n_hits"), found.alias("found"), "matched", reliable.alias("reliable"), verified.alias("span_verified"), out.alias("verdict"), needs_visual_check(F.col("action"), n, said, found, reliable).alias("needs_visual_check"))


def needs_visual_check(action: Column, n_hits: Column, said: Column, found: Column, reliable: Column) -> Column:
    """Whether "not found" may only mean that a font lost the unit."""
    return action.isin("verify", "verify_uncited") & (n_hits > 0) & (said == "not_found") & ~found & ~reliable


def report_lines(records: DataFrame, limit: int | None = None) -> DataFrame:
    """place and line for each problem, the worst first, then by claim."""
    worst = records.where(F.col("verdict").isin(PROBLEMS)).orderBy(priority(F.col("verdict")), "claim_id")
    worst = worst.limit(limit) if limit is not None else worst
    place = F.row_number().over(Window.orderBy(priority(F.col("verdict")), "claim_id"))
    return worst.select(place.alias("place"), F.concat(F.lit("["), F.upper("verdict"), F.lit("] claim "), F.col("claim_id").cast("string"), F.lit(" ("), "ref_status", F.lit(")")).alias("line"))


def grounded(answered: Column, answer: Column, n_sources: Column) -> Column:
    """An answer counts only if the model gave one and it names a source that there is."""
    return F.coalesce(answered, F.lit(False)) & (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.size(cited_sources(answer, n_sources)) > 0)


def verdict(action: Column, n_hits: Column, verdict: Column, verified: Column, found: Column, reliable: Column) -> Column:
    """The model's verdict after the rules, the first that holds."""
    known = F.when(verdict.isin(*PRIORITY), verdict).otherwise("underspecified")
    judged = F.when((known == "supported") & ~verified, "underspecified").otherwise(known)
    return (
        F.when(action == "skip", "skipped_own_result")
        .when(action == "flag", "unresolvable_reference")
        .when(n_hits == 0, "not_found")
        .when((judged == "not_found") & ~found & ~reliable, "underspecified")
        .when((action == "verify_uncited") & (judged == "supported") & found, "possibly_missing_citation")
        .otherwise(judged)
    )


def priority(c: Column) -> Column:
    out = F.lit(9)
    for i, v in enumerate(PRIORITY):
        out = F.when(c == v, i).otherwise(out)
    return out


def cited_sources(answer: Column, n_sources: Column) -> Column:
    """Numbers of the markers [S1], [S2] ... that exist, distinct, in order."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[\s*S([1-9]\d*)\s*\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.sort_array(F.array_distinct(F.filter(marks, lambda i: (i >= 1) & (i <= n_sources))))


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record of each key that comes last; ties are impossible in an append-only log."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, "r.*")
