"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is compiled to a regular expression and filed under one token: of the tokens that every URL
which the rule can fit must hold as a whole token, the one that the fewest rules of the list hold (ties:
the longer, then the smaller). A URL is cut into its tokens; the tokens fetch the rules filed under
them, and only the fetched rules run their regular expressions. Rules without any such token are filed
under the empty token, which every URL has, so none is ever lost.

Two kinds of rules:

* host rules, `host/path-prefix`: fit the host and its subdomains where the URL's path starts with the
  rule's path. The longest rule text wins (ties: block before allow, then the greater text).
* pattern rules, a subset of the usual blocking-list grammar: `||` host label start, `|` start or end,
  `^` separator or end, `*` anything, the rest literal; case is ignored. They decide only
  where no host rule fits, in the same order.

Both ways to run give the same rows: up to INLINE_RULES rules the index is a constant of the plan and
judging is one narrow projection, without any shuffle; a longer list becomes a table that is joined by
token to the distinct URLs, each token in SALTS parts, as tokens like `com` stand in most URLs.

Edge cases: null urls and urls without `://` have an empty host and path, fit no rule and
are allowed. Repeated rows are judged alike and all stay. Other columns pass through; those that are
named like an output column are replaced. An empty table gives an empty table. An empty rule
list allows all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, UPPER, ascii_lower, packed

INLINE_RULES = 2000
SALTS = 32
OUT = ["host", "path", "rule", "verdict", "pattern"]
_ENTRY = "token string, text string, block boolean, is_host boolean, size int, regex string"
_TO_LOWER = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    text: str
    action: str  # allow or block
    is_host: bool


class Compiled(NamedTuple):
    token: str
    text: str
    block: bool
    is_host: bool
    size: int
    regex: str


def host_rule(text: str, action: str) -> Rule:
    return Rule(text, action, True)


def pattern_rule(text: str, action: str = "block") -> Rule:
    return Rule(text, action, False)


def _quote(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in literal)


def _pieces(rule: Rule) -> list[str]:
    """The literals between the marks; a mark that cannot join two tokens is the character \\0."""
    if rule.is_host:
        return ["\0" + rule.text.translate(_TO_LOWER)]
    body = rule.text.translate(_TO_LOWER)
    body = "\0" + body[2:] if body.startswith("||") else "\0" + body[1:] if body.startswith("|") else body
    body = body[:-1] + "\0" if body.endswith("|") else body
    return body.replace("^", "\0").split("*")


def _tokens(rule: Rule) -> set[str]:
    """Whole tokens of any URL that the rule fits: bounded on both sides by something that is no token
    character. The ends of a piece are open unless a mark or a separator closes them."""
    return {m[0] for p in _pieces(rule) for m in re.finditer(r"[a-z0-9]+", p) if m.start() > 0 and m.end() < len(p)}


def _regex(rule: Rule) -> str:
    if rule.is_host:
        host, slash, path = rule.text.partition("/")
        return rf"^(?:[^/]*\.)?{_quote(host.translate(_TO_LOWER))}{_quote(slash + path)}"
    body = rule.text.translate(_TO_LOWER)
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    marks = {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
    return head + "".join(marks.get(c) or _quote(c) for c in body) + tail


def compile_rules(rules: Sequence[Rule]) -> list[Compiled]:
    for r in rules:
        if r.action not in ("allow", "block") or (r.is_host and "/" not in r.text):
            raise ValueError(f"not a rule: {r}")
    held = [_tokens(r) for r in rules]
    seen = Counter(t for tokens in held for t in tokens)
    rarest = [min(tokens, key=lambda t: (seen[t], -len(t), t), default="") for tokens in held]
    return [Compiled(t, r.text, r.action == "block", r.is_host, len(r.text), _regex(r)) for t, r in zip(rarest, rules, strict=True)]


def _parts(pages: DataFrame, keep: list[str]) -> DataFrame:
    """host, path and the lower-cased rest after the scheme, with the tokens that look rules up."""
    at = F.instr(F.col("url"), "://")
    rest = F.coalesce(F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    parts = pages.select(packed(pages, keep).alias("row"), rest.alias("_rest"))
    parts = parts.select(
        "*",
        ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)).alias("_host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("_path"),
        ascii_lower(F.col("_rest")).alias("_full"),
    )
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.col("_full"), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit(""))))
    return parts.select("*", F.when(F.col("_rest") == "", F.array().cast("array<string>")).otherwise(tokens).alias("_tokens"))


def _rank(entry: Column) -> Column:
    """Greater is stronger."""
    return F.struct(entry["is_host"].alias("is_host"), entry["size"].alias("size"), entry["block"].alias("block"), entry["text"].alias("text"))


def _fits(entry: Column) -> Column:
    return F.regexp_like(F.when(entry["is_host"], F.concat("_host", "_path")).otherwise(F.col("_full")), entry["regex"])


def _verdict(parts: DataFrame) -> DataFrame:
    best = F.col("_best")
    return parts.select(
        "row.*",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(best["is_host"], best["text"]).alias("rule"),
        F.when(best["block"], "block").otherwise("allow").alias("verdict"),
        F.when(~best["is_host"], best["text"]).alias("pattern"),
    )


def _inline(parts: DataFrame, rules: list[Compiled]) -> DataFrame:
    n = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for r in rules:
        buckets[zlib.crc32(r.token.encode()) % n].append(r._asdict())
    # parsed once, when the plan is made: the function of a constant is a constant
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{_ENTRY}>>>")
    found = F.flatten(F.transform("_tokens", lambda t: F.filter(F.get(index, F.crc32(t.cast("binary")) % F.lit(n)), lambda r: r["token"] == t)))
    parts = parts.select("*", found.alias("_found"))
    return parts.select("*", F.array_max(F.transform(F.filter("_found", _fits), _rank)).alias("_best"))


def _joined(parts: DataFrame, rules: list[Compiled]) -> DataFrame:
    """For rule lists too long for the plan: distinct URLs are judged once, then meet their rows again."""
    index = parts.sparkSession.createDataFrame(rules, _ENTRY)
    entry = F.struct(*[F.col(c) for c in Compiled._fields])
    urls = parts.where(F.col("_rest") != "").groupBy("_rest").agg(*[F.first(c).alias(c) for c in ("_host", "_path", "_full", "_tokens")])
    index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    urls = urls.select("*", F.pmod(F.xxhash64("_rest"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode("_tokens").alias("_token"))
    hits = urls.join(index, (F.col("_token") == F.col("token")) & (F.col("_salt") == F.col("salt"))).select("_rest", "_host", "_path", "_full", entry.alias("_e"))
    best = hits.where(_fits(F.col("_e"))).groupBy("_rest").agg(F.max(_rank(F.col("_e"))).alias("_best"))
    return parts.join(best, "_rest", "left")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule (the host rule that won, else null), verdict (allow or block) and
    pattern (the pattern rule that decided, else null)."""
    keep = [c for c in pages.columns if c not in OUT]
    parts = _parts(pages, keep)
    compiled = compile_rules(rules)
    judged = _inline(parts, compiled) if len(compiled) <= inline_rules else _joined(parts, compiled)
    return _verdict(judged)


def allowed_pages(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows whose URL is allowed, with their own columns."""
    return judge_urls(pages, rules).where(F.col("verdict") == "allow").select(*[f"`{c}`" for c in pages.columns if c not in OUT])
