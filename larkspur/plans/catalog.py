"""The queries over the reference's operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import units as U
from larkspur.operators import audit, blocks, chunking, evalkit, geometry, layout, rules, search, vision
from larkspur.operators import tables as tabs
from larkspur.plans import adapters as A
from larkspur.sources import registry as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "the thing and therein of 2 MB"
LOW = "lower(coalesce(text, ''))"
SIZE = r"\b(\d+(?:\.\d+)?)\s*(tb|gb|mb|kb|kib|mib|gib|tib|ns|µs|us|ms)\b"
TOKENS_SQL = f"list_distinct(list_concat(regexp_extract_all({LOW}, '{T.TOKEN}'), regexp_extract_all(regexp_replace({LOW}, '{SIZE}', '\\1\\2', 'g'), '{T.TOKEN}')))"
Q_TOKENS = ["the", "thing", "and", "therein", "of", "2", "mb", "2mb"]
INDEX_SQL = f"""
  t AS (SELECT doc_id, source, {TOKENS_SQL} AS toks FROM documents),
  p AS (SELECT doc_id, source, len(toks) AS dl, unnest(toks) AS token FROM t),
  n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
  d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
  i AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d, n),
  f AS (SELECT 0.25 * avg(idf) AS fl FROM i)"""


def bm25_sql(where: str = "true", k: int = 10) -> str:
    wanted = ", ".join(f"'{x}'" for x in Q_TOKENS)
    return f"""WITH {INDEX_SQL},
  s AS (SELECT doc_id AS chunk_id, round(sum((CASE WHEN idf < 0 THEN fl ELSE idf END) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM p JOIN i USING (token), n, f WHERE token IN ({wanted}) AND {where} GROUP BY doc_id)
  SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank < {k}"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- search -----------------------------------------------------------------------------------------------------
@query(bm25_sql())
def bm25_topk(spark, sf):
    return search.top(search.bm25(A.index(spark, sf), QUESTION), 10, "chunk_id")


@query(bm25_sql("source IN ('src1', 'src2')"))
def bm25_topk_scoped(spark, sf):
    return search.top(search.bm25(A.index(spark, sf), QUESTION, search.in_scope(doc_ids=["src1", "src2"])), 10, "chunk_id")


@query(bm25_sql("source <> 'src0'"))
def bm25_exclude_tier(spark, sf):
    return search.top(search.bm25(A.index(spark, sf), QUESTION, search.in_scope(exclude_tiers=[0])), 10, "chunk_id")


@query(f"WITH {INDEX_SQL} SELECT token, df, round(idf, 6) AS idf FROM i")
def token_stats(spark, sf):
    return A.index(spark, sf).stats.select("token", "df", F.round("idf", 6).alias("idf"))


DENSE_SQL = "SELECT e.vec_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"WITH s AS ({DENSE_SQL}) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 10")
def dense_topk(spark, sf):
    return search.top(search.dense(A.table(spark, sf, "embeddings"), 0), 10, "vec_id")


@query(f"WITH s AS ({DENSE_SQL} WHERE e.label = 1) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 10")
def dense_topk_scoped(spark, sf):
    return search.top(search.dense(A.table(spark, sf, "embeddings"), 0, F.col("label") == 1), 10, "vec_id")


@query(f"""WITH a AS ({bm25_sql(k=30)}), s AS ({DENSE_SQL}), b AS (SELECT vec_id AS chunk_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 30)
  SELECT chunk_id, a.rank AS first_rank, b.rank AS second_rank, round(coalesce(CAST(1 AS DOUBLE) / (61 + a.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (61 + b.rank), 0), 8) AS rrf
  FROM a FULL JOIN b USING (chunk_id) ORDER BY rrf DESC, first_rank NULLS LAST, second_rank NULLS LAST LIMIT 30""")
def hybrid_rrf(spark, sf):
    return search.search(A.index(spark, sf), QUESTION, A.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id"), 0, k=30)


BENCH_SQL = f"SELECT item_id, unnest({TOKENS_SQL}) AS token, item_id % 3 AS kind FROM benchmark"


@query(f"""WITH {INDEX_SQL}, q AS ({BENCH_SQL}),
  s AS (SELECT q.item_id AS query_id, p.doc_id AS chunk_id, round(sum((CASE WHEN idf < 0 THEN fl ELSE idf END) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM q JOIN p USING (token) JOIN i USING (token), n, f WHERE (kind <> 1 OR source IN ('src1', 'src2', 'src3')) AND (kind <> 2 OR source <> 'src0') GROUP BY ALL)
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank < 6""")
def claim_topk(spark, sf):
    """The items of benchmark as claims, a third of them bound to some documents, a third to tier 1."""
    kind = F.col("item_id") % 3
    scope = [F.when(kind == 1, F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"))).alias("doc_ids"), F.when(kind == 2, 0).alias("exclude_tier")]
    return search.bm25_batch(A.index(spark, sf), A.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", *scope), 6)


# --- tables -----------------------------------------------------------------------------------------------------
HIT_SQL = "regexp_matches(replace(lower(value), ' ', ''), '2mb')"


@query(f"SELECT label, arg_max(value, (table_id, p_partkey)) AS value, arg_max(table_id, (table_id, p_partkey)) AS table_id FROM ({A.CELLS_SQL}) WHERE {HIT_SQL} GROUP BY label")
def set_query(spark, sf):
    return tabs.set_query(A.tables(spark, sf), "2MB", "Gran")


@query(f"SELECT table_id, label || ' [' || p_partkey || ']' AS label, 'granularity' AS \"column\", value FROM ({A.CELLS_SQL}) WHERE regexp_matches(replace(lower(value), ' ', ''), '^4kb/[0-9]*2mb$')")
def table_query(spark, sf):
    """Finds cells like `4 KB / 2 MB`."""
    return tabs.query_tables(A.tables(spark, sf), "^4kb/[0-9]*2MB$", "GRANULARITY").select("table_id", "label", "column", "value")


@query(f"""WITH f AS (SELECT DISTINCT label FROM ({A.CELLS_SQL}) WHERE {HIT_SQL}), e AS (SELECT DISTINCT trim(p_name) AS label FROM part WHERE p_size = 2)
  SELECT (SELECT count(*) FROM e WHERE label NOT IN (SELECT label FROM f)) AS missing, (SELECT count(*) FROM f WHERE label NOT IN (SELECT label FROM e)) AS extra,
         (SELECT count(*) FROM e WHERE label NOT IN (SELECT label FROM f)) = 0 AS passed""")
def set_query_completeness(spark, sf):
    expected = A.table(spark, sf, "part").where("p_size = 2").select(F.trim("p_name").alias("label")).distinct()
    return tabs.completeness(tabs.set_query(A.tables(spark, sf), "2mb", "granularity"), expected)


# --- quantities -------------------------------------------------------------------------------------------------
CLAIMS_SQL = """
  SELECT o_orderkey AS claim_id, o_orderkey % 50 + 1 AS q, (o_orderkey % 50 + 1) * (CASE WHEN o_orderkey % 3 = 0 THEN 1100 ELSE 1000 END) AS u, o_custkey % 25 AS r1, (o_custkey // 25) % 40 AS r2,
         o_orderkey % 7 = 0 AS none, o_orderkey % 14 = 0 AS own FROM orders"""


@query(f"SELECT claim_id, q * CAST(0.001 AS DOUBLE) AS lo, 'time' AS dim, false AS ranged FROM ({CLAIMS_SQL})")
def quantity_parse(spark, sf):
    q = U.quantity(F.col("claimed"))
    return A.claims(spark, sf).select("claim_id", q["lo"].alias("lo"), q["dim"].alias("dim"), q["ranged"].alias("ranged"))


#: Spelling, dimension and factor, as the published table has them.
UNITS_SQL = "(VALUES " + ", ".join(f"({i}, '{u}', '{d}', CAST({f!r} AS DOUBLE))" for i, (u, d, f) in enumerate([
    ("ns", "time", 1e-9), ("nanosecond", "time", 1e-9), ("nanoseconds", "time", 1e-9), ("us", "time", 1e-6), ("µs", "time", 1e-6), ("microsecond", "time", 1e-6), ("microseconds", "time", 1e-6),
    ("ms", "time", 1e-3), ("millisecond", "time", 1e-3), ("milliseconds", "time", 1e-3), ("s", "time", 1.0), ("sec", "time", 1.0), ("second", "time", 1.0), ("seconds", "time", 1.0),
    ("b", "bytes", 1.0), ("byte", "bytes", 1.0), ("bytes", "bytes", 1.0), ("kb", "bytes", 2.0**10), ("kib", "bytes", 2.0**10), ("mb", "bytes", 2.0**20), ("mib", "bytes", 2.0**20), ("gb", "bytes", 2.0**30),
    ("gib", "bytes", 2.0**30), ("tb", "bytes", 2.0**40), ("tib", "bytes", 2.0**40), ("pb", "bytes", 2.0**50), ("b/s", "bandwidth", 1.0), ("kb/s", "bandwidth", 1e3), ("mb/s", "bandwidth", 1e6),
    ("gb/s", "bandwidth", 1e9), ("tb/s", "bandwidth", 1e12), ("%", "percent", 1.0), ("percent", "percent", 1.0), ("x", "ratio", 1.0), ("×", "ratio", 1.0), ("times", "ratio", 1.0), ("μs", "time", 1e-6), ("pages", None, 1.0), ("min", None, 1.0), ("h", None, 1.0)])).replace("'None'", "NULL") + ") AS units(u, unit, dim, factor)"


@query(f"""SELECT o_orderkey AS claim_id, (1000 + o_orderkey % 5000) * factor AS lo, CASE WHEN o_orderkey % 4 >= 2 THEN (7000 + o_orderkey % 5000) * factor ELSE (1000 + o_orderkey % 5000) * factor END AS hi, dim, o_orderkey % 4 >= 2 AS ranged
  FROM orders JOIN {UNITS_SQL} ON u = o_orderkey % 40""")
def quantity_units(spark, sf):
    """Every spelling of a unit, numbers with and without commas, ranges with a dash and with a word."""
    spelled = "ns nanosecond nanoseconds us µs microsecond microseconds ms millisecond Milliseconds s sec second seconds B byte bytes KB KiB MB MiB GB GiB TB TiB PB B/s KB/s MB/s GB/s TB/s % percent x × times μs pages min h".split()
    k = F.col("o_orderkey")
    n, m = F.lit(1000) + k % 5000, F.lit(7000) + k % 5000
    unit = F.get(F.array(*map(F.lit, spelled)), (k % 40).cast("int"))
    comma = F.concat(F.expr("cast((1000 + o_orderkey % 5000) div 1000 as string)"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    text = F.when(k % 4 == 0, F.concat(F.lit("about "), n.cast("string"), F.lit(" "), unit)).when(k % 4 == 1, F.concat(comma, F.lit(" "), unit))
    text = text.when(k % 4 == 2, F.concat(n.cast("string"), F.lit("–"), m.cast("string"), F.lit(" "), unit)).otherwise(F.concat(n.cast("string"), F.lit(" to "), m.cast("string"), F.lit(" "), unit))
    q = U.quantity(text)
    return A.table(spark, sf, "orders").select(k.alias("claim_id"), q["lo"].alias("lo"), F.coalesce(F.when(q["ranged"], q["hi"]), q["lo"]).alias("hi"), q["dim"].alias("dim"), q["ranged"].alias("ranged"))


@query("SELECT o_orderkey AS claim_id, CAST(3 AS BIGINT) AS n, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS first, (o_orderkey % 50 + 1) * CAST(0.001 AS DOUBLE) AS second, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS third FROM orders")
def quantity_find_all(spark, sf):
    """Ranges come first, though one stands in the middle."""
    k = F.col("o_orderkey")
    text = F.concat((k % 50 + 1).cast("string"), F.lit(" ms, "), (k % 9 + 1).cast("string"), F.lit("-20 x and "), (k % 7 + 1).cast("string"), F.lit(" %"))
    found = U.find_quantities(text)
    lo = lambda i: F.get(found, F.lit(i))["lo"]
    return A.table(spark, sf, "orders").select(k.alias("claim_id"), F.size(found).cast("long").alias("n"), lo(0).alias("first"), lo(1).alias("second"), lo(2).alias("third"))


@query(f"SELECT claim_id, abs(q * 1000 - u) <= 0.02 * greatest(q * 1000, u) AS same FROM ({CLAIMS_SQL})")
def quantity_match_pairs(spark, sf):
    return A.claims(spark, sf).select("claim_id", U.quantities_match(F.col("claimed"), F.col("source")).alias("same"))


@query(f"SELECT claim_id, abs(q * 1000 - u) <= 0.02 * greatest(q * 1000, u) AS found, CASE WHEN abs(q * 1000 - u) <= 0.02 * greatest(q * 1000, u) THEN u || ' us' END AS matched FROM ({CLAIMS_SQL})")
def numeric_prescreen(spark, sf):
    return audit.numeric_prescreen(A.claims(spark, sf).select("claim_id", "claimed", F.lit(0).alias("hit"), F.concat(F.lit("It took "), "source", F.lit(" here.")).alias("text")))


@query(f"SELECT claim_id, q || 'ms' AS collapsed FROM ({CLAIMS_SQL})")
def unit_collapse(spark, sf):
    return A.claims(spark, sf).select("claim_id", T.collapse_units(F.lower("claimed")).alias("collapsed"))


# --- audit ------------------------------------------------------------------------------------------------------
ACTION_SQL = "CASE WHEN none THEN (CASE WHEN own THEN 'skip' ELSE 'verify_uncited' END) ELSE 'verify' END"


@query(f"""SELECT claim_id, CASE WHEN none THEN 'no_citation' WHEN r2 < 25 THEN 'resolved' ELSE 'partially_resolved:[' || r2 || ']' END AS ref_status,
  CASE WHEN none THEN 0 WHEN r2 >= 25 OR r1 = r2 THEN 1 ELSE 2 END AS n_docs, {ACTION_SQL} AS action FROM ({CLAIMS_SQL})""")
def decide_scope(spark, sf):
    out = audit.decide_scope(audit.resolve_references(A.claims(spark, sf), A.registry(spark, sf)))
    return out.select("claim_id", "ref_status", F.size("doc_ids").alias("n_docs"), "action")


VERDICT_SQL = f"""SELECT claim_id, CASE WHEN action = 'skip' THEN 'skipped_own_result' WHEN NOT same AND action = 'verify' THEN 'underspecified'
  WHEN action = 'verify_uncited' AND same THEN 'possibly_missing_citation' WHEN NOT same THEN 'underspecified' ELSE 'supported' END AS verdict
  FROM (SELECT claim_id, {ACTION_SQL} AS action, abs(q * 1000 - u) <= 0.02 * greatest(q * 1000, u) AS same FROM ({CLAIMS_SQL}))"""


def _verdicts(spark, sf):
    claims = A.claims(spark, sf)
    scoped = audit.decide_scope(audit.resolve_references(claims, A.registry(spark, sf))).select("claim_id", "action")
    same = U.quantities_match(F.col("claimed"), F.col("source"))
    met = scoped.join(claims.select("claim_id", same.alias("same")), "claim_id")
    return met.select("claim_id", audit.verdict(F.col("action"), F.lit(1), F.lit("supported"), F.col("same"), F.col("same"), F.lit(True)).alias("verdict"))


@query(VERDICT_SQL)
def verdict_override(spark, sf):
    return _verdicts(spark, sf)


@query(f"SELECT verdict, count(*) AS n FROM ({VERDICT_SQL}) GROUP BY verdict")
def verdict_counts(spark, sf):
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT claim_id, verdict, CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'possibly_missing_citation' THEN 3 ELSE 4 END, claim_id) AS INTEGER) AS place FROM ({VERDICT_SQL}) WHERE verdict IN ('possibly_missing_citation', 'underspecified') QUALIFY place <= 50")
def document_report(spark, sf):
    worst = _verdicts(spark, sf).where(F.col("verdict").isin(audit.PROBLEMS)).orderBy(audit.priority(F.col("verdict")), "claim_id").limit(50)
    return worst.select("*", F.row_number().over(Window.orderBy(audit.priority(F.col("verdict")), "claim_id")).alias("place"))


@query("SELECT doc_id, length(text) >= 100 AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(substr(text, 10, 60)), '\\s+', ' ', 'g'))) AS verified FROM documents")
def span_verify(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", ((F.length("text") >= 100) & audit.span_verified(F.array("text"), F.substring("text", 10, 60))).alias("verified"))


@query("SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 3))) AS cited FROM (SELECT conv_id, turn, text || ' [S' || (turn % 5) || '][S2]' AS a FROM conversations)")
def answer_citations(spark, sf):
    a = F.concat("text", F.lit(" [S"), (F.col("turn") % 5).cast("string"), F.lit("][S2]"))
    return A.table(spark, sf, "conversations").select("conv_id", "turn", audit.cited_sources(a, F.lit(3)).alias("cited"))


@query("""SELECT conv_id, turn, CAST(0 AS INTEGER) AS claim_no, left(text, 20) AS subject, [CAST(turn AS VARCHAR), '9'] AS cited_ref, turn % 2 = 0 AS is_own_result, trim(coalesce(s, '')) AS source_span,
  coalesce(trim(s) <> '' AND contains(text, trim(s)), false) AS span_in_passage FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN 'odd ' ELSE '' END || substr(text, 5, 30) AS s FROM conversations)""")
def claim_extraction(spark, sf):
    """Replies in a code fence, each with one claim and some noise."""
    k = F.col("turn")
    span = F.concat(F.when(k % 4 == 0, "odd ").otherwise(""), F.substring("text", 5, 30))
    claim = F.struct(F.substring("text", 1, 20).alias("subject"), F.array(k.cast("string"), F.lit("09")).alias("cited_ref"), (k % 2 == 0).alias("is_own_result"), span.alias("source_span"))
    reply = F.concat(F.lit('```json\n{"claims": ["noise", '), F.to_json(claim), F.lit("]}\n```"))
    found = audit.extracted_claims(A.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("passage"), reply.alias("reply")))
    return found.select("conv_id", "turn", F.col("at").alias("claim_no"), "subject", "cited_ref", "is_own_result", "source_span", F.coalesce("span_in_passage", F.lit(False)).alias("span_in_passage"))


VERDICTS = ["supported", "not_found", "contradicted", "partially_supported", "odd", "underspecified"]
_ALL_SQL = """SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 11 = 0 THEN 'flag' WHEN o_orderkey % 14 = 0 THEN 'skip' WHEN o_orderkey % 7 = 0 THEN 'verify_uncited' ELSE 'verify' END AS action,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 2 END AS n_hits, (['supported', 'not_found', 'contradicted', 'partially_supported', 'odd', 'underspecified'])[o_orderkey % 6 + 1] AS said,
  o_orderkey % 5 <> 0 AS verified, o_orderkey % 3 <> 0 AS found, o_orderkey % 4 <> 0 AS reliable FROM orders"""


@query(f"""SELECT claim_id, CASE WHEN action = 'skip' THEN 'skipped_own_result' WHEN action = 'flag' THEN 'unresolvable_reference' WHEN n_hits = 0 THEN 'not_found'
  WHEN said = 'odd' THEN 'underspecified' WHEN said = 'supported' AND NOT verified THEN 'underspecified' WHEN said = 'not_found' AND NOT found AND NOT reliable THEN 'underspecified'
  WHEN said = 'supported' AND action = 'verify_uncited' AND found THEN 'possibly_missing_citation' ELSE said END AS verdict,
  action IN ('verify', 'verify_uncited') AND n_hits > 0 AND said = 'not_found' AND NOT found AND NOT reliable AS needs_visual_check FROM ({_ALL_SQL})""")
def verdict_all(spark, sf):
    """Every action with every reply: all eight verdicts occur."""
    k = F.col("o_orderkey")
    action = F.when(k % 11 == 0, "flag").when(k % 14 == 0, "skip").when(k % 7 == 0, "verify_uncited").otherwise("verify")
    n, said = F.when(k % 13 == 0, 0).otherwise(2), F.get(F.array(*map(F.lit, VERDICTS)), (k % 6).cast("int"))
    out = audit.verdict(action, n, said, k % 5 != 0, k % 3 != 0, k % 4 != 0)
    return A.table(spark, sf, "orders").select(k.alias("claim_id"), out.alias("verdict"), audit.needs_visual_check(action, n, said, k % 3 != 0, k % 4 != 0).alias("needs_visual_check"))


@query(f"""WITH p AS (SELECT doc_id, doc_id % 2 AS doc, regexp_extract_all(replace(text, 'The ', '54 MB '), '[0-9]\\s*(?:[𝐀-𝟿]{{1,4}}|[A-Z]{{2,4}}\\b)') AS s FROM documents)
  SELECT doc_id AS claim_id, len(s) AS n_sites, coalesce(s[1], '') AS first FROM p""")
def suspect_sites(spark, sf):
    d = A.table(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("claim_id"), F.lit(0).alias("hit"), F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.replace("text", F.lit("The "), F.lit("54 MB ")).alias("text"))
    return audit.suspect_sites(pairs).select("claim_id", F.col("n_sites").cast("long").alias("n_sites"), F.coalesce(F.get("sites", F.lit(0))["site"], F.lit("")).alias("first"))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'possibly_missing_citation' THEN 3 ELSE 4 END, claim_id) AS INTEGER) AS place, '[' || upper(verdict) || '] claim ' || claim_id || ' (' || ref_status || ')' AS line
  FROM ({VERDICT_SQL}) JOIN (SELECT claim_id, CASE WHEN none THEN 'no_citation' WHEN r2 < 25 THEN 'resolved' ELSE 'partially_resolved:[' || r2 || ']' END AS ref_status FROM ({CLAIMS_SQL})) USING (claim_id)
  WHERE verdict IN ('possibly_missing_citation', 'underspecified') QUALIFY place <= 50""")
def report_lines(spark, sf):
    records = _verdicts(spark, sf).join(audit.resolve_references(A.claims(spark, sf), A.registry(spark, sf)).select("claim_id", "ref_status"), "claim_id")
    return audit.report_lines(records, 50)


# --- quality rules ----------------------------------------------------------------------------------------------
PAGES_SQL = "SELECT source AS doc, doc_id AS page, replace(replace(replace(text, 'the', '(cid:7)'), 'oned', '12. 5 ms'), 'tha', '54 ' || chr(119885) || chr(119872)) AS text FROM documents"


def _pages(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit("the"), F.lit("(cid:7)")), F.lit("oned"), F.lit("12. 5 ms"))
    t = F.replace(t, F.lit("tha"), F.lit("54 " + chr(119885) + chr(119872)))
    return A.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), t.alias("text"))


def _context_sql(check: str, severity: str, pattern: str, before: int, after: int) -> str:
    """Each match with its context, by the places of the matches."""
    start = "(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))"
    return f"""SELECT doc, page, '{check}' AS check_name, substr(text, CAST(greatest(s - {before}, 0) AS BIGINT) + 1, CAST(s - greatest(s - {before}, 0) + length(m[i]) + {after} AS BIGINT)) AS detail, '{severity}' AS severity
    FROM (SELECT doc, page, text, m, i, {start} AS s FROM (SELECT doc, page, text, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc, page, text, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM ({PAGES_SQL}))))"""


FLAGS_SQL = f"""
  SELECT doc, page, 'cid_garble' AS check_name, CAST(len(regexp_extract_all(text, '\\(cid:\\d+\\)')) AS VARCHAR) AS detail, 'blocker' AS severity FROM ({PAGES_SQL}) WHERE regexp_matches(text, '\\(cid:\\d+\\)')
  UNION ALL {_context_sql("broken_measurement", "review", r"(?i)\\b\\d+(?:\\s+\\.\\s*\\d+|\\.\\s+\\d+)\\s*(?:ns|us|ms|GB/s|MB/s|TiB|GiB|MiB|KiB|TB|GB|MB|KB|%)\\b".replace(chr(92) * 2, chr(92)), 25, 25)}
  UNION ALL {_context_sql("misencoded_unit", "blocker", r"[0-9][ ]*[𝐀-𝟿]{1,4}", 40, 30)}
  UNION ALL SELECT doc, page, 'low_alnum_ratio', CAST(round(a / d, 2) AS VARCHAR), 'blocker' FROM (SELECT doc, page, CAST(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS DOUBLE) AS a, length(regexp_replace(text, '\\s', '', 'g')) AS d FROM ({PAGES_SQL})) WHERE d >= 200 AND a / d < 0.55"""


@query(FLAGS_SQL)
def quality_flags(spark, sf):
    return rules.page_flags(_pages(spark, sf))


@query(f"SELECT check_name, severity, count(*) AS n_flags, count(DISTINCT (doc, page)) AS n_pages FROM ({FLAGS_SQL}) GROUP BY ALL")
def quality_report(spark, sf):
    return rules.report(rules.page_flags(_pages(spark, sf)))


@query(f"SELECT DISTINCT doc, page FROM ({FLAGS_SQL}) UNION SELECT source, doc_id FROM documents WHERE doc_id % 10 = 0 AND lang = 'en'")
def review_pages(spark, sf):
    with_tables = A.chunks(spark, sf).join(A.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id").where("chunk_id % 10 = 0 and lang = 'en'").select("doc", F.col("chunk_id").alias("page"))
    return rules.review_pages(rules.page_flags(_pages(spark, sf)), with_tables)


@query(f"""WITH b AS ({A.BLOCKS_SQL}), h AS (SELECT doc, page, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS held FROM b WHERE ord % 4 <> 1 GROUP BY ALL),
  r AS (SELECT source AS doc, doc_id AS page, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS raw FROM documents)
  SELECT doc, page, 'coverage_gap' AS check_name, CAST(raw - coalesce(held, 0) AS VARCHAR) AS detail, 'review' AS severity FROM r LEFT JOIN h USING (doc, page) WHERE raw - coalesce(held, 0) > 120 AND coalesce(held, 0) < 0.92 * raw""")
def quality_coverage(spark, sf):
    pages = A.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return rules.coverage_gaps(pages, A.blocks(spark, sf).where("ord % 4 <> 1"))


@query(f"""WITH b AS (SELECT * REPLACE (rtrim(lower(text), '.') AS text) FROM ({A.BLOCKS_SQL}) WHERE kind = 'prose'), n AS (SELECT *, lead(text) OVER w AS nt, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY ord))
  SELECT doc, page, 'paragraph_split_mid_sentence' AS check_name, '...' || right(rtrim(text, ' '), 40) || ' || ' || left(ltrim(nt, ' '), 40) || '...' AS detail, 'info' AS severity FROM n
  WHERE abs(x0 - nx) < 25 AND ny >= y0 + 13 - ord % 3 - 2 AND rtrim(text, ' ') <> '' AND NOT regexp_matches(trim(text), '[.!?:;”"'')\\]]$') AND regexp_matches(trim(nt), '^\\p{{Ll}}')""")
def quality_split_paragraph(spark, sf):
    """Blocks 11 to 13 high, so that some overlap the next one by less than two."""
    return rules.split_paragraphs(A.blocks(spark, sf).withColumn("text", F.rtrim(F.lower("text"), F.lit("."))).withColumn("y1", F.col("y0") + 13 - F.col("ord") % 3))


@query(f"SELECT (SELECT count(*) FROM documents) AS pages_total, count(DISTINCT (doc, page)) AS pages_flagged, round(count(DISTINCT (doc, page)) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 4) AS flag_rate FROM ({FLAGS_SQL})")
def quality_totals(spark, sf):
    pages = _pages(spark, sf)
    return rules.totals(rules.page_flags(pages), pages)


@query("""SELECT source AS doc, doc_id AS page, CASE WHEN n < 0.4 * greatest(1, d) THEN 'low_alnum_ratio_possible_cid_garble' WHEN doc_id % 2 = 0 THEN 'near_figure_caption_possibly_not_a_table' END AS flag
  FROM (SELECT source, doc_id, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) AS n, length(regexp_replace(t, '\\s', '', 'g')) AS d FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', '....') ELSE text END AS t FROM documents))""")
def table_parse_flag(spark, sf):
    d = A.table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("...."))).otherwise(F.col("text"))
    return d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), rules.parse_flag(text, F.col("doc_id") % 2 == 0).alias("flag"))


# --- layout -----------------------------------------------------------------------------------------------------
@query(f"""WITH b AS ({A.BLOCKS_SQL}), z AS (SELECT doc, page * 1000 + ord AS o, 8 + (ord % 4) * 0.5 AS size, length(text) AS c FROM b), g AS (SELECT doc, size, sum(c) AS chars, min(o) AS first FROM z GROUP BY ALL)
  SELECT doc, CAST(arg_max(size, (chars, -first)) AS DOUBLE) AS body_size FROM g GROUP BY doc""")
def body_font_size(spark, sf):
    spans = A.blocks(spark, sf).select("doc", (F.col("page") * 1000 + F.col("ord")).alias("ord"), (F.lit(8.0) + (F.col("ord") % 4) * 0.5).alias("size"), "text")
    return layout.body_font_size(spans)


@query(f"""WITH b AS ({A.BLOCKS_SQL}), k AS (SELECT doc, page, CASE WHEN ord = 0 AND page % 2 = 0 THEN 'Draft #' ELSE regexp_replace(trim(text), '\\d+', '#', 'g') END AS band FROM b WHERE ord < 2 AND trim(text) <> ''), p AS (SELECT source AS doc, count(*) AS n_pages FROM documents GROUP BY source)
  SELECT doc, band, count(DISTINCT page) AS n FROM k JOIN p USING (doc) GROUP BY doc, band, n_pages HAVING count(DISTINCT page) >= greatest(2, floor(0.4 * n_pages))""")
def running_bands(spark, sf):
    """Every second page begins with a running head that holds a number."""
    head = F.when((F.col("ord") == 0) & (F.col("page") % 2 == 0) & (F.trim("text") != ""), F.concat(F.lit(" Draft "), F.col("page").cast("string"))).otherwise(F.col("text"))
    lines = A.blocks(spark, sf).select("doc", "page", head.alias("text"), (F.col("ord") < 2).alias("in_band"))
    return layout.running_bands(lines, A.table(spark, sf, "documents").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("n_pages")))


@query(f"SELECT doc, page, CAST(round_even(x0 / 2, 0) * 2 AS DOUBLE) AS bin, count(*) AS n FROM ({A.BLOCKS_SQL}) GROUP BY ALL")
def column_histogram(spark, sf):
    return layout.column_histogram(A.blocks(spark, sf))


@query(f"""WITH b AS ({A.BLOCKS_SQL}), s AS (SELECT *, sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, x0, ord) AS segment FROM b)
  SELECT doc, page, ord, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY segment, CASE WHEN length(text) > 200 THEN 0 WHEN x0 < 300 THEN 1 ELSE 2 END, y0, x0, ord) AS INTEGER) AS position FROM s""")
def reading_order(spark, sf):
    lines = A.blocks(spark, sf).select("*", (F.length("text") > 200).alias("is_full"), (F.col("x0") < 300).alias("is_left"))
    return layout.reading_order(lines).select("doc", "page", "ord", "position")


@query(f"SELECT doc, page, ord, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, ord ROWS UNBOUNDED PRECEDING) AS section FROM ({A.BLOCKS_SQL})")
def section_carry(spark, sf):
    return layout.carry_section(A.blocks(spark, sf)).select("doc", "page", "ord", "section")


@query(f"""WITH b AS (SELECT doc, page, y0 AS x0, y0 + length(text) / 20 AS x1 FROM ({A.BLOCKS_SQL})), e AS (SELECT doc, page, CAST(-10 AS DOUBLE) AS lo, max(x0) + 12.0 AS hi FROM b GROUP BY ALL), c AS (SELECT doc, page, greatest(x0, lo) AS x0, least(x1, hi) AS x1 FROM b JOIN e USING (doc, page)),
  s AS (SELECT doc, page, x0, x1 FROM c WHERE x0 < x1 UNION ALL SELECT doc, page, hi, hi FROM e UNION ALL SELECT doc, page, lo, lo FROM e), m AS (SELECT doc, page, x0 AS z, max(x1) OVER (PARTITION BY doc, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
  SELECT doc, page, before AS gap_start, z AS gap_end FROM m WHERE z - before >= 7""")
def whitespace_gaps(spark, sf):
    spans = A.blocks(spark, sf).select("doc", "page", F.col("y0").alias("x0"), (F.col("y0") + F.length("text") / 20).alias("x1"))
    extents = spans.groupBy("doc", "page").agg(F.lit(-10.0).alias("lo"), (F.max("x0") + 12.0).alias("hi"))
    return layout.whitespace_gaps(spans, extents)


@query(f"""WITH b AS ({A.BLOCKS_SQL}), n AS (SELECT *, CASE WHEN coalesce(y0 - lag(y0) OVER w > 13, true) THEN 1 ELSE 0 END AS fresh FROM (SELECT * FROM b WHERE ord % 3 <> 0) WINDOW w AS (PARTITION BY doc, page ORDER BY y0, x0, ord))
  SELECT doc, page, ord, CAST(sum(fresh) OVER (PARTITION BY doc, page ORDER BY y0, x0, ord) AS BIGINT) AS line FROM n""")
def line_groups(spark, sf):
    words = A.blocks(spark, sf).where("ord % 3 <> 0").select("doc", "page", "ord", "x0", (F.col("y0") / 13 * layout.LINE_JUMP).alias("y0"))
    return layout.line_groups(words).select("doc", "page", "ord", "line")


@query(f"""WITH b AS ({A.BLOCKS_SQL}) SELECT doc, page, ord FROM b l WHERE NOT EXISTS (SELECT 1 FROM b r WHERE r.doc = l.doc AND r.page = l.page AND r.ord % 5 = 0
  AND greatest(0, least(l.x0 + 100, r.x0 + 100) - greatest(l.x0, r.x0)) * greatest(0, least(l.y0 + 10, r.y0 + 20) - greatest(l.y0, r.y0)) > 0.5 * 100 * 10)""")
def region_exclusion(spark, sf):
    b = A.blocks(spark, sf)
    box = lambda h: [(F.col("x0") + 100).alias("x1"), (F.col("y0") + h).alias("y1")]
    return layout.outside_regions(b.select("*", *box(10)), b.where("ord % 5 = 0").select("doc", "page", "x0", "y0", *box(20))).select("doc", "page", "ord")


@query(f"SELECT doc, page, ord, regexp_matches(text, '^(Table|Figure|Fig\\.)\\s*\\d+\\s*[:.]?\\s+[A-Z]') AS caption, regexp_matches(text, '(?i)^\\s*(\\d+\\s*/\\s*\\d+|\\d+|Page\\s+\\d+(\\s+of\\s+\\d+)?)\\s*$') AS page_number, regexp_matches(text, '^[\\[\\(]?\\d+[\\]\\)]?[.:]?$') AS fragment FROM (SELECT doc, page, ord, CASE ord % 4 WHEN 0 THEN 'Table ' || ord || ': ' || text WHEN 1 THEN 'Page ' || ord || ' of 9' WHEN 2 THEN '[' || ord || ']' ELSE text END AS text FROM ({A.BLOCKS_SQL}))")
def line_kinds(spark, sf):
    o = F.col("ord").cast("string")
    t = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Table "), o, F.lit(": "), "text")).when(F.col("ord") % 4 == 1, F.concat(F.lit("Page "), o, F.lit(" of 9"))).when(F.col("ord") % 4 == 2, F.concat(F.lit("["), o, F.lit("]"))).otherwise(F.col("text"))
    return A.blocks(spark, sf).select("doc", "page", "ord", T.is_caption(t).alias("caption"), T.is_page_number(t).alias("page_number"), T.is_fragment(t).alias("fragment"))


_HEADED = f"(SELECT doc, page, ord, CASE ord % 5 WHEN 0 THEN (ord + 1) || '. ' || text WHEN 1 THEN '20' || (ord % 90 + 10) || ' ' || text WHEN 2 THEN '3.' || ord || ' Of: ' || text WHEN 3 THEN 'IV. ' || text ELSE text END AS t FROM ({A.BLOCKS_SQL}))"


@query(rf"""SELECT doc, page, ord, regexp_matches(t, '^(\d+(\.\d+){{0,3}}\.?)\s+[A-Z]|^([IVXLC]+)\.\s+[A-Z]|^([A-Z])\.\s+[A-Z]|^§\s*\d|^(?i:Abstract|References|Acknowledg(?:e)?ments?|Conclusions?)\s*$') AND length(t) <= 80 AND NOT regexp_matches(t, '^(19|20)\d\d[.\s]')
  AND NOT regexp_matches(r, '[.:]\s+\S') AND NOT contains(r, ',') AND len(string_split_regex(r, '\s+')) <= 9 AND NOT ends_with(r, ';') AS heading
  FROM (SELECT *, trim(regexp_replace(t, '^(\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.|§\s*\d+(?:\.\d+)*)\s*', '')) AS r FROM {_HEADED})""")
def heading_detect(spark, sf):
    """Lines after a number, a year, a number with a clause, a roman number, or nothing."""
    o = F.col("ord")
    t = F.when(o % 5 == 0, F.concat((o + 1).cast("string"), F.lit(". "), "text")).when(o % 5 == 1, F.concat(F.lit("20"), (o % 90 + 10).cast("string"), F.lit(" "), "text")).when(o % 5 == 2, F.concat(F.lit("3."), o.cast("string"), F.lit(" Of: "), "text")).when(o % 5 == 3, F.concat(F.lit("IV. "), "text")).otherwise(F.col("text"))
    return A.blocks(spark, sf).select("doc", "page", "ord", T.is_heading(t).alias("heading"))


@query("SELECT doc_id, text AS plain FROM documents")
def math_normalize(spark, sf):
    """Small letters in bold italics (where h is a letterlike symbol in italics alone), capitals and digits double-struck, seven of them outside of the block."""
    letters = "".join(map(chr, [*range(97, 123), *range(65, 91), *range(48, 58)]))
    double = {"C": 0x2102, "H": 0x210D, "N": 0x2115, "P": 0x2119, "Q": 0x211A, "R": 0x211D, "Z": 0x2124}
    struck = [chr(0x1D482 + i) for i in range(26)] + [chr(double.get(chr(65 + i), 0x1D538 + i)) for i in range(26)] + [chr(0x1D7D8 + i) for i in range(10)]
    disguised = F.translate("text", letters, "".join(struck))
    return A.table(spark, sf, "documents").select("doc_id", T.normalize_math(disguised).alias("plain"))


# --- chunking ---------------------------------------------------------------------------------------------------
@query("SELECT source AS doc, doc_id AS page, CAST(part AS INTEGER) AS part, trim(substr(text, part * 1000 + 1, 1000)) AS text FROM (SELECT source, doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 1000 + 1)) AS part FROM documents) WHERE length(trim(substr(text, part * 1000 + 1, 1000))) > 80")
def fixed_slices(spark, sf):
    return chunking.fixed_slices(A.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text"))


@query("SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS INTEGER) AS n FROM documents")
def sentence_counts(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query()
def chunk_pack(spark, sf):
    return chunking.number_chunks(chunking.pack_chunks(layout.carry_section(A.blocks(spark, sf))))


@query()
def sentence_pack(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.pack_sentences(F.col("text"))).alias("part", "piece"))


@query("SELECT doc_id, length(text) >= 80 AND regexp_matches(text, '[0-9]') AS kept FROM documents")
def digit_gate(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", chunking.digit_gate(F.col("text")).alias("kept"))


@query("SELECT doc_id, source, length(text) AS n FROM documents WHERE source = 'src0' AND regexp_matches(text, '[0-9]') ORDER BY length(text) DESC, doc_id LIMIT 8")
def self_audit_passages(spark, sf):
    return A.table(spark, sf, "documents").where((F.col("source") == "src0") & F.col("text").rlike("[0-9]")).select("doc_id", "source", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(8)


# --- records and evaluation -------------------------------------------------------------------------------------
LATEST_SQL = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"


def _latest(spark, sf):
    return audit.latest(A.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(LATEST_SQL)
def latest_record(spark, sf):
    return _latest(spark, sf)


@query(f"SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM ({LATEST_SQL}) WHERE event_type <> 'error'")
def retry_queue(spark, sf):
    queue = A.table(spark, sf, "events").select("user_id", "event_type").distinct()
    return queue.join(_latest(spark, sf).where("event_type = 'error'"), ["user_id", "event_type"], "left_semi")


@query(f"SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM ({LATEST_SQL}) WHERE event_type <> 'view'")
def resume_queue(spark, sf):
    queue = A.table(spark, sf, "events").select("user_id", "event_type").distinct()
    return queue.join(_latest(spark, sf).where("event_type <> 'view'"), ["user_id", "event_type"], "left_anti")


@query("SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'cannot_verify' ELSE 'none' END AS severity FROM events GROUP BY user_id")
def max_severity(spark, sf):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return A.table(spark, sf, "events").groupBy("user_id").agg(F.max(rank).alias("r")).select("user_id", F.element_at(F.array(*map(F.lit, ["none", "cannot_verify", "minor", "major"])), F.col("r") + 1).alias("severity"))


ANSWERS_SQL = "SELECT c.conv_id, c.turn, c.text || CASE WHEN c.turn % 3 = 0 THEN ' It is Not Stated.' ELSE '' END AS answer, 'q' || l.quality AS arm, c.turn % 5 <> 4 AS answered, CAST(length(c.text) AS DOUBLE) / 100 AS elapsed FROM conversations c JOIN labels l ON l.doc_id = c.conv_id WHERE c.role = 'assistant'"
REFUSED_SQL = "(NOT answered OR regexp_matches(lower(answer), '" + "|".join(evalkit.REFUSALS) + "'))"


def _answers(spark, sf):
    c, lab = A.table(spark, sf, "conversations").where("role = 'assistant'"), A.table(spark, sf, "labels")
    answer = F.concat("text", F.when(F.col("turn") % 3 == 0, " It is Not Stated.").otherwise(""))
    return c.join(lab, c["conv_id"] == lab["doc_id"]).select("conv_id", "turn", answer.alias("answer"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("arm"), (F.col("turn") % 5 != 4).alias("answered"), (F.length("text") / 100).alias("elapsed"))


@query(f"SELECT conv_id, turn, {REFUSED_SQL} AS refused FROM ({ANSWERS_SQL})")
def refusal_flag(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", evalkit.refused(F.col("answer"), F.col("answered")).alias("refused"))


@query(f"SELECT arm, count(*) AS n, round(avg(elapsed), 2) AS mean_elapsed, round(avg(CASE WHEN {REFUSED_SQL} THEN CAST(1 AS DOUBLE) ELSE 0 END), 3) AS refused_rate FROM ({ANSWERS_SQL}) GROUP BY arm")
def eval_summary(spark, sf):
    return evalkit.summarize(_answers(spark, sf).select("*", evalkit.refused(F.col("answer"), F.col("answered")).alias("refused")), "refused")


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 <> 0 END AS complete FROM orders")
def numeric_complete(spark, sf):
    """Truths of two numbers, of which every third answer has only one; every fifth truth has none."""
    k = F.col("o_orderkey")
    truth = F.when(k % 5 == 0, "no figure").otherwise(F.concat((k % 50 + 1).cast("string"), F.lit(" ms at 90 percent")))
    answer = F.concat(F.lit("It took "), ((k % 50 + 1) * 1000).cast("string"), F.lit(" us"), F.when(k % 3 != 0, " at 90%.").otherwise("."))
    return A.table(spark, sf, "orders").select(k.alias("claim_id"), evalkit.numeric_match(truth, answer).alias("complete"))


@query(f"""WITH r AS (SELECT CASE WHEN turn % 4 = 1 THEN 'none' ELSE 'scoped' END AS arm, (['A', 'B', 'C'])[conv_id % 3 + 1] AS class, {REFUSED_SQL} AS refused, conv_id % 2 = 0 AS num, turn % 3 = 0 AS ctx, turn % 7 = 0 AS err, elapsed FROM ({ANSWERS_SQL}))
  SELECT arm, count(*) FILTER (class = 'A' AND num) AS a_numeric_n, count(*) FILTER (class = 'A') AS a_numeric_of, count(*) FILTER (class = 'B' AND refused) AS b_refused_n, count(*) FILTER (class = 'B') AS b_refused_of,
  count(*) FILTER (class = 'A' AND refused) AS a_refused_n, count(*) FILTER (arm <> 'none' AND ctx) AS context_n, count(*) FILTER (arm <> 'none') AS context_of,
  round(CAST(count(*) FILTER (arm <> 'none' AND ctx) AS DOUBLE) / nullif(count(*) FILTER (arm <> 'none'), 0), 3) AS context_rate, count(*) FILTER (err) AS errors, round(avg(elapsed), 2) AS mean_elapsed FROM r GROUP BY arm""")
def eval_arms(spark, sf):
    """Answers as runs of two arms and three classes, through the record of each run to the summary."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = _answers(spark, sf).select(
        F.when(t % 4 == 1, "none").otherwise("scoped").alias("arm"),
        F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (c % 3).cast("int")).alias("class"),
        F.concat("answer", F.when(c % 2 == 0, " 90%").otherwise("")).alias("answer"),
        "answered", "elapsed", F.when(t % 7 == 0, "timeout").alias("error"),
        F.lit("90 percent").alias("ground_truth"), F.lit(None).cast("string").alias("trap_answer"), F.lit("d").alias("doc"), F.lit(3).alias("page"),
        F.array(F.struct(F.lit("d").alias("doc"), F.lit(2).alias("page_start"), F.when(t % 3 == 0, 3).otherwise(2).alias("page_end"))).alias("evidence"),
    )
    out = evalkit.summary(evalkit.run_records(rows))
    return out.select("arm", "a_numeric_n", "a_numeric_of", "b_refused_n", "b_refused_of", "a_refused_n", "context_n", "context_of", "context_rate", "errors", "mean_elapsed")


@query(f"SELECT doc, CAST(sum(len(regexp_extract_all(text, '[0-9][ ]*[𝐀-𝟿]{{1,4}}'))) AS BIGINT) AS n_sites FROM ({PAGES_SQL}) GROUP BY doc HAVING sum(len(regexp_extract_all(text, '[0-9][ ]*[𝐀-𝟿]{{1,4}}'))) > 0")
def misencoded_census(spark, sf):
    return evalkit.misencoded_census(_pages(spark, sf))


@query("""SELECT problem, value FROM (SELECT 'duplicate_doc_id' AS problem, p_name AS value FROM part GROUP BY p_name HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_ref', CAST(p_size AS VARCHAR) FROM part GROUP BY p_size HAVING count(*) > 1 UNION ALL SELECT 'no_tier_0', NULL)""")
def registry_problems(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_size").alias("ref"), F.col("p_name").alias("doc_id"), F.lit(1).alias("tier"), F.col("p_type").alias("title"))
    return R.problems(p)


@query("SELECT n_name AS doc_id FROM nation WHERE lower(n_name) = 'nation_7'")
def short_id_resolve(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_name").alias("doc_id"), F.col("n_name").alias("short"))
    return R.resolve_short(n, "Nation_7")


@query()
def bibliography_parse(spark, sf):
    d = A.table(spark, sf, "documents")
    # the whole text: each line in pieces of an entry's most characters, at most 999 entries to a bibliography, as numbers have three digits
    of_line = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(600)), lambda i: F.substr(x, i + 1, F.lit(600)))
    pieces = d.select("doc_id", F.filter(F.flatten(F.transform(F.split("text", "\n"), of_line)), lambda x: x.rlike(r"\S")).alias("pieces")).where("size(pieces) > 0")
    parts = pieces.select("doc_id", "pieces", F.explode(F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(999))).alias("first"))
    numbered = F.transform(F.slice("pieces", F.col("first") + 1, 999), lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit("["), i + 1, F.lit("] "))).otherwise(F.concat(i + 1, F.lit(". "))), x))
    t = F.concat(F.lit("x References\n"), F.array_join(numbered, "\n"))
    return parts.select("doc_id", "first", F.explode(R.bibliography(t)).alias("k", "entry")).select("doc_id", (F.col("first") + F.col("k")).alias("n"), "entry")


# --- pages rebuilt from positions -------------------------------------------------------------------------------
@query()
def line_blocks(spark, sf):
    """Lines with made-up sizes: every seventh large, every eleventh a number on its own, every thirteenth a caption."""
    o = F.col("ord")
    text = F.when(o % 11 == 3, (o % 9 + 1).cast("string")).when(o % 13 == 5, F.concat(F.lit("Table "), o.cast("string"), F.lit(": Of "), "text")).otherwise(F.col("text"))
    lines = A.blocks(spark, sf).select("doc", "page", "ord", "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 10).alias("y1"), F.when((o % 7 == 0) | (o % 11 == 3), 14.0).otherwise(10.0).alias("size"), F.lit(10.0).alias("body_size"), text.alias("text"))
    return blocks.line_blocks(lines)


@query(f"""WITH h AS (SELECT doc, page, CAST(round_even(x0 / 2, 0) * 2 AS DOUBLE) AS bin, count(*) AS n FROM ({A.BLOCKS_SQL}) GROUP BY ALL),
  a AS (SELECT doc, page, sum(n) AS lines, min(bin) FILTER (n >= 3) AS l FROM h GROUP BY ALL), r AS (SELECT doc, page, min(bin) AS r FROM h JOIN a USING (doc, page) WHERE n >= 3 AND bin - l > 0.25 * 612 GROUP BY ALL),
  c AS (SELECT doc, page, any_value(lines) AS lines, any_value(r) AS r, sum(CASE WHEN abs(bin - l) <= 6 THEN n ELSE 0 END) AS nl, sum(CASE WHEN abs(bin - r) <= 6 THEN n ELSE 0 END) AS nr FROM h JOIN a USING (doc, page) LEFT JOIN r USING (doc, page) GROUP BY ALL)
  SELECT doc, page, CASE WHEN lines >= 8 AND nl >= 3 AND nr >= 3 THEN r - 4 END AS split FROM c""")
def column_split(spark, sf):
    pages = A.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lit(612.0).alias("width"))
    return layout.column_split(A.blocks(spark, sf), pages)


@query("SELECT table_id, row, col, CASE col WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS text FROM (SELECT p_brand AS table_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS row, p_partkey, p_type, p_size FROM part), (SELECT CAST(unnest(range(3)) AS INTEGER) AS col)")
def table_rebuild(spark, sf):
    """Parts as words at places, one table for each brand, and back."""
    p = A.table(spark, sf, "part").select(F.col("p_brand").alias("table_id"), "p_partkey", "p_type", "p_size", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("at"))
    cells = F.array(F.struct(F.lit(10.0).alias("x0"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("text")), F.struct(F.lit(200.0).alias("x0"), F.col("p_type").alias("text")), F.struct(F.lit(400.0).alias("x0"), F.col("p_size").cast("string").alias("text")))
    words = p.select(F.lit("parts").alias("doc"), F.conv(F.substring("table_id", 7, 9), 10, 10).cast("long").alias("page"), (F.col("at") * 12.0).alias("y0"), F.explode(cells).alias("c")).select("doc", "page", "c.x0", "y0", (F.col("c.x0") + 4 * F.length("c.text")).alias("x1"), (F.col("y0") + 10).alias("y1"), "c.text")
    tables = p.groupBy("table_id").agg(F.max(F.col("at") * 12.0 + 10).alias("y1")).select(F.lit("parts").alias("doc"), F.conv(F.substring("table_id", 7, 9), 10, 10).cast("long").alias("page"), "table_id", F.lit(8.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(600.0).alias("x1"), "y1", F.lit(612.0).alias("width"), (F.col("y1") + 50).alias("height"))
    rows = geometry.reconstruct_tables(words, tables).select("table_id", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table_id", "row", F.posexplode("cells").alias("col", "text"))


@query("SELECT s_suppkey AS page, CASE s_suppkey % 3 WHEN 0 THEN 'a / (b_' || s_nationkey || ')' WHEN 1 THEN 'a = b_' || s_nationkey END AS text FROM supplier WHERE s_suppkey % 3 < 2")
def formula_rebuild(spark, sf):
    """a over b_n with a bar, a = b_n without, or two lone letters, which are no formula."""
    k = F.col("s_suppkey")
    span = lambda o, x, y, text, size=10.0: F.struct(F.lit(o).alias("ord"), F.lit(x).alias("x0"), y.alias("y0"), F.lit(x + 6.0).alias("x1"), (y + size).alias("y1"), F.lit(size).alias("size"), text.alias("text"))
    low = F.when(k % 3 == 0, 115.0).otherwise(100.0)
    spans = F.array(span(0, 10.0, F.lit(100.0), F.lit(chr(0x1D44E))), span(1, 20.0, F.lit(100.0), F.when(k % 3 == 1, "=").otherwise("")), span(2, 30.0, low, F.lit("b")), span(3, 36.0, low + 7, F.col("s_nationkey").cast("string"), 6.0))
    s = A.table(spark, sf, "supplier")
    rows = s.select(F.lit("f").alias("doc"), k.cast("long").alias("page"), F.explode(F.filter(spans, lambda x: x["text"] != "")).alias("s")).select("doc", "page", "s.*")
    bars = s.where(k % 3 == 0).select(F.lit("f").alias("doc"), k.cast("long").alias("page"), F.lit(0).alias("ord"), F.lit(8.0).alias("x0"), F.lit(112.0).alias("y0"), F.lit(45.0).alias("x1"), F.lit(113.0).alias("y1"))
    return geometry.reconstruct_formulas(rows, bars).select("page", "text")


@query("""SELECT doc, page, seen AS channel_ok, CASE WHEN NOT seen THEN 'channel_failed_needs_human' WHEN page % 2 = 0 THEN 'discrepancies_found' ELSE 'clean' END AS status,
  CASE WHEN seen THEN CASE WHEN page % 2 = 1 THEN 'none' WHEN page % 4 = 0 THEN 'major' ELSE 'cannot_verify' END END AS max_severity, CASE WHEN seen AND page % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN seen THEN 1 ELSE 0 END AS dropped
  FROM (SELECT source AS doc, doc_id AS page, doc_id % 7 = doc_id % 5 AS seen FROM documents)""")
def vision_normalize(spark, sf):
    p = F.col("page")
    same = F.struct(F.lit("x").alias("extracted"), F.lit(" x ").alias("image_shows"), F.lit("minor").alias("severity"))
    other = F.struct(F.lit("x").alias("extracted"), F.lit("y").alias("image_shows"), F.when(p % 4 == 0, " Major").otherwise("grave").alias("severity"))
    reply = F.to_json(F.struct(F.concat(F.lit(" t"), (p % 5).cast("string")).alias("image_token"), F.when(p % 2 == 0, F.array(same, other)).otherwise(F.array(same)).alias("discrepancies")))
    replies = A.table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page")).select("doc", "page", F.concat(F.lit("T"), (p % 7).cast("string")).alias("image_token"), reply.alias("reply"))
    return vision.normalize_records(replies).select("doc", "page", "channel_ok", "status", "max_severity", F.size("discrepancies").alias("n"), F.col("self_agreeing_dropped").alias("dropped"))


# --- other arms, contexts, metadata -----------------------------------------------------------------------------
RAW = f"regexp_extract_all({LOW}, '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT doc_id, {RAW} AS toks FROM documents), z AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM t),
  f AS (SELECT doc_id, dl, token, count(*) AS tf FROM p GROUP BY ALL), i AS (SELECT token, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f, z GROUP BY token), m AS (SELECT 0.25 * avg(idf) AS fl FROM i)
  SELECT doc_id AS chunk_id, round(sum((CASE WHEN idf < 0 THEN fl ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM f JOIN i USING (token), m WHERE token IN ('the', 'thing', 'and', 'therein', 'of', '2', 'mb') GROUP BY doc_id""")
def raw_bm25(spark, sf):
    return search.raw_bm25(A.chunks(spark, sf), QUESTION)


@query(f"""WITH a AS ({bm25_sql("source = 'src1'", 8)}), b AS ({bm25_sql("source <> 'src0'", 8)}), x AS (SELECT bool_and(source = 'src1') AS confined, count(*) > 0 AS found FROM a JOIN documents ON doc_id = chunk_id),
  y AS (SELECT count(*) FILTER (source = 'src0') = 0 AS tier_gone FROM b JOIN documents ON doc_id = chunk_id) SELECT coalesce(confined, true) AS confined, found, tier_gone, coalesce(confined, true) AND found AND tier_gone AS passed FROM x, y""")
def acceptance(spark, sf):
    return search.acceptance(A.index(spark, sf), QUESTION, "src1")


@query("""SELECT string_agg('[S' || (r_regionkey + 1) || '] (' || CASE WHEN r_regionkey = 0 THEN 'TIER-0, the survey''s own paraphrase' ELSE 'TIER-1, original paper' END || ') ' || r_name || ' p' || r_regionkey || CASE WHEN r_regionkey % 2 = 1 THEN '-' || (r_regionkey + 1) ELSE '' END
  || ', section: ' || CASE WHEN r_regionkey = 2 THEN '(no section heading)' ELSE 's' END || chr(10) || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS context FROM region""")
def context_blocks(spark, sf):
    k = F.col("r_regionkey").cast("int")
    hits = A.table(spark, sf, "region").select(k.alias("rank"), F.when(k == 0, 0).otherwise(1).alias("tier"), F.col("r_name").alias("doc"), k.alias("page_start"), (k + k % 2).alias("page_end"), F.when(k != 2, "s").alias("section"), F.col("r_name").alias("text"))
    return search.context(hits)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'OSDI' WHEN 1 THEN 'arXiv:2401.0' || (1000 + doc_id % 9000) END AS venue, CASE doc_id % 3 WHEN 0 THEN 2019 WHEN 1 THEN 2024 END AS year FROM (SELECT DISTINCT doc_id FROM documents)")
def venue_year(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id").distinct()
    k = F.col("doc_id")
    front = F.when(k % 3 == 0, "In OSDI 2019, after 2018").when(k % 3 == 1, F.concat(F.lit("arXiv: 2401.0"), (F.lit(1000) + k % 9000).cast("string"), F.lit(" of 2022"))).otherwise("none")
    return d.select("doc_id", R.venue(front).alias("venue"), R.year(front, front).alias("year"))


@query()
def draft_passages(spark, sf):
    return chunking.split_passages(A.table(spark, sf, "documents"), "doc_id")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
