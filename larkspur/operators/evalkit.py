"""Evaluation metrics over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import MISENCODED, extract_all, quote_key
from larkspur.functions.units import numbers_in, quantities_match

#: Fixed values.
REFUSALS = ["not stated", "does not", "do not contain", "no information", "not mentioned", "not provided", "cannot determine", "not found", "unable to", "not specified", "no such", "not report"]


def refused(answer: Column, answered: Column) -> Column:
    return ~answered | F.lower(answer).rlike("|".join(REFUSALS))


def numeric_match(truth: Column, answer: Column) -> Column:
    """Whether every number of the truth matches one of the answer; null if the truth has none."""
    want, have = numbers_in(truth), numbers_in(answer)
    return F.when(F.size(want) > 0, F.forall(want, lambda w: F.exists(have, lambda h: F.coalesce(quantities_match(w, h), F.lit(False)))))


#: Words of a trap answer that tell nothing about the system it names.
TRAP_STOP = ["the", "and", "for", "with", "that", "this", "answering", "reporting", "labelled", "labeled", "attributed", "confidently", "either", "only", "omitted", "generally", "achieves", "yes", "unconditional", "as", "if", "were", "consistent", "source", "corpus", "default", "most", "other", "systems", "use", "which", "them", "than", "not"]


def misattributed(answer: Column, trap: Column, truth: Column, stop: list[str]) -> Column:
    """Whether a word of the trap answer that isn't in the truth stands in the answer; null without a trap or an answer."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z][a-z0-9/]{2,}"), F.lit(0)))
    telling = F.array_except(F.array_except(words(trap), words(truth)), F.array(*map(F.lit, stop)).cast("array<string>"))
    return F.when((trap != "") & (answer != ""), F.exists(telling, lambda t: F.lower(answer).contains(t)))


def context_hit(evidence: Column, doc: Column, page: Column) -> Column:
    """Whether the evidence covers the page; null without evidence."""
    return F.when(F.size(evidence) > 0, F.exists(evidence, lambda e: (e["doc"] == doc) & (e["page_start"] <= page) & (page <= e["page_end"])))


def summarize(runs: DataFrame, *rates: str) -> DataFrame:
    """By arm: rows, mean latency, and for each flag the share of true among its known values."""
    shares = [F.round(F.avg(F.col(c).cast("double")), 3).alias(f"{c}_rate") for c in rates]
    return runs.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("elapsed"), 2).alias("mean_elapsed"), *shares)


#: Fixed values of the evaluation set.
CLASSES = ["A", "B", "C", "selfaudit"]
BEHAVIORS = ["answer", "refuse", "flag", "flag_ambiguous"]
REQUIRED = ["id", "class", "question", "expected_behavior"]
QUOTE = 60


def items_in(items: DataFrame, classes: list[str] | None = None) -> DataFrame:
    return items.where(F.col("class").isin(classes)) if classes else items


def runs(items: DataFrame, arms: list[str], repeats: int) -> DataFrame:
    """A row for each item, arm and repeat: the plan of an evaluation; arms and repeats are a few constants."""
    each = F.array(*map(F.lit, arms))
    return items.select("*", F.explode(each).alias("arm")).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))


def run_records(rows: DataFrame, stop: list[str] = TRAP_STOP) -> DataFrame:
    """rows (id, class, arm, answer, answered, error, elapsed, ground_truth, trap_answer, doc, page, evidence) with the metrics that their
    class asks for, null elsewhere."""
    answer, kind = F.coalesce("answer", F.lit("")), F.col("class")
    return rows.select(
        "*",
        refused(answer, F.coalesce("answered", F.lit(False))).alias("refused"),
        F.when(kind.isin("A", "C"), numeric_match(F.col("ground_truth"), answer)).alias("numeric_match"),
        F.when(kind == "C", misattributed(answer, F.col("trap_answer"), F.coalesce("ground_truth", F.lit("")), stop)).alias("misattributed"),
        F.when((F.col("arm") != "none") & F.col("doc").isNotNull(), context_hit(F.col("evidence"), F.col("doc"), F.col("page"))).alias("context_hit"),
    )


def summary(records: DataFrame) -> DataFrame:
    """By arm: each metric's numerator, denominator and rate to three places over the rows that have it, the errors and the mean latency."""
    kind = F.col("class")
    metrics = {
        "a_numeric": F.when(kind == "A", F.col("numeric_match")),
        "b_refused": F.when(kind == "B", F.col("refused")),
        "c_misattributed": F.when(kind == "C", F.col("misattributed")),
        "a_refused": F.when(kind == "A", F.col("refused")),
        "context": F.col("context_hit"),
    }
    parts = []
    for name, c in metrics.items():
        n, of = F.count_if(F.coalesce(c, F.lit(False))), F.count(c)
        parts += [n.alias(f"{name}_n"), of.alias(f"{name}_of"), F.round(F.when(of > 0, n / of), 3).alias(f"{name}_rate")]
    return records.groupBy("arm").agg(*parts, F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.round(F.avg("elapsed"), 2).alias("mean_elapsed"))


def item_problems(items: DataFrame, registry: DataFrame, pages: DataFrame) -> DataFrame:
    """id, level (error or warning) and problem for each fault of the evaluation set. items: id, class, question, ground_truth, expected_behavior, source
    (struct of doc_id, tier, page, quote); registry: doc, tier; pages: doc, page, text."""
    src, kind = F.col("source"), F.col("class")
    fault = lambda condition, problem, level="error": F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(problem).alias("problem")))
    none = F.lit(None).cast("struct<level:string,problem:string>")
    missing = F.exists(F.array(*[F.col(c).isNull() for c in REQUIRED]), lambda x: x)  # the others of its fields may be null
    is_b = F.coalesce(kind == "B", F.lit(False))
    counts = pages.groupBy("doc").agg(F.max("page").alias("n_pages"))
    known = registry.select(F.col("doc").alias("r_doc"), F.col("tier").alias("r_tier"))
    rows = items.join(known, src["doc_id"] == known["r_doc"], "left").join(counts, F.col("r_doc") == counts["doc"], "left").drop("doc")
    sourced = ~is_b & src.isNotNull()
    paged = sourced & F.col("r_doc").isNotNull() & F.coalesce(src["page"].between(1, F.col("n_pages")), F.lit(False))
    probe = F.substring(quote_key(F.coalesce(src["quote"], F.lit(""))), 1, QUOTE)
    checks = [
        fault(missing, "missing fields"),
        fault(~missing & ~kind.isin(CLASSES), "unknown class"),
        fault(~missing & ~F.col("expected_behavior").isin(BEHAVIORS), "unknown expected_behavior"),
        fault(is_b & F.col("ground_truth").isNotNull(), "B-class must have null ground_truth"),
        fault(is_b & src.isNotNull(), "B-class must have null source"),
        fault(is_b & (F.col("expected_behavior") != "refuse"), "B-class must expect refusal"),
        fault(kind.isin("A", "selfaudit") & src.isNull(), "class needs a source"),
        fault(sourced & F.col("r_doc").isNull(), "source not in the registry"),
        fault(sourced & F.col("r_doc").isNotNull() & ~F.col("r_tier").eqNullSafe(src["tier"]), "source tier differs from the registry's"),
        fault(sourced & F.col("r_doc").isNotNull() & ~paged, "page out of range"),
        fault(paged & (probe == ""), "no quote to verify", "warning"),
    ]
    judged = rows.select("id", F.filter(F.array(none, *checks), lambda x: x.isNotNull()).alias("faults"))
    single = judged.select("id", F.inline("faults"))
    twice = items.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("error"), F.lit("duplicate id"))
    # the quote: on its page, else anywhere in its document
    quoted = rows.where(paged & (probe != "")).select("id", src["doc_id"].alias("doc"), src["page"].alias("at"), probe.alias("probe"))
    found = quoted.join(pages.select("doc", "page", quote_key(F.col("text")).alias("key")), "doc").groupBy("id", "at").agg(
        F.coalesce(F.bool_or((F.col("page") == F.col("at")) & F.contains("key", "probe")), F.lit(False)).alias("here"), F.sort_array(F.collect_list(F.when(F.contains("key", "probe"), F.col("page")))).alias("on")
    )
    elsewhere = F.when(F.size("on") > 0, F.concat(F.lit("quote found on pages "), F.array_join(F.col("on").cast("array<string>"), ","))).otherwise("quote not located")
    return single.union(twice).union(found.where("not here").select("id", F.lit("warning"), elsewhere))


def composition(items: DataFrame) -> DataFrame:
    return items.groupBy("class").agg(F.count("*").alias("n"))


def misencoded_census(pages: DataFrame) -> DataFrame:
    """doc and the number of its sites where a number is followed by mathematical letters, for documents that have any."""
    sites = F.size(extract_all(F.col("text"), MISENCODED))
    return pages.groupBy("doc").agg(F.sum(sites).alias("n_sites")).where("n_sites > 0")
