"""Grounded answers: questions with their hits become prompts, replies become answers. Which source a marker means is decided here, never by the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.audit import cited_sources
from larkspur.operators.providers import Completer, complete_once, parse_reply
from larkspur.operators.search import context

#: Fixed values.
NOT_STATED = "not stated in the retrieved sources"
NO_HITS = "retrieval returned no candidate passages"
UNCITED = "the model claims an answer but names no source that there is"

REPLY = "answered boolean, answer string, used_sources array<string>, unsupported_note string"
SOURCE = ["chunk_id", "doc", "tier", "page_start", "page_end", "section"]
INSTRUCTIONS = """Answer the question from the numbered sources alone; what they do not say, you do not know.
Give figures exactly as they stand there, with their units and conditions; compute and convert nothing.
After each statement name its source as [S1], [S2] and so on. Where sources differ, say so and name both.
Reply with one JSON object: {"answered": true or false, "answer": "...", "used_sources": ["S1"], "unsupported_note": "what is missing, if not answered"}"""


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, question, sources, prompt for each question (query_id, question) that has hits (query_id, rank from 0, the columns of SOURCE, text;
    a top-k of each question, so a row holds k texts at most)."""
    sources = F.transform(F.sort_array(F.collect_list(F.struct("rank", *SOURCE))), lambda s: F.struct(F.concat(F.lit("S"), (s["rank"] + 1).cast("string")).alias("marker"), *[s[c].alias(c) for c in SOURCE]))
    listed = hits.groupBy("query_id").agg(sources.alias("sources")).join(context(hits, keys=["query_id"]), "query_id")
    prompt = F.concat(F.lit(INSTRUCTIONS + "\n\n--- SOURCES ---\n"), "context", F.lit("\n\n--- QUESTION ---\n"), "question")
    return questions.select("query_id", "question").join(listed, "query_id").select("query_id", "question", "sources", prompt.alias("prompt"))


def used_markers(answer: Column, listed: Column, n_sources: Column) -> Column:
    """Numbers of the sources that the answer's text or the reply's own list names and that exist, in order."""
    named = F.array_join(F.transform(listed, lambda m: F.concat(F.lit("["), F.upper(F.regexp_replace(m, r"^[\s\[\]]+|[\s\[\]]+$", "")), F.lit("]"))), " ")
    return cited_sources(F.concat_ws(" ", answer, named), n_sources)


def resolve(replied: DataFrame) -> DataFrame:
    """Replied prompts (query_id, question, sources, reply, error) as answers: query_id, question, answered, answer, not_stated, note, citations. An
    answer without a source that there is counts as none; so does a reply that cannot be read."""
    r = F.col("r")
    text = F.trim(F.coalesce(r["answer"], F.lit("")))
    rows = replied.select("query_id", "question", "sources", "error", parse_reply(F.col("reply"), REPLY).alias("r"))
    rows = rows.select("*", (F.coalesce(r["answered"], F.lit(False)) & (text != "")).alias("claims"), text.alias("text"), used_markers(text, r["used_sources"], F.size("sources")).alias("used"))
    answered = F.col("claims") & (F.size("used") > 0)
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("claims") & ~answered, UNCITED).otherwise(F.coalesce(r["unsupported_note"], F.lit("")))
    return rows.select(
        "query_id",
        "question",
        answered.alias("answered"),
        F.when(answered, F.col("text")).otherwise("").alias("answer"),
        F.when(~answered, NOT_STATED).alias("not_stated"),
        note.alias("note"),
        F.transform("used", lambda i: F.get("sources", i - 1)).alias("citations"),
    )


def ask(questions: DataFrame, hits: DataFrame, make: Callable[[], Completer]) -> DataFrame:
    """An answer for each question; those without hits never reach the model."""
    answers = resolve(complete_once(prompts(questions, hits), "prompt", make))
    silent = questions.select("query_id", "question").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    none = F.array().cast(answers.schema["citations"].dataType)
    return answers.union(silent.select("query_id", "question", F.lit(False), F.lit(""), F.lit(NOT_STATED), F.lit(NO_HITS), none))
