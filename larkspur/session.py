"""A lookup session: a scope that sticks, searches, table queries, questions and checks over held DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import page_range, preview
from larkspur.operators import answers, audit, search, tables
from larkspur.operators.providers import Completer
from larkspur.sources import registry as R
from larkspur.sources.index import index_of

HELP = "/tables PATTERN [in COLUMN], /doc ID, /tier N, /k N, /ask QUESTION, /check PASSAGE, /docs, /help, /quit; anything else is searched for"
OFF = ("", "off", "none", "-")
MOST = 20


class Session:
    """chunks: chunk_id, doc, tier, page_start, page_end, text and perhaps section; tables as in operators.tables; registry as in sources.registry; make:
    the model of /ask and /check. Each call of line() returns a DataFrame of results or a message; None ends the session."""

    def __init__(self, chunks: DataFrame, table_layer: DataFrame, registry: DataFrame, k: int = 6, make: Callable[[], Completer] | None = None):
        self.chunks = chunks if "section" in chunks.columns else chunks.withColumn("section", F.lit(None).cast("string"))
        self.table_layer, self.registry = table_layer, registry
        self.index = index_of(chunks, f"session {id(self)}")
        self.doc: str | None = None
        self.tier: int | None = None
        self.k = k
        self.make = make

    def scope(self) -> str:
        return " ".join(([f"doc={self.doc}"] if self.doc else []) + ([f"tier={self.tier}"] if self.tier is not None else []))

    def _hits(self, query: str) -> DataFrame:
        scope = search.in_scope([self.doc] if self.doc else None, None if self.tier is None else [self.tier])
        return search.top(search.bm25(self.index, query, scope), self.k, "chunk_id").join(self.chunks, "chunk_id")

    def search(self, query: str) -> DataFrame:
        return self._hits(query).select("rank", "score", "doc", page_range(F.col("page_start"), F.col("page_end")).alias("pages"), preview(F.col("text"), 300).alias("preview")).orderBy("rank")

    def ask(self, question: str) -> DataFrame:
        questions = self.chunks.sparkSession.createDataFrame([(0, question)], "query_id int, question string")
        return answers.ask(questions, self._hits(question).withColumn("query_id", F.lit(0)), self.make)

    def check(self, passage: str) -> DataFrame:
        """The claims choose their own scopes; that of the session does not hold here."""
        passages = self.chunks.sparkSession.createDataFrame([(1, passage)], "paragraph_index int, passage string")
        return audit.audit_passages(passages, self.registry.select("ref", F.col("doc_id").alias("doc")), self.index, self.chunks, self.make, self.k)

    def query_tables(self, pattern: str, column: str | None) -> DataFrame:
        held = self.table_layer.columns
        return tables.query_tables(self.table_layer, pattern, column, self.doc if "doc" in held else None, self.tier if "tier" in held else None)

    def _set_doc(self, wanted: str) -> str:
        if wanted in OFF:
            self.doc = None
            return "all documents"
        found = R.resolve_short(self.registry, wanted).first()
        if found is None:
            return f"no single document is meant by {wanted}"
        self.doc = found["doc_id"]
        return self.scope()

    def _set_tier(self, value: str) -> str:
        if value not in (*OFF, "0", "1"):
            return "/tier wants 0, 1 or off"
        self.tier = None if value in OFF else int(value)
        return self._state()

    def _set_k(self, value: str) -> str:
        if not value.isdecimal():
            return "/k wants a number"
        self.k = max(1, min(MOST, int(value)))
        return self._state()

    def _state(self) -> str:
        return f"{self.scope()} k={self.k}".strip()

    def line(self, text: str) -> DataFrame | str | None:
        text = text.strip()
        if not text.startswith("/"):
            return self.search(text) if text else ""
        command, _, rest = text[1:].partition(" ")
        rest = rest.strip()
        if command in ("quit", "q", "exit"):
            return None
        if command == "docs":
            return self.registry.orderBy(F.asc_nulls_last("ref"))
        setter = {"doc": self._set_doc, "tier": self._set_tier, "k": self._set_k}.get(command)
        if setter:
            return setter(rest)
        if command in ("ask", "check") and rest:
            if self.make is None:
                return "/ask and /check want a model"
            return self.ask(rest) if command == "ask" else self.check(rest)
        if command == "tables" and rest:
            pattern, _, column = rest.partition(" in ")
            return self.query_tables(pattern.strip(), column.strip() or None)
        return HELP
