"""Benchmark decontamination: prefix-filtered set join (DataFrame functions only).

An item is the set of its windows of WINDOW consecutive words (an item of fewer words is one window), and a window is the set of its
shingles of SHINGLE words (a shorter window is one shingle). For a document to contain a window exactly it must contain each of these shingles,
so one necessary shingle, the first in rarity order, is the whole prefix that has to be joined. Shingles are ordered by rarity: by
how many windows of the benchmark hold them (ties: by hash, then by place).

1. The index has a row for each distinct window: the hash of its rarest shingle, that shingle's place and length, the window's words and its id.
2. A bitmap over these hashes, a constant of bounded size, thins each document's shingles to the candidates, each with its
   neighbourhood of window size. Texts are looked at in pieces of PIECE words that overlap by a window, so the working arrays of a very long
   text are bounded.
3. Candidates join the index on the hash. Positional bound: the window must start inside the document;
   length bound: and end inside it; verification: its words must equal the neighbourhood's exactly.
4. One aggregation by document unites the hit spans and the windows; the documents with hits then meet the items of their windows.

Texts are never shuffled: only candidates and one row for each document are. The index, and the pairs of windows and items, are broadcast if their
bytes, which are counted, are at most BROADCAST_BYTES; else they are joined by a shuffle, where a shingle that is frequent in the documents is
a skewed key that adaptive execution splits.

Words: A-Z lower-cased, runs of 0-9, a-z and everything beyond ASCII.

Edge cases: null or empty texts have no words and no hits. Items without words and items whose id is null are left out;
repeated items count once. Repeated document rows are judged alike and all stay. An empty table gives
an empty result; an empty benchmark leaves all documents clean. Other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, bitmap, listed, materialize, text_key, whole_text, without

WINDOW = 8
SHINGLE = 3
#: From so many items on a document counts as contaminated in `find_contamination`.
MIN_ITEMS = 2
#: And from so many on `drop_contaminated` drops it: a training corpus should hold no window of any item.
MIN_ITEMS_DROPPED = 1
PIECE = 4096
BROADCAST_BYTES = 32 << 20
MAX_BITS = 1 << 22
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUT = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS), "")


def _word_hashes(words_: str) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _shingle_hashes(hashes: str, size: int) -> Column:
    """The hash of each run of `size` words; the last places, which have no whole run, have hashes of nothing in particular."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))


def _in_items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, window) for each window of each item."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(whole_text()).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("window")).distinct()
    return each.select("item", "window", F.md5(F.array_join("window", " ")).alias("wid"))


def window_index(each: DataFrame) -> DataFrame:
    """(token, at, size, window, wid): each distinct window under its rarest shingle."""
    windows = each.select("wid", "window").distinct().select("*", _word_hashes("window").alias("h"))
    whole = F.least(F.size("window"), F.lit(SHINGLE))
    by_size = F.when(whole == 1, _shingle_hashes("h", 1))
    for k in range(2, SHINGLE + 1):
        by_size = by_size.when(whole == k, _shingle_hashes("h", k))
    placed = windows.select("wid", whole.alias("size"), F.posexplode(F.slice(by_size, 1, F.size("window") - whole + 1)).alias("at", "token"))
    counts = placed.groupBy("token", "size").agg(F.count_distinct("wid").alias("held"))
    rarest = placed.join(counts, ["token", "size"]).groupBy("wid", "size").agg(F.min(F.struct("held", "token", "at")).alias("r"))
    return rarest.join(windows.select("wid", "window"), "wid").select("r.token", "r.at", "size", "window", "wid")


def _bounded(rows: DataFrame, size: Column) -> DataFrame:
    """Marks a materialized side for broadcast if its counted bytes, with 64 more for each row, allow it."""
    total = rows.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def _candidates(docs: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """One row for each document (at -1) and each candidate shingle, with the words around it."""
    found = index.agg(F.count_distinct("token").alias("n"), F.collect_set("size").alias("sizes")).first()
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * found["n"]).bit_length()))
    marks = bitmap(index.select("token"), bits)
    df = docs.select("doc_id", text_key().alias("text_key"), words(whole_text()).alias("whole"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("whole") - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.greatest(s - window + 1, F.lit(0)).alias("first"), F.slice("whole", F.greatest(s - window + 1, F.lit(0)) + 1, PIECE + 2 * window).alias("words")))
    df = df.select("doc_id", "text_key", F.size("whole").alias("n"), F.explode(pieces).alias("p")).select("doc_id", "text_key", "n", "p.*")
    df = df.select("*", _word_hashes("words").alias("h"))
    around = lambda i: F.slice("words", F.greatest(i - window + 1, F.lit(0)) + 1, 2 * window - 1)
    itself = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("long").alias("token"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("around"))
    parts = [F.when(F.col("start") == 0, F.array(itself)).otherwise(F.slice(F.array(itself), 1, 0))]
    own = F.col("start") - F.col("first")
    for k in sorted(found["sizes"]):
        fits = F.size("words") - k
        each = F.transform(_shingle_hashes("h", k), lambda t, i: F.struct(i.alias("i"), t.alias("token")))
        df = df.select("*", F.filter(each, lambda s: listed(marks, bits, s["token"]) & s["i"].between(own, F.least(own + PIECE - 1, fits))).alias(f"at{k}"))  # noqa: B023
        size = F.lit(k).alias("size")
        parts.append(F.transform(f"at{k}", lambda s: F.struct((s["i"] + F.col("first")).alias("i"), s["token"].alias("token"), size, around(s["i"]).alias("around"))))  # noqa: B023
    return df.select("doc_id", "text_key", "n", F.explode(F.concat(*parts)).alias("c")).select("doc_id", "text_key", "n", "c.*")


def _verified(joined: DataFrame, window: int) -> DataFrame:
    start, long_ = F.col("i") - F.col("at"), F.size("window")
    first = F.greatest(F.col("i") - window + 1, F.lit(0))
    inside = (start >= 0) & (start + long_ <= F.col("n"))
    fits = F.when(inside, F.slice("around", F.greatest(start - first, F.lit(0)) + 1, long_) == F.col("window")).otherwise(False)
    return joined.where((F.col("i") < 0) | fits).select("doc_id", "text_key", "n", "i", F.when(F.col("i") >= 0, F.struct(start.alias("start"), (start + long_).alias("end"))).alias("span"), "wid")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, text_key, and OUT: n_words, n_hit (words inside matched windows), n_items, items (sorted as strings), contaminated (holds windows
    of min_items items or more)."""
    each = materialize(_in_items(benchmark, window))
    index = materialize(window_index(each))
    rows = _candidates(docs, index, window)
    own = rows.where(F.col("i") < 0).select("*", *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("at", "window", "wid")])
    side = _bounded(index, F.octet_length(F.array_join("window", " ")) + 8 * F.size("window"))
    met = rows.join(side, ["token", "size"], "left") if side is not index else rows.where(F.col("i") >= 0).join(index, ["token", "size"]).unionByName(own)
    found = _verified(met, window).groupBy("doc_id", "text_key").agg(
        F.count_if(F.col("i") < 0).alias("copies"),
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.collect_set("wid").alias("wids"),
    )
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["hit"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("hit")),
    )
    found = materialize(found.select("doc_id", "text_key", "copies", "n_words", union["hit"].alias("n_hit"), "wids"))
    key = ["doc_id", "text_key", "copies", "n_words", "n_hit"]
    pairs = _bounded(each.select("wid", "item"), F.octet_length("item") + 32)
    hit = found.where(F.size("wids") > 0).select(*key, F.explode("wids").alias("wid")).join(pairs, "wid").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = hit.unionByName(found.where(F.size("wids") == 0).select(*key, F.array().cast("array<string>").alias("items")))
    out = out.select("*", F.size("items").cast("long").alias("n_items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.select("*", (F.col("n_items") >= min_items).alias("contaminated")).select("doc_id", "text_key", *OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS_DROPPED) -> DataFrame:
    """The documents that hold windows of fewer than min_items items, with their own columns."""
    found = find_contamination(docs, benchmark, min_items=min_items).where("contaminated")
    return without(docs, materialize(found.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct()))
