"""Quality rules: distribution divergence (DataFrame functions only).

Each document is compared with references of its language by Jensen-Shannon distance (the square root of
the divergence to base 2, 0 to 1): once by the histogram of its characters over seven classes, once by
the histogram of its language's common words against all other words. The references are
the pooled histograms of all documents of that language that pass the base rules; documents of a
language without a word list use one reference of all such languages, and only the character
histogram is judged. The bound of the word distance is a share of the distance that a text without any common word has, as that depends on
the reference. A histogram that rests on too few characters or words is not judged (the
minimum-length guards), so short clean texts are never rejected by chance.

Base rules, before the divergence: at least MIN_WORDS words, and at most MAX_REPEAT_PERCENT of the words
inside 8-word windows that the text holds twice or more.

A word is a run of characters other than space, \\t, \\n, \\v, \\f and \\r. Windows are compared by 64-bit
hashes, and windows with equal hashes by their words.

Edge cases: a null text counts as an empty one: no words, all counts 0, base_failed. A null or unknown
language uses the shared reference. Repeated rows are judged alike and all stay. Columns named like
an output column are replaced, others pass through. An empty table gives an empty table. Where
no document of a language passes the base rules there is no reference and its documents are
judged by the base rules alone. Work per document grows as n log n in its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, SPACE_CLASS, UPPER, held, materialize, packed, text_key, whole_text, without, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Histograms over fewer characters or words are not judged.
MIN_CHARS_JUDGED = 400
MIN_WORDS_JUDGED = 80
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_SHARE = 0.85
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

#: The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "on", "be", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"],
}
OTHER = "other"
CLASSES = ["lower", "space", "symbol", "upper", "digit", "punct", "rest"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = [*COUNTS, "base_failed", "kept", "char_distance", "word_distance"]
FEATURES = ["language", *CLASSES, "common", "n_chars_", *COUNTS, "base_failed"]


def _language(c: Column) -> Column:
    return F.when(c.isin(*COMMON_WORDS), c).otherwise(F.lit(OTHER))


def _by_language(values: dict[str, list], kind: str) -> Column:
    """A constant of each language, chosen by the column `language`."""
    out = F.array().cast(kind)
    for lang, v in values.items():
        out = F.when(F.col("language") == lang, F.array(*[F.lit(x) for x in v]).cast(kind)).otherwise(out)
    return out


def _character_counts(df: DataFrame) -> DataFrame:
    """Each class is what one more removal takes away, so later passes see shorter texts."""
    left, counts = "text_", []
    removals = [("lower", f"[{LOWER}]+"), ("space", f"[{SPACE_CLASS}]+"), ("symbol", r"[#*$%&|<>]+"), ("upper", f"[{UPPER}]+"), ("digit", "[0-9]+"), ("punct", r"[.,;:!?'\"()\-]+")]
    for name, pattern in removals:
        df = df.select("*", F.regexp_replace(left, pattern, "").alias(f"no_{name}"))
        counts.append((F.length(left) - F.length(f"no_{name}")).cast("long").alias(name))
        left = f"no_{name}"
    df = df.select("*", *counts, F.length(left).cast("long").alias("rest"), F.length("text_").cast("long").alias("n_chars_"))
    return df.drop(*[f"no_{name}" for name, _ in removals])


def _common_counts(df: DataFrame) -> DataFrame:
    """`common`: how often the text holds each listed word, small or with a capital first letter."""
    both = {k: [x for w in v for x in (w, w[:1].upper() + w[1:])] for k, v in COMMON_WORDS.items()}
    # columns of their own: inside a lambda they would be built anew for each word
    df = df.select("*", _by_language(both, "array<string>").alias("listed"))
    df = df.select("*", F.filter("words", lambda w: F.array_contains("listed", w)).alias("hits"))
    count = F.transform("listed", lambda x: F.size(F.filter("hits", lambda h: h == x)).cast("long"))
    # `hits` stands here twice, so that the optimizer leaves it a column and does not move it into the lambda
    df = df.select("*", F.when(F.size("hits") == 0, F.transform("listed", lambda x: F.lit(0).cast("long"))).otherwise(count).alias("each"))
    return df.select("*", F.filter(F.transform("each", lambda c, i: F.when(i % 2 == 0, c + F.get("each", i + 1))), lambda c: c.isNotNull()).alias("common")).drop("listed", "hits", "each")


def _with_next(hashes: str, k: int):
    return lambda x, i: F.xxhash64(x, F.get(hashes, i + k))


def _repeated_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: positions inside the windows that occur twice or more, overlaps among them.

    Hashes first; only texts in which one repeats sort them by (hash, place). Neighbours of equal hash whose words
    agree are repeated windows; each covers its words up to the next one."""
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    for k in (1, 2, 4):  # a window of 2k words is two neighbours of k
        df = df.select("*", F.transform(f"h{k}", _with_next(f"h{k}", k)).alias(f"h{2 * k}")).drop(f"h{k}")
    df = df.select("*", F.slice(f"h{WINDOW}", 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0))).alias("hashes")).drop(f"h{WINDOW}")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.select("*", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("sorted"))
    words = lambda s: F.slice("words", s["i"] + 1, WINDOW)
    same = lambda s, o: F.coalesce((s["h"] == o["h"]) & (words(s) == words(o)), F.lit(False))
    df = df.select("*", F.filter("sorted", lambda s, j: same(s, F.get("sorted", j - 1)) | same(s, F.get("sorted", j + 1))).alias("flagged"))
    df = df.select("*", F.sort_array(F.transform("flagged", lambda s: s["i"])).alias("at"))
    covered = F.transform("at", lambda p, j: F.least(F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("*", total.alias("n_repeat_words")).drop("hashes", "sorted", "flagged", "at")


def features(docs: DataFrame) -> DataFrame:
    """row (the input columns), language, the counts of OUT, the class counts and `common`."""
    df = docs.select(packed(docs).alias("row"), _language(F.col("lang")).alias("language"), whole_text().alias("text_"))
    df = df.select("*", words_of("text_").alias("words"))
    df = df.select("*", F.filter(F.split("text_", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE_CLASS}]"))).alias("lines"))
    df = df.select("*", F.size("words").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    df = _repeated_words(_common_counts(_character_counts(df))).drop("words", "text_")
    df = df.select("*", (F.col("n_chars_") - F.col("space")).alias("word_chars"), F.col("symbol").alias("n_symbols"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("*", held(failed).alias("base_failed"))


def references(feats: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Pooled counts by language: at most one row for each listed language and one for the others."""
    k = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(c).alias(c) for c in CLASSES] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(k)] + [F.sum("n_words").alias("n_words")]
    out = {}
    for r in feats.where(~F.col("base_failed")).groupBy("language").agg(*sums).collect():
        words = [r[f"w{i}"] or 0 for i in range(len(COMMON_WORDS.get(r["language"], [])))]
        out[r["language"]] = ([r[c] for c in CLASSES], [*words, r["n_words"] - sum(words)])
    return out


def _distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts/total from the reference's shares. Counts of 0 add the reference's half alone."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    term = lambda c, q: (half(c / total, (c / total + q) / 2) + half(q, (c / total + q) / 2)) / 2
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x)))


def _most(reference: list[float]) -> float:
    """The distance of a text without any common word; 0 for a reference without any."""
    rest = reference[-1]
    mean = (1 + rest) / 2
    both = -math.log2(mean) + (rest * math.log2(rest / mean) if rest else 0.0)
    return math.sqrt(max(0.0, (sum(reference[:-1]) + both) / 2)) if rest < 1 else 0.0


def judged(feats: DataFrame, refs: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """feats with char_distance, word_distance (null where a guard holds) and kept."""
    share = lambda xs: [x / max(1, sum(xs)) for x in xs]
    chars = _by_language({k: share(v[0]) for k, v in refs.items()}, "array<double>")
    words = _by_language({k: share(v[1]) for k, v in refs.items()}, "array<double>")
    most = F.get(_by_language({k: [_most(share(v[1]))] for k, v in refs.items()}, "array<double>"), F.lit(0))
    df = feats.select("*", chars.alias("char_ref"), words.alias("word_ref"), most.alias("most"), F.array(*CLASSES).alias("classes"))
    df = df.select("*", F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x))).alias("word_bins"))
    has = lambda ref, n, least: (F.size(ref) > 0) & (F.col(n) >= least)
    df = df.select(
        "*",
        F.when(has("char_ref", "n_chars_", MIN_CHARS_JUDGED), _distance(F.col("classes"), F.col("n_chars_"), F.col("char_ref"))).alias("char_distance"),
        F.when(has("word_ref", "n_words", MIN_WORDS_JUDGED) & (F.size("word_ref") > 1), _distance(F.col("word_bins"), F.col("n_words"), F.col("word_ref"))).alias("word_distance"),
    )
    without_words = (F.col("most") > 0) & (F.col("word_distance") > MAX_WORD_SHARE * F.col("most"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | F.coalesce(without_words, F.lit(False))
    return df.select("*", held(~F.col("base_failed") & ~far).alias("kept"))


def judge_quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with OUT. The small features are kept once, so texts are read once."""
    keep = [c for c in keep if c not in OUT]
    feats = materialize(features(docs).select(packed_of(keep), *FEATURES))
    return judged(feats, references(feats)).select("row.*", *OUT)


def packed_of(names: list[str]) -> Column:
    return F.struct(*[F.col("row")[c].alias(c) for c in names]).alias("row")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are read once for their features, which are small and kept, and once to leave
    out the rows that were judged bad."""
    read = docs.select("doc_id", "text", "lang", text_key("lang").alias("text_key"))
    feats = materialize(features(read).select(F.col("row.doc_id").alias("k_id"), F.col("row.text_key").alias("k_text"), *FEATURES))
    bad = judged(feats, references(feats)).where("not kept").select("k_id", "k_text").distinct()
    return without(docs, materialize(bad), "lang")
