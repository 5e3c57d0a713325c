"""LM scoring: subword lattice likelihood.

The lexicon is the vocabulary of an existing subword tokenizer. Its pieces get unigram weights: their counts when the tokenizer
cuts the training words, plus the vocabulary's own order as a prior (a piece of rank r has prior weight 1 / (r + PRIOR_SHIFT), PRIOR_MASS in
all). A word's probability is the sum over all its segmentations into pieces, by a forward recursion over the lattice in log space; any character can
also be spelled by the vocabulary's byte pieces, so no word is impossible. Words start with the
vocabulary's word mark, which no piece has inside, so a text's probability is the product of its words' and that of the end symbol: the marginal over all
segmentations, a proper distribution over texts.

Learning gathers from all training documents (crc32 of the id as text, modulo FOLDS, is not HELD_OUT):

1. Each task counts the words of its texts; one aggregation sums them, for the training documents and for all.
2. Piece counts follow from the table of distinct words; they are at most as many as the vocabulary and go to the driver, and to all tasks.
3. Each distinct word is scored once. Words with at least 1 / HEAD_WORDS of all tokens, of which there can be no more than HEAD_WORDS, go
   to all tasks as a dictionary; a task adds them up on the spot. For all other words it emits (document, word, count), which
   meet counts and scores in a join on the word; no such word is hot.
4. One aggregation by document adds both parts.

base_score is the add-one unigram model of whole words over the same tokens.

Words: A-Z lower-cased, runs of characters other than space, \\t, \\n, \\v, \\f and \\r; each text has one end token after them.

Edge cases: a null text counts as empty: the end token alone. A null id counts as the text "" for the folds. Repeated rows are scored alike and all stay, and
count as often as they stand there in training. An empty table gives an empty one; without training documents all weights come from the prior,
and base probabilities are 1/(V+1) with V = 0. Other columns are ignored. A text costs time in proportion to its length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize

FOLDS, HELD_OUT = 7, 2
HEAD_WORDS = 1 << 17
PRIOR_MASS, PRIOR_SHIFT = 1000.0, 10.0
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
MARK = "▁"
NEVER = -math.inf


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """The words without the end token, as UTF-8; bytes.lower and bytes.split know ASCII alone."""
    return text.encode().lower().split() if text else []


# --- the lattice ----------------------------------------------------------------------------------------------------
class Model(NamedTuple):
    """Natural logarithms of the pieces' probabilities; pieces by their text, byte pieces by their byte."""

    pieces: dict[str, float]
    bytes_: list[float]
    end: float


@cache
def lexicon(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def fit(counts: dict[int, int], ends: int, path: str) -> Model:
    """counts: piece ids in the cut training words; ends: training documents."""
    sp = lexicon(path)
    pieces, bytes_ = {}, [0.0] * 256
    order = {i: 1 / (rank + PRIOR_SHIFT) for rank, i in enumerate(sorted(range(sp.get_piece_size()), key=lambda i: (-sp.get_score(i), i)))}
    usable = [i for i in order if not (sp.is_control(i) or sp.is_unknown(i)) and MARK not in sp.id_to_piece(i)[1:]]
    scale = PRIOR_MASS / sum(order[i] for i in usable)
    weight = {i: counts.get(i, 0) + scale * order[i] for i in usable}
    total = math.log(sum(weight.values()) + ends + 1)
    for i, w in weight.items():
        if sp.is_byte(i):
            bytes_[int(sp.id_to_piece(i)[3:5], 16)] = math.log(w) - total
        else:
            pieces[sp.id_to_piece(i)] = math.log(w) - total
    return Model(pieces, bytes_, math.log(ends + 1) - total)


class Lattice:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.find = ahocorasick.Automaton()
        for piece, w in model.pieces.items():
            self.find.add_word(piece, (len(piece), w))
        self.find.make_automaton()

    def word(self, word: str) -> float:
        """log of the summed probability of all segmentations of the marked word."""
        text = MARK + word
        alpha = [0.0] + [NEVER] * len(text)
        bytes_, exp, log1p = self.model.bytes_, math.exp, math.log1p
        at = 0

        def spell(upto: int) -> None:
            nonlocal at
            while at < upto:  # characters whose edges are all known: add the spelling by bytes
                c = text[at]
                self._add(alpha, at + 1, alpha[at] + sum([bytes_[b] for b in c.encode()]))
                at += 1

        done = 0
        for last, (size, w) in self.find.iter(text):
            if last > done:
                # all edges into the places up to `last` have been seen, but for the byte spellings
                spell(last)
                done = last
            x = alpha[last + 1 - size] + w
            y = alpha[last + 1]
            if x > y:
                x, y = y, x
            alpha[last + 1] = y if x == NEVER else y + log1p(exp(x - y))
        spell(len(text))
        return alpha[-1]

    @staticmethod
    def _add(alpha: list[float], i: int, x: float) -> None:
        y = alpha[i]
        if x > y:
            x, y = y, x
        alpha[i] = y if x == NEVER else y + math.log1p(math.exp(x - y))


# --- tasks ----------------------------------------------------------------------------------------------------------
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_all, n_train); the end token's row has a null word."""
    both: tuple[Counter, Counter] = (Counter(), Counter())
    ends = [0, 0]

    def out() -> pa.RecordBatch:
        words = list({**both[0], **both[1]})
        train, rest = both[0], both[1]
        n = [train[w] for w in words]
        batch = pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*[x + rest[w] for x, w in zip(n, words, strict=True)], ends[0] + ends[1]], pa.int64()), pa.array([*n, ends[0]], pa.int64())], names=["word", "n_all", "n_train"])
        both[0].clear()
        both[1].clear()
        ends[:] = [0, 0]
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            k = int(held_out(doc_id))
            ends[k] += 1
            both[k].update(tokens(text))
            if len(both[0]) + len(both[1]) > FLUSH:
                yield out()
    yield out()


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sp = lexicon(path)
    counts: Counter = Counter()
    for batch in batches:
        words = [w.decode() for w in batch.column("word").to_pylist()]
        for ids, n in zip(sp.encode(words, num_threads=1), batch.column("n_train").to_pylist(), strict=True):
            for i in ids:
                counts[i] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])


def _score_words(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(model.value)
    for batch in batches:
        scores = [lattice.word(w.decode()) for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n_all"), batch.column("n_train"), pa.array(scores, pa.float64())], names=["word", "n_all", "n_train", "score"])


def _score_texts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For each document its own row (word null) with what the head words give, and a row for each other word. count: the
    document's tokens, or the word's."""
    head, end_base, end_score = shared.value
    names = ["doc_id", "text_key", "word", "count", "known", "base", "score"]
    rows: list[list] = [[] for _ in names]

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)
        for x in rows:
            x.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key = xxhash.xxh64_intdigest(text or "") - (1 << 63)
            words = tokens(text)
            base, score, known = end_base, end_score, 0
            tail: list[tuple[bytes, int]] = []
            for w, n in Counter(words).items():
                x = head.get(w)
                if x is None:
                    tail.append((w, n))
                else:
                    base += n * x[0]
                    score += n * x[1]
                    known += n * x[2]
            ws = [w for w, _ in tail]
            k = len(ws)
            for column, own, more in zip(rows, (doc_id, key, None, len(words), known, base, score), ([doc_id] * k, [key] * k, ws, [n for _, n in tail], [0] * k, [0.0] * k, [0.0] * k), strict=True):
                column.append(own)
                column.extend(more)
            if len(rows[0]) > 100_000:
                yield out()
    if rows[0]:
        yield out()


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row. path: the vocabulary's file, at
    the same place on all machines."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.mapInArrow(_count_words, "word binary, n_all long, n_train long").groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))
    counted = materialize(counted)
    is_end = F.col("word").isNull()
    stats = counted.agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n"), F.count_if(F.col("n_train") > 0).alias("v"), F.sum(F.when(is_end, F.col("n_train"))).alias("ends")).first()
    n, v, ends, n_all = (stats[k] or 0 for k in ("n", "v", "ends", "n_all"))
    words = counted.where(~is_end)
    pieces = words.where("n_train > 0").select("word", "n_train").mapInArrow(lambda b: _count_pieces(b, path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = fit({r["piece"]: r["n"] for r in pieces.collect()}, ends, path)
    shared = sc.broadcast(model)
    scored = materialize(words.mapInArrow(lambda b: _score_words(b, shared), "word binary, n_all long, n_train long, score double"))
    log10 = math.log(10)
    floor = math.log10(n + v + 1)
    is_head = F.col("n_all") * HEAD_WORDS >= F.lit(n_all)
    head = {bytes(r["word"]): (math.log10(r["n_train"] + 1) - floor, r["score"] / log10, int(r["n_train"] > 0)) for r in scored.where(is_head).collect()}
    given = sc.broadcast((head, math.log10(ends + 1) - floor, model.end / log10))
    rows = docs.mapInArrow(lambda b: _score_texts(b, given), "doc_id long, text_key long, word binary, count long, known long, base double, score double")
    # The document's own rows meet nothing in the join. They get a word of their own, by hash, so that they spread over all tasks.
    key = F.coalesce("word", F.concat(F.lit(" ").cast("binary"), F.col("text_key").cast("string").cast("binary")))
    tail = scored.where(~is_head).select(F.col("word").alias("key"), "n_train", F.col("score").alias("word_score"))
    met = rows.select("doc_id", "text_key", "count", "known", "base", "score", F.col("word").isNull().alias("own"), key.alias("key")).join(tail, "key", "left")
    part = ~F.col("own")
    c = F.col("count")
    sums = met.groupBy("doc_id", "text_key").agg(
        F.count_if("own").alias("copies"),
        F.sum(F.when(F.col("own"), c)).alias("n_words"),
        F.sum(F.when(part & (F.col("n_train") > 0), c).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(part, c * (F.log10(F.col("n_train") + 1) - F.lit(floor))).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(part, c * F.col("word_score") / F.lit(log10)).otherwise(F.col("score"))).alias("score"),
    )
    k = F.col("copies")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return sums.select(
        "doc_id",
        (F.crc32(id_text.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"),
        F.expr("n_words div copies + 1").alias("n_tokens"),
        (F.expr("n_known div copies") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / k).alias("base_score"),
        (F.col("score") / k).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), k)).alias("_copy"),
    ).drop("_copy")
