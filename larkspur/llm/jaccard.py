"""N-gram Jaccard join by grouped prefixes: exact, on sets of distinct 5-word shingles.

Two documents link when 100 * |intersection| >= THRESHOLD * |union|. Order every set by a rarity order that all documents
share; then two linked sets meet in their prefixes: the larger one's is its first n - ceil(t * n) + 1 shingles, the smaller one's, which
is all that needs to be looked up, its first n - ceil(2t / (1 + t) * n) + 1.

1. Rarity: a table of 2**SKETCH_BITS counters over the shingles of all documents (hashed), of fixed size, summed over all tasks. The order
   is by level of the counter, then by the fingerprint. Any total order is right; this one keeps shared passages out of prefixes.
2. Documents with equal sets are one class; classes with the same prefix and size are one group. Most shingles stand in one prefix only: of
   each, 32 bits are shuffled, and a bitmap of bounded size over those found twice tells which to look at. The lists, one row for each such prefix shingle
   of each group, are sorted by shingle and the one before it over range partitions, so that a shingle that many groups hold is cut between tasks. Rows
   without a neighbour of the same shingle go, whatever the bitmap let through.
3. First pass: neighbours in a list, each group and its list's centre, and neighbours among the classes of a group, are candidates where sizes, places in
   the prefix and parity bitmaps (an upper bound of the intersection from n to 2n bits) allow a link; they are verified on their whole sets. The
   links found join classes to components.
4. Second pass: in lists that still hold several components the groups are expanded to members. Members of different components meet in each shingle
   that the smaller one's short prefix and the larger one's prefix share; sizes, places and a parity bitmap of 256 bits stand in the join's own
   condition, so that only pairs that may link become rows. They pass the whole bitmaps and are verified. A pair inside one component needs no check, as its
   members already reach each other, so a group of copies costs its size, not its square.
5. Groups that still hold several components themselves: their members have the prefix in common, so two that link also share one of the next
   n - ceil(2t / (1 + t) * n) + 1 shingles in order. These are the keys by which their members meet, under the same conditions.

Every link between different texts thus either is found or runs inside a component, and components are exact.
Texts are read three to five times and never shuffled: where the sets of some documents are needed, a bitmap of fixed size over their ids tells which texts
to cut, and sets that it lets through for nothing fall in the join by class. Components come from alternating large-star and small-star
steps, each cut by a checkpoint.

Fingerprints have 64 bits: for two sets of a thousand shingles the chance that a collision adds to their intersection is
below 10**-13. Classes are told apart by 128 bits.

Edge cases: null texts and texts without words have no set, n_shingles 0, and are components of their own. Repeated rows and equal sets share a component. A
null id never is a component's id unless all its documents' ids are null. An empty table gives an empty one. Very long texts are cut in pieces;
their sets take 8 bytes for each word. Other columns are ignored by the join and pass through the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import among, map_batches, materialize, spread, text_key, tidy, without
from larkspur.llm.shingles import all_shingles, least_difference, parity, parity_words, shingles

THRESHOLD = 80
SKETCH_BITS = 22
SLICES = 64
#: Bits of the map that tells which documents' sets are needed: 8 MB.
MARK_BITS = 1 << 26
#: Least and most bits of the map of shingles that several prefixes hold, 8 and 64 MB; a fuller map lets more through.
SHARED_BITS = (1 << 26, 1 << 29)
#: Rows whose prefixes are looked at together.
SLICE_ROWS = 2_000
#: Columns of 64 bits each: a parity bitmap of one width for all sets, for the conditions of joins.
PARITY = ["q0", "q1", "q2", "q3"]
Batches = Iterator[pa.RecordBatch]


# --- rarity ---------------------------------------------------------------------------------------------------------
def _places(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Batches) -> Batches:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for t in batch.column("text").to_pylist():
            np.add.at(counts, _places(all_shingles(t)), np.uint32(1))  # in place: no array of all counters beside it
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _sum_slices(batches: Batches) -> Batches:
    """Sums what comes, one slice's worth of counters at a time in memory."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(raw), np.uint32)
            if i in sums:
                sums[i] += x
            else:
                sums[i] = x.astype(np.uint64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.astype(np.uint64).tobytes(), 1) for x in sums.values()], pa.binary())], names=["slice", "counts"])


def rarity_levels(docs: DataFrame) -> np.ndarray:
    """A byte for each counter: 0 for counters near the mean, more for those that some frequent shingle fills."""
    kind = "slice int, counts binary"
    summed = docs.select("text").transform(map_batches, _sketch, kind).repartition(SLICES, "slice").transform(map_batches, _sum_slices, kind)
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for r in summed.collect():  # SLICES rows, of 32 MB at most before compression
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    counts = counts.reshape(-1)
    return np.minimum(counts // np.uint64(4 + 2 * int(counts.mean())), 255).astype(np.uint8)


# --- signatures -----------------------------------------------------------------------------------------------------
def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def least_common(n: int, threshold: int = THRESHOLD) -> int:
    """What two linked sets of n shingles have in common at least."""
    return -(-2 * threshold * n // (100 + threshold))


def index_length(n: int, threshold: int = THRESHOLD) -> int:
    """Of the smaller of two linked sets one of so many shingles, in order, stands in the larger one's prefix."""
    return n - least_common(n, threshold) + 1


def _class_id(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _sign(batches: Batches, levels, threshold: int) -> Batches:
    names = ["doc_id", "text_key", "n", "cls", "grp", "bits", *PARITY, "prefix"]
    for batch in batches:
        n, cls, grp, bits, prefix = [], [], [], [], []
        words = np.zeros((batch.num_rows, len(PARITY)), np.int64)
        for i, t in enumerate(batch.column("text").to_pylist()):
            x = shingles(t)
            n.append(len(x))
            if not len(x):
                cls.append(None)
                grp.append(None)
                bits.append(None)
                prefix.append(None)
                continue
            words[i] = parity_words(x, len(PARITY))
            first = _ordered(x, levels.value)[: prefix_length(len(x), threshold)].view(np.int64)
            cls.append(_class_id(x))
            grp.append(xxhash.xxh3_64_intdigest(first.tobytes()) - (1 << 63))
            bits.append(parity(x))
            prefix.append(first)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int32()), pa.array(cls, pa.binary()), pa.array(grp, pa.int64()), pa.array(bits, pa.binary()), *map(pa.array, np.ascontiguousarray(words.T)), pa.array(prefix, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _ordered(x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x, levels[_places(x)]))]


def _wanted(batches: Batches, marks: np.ndarray) -> Iterator[np.ndarray]:
    """The sets of the texts whose document's bit is set."""
    for batch in batches:
        keep = _has_bits(marks, np.asarray(batch.column("place")).astype(np.int64))
        for t in batch.column("text").filter(pa.array(keep)).to_pylist():
            x = shingles(t)
            if len(x):
                yield x


def _in_groups(rows: Iterator[tuple[bytes, np.ndarray]], name: str) -> Batches:
    """(cls, array) rows as batches of about a million elements."""
    ids: list[bytes] = []
    arrays: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(arrays, pa.list_(pa.int64()))], names=["cls", name])

    for cls, x in rows:
        ids.append(cls)
        arrays.append(x.view(np.int64))
        size += len(x)
        if size > 1_000_000:
            yield out()
            ids, arrays, size = [], [], 0
    if ids:
        yield out()


def _sets(batches: Batches, marks) -> Batches:
    return _in_groups(((_class_id(x), x) for x in _wanted(batches, marks.value)), "elements")


def _next_shingles(batches: Batches, marks, levels, threshold: int) -> Batches:
    """The shingles that follow on the prefix, as many as two linked sets with equal prefixes need to meet again."""

    def rows() -> Iterator[tuple[bytes, np.ndarray]]:
        for x in _wanted(batches, marks.value):
            at = prefix_length(len(x), threshold)
            yield _class_id(x), _ordered(x, levels.value)[at : at + index_length(len(x), threshold)]

    return _in_groups(rows(), "tokens")


def _set_bits(marks: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has_bits(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((marks[at >> 3] >> (at & 7)) & 1).astype(bool)


def _mark_bits(batches: Batches) -> Batches:
    marks = np.zeros(MARK_BITS // 8, np.uint8)
    for batch in batches:
        _set_bits(marks, np.asarray(batch.column("place")).astype(np.int64))
    if marks.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(marks, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "marks"])


def _unite_slices(batches: Batches) -> Batches:
    united: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("slice").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(raw), np.uint8)
            united[i] = united[i] | x if i in united else x
    if united:
        yield pa.RecordBatch.from_arrays([pa.array(list(united), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in united.values()], pa.binary())], names=["slice", "marks"])


def _place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(MARK_BITS))


MARKS_KIND = "slice int, marks binary"


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARK_BITS over the ids in column `rep`, united over all tasks; an id that was given has its bit, whatever their number."""
    places = ids.select(_place(F.col("rep")).alias("place"))
    parts = places.transform(map_batches, _mark_bits, MARKS_KIND).repartition(SLICES, "slice").transform(map_batches, _unite_slices, MARKS_KIND)
    marks = np.zeros((SLICES, MARK_BITS // 8 // SLICES), np.uint8)
    for r in parts.collect():  # SLICES rows, of 8 MB at most before compression
        marks[r["slice"]] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    return marks.reshape(-1)


def _read(docs: DataFrame, ids: DataFrame, work, kind: str) -> DataFrame:
    """What `work` makes of the texts whose ids stand in `ids`; a few other texts may be among them."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(ids))
    return docs.select(_place(F.col("doc_id")).alias("place"), "text").transform(map_batches, lambda b: work(b, marks), kind)


# --- components -----------------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long vertices -> (v, root) for every vertex but the roots; root is the least vertex reachable."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := state(stars)) != before:
        before = now
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).union(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        stars = materialize(large.join(least, "u").select(F.inline(pair)).where("u <> v").distinct())
    return stars.select(F.col("u").alias("v"), F.col("v").alias("root"))


# --- the join -------------------------------------------------------------------------------------------------------
def _least_common(n: str, threshold: int) -> Column:
    return F.expr(f"({2 * threshold}L * {n} + {99 + threshold}) div {100 + threshold}")


def _allowed(a: str, b: str, threshold: int) -> Column:
    """For columns n, pos and PARITY of two sides with suffixes a and b: whether sizes, places of a common shingle, if it is the first, and the
    parity bitmaps, whose difference is at most that of the sets, allow a link."""
    n, m = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
    most = F.least(n - F.col(f"pos{a}"), m - F.col(f"pos{b}"))
    common = F.expr(f"({threshold}L * (n{a} + n{b}) + {99 + threshold}) div {100 + threshold}")
    differ = reduce(add, [F.bit_count(F.col(f"{q}{a}").bitwiseXOR(F.col(f"{q}{b}"))) for q in PARITY])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (most >= common) & (differ <= n + m - common * 2)


ROW = ["token", "n", "g", "pos"]
ROW_KIND = "token long, n int, g long, pos int"
#: The two shingles before a row's own in its prefix.
PAST = ["p1", "p2"]


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)) for c in names]


def _in_company(batches: Batches) -> Batches:
    """Of rows in order of the token those that have a neighbour of the same token; `many` tells those of three or more. The outer rows
    of a task may have neighbours in another task and count as such."""
    kept: list[np.ndarray] | None = None
    sent = 0  # how many of the kept rows were judged already
    begun = False

    def judged(rows: list[np.ndarray], start: int, end: int, last: bool) -> pa.RecordBatch:
        t = rows[0]
        k = len(t)
        one, two = np.zeros(k, bool), np.zeros(k, bool)
        one[1:] = t[1:] == t[:-1]
        two[2:] = t[2:] == t[:-2]
        some, many = one.copy(), two.copy()
        some[:-1] |= one[1:]
        many[:-1] |= two[1:]
        many[:-2] |= two[2:]
        if not begun:
            some[:1] = True
            many[:2] = True
        if last:
            some[-1:] = True
            many[-2:] = True
        at = np.flatnonzero(some[start:end]) + start
        columns = [pa.array(c[at]) for c in rows]
        for i, c in enumerate(columns[len(ROW) :], 1):  # the first places of a prefix have none
            columns[len(ROW) + i - 1] = pc.if_else(pc.greater_equal(columns[3], i), c, None)
        return pa.RecordBatch.from_arrays([*columns, pa.array(many[at])], names=[*ROW, *PAST, "many"])

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = _columns(batch, [*ROW, *PAST])
        rows = fresh if kept is None else [np.concatenate(x) for x in zip(kept, fresh, strict=True)]
        end = max(sent, len(rows[0]) - 2)  # two rows beyond tell what a row belongs to
        if end > sent:
            yield judged(rows, sent, end, False)
        cut = max(0, end - 2)
        begun = begun or cut > 0
        kept, sent = [c[cut:] for c in rows], end - cut
    if kept is not None:
        yield judged(kept, sent, len(kept[0]), True)


def _near(n, pos, m, pos_m, threshold: int) -> np.ndarray:
    """Whether sizes and places of a common shingle, if it is the first, allow a link."""
    n, m, most = n.astype(np.int64), m.astype(np.int64), np.minimum(n - pos, m - pos_m)
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & ((100 + threshold) * most >= threshold * (n + m))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _neighbours(batches: Batches, threshold: int) -> Batches:
    """The pairs of groups next to each other in a list."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch, ROW)
        rows = rows if last is None else [np.concatenate(x) for x in zip(last, rows, strict=True)]
        token, n, g, pos = rows
        near = (token[1:] == token[:-1]) & _near(n[1:], pos[1:], n[:-1], pos[:-1], threshold)
        yield _pairs(g[1:][near], g[:-1][near])
        last = [c[-1:] for c in rows]


def _to_centre(batches: Batches, threshold: int) -> Batches:
    """Of rows in order of (token, degree from high to low) the pairs of each with the first one of its token in the task, the centre."""
    centre: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch, ROW)
        token, n, g, pos = rows
        heads = np.flatnonzero(np.concatenate([[centre is None or centre[0] != token[0]], token[1:] != token[:-1]]))
        run = np.searchsorted(heads, np.arange(len(token)), side="right") - 1
        firsts = [c[heads] for c in rows]
        if centre is not None:  # the first rows may go on with the list before
            firsts = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(centre, firsts, strict=True)]
            run = run + 1
        _, n_c, g_c, pos_c = [c[run] for c in firsts]
        near = (g != g_c) & _near(n, pos, n_c, pos_c, threshold)
        yield _pairs(g[near], g_c[near])
        centre = [c[-1] for c in firsts]


def _promising(batches: Batches, threshold: int) -> Batches:
    """The pairs whose bitmaps leave room for a link: the intersection is at most (n + m - difference) / 2."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
        most = [((n + m - least_difference(x, y)) // 2, n + m) for n, m, x, y in zip(*columns, strict=True)]
        keep = pa.array([100 * k >= threshold * (both - k) for k, both in most], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _promising_pairs(classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    side = lambda c: classes.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").transform(map_batches, lambda b: _promising(b, threshold), "a long, b long"))


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that link, decided on whole sets."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(classes.select("v", "rep", "cls"), "v"))
    sets = _read(docs, needed, _sets, "cls binary, elements array<long>").join(needed, "cls").select("v", "elements")
    sets = materialize(sets.dropDuplicates(["v"]))  # repeated ids give a set twice
    a = sets.select(F.col("v").alias("a"), F.col("elements").alias("x"))
    b = sets.select(F.col("v").alias("b"), F.col("elements").alias("y"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(met.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _prefixes(batches: Batches, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows whose document's bit is set, one for each group of a slice: n, grp, the prefixes end to end and their lengths."""
    for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
        batch = batch.filter(pa.array(_has_bits(marks, np.asarray(batch.column("place")).astype(np.int64))))
        if batch.num_rows:
            n, grp = _columns(batch, ["n", "grp"])
            batch = batch.take(pa.array(np.unique(np.stack([grp, n.astype(np.int64)]), axis=1, return_index=True)[1]))
            prefix = batch.column("prefix")
            yield *_columns(batch, ["n", "grp"]), np.asarray(prefix.flatten()), np.asarray(prefix.value_lengths()).astype(np.int64)


def _token_places(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Prefixes prefer low fingerprints, so the lower bits are the even ones."""
    return tokens & np.int64(bits - 1)


def _short_tokens(batches: Batches, marks, bits: int, width: int) -> Batches:
    """32 bits for each prefix shingle, dealt out by ranges of `width` places: the place in the range, and of the upper half what room is left. Those
    of one shingle go at most twice for about a million."""

    def out() -> pa.RecordBatch:
        t, count = np.unique(np.concatenate(found), return_counts=True)
        t = np.concatenate([t, t[count > 1]])
        place = _token_places(t, bits)
        upper = ((t.view(np.uint64) >> np.uint64(32)) % np.uint64((1 << 32) // width)).astype(np.int64)
        part, short = place // width, (place % width + width * upper).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        part, short = part[order], short[order]
        used, starts = np.unique(part, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([x.tobytes() for x in np.split(short, starts[1:])], pa.binary())], names=["part", "short"])

    found: list[np.ndarray] = []
    held = 0
    for _, _, tokens, _ in _prefixes(batches, marks.value):
        found.append(tokens)
        held += len(tokens)
        if held > 1_000_000:
            yield out()
            found, held = [], 0
    if held:
        yield out()


def _twice(batches: Batches, width: int) -> Batches:
    """Of each range of places the bits of those where the same came twice."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, raw in zip(batch.column("part").to_pylist(), batch.column("short").to_pylist(), strict=True):
            parts.setdefault(i, []).append(np.frombuffer(raw, np.uint32))
    for i, found in parts.items():
        x = np.sort(np.concatenate(found))
        marks = np.zeros(width // 8, np.uint8)
        _set_bits(marks, (x[1:][x[1:] == x[:-1]] % np.uint32(width)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(marks.tobytes(), 1)], pa.binary())], names=["slice", "marks"])


def _several(prefixes: DataFrame, marks, bits: int) -> np.ndarray:
    """A bitmap over shingles with the bits of all that stand in two prefixes or more."""
    parts = spread(prefixes)
    width = -(-bits // (8 * parts)) * 8
    short = prefixes.transform(map_batches, lambda b: _short_tokens(b, marks, bits, width), "part int, short binary")
    pieces = short.repartition(parts, "part").transform(map_batches, lambda b: _twice(b, width), MARKS_KIND)
    several = np.zeros((parts, width // 8), np.uint8)
    for r in pieces.collect():  # SHARED_BITS in all, before compression
        several[r["slice"]] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    return several.reshape(-1)


def _shared(batches: Batches, marks, several, bits: int) -> Batches:
    """A row for each prefix shingle whose bit is set in `several`, with the two before it; 0 where there are none."""
    for n, grp, tokens, lengths in _prefixes(batches, marks.value):
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.flatnonzero(_has_bits(several.value, _token_places(tokens, bits)))
        owner = np.repeat(np.arange(len(n)), lengths)[at]
        pos = at - starts[at]
        past = [np.where(pos >= k, tokens[np.maximum(at - k, 0)], 0) for k in (1, 2)]
        columns = [tokens[at], n[owner], grp[owner], pos.astype(np.int32), *past]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "n", "grp", "pos", *PAST])


def _lists(held: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each prefix shingle of each group g, which is known by its least class, in order of the shingle and, so that neighbours have
    much in common, of the one before it."""
    sc = held.sparkSession.sparkContext
    groups = classes.groupBy("grp", "n").agg(F.min(F.struct("v", "rep")).alias("least")).select("grp", "n", F.col("least.v").alias("g"), F.col("least.rep").alias("rep"))
    marks = sc.broadcast(_marks(groups))
    prefixes = held.select(_place(F.col("doc_id")).alias("place"), "n", "grp", "prefix")
    shingles_ = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(max(1 << (shingles_ // 20).bit_length(), SHARED_BITS[0]), SHARED_BITS[1])
    several = sc.broadcast(_several(prefixes, marks, bits))
    # other rows of a group may have passed by chance or by their id
    rows = prefixes.transform(map_batches, lambda b: _shared(b, marks, several, bits), "token long, n int, grp long, pos int, p1 long, p2 long").distinct()
    rows = rows.join(groups, ["grp", "n"]).select(*ROW, *PAST)
    order = ["token", "p1", "n", "g"]
    in_order = rows.repartitionByRange(spread(held), *order).sortWithinPartitions(*order)
    return materialize(in_order.transform(map_batches, _in_company, f"{ROW_KIND}, p1 long, p2 long, many boolean"))


def _first_pairs(lists: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    kind = "a long, b long"
    chain = lists.select(*ROW).transform(map_batches, lambda b: _neighbours(b, threshold), kind)
    # a list's centre is the group that stands in most lists: the original of a group of near copies shares the most with each
    long_ = lists.where("many").select(*ROW)
    ranked = long_.join(long_.groupBy("g").agg(F.count("*").alias("degree")), "g")
    ranked = ranked.repartitionByRange(spread(lists), "token", F.desc("degree"), "g").sortWithinPartitions("token", F.desc("degree"), "g")
    star = ranked.select(*ROW).transform(map_batches, lambda b: _to_centre(b, threshold), kind)
    in_group = Window.partitionBy("grp", "n").orderBy("v")
    inner = classes.select("v", F.lag("v").over(in_group).alias("b")).where("b is not null").select(F.col("b").alias("a"), F.col("v").alias("b"))
    return chain.union(star).union(inner).distinct()


def _outer_pairs(lists: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs of classes of different groups and components that a common shingle brings together."""
    spans = members.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = lists.select("token", "g").join(spans, "g").groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
    left = materialize(lists.select(*ROW, *PAST).join(mixed, "token").join(members.drop("n"), "g"))
    side = lambda rows, c: rows.select("token", *[F.col(x).alias(f"{x}_{c}") for x in ("n", "g", "pos", "v", "root", *PARITY, *PAST)])
    met_before = reduce(or_, [F.coalesce(F.col(f"{a}_a") == F.col(f"{b}_b"), F.lit(False)) for a in PAST for b in PAST])
    x, y = side(left.where(F.col("pos") <= F.col("n") - _least_common("n", threshold)), "a"), side(left, "b")
    in_order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("g_a") < F.col("g_b")))
    # a pair that an earlier shingle brings together need not meet here again
    return x.join(y, "token").where(in_order & ~met_before & (F.col("root_a") != F.col("root_b")) & _allowed("_a", "_b", threshold)).select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))


def _inside_pairs(docs: DataFrame, classes: DataFrame, members: DataFrame, levels, threshold: int) -> DataFrame | None:
    """Pairs of classes of one group in different components. Two different sets of n shingles share n - 1 at most."""
    several = members.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    open_ = members.where((F.col("n").cast("long") - 1) * 100 >= (F.col("n").cast("long") + 1) * threshold).join(several, "g").join(classes.select("v", "cls", "rep"), "v")
    open_ = materialize(open_)
    if not open_.limit(1).count():
        return None
    tokens = _read(docs, open_, lambda b, marks: _next_shingles(b, marks, levels, threshold), "cls binary, tokens array<long>").dropDuplicates(["cls"])
    # places count from the end of the prefix, all of which is common; a token's place so tells what is left, prefix and all
    rows = materialize(open_.join(tokens, "cls").select("g", "n", "v", "root", *PARITY, F.posexplode("tokens").alias("pos", "token")))
    side = lambda c: rows.select("g", "token", *[F.col(x).alias(f"{x}_{c}") for x in ("n", "v", "root", "pos", *PARITY)])
    met = side("a").join(side("b"), ["g", "token"]).where((F.col("v_a") < F.col("v_b")) & (F.col("root_a") != F.col("root_b")) & _allowed("_a", "_b", threshold))
    return met.select(F.col("v_a").alias("a"), F.col("v_b").alias("b"))


def link_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id for each row."""
    sc = docs.sparkSession.sparkContext
    read = docs.select("doc_id", text_key().alias("text_key"), "text")
    levels = sc.broadcast(rarity_levels(docs))
    words = ", ".join(f"{q} long" for q in PARITY)
    signed = read.transform(map_batches, lambda b: _sign(b, levels, threshold), f"doc_id long, text_key long, n int, cls binary, grp long, bits binary, {words}, prefix array<long>")
    signed = materialize(signed)
    held = signed.where("n > 0")
    classes = _numbered(held.groupBy("cls", "grp", "n", "bits", *PARITY).agg(F.min("doc_id").alias("rep")))
    lists = _lists(held, classes)
    signed = materialize(signed.select("doc_id", "text_key", "n", "cls"))
    del held  # the prefixes are most of the checkpoint before

    first = _promising_pairs(classes, _first_pairs(lists, classes, threshold), threshold)
    tidy(docs.sparkSession)  # what made the lists, and the prefixes; Python lets go of JVM objects with some delay
    links = _verify(docs, classes, first, threshold)
    tidy(docs.sparkSession)  # its sets
    roots = components(links)

    # what the neighbours left open
    named = classes.groupBy("grp", "n").agg(F.min("v").alias("g"))
    members = materialize(classes.select("grp", "n", "v", *PARITY).join(named, ["grp", "n"]).join(roots, "v", "left").select("g", "n", "v", F.coalesce("root", "v").alias("root"), *PARITY))
    pairs = _outer_pairs(lists, members, threshold)
    inside = _inside_pairs(docs, classes, members, levels, threshold)
    pairs = pairs if inside is None else pairs.union(inside)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = _promising_pairs(classes, pairs, threshold)
    del lists, first, members, inside, pairs  # their checkpoints may go
    if second.limit(1).count():
        more = _verify(docs, classes, second, threshold)
        if more.limit(1).count():
            roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(more))

    rooted = classes.join(roots, "v", "left").select("cls", F.coalesce("root", "v").alias("root"))
    named = rooted.join(classes.select(F.col("v").alias("root"), F.col("rep").alias("component_id")), "root").select("cls", "component_id")
    out = signed.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Gives each class a long v that grows with its least id, nulls last, so that the least class of a component has its least id."""
    in_order = classes.repartitionByRange(spread(classes), F.asc_nulls_last("rep"), "cls").sortWithinPartitions(F.asc_nulls_last("rep"), "cls")
    return materialize(in_order.select("*", F.monotonically_increasing_id().alias("v")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Of each component the documents with the least id stay, and of repeated rows one; with their own columns."""
    found = materialize(link_components(docs))
    key = [F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")]
    leaves = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    stay = without(docs, materialize(leaves))
    repeated = materialize(found.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").select(*key))
    if not repeated.limit(1).count():
        return stay
    return without(stay, repeated).unionByName(among(stay, repeated).dropDuplicates(["doc_id", "text"]))
