"""Edit-aware token counts.

A document keeps the places where its pre-tokens end and a segment tree over their token counts. An edit replaces
text[start:end] by other text. Pre-tokens are found from left to right by a pattern without look-behind that reads at most LOOK_AHEAD
characters beyond a pre-token, so those that end LOOK_AHEAD before the edit stay as they are; from there the
pattern runs on the new text until one of its pre-tokens ends where, past the edit, an old one ended. From
that place on all old pre-tokens hold again. Only the pre-tokens between are encoded; the tree replaces their leaves and the sums of the subtrees
above them.

The count always equals that of the whole edited text encoded anew. The tokenizer is a byte-level BPE given as ranks;
each distinct pre-token is counted once in a worker's bounded memory.

Edge cases: a null text counts as empty; edits beyond the end are cut to the text. Repeated rows are counted alike and all stay. An empty
table gives an empty one. Columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the usual pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOK_AHEAD = 3
MEMORY = 200_000
#: Pre-tokens of one leaf of the tree.
LEAF = 64
Edit = tuple[int, int, str]


class Counter:
    """Counts the tokens of pre-tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) < 100:
                self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        return [known[p] if p in known else self.count(p) for p in pieces]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


class Sums:
    """A segment tree over the leaves of a document: blocks of pre-tokens with (tokens, characters, pre-tokens), and their
    sums by subtree. Replacing a range of blocks rebuilds only the paths above it."""

    def __init__(self, blocks: list[list[tuple[int, int]]]):
        self.blocks = blocks
        self._build()

    def _build(self) -> None:
        self.size = 1
        while self.size < len(self.blocks):
            self.size *= 2
        self.tokens = [0] * (2 * self.size)
        self.chars = [0] * (2 * self.size)
        for i, b in enumerate(self.blocks):
            self._leaf(i, b)
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _leaf(self, i: int, block: list[tuple[int, int]]) -> None:
        self.tokens[self.size + i] = sum(n for _, n in block)
        self.chars[self.size + i] = sum(c for c, _ in block)

    def _pull(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at`, and where it starts; the last block for the end of the text."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and i + 1 - (1 << (i.bit_length() - 1)) < self._width(i):
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _width(self, i: int) -> int:
        """How many nodes of i's level have blocks below them."""
        span = self.size >> (i.bit_length() - 1)
        return -(-max(1, len(self.blocks)) // span)

    def replace(self, first: int, last: int, pieces: list[tuple[int, int]]) -> None:
        """Blocks first..last give way to the pieces, spread over as many blocks; a block that would grow beyond
        four times its size splits, and only then the tree is built anew."""
        n = last - first + 1
        if len(pieces) > 4 * LEAF * n:
            self.blocks[first : last + 1] = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            self._build()
            return
        each = -(-len(pieces) // n) if pieces else 0
        for k in range(n):
            self.blocks[first + k] = pieces[k * each : (k + 1) * each]
            self._leaf(first + k, self.blocks[first + k])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self._pull(i)
            low, high = low // 2, high // 2


class Document:
    """A text with its counts. `encoded` adds up the pre-tokens that edits had to encode."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.cut.findall(text)
        leaves = list(zip(map(len, pieces), counter.counts(pieces), strict=True))
        self.n_pieces = len(leaves)
        self.sums = Sums([leaves[i : i + LEAF] for i in range(0, len(leaves), LEAF)] or [[]])

    def tokens(self) -> int:
        return self.sums.total()

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first, at = self.sums.find(max(0, start - LOOK_AHEAD))
        kept: list[tuple[int, int]] = []  # of the first block, what ends early enough
        old_at = at
        block = self.sums.blocks[first]
        k = 0
        while k < len(block) and old_at + block[k][0] + LOOK_AHEAD <= start:
            kept.append(block[k])
            old_at += block[k][0]
            k += 1
        at = old_at
        last = first
        fresh: list[tuple[int, int]] = []
        # old ends are visited in step with the new ones
        for m in self.counter.cut.finditer(text, at):
            while old_at < m.start() - shift or old_at < end:
                while k >= len(self.sums.blocks[last]) and last + 1 < len(self.sums.blocks):
                    last, k, block = last + 1, 0, self.sums.blocks[last + 1]
                if k >= len(self.sums.blocks[last]):
                    break
                old_at += block[k][0]
                k += 1
            if old_at >= end and old_at + shift == m.start() and m.start() >= start + len(new):
                break
            fresh.append((m.end() - m.start(), self.counter.count(m[0])))
        else:
            last, k = len(self.sums.blocks) - 1, len(self.sums.blocks[-1])
        rest = self.sums.blocks[last][k:]
        self.encoded += len(fresh)
        dropped = sum(len(self.sums.blocks[i]) for i in range(first, last + 1))
        self.n_pieces += len(kept) + len(fresh) + len(rest) - dropped
        self.sums.replace(first, last, kept + fresh + rest)
        self.text = text


def apply_edits(text: str, edits: list[Edit], counter: Counter) -> Document:
    """Edits are applied one after another, each in the coordinates of the text before it."""
    doc = Document(text, counter)
    for start, end, new in edits:
        doc.edit(start, end, new)
    return doc


def revision(text: str) -> list[Edit]:
    """The query's edits of a text, by places alone: a note after a third, 40 characters fewer from the middle on, a closing line."""
    n = len(text)
    first, second = (n // 3, n // 3, " [revised]"), (n // 2, n // 2 + 40, "")
    grown = n + 10
    left = grown - (min(grown, n // 2 + 40) - n // 2)
    return [first, second, (left, left, "\nEnd of document.")]


OUT = ["n_tokens", "n_tokens_edited", "n_pieces", "n_pieces_edited", "n_pieces_encoded"]


def _batches(batches: Iterator[pa.RecordBatch], keep: list[str], path: str, edits: Callable[[str], list[Edit]]) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for batch in batches:
        rows = []
        for t in batch.column("text").to_pylist():
            doc = Document(t or "", c)
            before = (doc.tokens(), doc.n_pieces)
            for start, end, new in edits(t or ""):
                doc.edit(start, end, new)
            rows.append((before[0], doc.tokens(), before[1], doc.n_pieces, doc.encoded))
        cols = {k: batch.column(k) for k in keep} | {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(OUT)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def count_revisions(docs: DataFrame, keep: list[str], path: str, edits: Callable[[str], list[Edit]] = revision) -> DataFrame:
    """The columns `keep` of docs with token counts before and after the edits that `edits` gives for a text, the pre-tokens before and after,
    and how many of them the edits had to encode."""
    keep = [c for c in keep if c not in OUT]
    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in OUT]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda b: _batches(b, keep, path, edits), T.StructType(fields))
