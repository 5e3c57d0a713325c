"""BPE encoding and decoding by tree concatenation.

A text is cut at its ASCII white space, across which this vocabulary never merges; each distinct word is encoded once in a
worker's bounded memory of words. A word without white space that is longer than LEAF characters, "long unsplit text", is
encoded as a tree: each of its pieces (after the tokenizer's own normalizer and pre-tokenizer) is halved until the parts are leaves of at most LEAF
characters. The halves of the upper LEVELS levels are encoded in parallel, by threads of the worker (the library encodes a batch of leaves without
Python's lock), and neighbours are concatenated. At a join, the last k tokens of the left and the first k of the right are encoded anew as one
window; if the window begins with the left side's token and ends with the right side's, both sides agree and the
join is exact, else k doubles. (A sequence of BPE tokens is the encoding of its text if and only if every two neighbours are the encoding of
theirs; the window keeps its outer tokens, so all neighbours are.) The last leaf carries the end-of-word mark.

The results equal the library's encode and decode of the whole text without template tokens, truncation or padding. Strings of special tokens
in a text become these tokens, as there.

Edge cases: a null text counts as empty: no tokens, an empty decoded text. Repeated rows are encoded alike and all stay. An empty table gives an
empty one. Columns named like an output column are replaced. A very long text is one row to one worker; beyond its own size it takes memory for its
distinct words, and for a long word for its pieces.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.common import map_batches

LEAF = 512
FIRST_WINDOW = 4
#: Levels of a tree whose halves are encoded in parallel, by 2**LEVELS threads.
LEVELS = 2
#: Words that a worker keeps beyond those of the group of texts at hand.
MEMORY = 100_000
OUT = ["n_tokens", "ids_sha256", "decoded_sha256"]


_PLAIN = re.compile(rb"[!-&(-;=?-~]+")
_PLAIN_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: The steps before the merges for which _plain is exact.
_PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(self.spec))
        self.library.no_truncation()
        self.library.no_padding()
        model = self.spec["model"]
        self.vocab, self.suffix, self.leaf = model["vocab"], model.get("end_of_word_suffix") or "", leaf
        self.last = self.library.model
        del self.spec["model"]
        self.special = [t["content"] for t in self.spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.path = path
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        steps = [x["type"] for x in (self.spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (self.spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == _PLAIN_NORMALIZERS and cuts[0].get("pattern") == {"Regex": _PLAIN_SPLIT} and all("<" in s for s in self.special)
        self.pieces: dict[str, list[int]] = {}
        self.known: dict[bytes, tuple[str, str, int]] = {}

    # --- tree concatenation -------------------------------------------------------------------------------------
    @cached_property
    def alone(self) -> dict:
        """The two models on their own: without a normalizer and a pre-tokenizer a text is one piece. Built for the first long word, as most
        workers never meet one and the merges of the inner model take memory."""
        from tokenizers import Tokenizer, models

        with open(self.path, encoding="utf-8") as f:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        return {True: Tokenizer(self.last), False: Tokenizer(models.BPE(vocab=self.vocab, merges=merges))}

    def _tokens(self, text: str, end: bool) -> list[str]:
        return self.alone[end].encode(text, add_special_tokens=False).tokens if text else []

    def _join(self, left: list[str], right: list[str], end: bool) -> list[str]:
        k = FIRST_WINDOW
        while left and right:
            a, b = left[-k:], right[:k]
            whole = end and len(b) == len(right)
            text = "".join(a + b)
            window = self._tokens(text[: len(text) - len(self.suffix)] if whole and self.suffix else text, whole)
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2
        return left or right

    def _halves(self, text: str) -> list[str]:
        """The leaves: halves of halves, and so on."""
        if len(text) <= self.leaf:
            return [text]
        mid = len(text) // 2
        return self._halves(text[:mid]) + self._halves(text[mid:])

    def _united(self, parts: list[list[str]], end: bool) -> list[str]:
        if len(parts) == 1:
            return parts[0]
        mid = len(parts) // 2
        return self._join(self._united(parts[:mid], False), self._united(parts[mid:], end), end)

    def _tree(self, text: str, end: bool, level: int, pool: ThreadPoolExecutor) -> list[str]:
        if level < LEVELS and len(text) > self.leaf:  # one half by another thread, the other by this one
            mid = len(text) // 2
            other = pool.submit(self._tree, text[:mid], False, level + 1, pool)
            right = self._tree(text[mid:], end, level + 1, pool)
            return self._join(other.result(), right, end)
        leaves = self._halves(text)
        inner = leaves[:-1] if end else leaves  # one call, during which other threads run
        parts = [e.tokens for e in self.alone[False].encode_batch(inner, add_special_tokens=False)]
        return self._united(parts + [self._tokens(leaves[-1], True)] if end else parts, end)

    def piece(self, text: str) -> list[str]:
        """Tokens of one pre-token, which stands at the end of a word of this vocabulary."""
        if len(text) <= self.leaf:
            return self._tokens(text, True)
        assert self.alone  # built before threads ask for it
        with ThreadPoolExecutor(2**LEVELS) as pool:  # no more halves than that ever wait for others
            return self._tree(text, True, 0, pool)

    def _unsplit(self, text: str) -> list[int]:
        text = self.library.normalizer.normalize_str(text) if text and self.library.normalizer else text
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text) if text else []
        known: dict[str, list[int]] = {}
        ids: list[int] = []
        for p, _ in pieces:
            if p not in known:
                known[p] = [self.vocab[t] for t in self.piece(p)]
            ids += known[p]
        return ids

    def long_word(self, word: str) -> list[int]:
        """A long run without white space; the strings of special tokens come first, from left to right, then the usual steps on what is between."""
        ids: list[int] = []
        at = 0
        for m in self.specials.finditer(word):
            ids += self._unsplit(word[at : m.start()])
            ids.append(self.library.token_to_id(m[0]))
            at = m.end()
        return ids + self._unsplit(word[at:])

    # --- whole texts --------------------------------------------------------------------------------------------
    def _plain(self, word: str) -> list[int]:
        """A short word of printable ASCII without apostrophes or angle brackets: here the normalizer only
        lower-cases and the pre-tokenizer cuts runs of letters, single digits and runs of the rest."""
        ids: list[int] = []
        for p in _PLAIN_PIECES.findall(word.lower()):
            known = self.pieces.get(p)
            if known is None:
                if len(self.pieces) >= MEMORY:
                    self.pieces.clear()
                known = self.pieces[p] = [self.vocab[t.value] for t in self.last.tokenize(p)]
            ids += known
        return ids

    def _learn(self, words: set[bytes]) -> None:
        plain = [w for w in words if len(w) <= self.leaf and self.plain and _PLAIN.fullmatch(w)]
        rest = words.difference(plain)
        short = [w for w in rest if len(w) <= self.leaf]
        long = [w for w in rest if len(w) > self.leaf]
        ids = [self._plain(w.decode()) for w in plain]
        ids += [e.ids for e in self.library.encode_batch([w.decode() for w in short], add_special_tokens=False)]
        ids += [self.long_word(w.decode()) for w in long]
        for w, x in zip(plain + short + long, ids, strict=True):
            self.known[w] = (" ".join(map(str, x)), " ".join([self.names[i] for i in x]), len(x))

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, str, int]]]:
        """For each text what its words have: ids, decoded tokens and their number. A batch's words stay until it is done."""
        split = [t.encode().split() if t else [] for t in texts]
        here: set[bytes] = set().union(*split)
        gc.disable()  # a batch makes many small objects, none in a cycle
        try:
            if len(self.known) > MEMORY:
                self.known = {w: self.known[w] for w in here if w in self.known}
            self._learn(here.difference(self.known))
        finally:
            gc.enable()
        known = self.known
        return [[known[w] for w in ws] for ws in split]


def encode(codec: Codec, text: str) -> list[int]:
    return [int(i) for ids, _, n in codec.batch([text])[0] if n for i in ids.split(" ")]


def decode(codec: Codec, ids: list[int]) -> str:
    """This vocabulary names no decoder, so tokens are joined by spaces."""
    if codec.spec.get("decoder") is not None:
        return codec.library.decode(ids, skip_special_tokens=False)
    return " ".join(codec.names[i] for i in ids)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


#: Texts are handed to the codec in groups of about so many characters.
GROUP = 1_000_000


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group: list[str | None] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encoded(c: Codec, group: list[str | None], full: bool) -> dict[str, pa.Array]:
    n, ids, decoded, tokens = [], [], [], []
    for words in c.batch(group):
        held = [w for w in words if w[2]]
        joined = " ".join([w[0] for w in held])
        n.append(sum([w[2] for w in held]))
        ids.append(hashlib.sha256(joined.encode()).hexdigest())
        decoded.append(hashlib.sha256(" ".join([w[1] for w in held]).encode()).hexdigest())
        if full:
            tokens.append(np.fromstring(joined, np.int32, sep=" "))
    cols = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
    if full:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
        cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))
    return cols


def _batches(batches: Iterator[pa.RecordBatch], keep: list[str], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        at = 0
        for group in groups(batch.column("text").to_pylist()):
            rows = batch.slice(at, len(group))
            cols = {k: rows.column(k) for k in keep} | _encoded(c, group, full)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
            at += len(group)
    # workers live on for other operators' tasks; the words would stay in their memory
    c.known, c.pieces = {}, {}


def encode_documents(docs: DataFrame, keep: list[str], path: str, full: bool = False) -> DataFrame:
    """The columns `keep` of docs with OUT, and with `ids` if full. path: the tokenizer's file, at the same place on all machines."""
    keep = [c for c in keep if c not in [*OUT, "ids"]]
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in OUT[1:]]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * full
    return docs.select(*dict.fromkeys([*keep, "text"])).transform(map_batches, lambda b: _batches(b, keep, path, full), T.StructType(fields))
