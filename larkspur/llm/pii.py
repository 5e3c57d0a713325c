"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, `://` and identifier cues.
Each anchor starts a deterministic local parser that expands to the boundaries of the datum and checks it:

* at-sign: left over local-part characters, right over at least two labels (email);
* digit that starts a chain: runs joined by dots, taken four at a time, each at most 255 (ip); digits joined by single
  spaces or hyphens, 12 to 19 of them, with a right Luhn sum (card);
* plus sign: digit, phone characters, up to the last digit of the run, 9 to 15 digits (phone);
* `://`: scheme to the left, address to the right; kept if the authority names a user or the path a profile (url);
* cue such as `iban` or `account`: a number mark, `:`, `=` or `#`, then an identifier of 6 characters or more with a digit
  among them; after `iban` the check digits must be right (account).

Per kind, spans don't overlap and the leftmost wins; a match that fails its check is dropped and consumed. The first four kinds equal
the plain patterns of PATTERNS exactly. Offsets count code points, ends are exclusive. Each character is
visited by a bounded number of parsers, so a text costs time in proportion to its length.

Edge cases: a null text counts as empty and has no spans. Repeated rows are judged alike and all stay. An empty table gives an
empty one. Columns named like an output column are replaced; others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.common import map_batches

KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = KINDS[:4]
#: The base kinds as plain patterns, before their checks. Tests hold the parsers against them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CUES = ["iban", "account", "acct", "ssn", "passport", "customer", "member", "patient", "license", "login", "userid", "user_id", "token", "api_key", "apikey", "password"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"[\x20().0-9-]+")
_ADDRESS = re.compile(r"[^\s<>\"'`]+")
_PERSONAL = re.compile(r"[^/?#@]+@|[^/?#]+/(?:~|(?:u|user|users|profile|profiles|people|in)/)[A-Za-z0-9]")
_AFTER_CUE = re.compile(r"(?:[ _-]?(?:no|nr|number|id|key)\b)?\.?[\x20\t]{0,3}[:=#][\x20\t]{0,3}[\"']?(?P<id>[A-Za-z0-9](?:[\x20._/+-]?[A-Za-z0-9]){5,})")
Span = tuple[int, int, str]


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in "@+0123456789":
        found.add_word(x, (x if x in "@+" else "0", 1))
    found.add_word("://", (":", 3))
    for cue in CUES:
        for x in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(x, ("cue", len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = [int(x) for x in digits[-1::-2]]
    even = [2 * int(x) for x in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def _iban(text: str) -> bool:
    bare = re.sub(r"[^A-Za-z0-9]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def find_spans(text: str) -> list[Span]:
    """(start, end, kind) in the order of start, then of KINDS."""
    out: list[Span] = []
    email = dotted = chain = phone = url = account = 0  # where the last match or failed chain of each kind ended
    for last, (what, size) in _anchors().iter(text):
        at = last - size + 1
        if what == "0":
            if at >= dotted:
                runs = list(re.finditer("[0-9]+", text[at : (dotted := _DOTTED.match(text, at).end())]))
                for i in range(0, len(runs) - 3, 4):
                    if all(len(r[0].lstrip("0")) <= 3 and int(r[0].lstrip("0") or "0") <= 255 for r in runs[i : i + 4]):
                        out.append((at + runs[i].start(), at + runs[i + 3].end(), "ip"))
            if at >= chain:
                chain = _CHAIN.match(text, at).end()
                digits = text[at:chain].replace(" ", "").replace("-", "") if chain - at < 40 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, chain, "card"))
        elif what == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, email, "email"))
        elif what == "+":
            if at >= phone and text[at + 1 : at + 2] in _ALNUM and text[at + 1].isdigit() and (m := _PHONE.match(text, at + 2)):
                end = len(text[: m.end()].rstrip(" ().-")) if m.end() - at < 200 else _last_digit(text, at + 2, m.end()) + 1
                if end >= at + 4:
                    phone = end
                    if 9 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                        out.append((at, end, "phone"))
        elif what == ":":
            start = at
            while start > url and at - start < 20 and (text[start - 1] in _ALNUM or text[start - 1] in "+.-"):
                start -= 1
            if start < at and (m := _ADDRESS.match(text, at + 3)):
                url = at + 3 + len(m[0].rstrip(".,;:!?)]}"))
                if _PERSONAL.match(text, at + 3, url):
                    out.append((start, url, "url"))
        elif at >= account and (at == 0 or text[at - 1] not in _ALNUM) and (m := _AFTER_CUE.match(text, last + 1)):
            start, end = m.span("id")
            if text[at : last + 1].lower() == "iban":
                ends = [i for i in range(min(end, start + 48), start, -1) if (i == end or text[i] not in _ALNUM) and _iban(text[start:i])]
                if not ends:
                    continue
                end = ends[0]
            else:
                end = start + len(re.match(r"[A-Za-z0-9](?:[._/+-]?[A-Za-z0-9])*", text[start:end])[0])
            if end - start >= 6 and any(c in "0123456789" for c in text[start:end]):
                out.append((start, end, "account"))
                account = end
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _last_digit(text: str, low: int, high: int) -> int:
    at = high - 1
    while at >= low and text[at] not in "0123456789":
        at -= 1
    return at


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in angle brackets; of overlapping spans the first names their union."""
    out: list[str] = []
    done = 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _batches(batches: Iterator[pa.RecordBatch], keep: list[str], redacted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [find_spans(t) if t else [] for t in texts]
        cols = {c: batch.column(c) for c in keep}
        if redacted:
            new = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                old = batch.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)], batch.column("n_chars").type)
        else:
            base = [[x for x in s if x[2] in BASE] for s in found]
            for kind in BASE:
                cols[f"n_{kind}"] = pa.array([sum(x[2] == kind for x in s) for s in base], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base])
            cols["spans"] = pa.array([written(s) for s in found], pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


OUT = [*[f"n_{k}" for k in BASE], "base_sha256", "spans"]


def find_pii(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the counts of the base kinds, base_sha256 and spans."""
    keep = [c for c in keep if c not in OUT]
    fields = [docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in OUT[4:]]
    read = docs.select(*dict.fromkeys([*keep, "text"]))
    return read.transform(map_batches, lambda batches: _batches(batches, keep, False), T.StructType(fields))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with all personal data in `text` replaced, and n_chars, if there, counted anew for changed texts."""
    keep = docs.columns
    return docs.transform(map_batches, lambda batches: _batches(batches, keep, True), docs.schema)
