"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import math
import re
import string
import zlib

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def hits(words_, items, size=8):
    found, at = set(), set()
    for item, w in items:
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words_) - n + 1):
                if words_[j : j + n] == w[i : i + n]:
                    found.add(str(item))
                    at |= set(range(j, j + n))
    return found, at


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def shingle_set(t):
    w = words((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs, threshold=80):
    """docs: list of (id, text) -> least id reachable, by place."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(docs))], [len(s) for s in sets]


def repeated_words(w, size=8):
    seen = collections.defaultdict(list)
    for i in range(len(w) - size + 1):
        seen[tuple(w[i : i + size])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(size)})


def base_scores(docs):
    train = collections.Counter()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    toks = [[*words((t or "").translate(LOW)), None] for _, t in docs]
    for (d, _), t in zip(docs, toks):
        if not fold(d):
            train.update(t)
    n, v = sum(train.values()), len(train)
    return [(d, fold(d), len(t), sum(train[x] > 0 for x in t), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)) for (d, _), t in zip(docs, toks)]
