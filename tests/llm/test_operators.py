import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, decontaminate, jaccard, lm, pii, quality, queries, sharding, shingles, tokencount, urls
from larkspur.llm.queries import HOST_RULES, PATTERN_RULES, vocabulary
from tests.llm import brute

random.seed(7)
VOCABULARY = "the of and in was thouer nder ither ea tion ing sh bleed ann".split()


def prose(n):
    return " ".join(random.choice(VOCABULARY) + random.choice(["", "", "er", "ing", "."]) for _ in range(n))


LONG = prose(400)
NEAR = " ".join(w if i != 200 else "changed" for i, w in enumerate(LONG.split()))
TEXTS = [
    LONG, LONG, NEAR, None, "", "   \n\t ", "one two", "one two", "ONE two", "x" * 5000 + "é" * 3000, prose(120), "a b c d e f g h " * 30,
    "Mail bob.x+1@mail.example.com or 10.0.0.256 or 10.20.30.40.50.60.70.80, card 4111-1111 1111 1111, call +1 (555) 010-9999.",
    "line one is here\nline one is here\n\nother line\nline one is here ", "Ünï " * 50, "\x0b\x1c word\xa0  ",
    "thouer ither NDER ea tion-ing sh/bleed of ann and more", "#### $$ && " * 40,
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (0, LONG), (None, "one two"), (None, None)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, kept string, verdict string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, ["en", "xx", None][i % 3], "s", len(t or ""), "r", "w", "k", "v") for i, (d, t) in enumerate(DOCS)], KINDS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_urls(spark):
    urls_ = ["http://A.Example.ORG/es/1", "https://x.example.org/en/148", "https://example.org", "ftp://com/de/", "http://b.com/fr/x?y#z", None, "none", "http://notorg/", "http://spam-farm.net/a", "https://q.net/casino/x", "http://org", "://", "http://www.cheap-pills.com/fr/"] * 2
    pages = spark.createDataFrame([(i, u, "t", "h") for i, u in enumerate(urls_)], "page_id long, url string, token string, host string")
    short, joined = urls.judge_urls(pages, HOST_RULES + PATTERN_RULES), urls.judge_urls(pages, HOST_RULES + PATTERN_RULES, inline_rules=0)
    cols = ["page_id", "token", "host", "path", "rule", "verdict", "pattern"]
    found = rows(short, *cols)
    assert found == rows(joined, *cols) and len(found) == len(urls_)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in short.collect()}
    assert by[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and by[1][2] == "example.org/en/1" and by[2] == ("example.org", "", None, "allow")
    assert by[3][2:] == ("com/de/", "block") and by[4] == ("b.com", "/fr/x", "com/fr/", "allow") and by[5] == by[6] == ("", "", None, "allow")
    assert by[7][2] is None and by[8][3] == "block" and by[9][3] == "block" and by[12][3] == "allow"
    assert urls.judge_urls(pages.where("false"), HOST_RULES).count() == 0 and {r["verdict"] for r in urls.judge_urls(pages, []).collect()} == {"allow"}
    assert {c.token for c in urls.compile_rules(HOST_RULES)} == {"org", "es", "en", "fr", "de"}


def plain_pii(t):
    out = []
    for kind, p in pii.PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii(docs, none):
    want = sorted(((d, brute.sha(pii.written(plain_pii(t)))) for d, t in DOCS), key=repr)
    assert rows(pii.find_pii(docs, ["doc_id", "kept"]), "doc_id", "base_sha256") == want
    for _ in range(5000):
        t = "".join(random.choice(["1", "25", "256", ".", ".", "+", "@", "-", " ", "a", "b.c", "(", "4111111111111111", "iban: "]) for _ in range(20))
        assert [s for s in pii.find_spans(t) if s[2] in pii.BASE] == plain_pii(t)
    assert pii.redact("a bob@x.org b", pii.find_spans("a bob@x.org b")) == "a <EMAIL> b"
    assert [s[2] for s in pii.find_spans("IBAN: GB82 WEST 1234 5698 7654 32, see http://u:p@h.org/x, account no: AB-12345")] == ["account", "url", "email", "account"]
    assert pii.find_spans("IBAN: GB83 WEST 1234 5698 7654 32") == [] and pii.find_pii(none, ["doc_id"]).count() == 0
    redacted = pii.redact_pii(docs)
    assert redacted.columns == docs.columns and redacted.where("text like '%@%'").count() == 0 and redacted.where("text is null").count() == 2


def test_lm(docs, none):
    found = lm.score_documents(docs, vocabulary("piece_bpe_32k.model"))
    got = rows(found.select("*", F.round("base_score", 6).alias("b")), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b")
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in brute.base_scores(DOCS)), key=repr)
    assert found.where("score >= 0 or score is null").count() == 0 and lm.score_documents(none, vocabulary("piece_bpe_32k.model")).count() == 0
    model = lm.Model({p: -i / 3 - 1 for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "aba"])}, [-6.0] * 256, 0.0)

    def total(t):
        import math

        return sum(math.exp(w) * total(t[len(p) :]) for p, w in model.pieces.items() if t.startswith(p)) + math.exp(-6 * len(t[0].encode())) * total(t[1:]) if t else 1.0

    import math

    for w in ["", "a", "abab", "zéb", "bababa"]:
        assert abs(lm.Lattice(model).word(w) - math.log(total("▁" + w))) < 1e-9


def test_lm_scores(docs):
    """Whole documents against a plain recursion over all cuts of each word, with weights from the same counts."""
    import math
    from functools import cache

    path = vocabulary("piece_bpe_32k.model")
    counts = collections.Counter()
    train = [(d, t) for d, t in DOCS if not lm.held_out(d)]
    for _, t in train:
        for w in lm.tokens(t):
            counts.update(lm.lexicon(path).encode(w.decode()))
    model = lm.fit(counts, len(train), path)
    longest = max(map(len, model.pieces))

    def word(w):
        ways = [1.0] + [0.0] * len(w)
        for i in range(len(w)):
            for p in range(1, min(longest, len(w) - i) + 1):
                ways[i + p] += ways[i] * math.exp(model.pieces.get(w[i : i + p], -math.inf))
            ways[i + 1] += ways[i] * math.exp(sum(model.bytes_[b] for b in w[i].encode()))
        return math.log(ways[-1])

    word = cache(word)
    short = {d: sum(word("▁" + w.decode()) for w in lm.tokens(t)) + model.end for d, t in DOCS if d is not None and all(len(w) < 60 for w in lm.tokens(t))}
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, path).collect() if r["doc_id"] in short}
    assert len(got) > 10 and all(abs(got[d] - x / math.log(10)) < 1e-6 * max(1, abs(x)) for d, x in short.items())


def test_very_long_text(spark):
    """One text of some MB among short ones, in each operator that works on texts."""
    rnd = random.Random(5)
    long_ = " ".join(rnd.choice(VOCABULARY) + str(rnd.randrange(5000)) for _ in range(200_000)) + " mail bob@x.org"
    some = [(1, long_), (2, "short one here"), (3, long_ + " end")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in some], "doc_id long, text string, lang string").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(long_.split()[150_000:150_020]))], "item_id long, text string")
    assert rows(jaccard.link_components(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]
    assert rows(decontaminate.find_contamination(docs, bench), "doc_id", "n_hit", "n_items") == [(1, 20, 1), (2, 0, 0), (3, 20, 1)]
    assert [r[1] for r in rows(pii.find_pii(docs, ["doc_id"]), "doc_id", "n_email")] == [1, 0, 1]
    assert [r[1] for r in rows(quality.judge_quality(docs, ["doc_id"]), "doc_id", "n_words")] == [200_002, 3, 200_003]
    c = tokencount.counter(vocabulary("byte_bpe_50k.tiktoken"))
    assert [r[1] for r in rows(tokencount.count_revisions(docs, ["doc_id"], vocabulary("byte_bpe_50k.tiktoken")), "doc_id", "n_tokens")] == [len(c.encoding.encode_ordinary(t)) for _, t in some]
    assert [r[1] for r in rows(lm.score_documents(docs, vocabulary("piece_bpe_32k.model")), "doc_id", "n_tokens")] == [200_003, 4, 200_004]
    assert [r[1] for r in rows(sharding.assign_shards(docs, ["doc_id"]), "doc_id", "size")] == [len(t) + 1 for _, t in some]


def test_quality(docs, none):
    found = quality.judge_quality(docs, ["doc_id", "row", "kept"])
    want = []
    for d, t in DOCS:
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        n = brute.repeated_words(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)))
    assert rows(found, "doc_id", *quality.COUNTS, "base_failed") == sorted(want, key=repr)
    assert found.where("kept and base_failed").count() == 0 and quality.judge_quality(none, ["doc_id"]).count() == 0
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


def test_decontamination(spark, docs, none):
    items = [(1, "thouer ither nder ea tion"), (2, None), (None, "one two"), (3, " ".join(LONG.split()[50:70])), (4, " ".join(LONG.split()[60:80])), (4, "ann and more"), (10, "of ann and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in DOCS:
        found, at = brute.hits(brute.plain_words(t), [(i, brute.plain_words(x)) for i, x in items if i is not None])
        want.append((d, len(brute.plain_words(t)), len(at), len(found), sorted(found), len(found) >= 2))
    usual = decontaminate.BROADCAST_BYTES, decontaminate.PIECE
    for most, piece in (usual, (-1, 10), (-1, usual[1]), (usual[0], 3)):
        decontaminate.BROADCAST_BYTES, decontaminate.PIECE = most, piece
        assert rows(decontaminate.find_contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == sorted(want, key=repr)
    decontaminate.BROADCAST_BYTES, decontaminate.PIECE = usual
    for least in (1, 2):
        clean = decontaminate.drop_contaminated(docs, bench, least)
        assert clean.columns == docs.columns and clean.count() == sum(x[3] < least for x in want)
    assert decontaminate.find_contamination(none, bench).count() == 0 and decontaminate.find_contamination(docs, bench.where("false")).where("n_items > 0").count() == 0


def test_bpe(docs, none):
    path = vocabulary("word_bpe_49k.json")
    small = bpe.Codec(path, leaf=8)
    library = lambda t: small.library.encode(t or "", add_special_tokens=False).ids
    want = sorted(((d, len(library(t)), brute.sha(" ".join(map(str, library(t)))), brute.sha(small.library.decode(library(t), skip_special_tokens=False))) for d, t in DOCS), key=repr)
    assert rows(bpe.encode_documents(docs, ["doc_id"], path), "doc_id", *bpe.OUT) == want
    full = {tuple(r["ids"]) for r in bpe.encode_documents(docs, ["doc_id"], path, full=True).collect()}
    assert full == {tuple(library(t)) for _, t in DOCS} and bpe.encode_documents(none, ["doc_id"], path).count() == 0
    parts = ["a", "the", "ing", "É", "ß", "1", "!", "'s", "İ", "Σ", "́", "한", "<|endoftext|>", "_", "🙂", "\xa0", "tion", " "]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(1, 50)))
        assert bpe.encode(small, t) == library(t)


def test_bpe_long_unsplit(spark, tmp_path):
    """The query over texts without white space, which all go through the tree: special tokens in thousands, a word of some MB."""
    rnd = random.Random(2)
    texts = ["<|endoftext|>" * 10_000, "".join(rnd.choices("abcdeft", k=3_000_000)), "".join(rnd.choices("ab1é!'", k=50_000)), "the" * 4000 + "<|endoftext|>" + "x" * 2000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = bpe.codec(vocabulary("word_bpe_49k.json")).library
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe(spark, str(tmp_path)).collect()} == want


def test_bounded_batches(spark, tmp_path, monkeypatch):
    """The pipeline's workers get some MB of text at once, however long texts are; a batch stands in the JVM and in the worker."""
    log = str(tmp_path / "sizes")

    def noting(work):
        def noted(batches, *args):
            def each():
                for b in batches:
                    with open(log, "a") as f:
                        f.write(f"{b.num_rows} {b.nbytes}\n")
                    yield b

            return work(each(), *args)

        return noted

    for module, name in ((bpe, "_batches"), (pii, "_batches"), (jaccard, "_sketch"), (jaccard, "_sign")):
        monkeypatch.setattr(module, name, noting(getattr(module, name)))
    table = spark.range(240).repartition(1).select(F.col("id").alias("doc_id"), F.concat("id", F.lit(" "), F.repeat(F.lit("the of and in was "), 3000)).alias("text")).localCheckpoint()
    for run in (lambda: bpe.encode_documents(table, ["doc_id"], vocabulary("word_bpe_49k.json")), lambda: pii.redact_pii(table), lambda: jaccard.link_components(table)):
        open(log, "w").close()
        assert len({r["doc_id"] for r in run().collect()}) == 240
        sizes = [tuple(map(int, x.split())) for x in open(log)]
        assert sum(n for n, _ in sizes) % 240 == 0 and sizes and max(size for _, size in sizes) < 6 << 20


def test_token_counts(docs, none):
    path = vocabulary("byte_bpe_50k.tiktoken")
    c = tokencount.counter(path)
    want = []
    for d, t in DOCS:
        new = t or ""
        for start, end, text in tokencount.revision(new):
            new = new[:start] + text + new[max(start, end) :]
        both = [(len(c.encoding.encode_ordinary(x)), len(c.cut.findall(x))) for x in (t or "", new)]
        want.append((d, both[0][0], both[1][0], both[0][1], both[1][1]))
    found = tokencount.count_revisions(docs, ["doc_id"], path)
    assert rows(found, "doc_id", *tokencount.OUT[:4]) == sorted(want, key=repr) and found.where("n_pieces_encoded > 40").count() == 0
    assert tokencount.count_revisions(none, ["doc_id"], path).count() == 0
    for leaf in (1, 3, 64):
        tokencount.LEAF = leaf
        for _ in range(300):
            doc = tokencount.Document("".join(random.choice(["a", "the", " ", "\n", "'", "'ll", "1", "!", "é", " x"]) for _ in range(50)), c)
            for _ in range(4):
                i, new = random.randint(0, len(doc.text) + 2), random.choice(["", " ", "'s", "the end", "\n\n"])
                doc.edit(i, i + random.choice([0, 1, 9]), new)
                assert doc.tokens() == len(c.encoding.encode_ordinary(doc.text)) and doc.n_pieces == len(c.cut.findall(doc.text))
    tokencount.LEAF = 64


def plain_shards(docs, shards=16):
    import hashlib
    import zlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    keyed = sorted((md5(t or ""), md5("" if d is None else str(d)), d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    total = sum(x[3] for x in keyed)
    groups = collections.Counter()
    for x in keyed:
        groups[x[0]] += x[3]
    before, start, slots, out = 0, {}, collections.Counter(), []
    for g, _, d, size, crc in keyed:
        start.setdefault(g, before)
        twice = 2 * start[g] + groups[g] if groups[g] <= int(0.02 * total / shards) else 2 * before + size
        shard = min(shards - 1, twice * shards // (2 * total))
        out.append((d, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def test_sharding(spark, docs, none):
    cols = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert rows(sharding.assign_shards(docs, ["doc_id"]), *cols) == sorted(plain_shards(DOCS), key=repr)
    many = [(i, f"copy {'same' if i % 3 else i} of this") for i in range(6000)]
    assert rows(sharding.assign_shards(spark.createDataFrame(many, "doc_id long, text string"), ["doc_id"]), *cols) == sorted(plain_shards(many), key=repr)
    same = [(7, "one text")] * 3000 + [(i, f"text {i}") for i in range(50)]
    assert rows(sharding.assign_shards(spark.createDataFrame(same, "doc_id long, text string"), ["doc_id"]), *cols) == sorted(plain_shards(same), key=repr)
    assert sharding.assign_shards(none, ["doc_id"]).count() == 0


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "doc_id", "text", "kept") == rows(docs, "doc_id", "text", "kept") and sorted(back.columns) == sorted([*docs.columns, "shard"])


def test_allowed_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://spam-farm.net/"), (3, None)], "page_id long, url string")
    assert rows(urls.allowed_pages(pages, HOST_RULES + PATTERN_RULES), "page_id") == [(1,), (3,)]


def test_jaccard(spark, docs, none):
    base = prose(200).split()
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(200)] = f"z{i}"
        near.append((100 + i, " ".join(w)))
    for rows_ in (DOCS, near + DOCS):
        frame = spark.createDataFrame(rows_, "doc_id long, text string")
        ids, sizes = brute.components(rows_)
        want = [(d, n, c if n else d) for (d, _), n, c in zip(rows_, sizes, ids)]
        assert rows(jaccard.link_components(frame), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert jaccard.link_components(none).count() == 0
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    left = collections.Counter(r["text"] for r in kept.collect())
    assert left[LONG] == 1 and left[NEAR] == 0 and left["one two"] == 1 and left[None] == 2


def test_jaccard_inside_group(spark):
    """Texts of nine shingles that differ in their last words only: most share their prefix, and no other text shares it."""
    texts = []
    for seed in range(60):
        w = [f"s{seed}w{i}" for i in range(13)]
        texts += [" ".join(w), " ".join([*w[:11], "x", "y"]), " ".join([*w[:12], "z"])]
    for order in (1, -1):
        rows_ = list(enumerate(texts[::order]))
        ids, sizes = brute.components(rows_)
        found = jaccard.link_components(spark.createDataFrame(rows_, "doc_id long, text string"))
        assert rows(found, "doc_id", "n_shingles", "component_id") == sorted([(d, n, c) for (d, _), n, c in zip(rows_, sizes, ids)], key=repr)


def test_jaccard_near_the_threshold(spark):
    """Families around one template: most pairs share almost 80 in 100, some lists are long, and few of their members link."""
    rnd = random.Random(11)
    texts = []
    for family in range(6):
        template = [f"f{family}w{i}" for i in range(50)]
        texts += [" ".join([*template, *[f"u{family}x{k}y{j}" for j in range(rnd.randint(3, 9))]]) for k in range(25)]
        for k in range(25):
            w = list(template)
            at = rnd.randrange(50)
            w[at : at + rnd.randint(0, 3)] = [f"z{rnd.randrange(3)}"] * rnd.randint(0, 3)
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    rows_ = list(enumerate(texts))
    for threshold in (80, 60):
        ids, sizes = brute.components(rows_, threshold)
        found = jaccard.link_components(spark.createDataFrame(rows_, "doc_id long, text string"), threshold)
        assert rows(found, "doc_id", "n_shingles", "component_id") == sorted([(d, n, c) for (d, _), n, c in zip(rows_, sizes, ids)], key=repr)


def test_jaccard_lists():
    """Company and centres of sorted rows, however they are cut into batches."""
    import pyarrow as pa

    rnd = random.Random(3)
    for _ in range(200):
        token = sorted(rnd.choice(range(12)) for _ in range(rnd.randint(1, 30)))
        cols = [token, [rnd.randint(1, 9) for _ in token], list(range(len(token))), [rnd.randint(0, 5) for _ in token], token, token]
        whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=[*jaccard.ROW, *jaccard.PAST])
        cuts = sorted({0, len(token), *[rnd.randint(0, len(token)) for _ in range(4)]})
        batches = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        kept = [r for b in jaccard._in_company(iter(batches)) for r in b.to_pylist()]
        last = len(token) - 1
        assert [r["g"] for r in kept] == [i for i, t in enumerate(token) if i in (0, last) or token.count(t) > 1]
        assert all((r["p1"] is None) == (r["pos"] < 1) and (r["p2"] is None) == (r["pos"] < 2) for r in kept)
        assert all(r["many"] or token.count(r["token"]) < 3 for r in kept)
        pairs = [(r["a"], r["b"]) for b in jaccard._neighbours(iter(batches), 1) for r in b.to_pylist()]
        assert set(pairs) <= {(i, i + 1) for i in range(last) if token[i] == token[i + 1]} and len(pairs) == len(set(pairs))
        near = lambda i, j: min(cols[1][i], cols[1][j]) * 100 >= 30 * max(cols[1][i], cols[1][j]) and 130 * min(cols[1][i] - cols[3][i], cols[1][j] - cols[3][j]) >= 30 * (cols[1][i] + cols[1][j])
        stars = [(r["a"], r["b"]) for b in jaccard._to_centre(iter(batches), 30) for r in b.to_pylist()]
        assert stars == [(token.index(t), i) for i, t in enumerate(token) if token.index(t) != i and near(token.index(t), i)]


def shuffled(spark):
    """Records that all stages so far have written for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_jaccard_shuffles_no_lone_shingles(spark):
    """Only prefix shingles that several prefixes hold become rows; here 40 in some 20,000."""
    texts = [" ".join(f"d{d}w{i}" for i in range(400)) for d in range(250)]
    texts.append(texts[7] + " more")
    rows_ = list(enumerate(texts))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    before = shuffled(spark)
    found = rows(jaccard.link_components(docs), "doc_id", "component_id")
    assert found == sorted([(d, 7 if d == 250 else d) for d in range(251)], key=repr)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < shuffled(spark) - before < 12_000


def test_shingles():
    for t in ["", "a", "a b c d", "A b c d e", "x" * 200 + " y z", prose(500)]:
        assert len(shingles.shingles(t)) == len(brute.shingle_set(t))
    a, b = shingles.shingles(LONG), shingles.shingles(NEAR)
    apart = len(set(a.tolist()) ^ set(b.tolist()))
    assert shingles.least_difference(shingles.parity(a), shingles.parity(b)) <= apart
    assert sum(int(x).bit_count() for x in (shingles.parity_words(a, 4) ^ shingles.parity_words(b, 4)).view("uint64")) <= apart


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "one two three"), (2, 0, "user", "alone"), (3, 1, None, None), (3, None, "system", "s"), (4, 0, "assistant", "word"), (None, 0, "user", "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_pairs(chat.against_cut_answers(chat.gather(table))).collect()}
    assert len(out) == 5 and out[1]["prompt"] == "<|user|>\nhi<|end|>\n" and out[1]["chosen"] == "<|assistant|>\none two three<|end|>\n" and out[1]["rejected"] == "<|assistant|>\none two<|end|>\n"
    both = out[1]["prompt"] + out[1]["chosen"]
    start, end = map(int, out[1]["chosen_mask"].split(":"))
    assert both[start:end] == "one two three<|end|>" and out[1]["n_common"] == 1
    assert not out[2]["differs"] and out[2]["chosen"] == "" and out[3]["prompt"] == "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n" and not out[4]["differs"]
    other = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (9, 0, "user", "new")], table.schema)
    pairs = {r["conv_id"]: r for r in chat.format_pairs(chat.pair(table, other)).collect()}
    assert pairs[1]["rejected"].count("<|end|>") == 2 and pairs[9]["prompt"] == "" and pairs[9]["rejected"] and pairs[9]["chosen"] == ""
    assert chat.format_pairs(chat.against_cut_answers(chat.gather(table.where("false")))).count() == 0
