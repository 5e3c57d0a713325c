"""DuckDB SQL for the queries that SQL can express. op2 (offsets of parsers), op3 (lattices), op6 and op7 (tokenizers) and op8 (a CRC that DuckDB
lacks) have none; tests hold them against plain Python."""

from __future__ import annotations

from larkspur.llm import quality as Q
from larkspur.llm.common import LOWER, UPPER

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_HOST_RULES = [("example.org", "/en/1"), ("example.org", "/es/"), ("com", "/fr/"), ("com", "/de/"), ("org", "/")]
_HOST = r"^([^/?#]*\.)?"
_PATTERNS = [
    ("/affiliate-*-offers/", "/affiliate-.*-offers/"),
    ("/casino/history/", "/casino/history/"),
    ("||cheap-pills.", _HOST + r"cheap-pills\."),
    ("|ads.*/banner.", r"^ads\..*/banner\."),
    ("||casino-win.", _HOST + r"casino-win\."),
    ("||spam-farm.", _HOST + r"spam-farm\."),
    ("||free-bets.", _HOST + r"free-bets\."),
    ("||ads-track.", _HOST + r"ads-track\."),
    ("||adult-x.", _HOST + r"adult-x\."),
    ("/adserver/", "/adserver/"),
    ("/viagra^", "/viagra([^a-z0-9_.%-]|$)"),
    ("/casino/", "/casino/"),
]
OP1 = f"""
WITH b AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(rest, '{UPPER}', '{LOWER}') AS f, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
r AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, x)} THEN '{h}{x}'" for h, x in _HOST_RULES)} END AS rule FROM p),
m AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {" ".join(f"WHEN regexp_matches(f, '{x}') THEN '{t}'" for t, x in _PATTERNS)} END END AS pattern FROM r)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') OR (pattern IS NOT NULL AND pattern <> '/casino/history/') THEN 'block' ELSE 'allow' END AS verdict FROM m"""


def _op4() -> str:
    removals = [("lower", f"[{LOWER}]+"), ("space", r"[\x20\x09-\x0D]+"), ("symbol", "[#*$%&|<>]+"), ("upper", f"[{UPPER}]+"), ("digit", "[0-9]+"), ("punct", r"""[.,;:!?''"()\-]+""")]
    bare, counts = "t", []
    for name, pattern in removals:
        less = f"regexp_replace({bare}, '{pattern}', '', 'g')"
        counts.append(f"length({bare}) - length({less}) AS c_{name}")
        bare = less
    counts.append(f"length({bare}) AS c_rest")
    k = max(map(len, Q.COMMON_WORDS.values()))
    common = []
    for i in range(k):
        cases = " ".join(f"WHEN '{lang}' THEN len(list_filter(w, lambda x: x = '{ws[i]}' OR x = '{ws[i][:1].upper() + ws[i][1:]}'))" for lang, ws in Q.COMMON_WORDS.items() if i < len(ws))
        common.append(f"CASE language {cases} END AS w{i}")
    languages = ", ".join(f"'{x}'" for x in Q.COMMON_WORDS)
    classes = [f"c_{c}" for c in Q.CLASSES]
    bins = [f"w{i}" for i in range(k)]
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"

    def distance(names: list[str], total: str, ref: str) -> str:
        terms = []
        for n in names:
            p, q = f"(CAST(f.{n} AS DOUBLE) / {total})", f"(CAST(r.{n} AS DOUBLE) / r.{ref})"
            terms.append(f"coalesce(({half(p, f'({p} + {q}) / 2')} + {half(q, f'({p} + {q}) / 2')}) / 2, 0)")
        return f"sqrt(greatest(0, {' + '.join(terms)}))"

    share = lambda n: f"(CAST({n} AS DOUBLE) / words)"
    rest = share("w_rest")
    bare_terms = [f"coalesce({half(share(b), share(b) + ' / 2')}, 0) / 2" for b in bins]
    most = f"sqrt(greatest(0, {' + '.join(bare_terms)} + ({half('1', f'(1 + {rest}) / 2')} + {half(rest, f'(1 + {rest}) / 2')}) / 2))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, CASE WHEN lang IN ({languages}) THEN lang ELSE 'other' END AS language FROM documents),
win AS (SELECT k, unnest(range(1, len(w) - {Q.WINDOW} + 2)) AS i, w FROM d WHERE len(w) >= {Q.WINDOW}),
hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(w[i:i + {Q.WINDOW - 1}], ' ')) AS n FROM win) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT place) AS n FROM (SELECT k, unnest(range(i, i + {Q.WINDOW})) AS place FROM hit) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f0 AS (SELECT d.k, doc_id, language, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(t) AS n_chars, {", ".join(counts)}, {", ".join(common)}
  FROM d LEFT JOIN rep USING (k) JOIN l USING (k)),
f AS (SELECT *, n_words - ({" + ".join(f"coalesce({b}, 0)" for b in bins)}) AS w_rest, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f0),
r AS (SELECT *, {most} AS most FROM (SELECT language, {", ".join(f"sum({c}) AS {c}" for c in [*classes, *bins, "w_rest"])}, sum({" + ".join(classes)}) AS chars, sum(n_words) AS words FROM f WHERE NOT base_failed GROUP BY language))
SELECT f.doc_id, f.n_words, n_chars - f.c_space AS word_chars, f.c_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {Q.MIN_CHARS_JUDGED} AND coalesce({distance(classes, "n_chars", "chars")}, 0) > {Q.MAX_CHAR_DISTANCE})
  AND NOT (n_words >= {Q.MIN_WORDS_JUDGED} AND f.language <> 'other' AND coalesce(r.most > 0 AND {distance([*bins, "w_rest"], "n_words", "words")} > {Q.MAX_WORD_SHARE} * r.most, false)) AS kept
FROM f LEFT JOIN r USING (language)"""


_TOKENS5 = rf"list_filter(string_split_regex({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP5 = f"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_TOKENS5} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 8) AS size, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_TOKENS5} AS w FROM documents),
dw AS (SELECT k, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT k, s, size, item FROM dw JOIN iw USING (size, win)),
h AS (SELECT k, count(DISTINCT place) AS n FROM (SELECT k, unnest(range(s, s + size)) AS place FROM m) GROUP BY k),
n AS (SELECT k, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN n USING (k)"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWERED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""

OP10 = """
WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN i END) AS last, max(i) AS total FROM t GROUP BY conv_id),
c AS (SELECT t.*, last, total, CASE WHEN i = last THEN array_to_string(string_split(text, ' ')[1:(len(string_split(text, ' ')) + 1) // 2], ' ') ELSE text END AS cut FROM t JOIN l USING (conv_id)),
n AS (SELECT conv_id, coalesce(min(CASE WHEN cut <> text THEN i - 1 END), max(i)) AS n, count(CASE WHEN cut <> text THEN 1 END) > 0 AS differs FROM c GROUP BY conv_id),
x AS (SELECT c.*, n, differs, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || cut || '<|end|>' || chr(10) AS b FROM c JOIN n USING (conv_id)),
y AS (SELECT *, sum(length(a)) OVER (PARTITION BY conv_id ORDER BY i) AS ea, sum(length(b)) OVER (PARTITION BY conv_id ORDER BY i) AS eb FROM x)
SELECT conv_id, n AS n_common, differs, coalesce(string_agg(CASE WHEN i <= n THEN a END, '' ORDER BY i), '') AS prompt, coalesce(string_agg(CASE WHEN i > n THEN a END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN i > n THEN b END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN i > n AND role = 'assistant' THEN (ea - length(a) + length(role) + 5) || ':' || (ea - 1) END, ',' ORDER BY i), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN i > n AND role = 'assistant' THEN (eb - length(b) + length(role) + 5) || ':' || (eb - 1) END, ',' ORDER BY i), '') AS rejected_mask
FROM y GROUP BY conv_id, n, differs"""

ORACLES: dict[str, str] = {"op1_url_filters": OP1, "op4_quality_rules": _op4(), "op5_decontamination": OP5, "op9_jaccard_join": OP9, "op10_chat_formatting": OP10}
