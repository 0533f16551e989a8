"""Independent SQL (DuckDB's) for the queries that SQL can express, made from the operators' fixed values alone."""

from __future__ import annotations

import string
from fractions import Fraction

from revgraph.llm import licenses, quality

LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
BLANK = r"[\x20\x09-\x0D]+"


def listed(words: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{w}'" for w in words) + "] AS VARCHAR[])"


#: Sets of shingles, links by counting what pairs share, components by reaching.
NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED}, '{BLANK}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r AS (SELECT doc_id AS id, doc_id AS place FROM documents UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.place),
c AS (SELECT id, min(place) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, CAST(len(w) AS BIGINT)), lambda i: w[i + 1:i + {len(phrase.split())}] = {listed(phrase.split())})) AS place FROM w" for phrase, label in licenses.PHRASES.items()
)


def template(label: str, text: str, required: str, excluded: str) -> str:
    words = sorted({x.decode() for x in licenses.words(text)})
    return f"('{label}', {listed(words)}, {listed(required.split())}, {listed(excluded.split())}, {licenses.needs(len(words), Fraction(4, 5), 16)})"


LICENSES = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({PHRASES}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM p GROUP BY doc_id),
b AS (SELECT doc_id, list_distinct(w[k + 1:k + 128]) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(len(w) AS BIGINT) - 64), 64)) AS k FROM w)),
t(label, tokens, required, excluded, need) AS (VALUES {", ".join(template(*t) for t in licenses.TEMPLATES)}),
h AS (SELECT doc_id, label, len(list_intersect(b, tokens)) / len(tokens) AS part FROM b, t WHERE len(list_intersect(b, tokens)) >= need AND len(list_intersect(b, required)) = len(required) AND len(list_intersect(b, excluded)) = 0),
l AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM p) GROUP BY doc_id),
m AS (SELECT doc_id, max(part) AS part FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)"""


def without(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


REST = ["x"]
for _, _pattern in quality.CLASSES:
    REST.append(f"regexp_replace({REST[-1]}, '{_pattern}', '', 'g')")
CHARS = "[" + ", ".join(f"length({a}) - length({b})" for a, b in zip(REST, REST[1:], strict=False)) + f", length({REST[-1]})]"
LANGUAGES = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)


def js(counts: str, shares: str) -> str:
    """Jensen-Shannon distance of a list of counts to a list of shares."""
    p, q = f"({counts}[i] / list_sum({counts}))", f"{shares}[i]"
    part = lambda a: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({p} + {q})) ELSE 0 END)"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, CAST(len({counts}) + 1 AS BIGINT)), lambda i: {part(p)} + {part(q)})) / 2))"


QUALITY = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda z: z <> '') AS w FROM documents),
three AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM three) WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(x) - {without("x", "[#*$%&|<>]")} AS BIGINT) AS n_symbols,
 CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, {CHARS} AS chars,
 list_transform({listed(quality.WORD_LIST)}, lambda c: len(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D.,;:!?]+'), lambda z: z = c))) AS common
 FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN again ON again.doc_id = d.doc_id),
u AS (SELECT lang, n_words, chars, common FROM m WHERE lang IN ({LANGUAGES}) AND n_words >= 100),
rc AS (SELECT lang, list(s / t ORDER BY i) AS q FROM (SELECT lang, i, s, sum(s) OVER (PARTITION BY lang) AS t FROM (SELECT lang, i, sum(chars[i]) AS s FROM u, range(1, {len(quality.CLASSES) + 2}) r(i) GROUP BY lang, i)) GROUP BY lang),
rw AS (SELECT lang, list(s / t ORDER BY i) AS q, greatest(0, 1 - sum(s) / min(t)) AS rest FROM (SELECT lang, i, sum(common[i]) AS s, sum(n_words) AS t FROM u, range(1, {len(quality.WORD_LIST) + 1}) r(i) GROUP BY lang, i) GROUP BY lang),
f AS (SELECT *, list_append(common, greatest(0, n_words - list_sum(common))) AS words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
dist AS (SELECT f.doc_id, min({js("chars", "rc.q")}) AS a, min({js("words", "(list_append(rw.q, rw.rest))")}) AS b FROM f, rc JOIN rw ON rw.lang = rc.lang WHERE n_words >= 100 GROUP BY f.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(a > {quality.MOST_CHARS} OR b > {quality.MOST_WORDS}, false) AS kept, round(a, 6) AS char_distance, round(b, 6) AS word_distance
FROM f LEFT JOIN dist ON dist.doc_id = f.doc_id"""

ORACLES = {"op2_quality_rules": QUALITY, "op7_licenses": LICENSES, "op10_ngram_jaccard": NGRAM_JACCARD}
