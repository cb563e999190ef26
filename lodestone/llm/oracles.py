"""DuckDB SQL for what SQL can express of the operators: whole results, or the columns that are no model's."""

from __future__ import annotations

from .licenses import BASE as PHRASES

#: A text in lower case as the operators take it: A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^ \t\n\x0b\x0c\r]+')"

NEAR_DEDUP = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
t(a, b) AS (SELECT r, r FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT t.a AS r, min(o.doc_id) AS least FROM t JOIN d o ON o.r = t.b GROUP BY t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id, d.doc_id IS NOT DISTINCT FROM m.least AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

TOP_K = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


LICENSES = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_places(p)} AS p{k}" for k, p in enumerate(PHRASES))} FROM d),
a AS (SELECT *, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS p FROM p)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a"""

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS w FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 2) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
t AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
u AS (SELECT r, count(DISTINCT i + k) AS n FROM t CROSS JOIN range(3) AS o(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t\n\x0b\x0c\r]') GROUP BY r)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words,
len(w) < 50 OR 100 * coalesce(u.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN u USING (r) LEFT JOIN l USING (r)"""

#: crc32 of a short text, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, o: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""

SUFFIX_TREE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC.format("doc_id::VARCHAR")} % 5 = 1, false) AS held_out, {_WORDS.format(_LOWER)} AS w FROM documents),
t AS (SELECT r, held_out, unnest(list_append(w, chr(10))) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base FROM t LEFT JOIN c USING (x) CROSS JOIN n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, CAST(round(base * 1000) AS BIGINT) AS base_milli FROM d JOIN s USING (r) CROSS JOIN n"""

_LUHN = "list_sum(list_transform(string_split({0}, ''), lambda d, i: CASE WHEN (length({0}) - i) % 2 = 0 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"

PII = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e,
regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c,
list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM d)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) AS n_ip,
len(list_filter(c, lambda x: CASE WHEN length(x) BETWEEN 13 AND 19 THEN {_LUHN.format("x")} ELSE false END)) AS n_card,
len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone FROM m"""
