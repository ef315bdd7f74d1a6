"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, CLOSED

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """Words between ASCII white space."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def plain_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP2 = f"""WITH d AS (SELECT doc_id, {plain_words('text')} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {plain_words('text')} AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, list_slice(w, p + 1, p + k) AS win FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM i)),
dw AS (SELECT doc_id, k, p, list_slice(w, p + 1, p + k) AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN names USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
dw AS (SELECT doc_id, p, list_slice(w, p + 1, p + 20) AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS n FROM dw),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r WHERE n > 1),
kept AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.q) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS q FROM d) u ANTI JOIN gone USING (doc_id, q) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def count_of(text: str, signs: str) -> str:
    return f"length(regexp_replace({text}, '[^{signs}]', '', 'g'))"


SYMBOLS = r"#*$%&|<>"
OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words('text')} AS w FROM documents),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, p, list_slice(w, p + 1, p + 8) AS x FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS p FROM d))),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM win WHERE n > 1) GROUP BY 1),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i, len(string_split(t, chr(10))) AS m FROM d),
l AS (SELECT *, {words('line')} AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS copy FROM raw),
f AS (SELECT *, len(w) AS nw, length(line) AS chars, {count_of('line', '|<>/\\\\')} AS bars, {count_of('line', 'A-Z')} AS upper, {count_of('line', 'A-Za-z')} AS letters,
 len(list_filter(w, lambda x: regexp_matches(x, '[{SYMBOLS}]'))) AS marked, len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS stutters FROM l),
v AS (SELECT *, nw > 0 AND ((NOT regexp_matches(line, '{CLOSED.replace("'", "''")}') AND i > 0 AND i < m - 1 AND nw < 4) OR (bars >= 2 AND bars * 4 >= nw) OR (regexp_matches(line, '(?i){"|".join(BOILERPLATE)}') AND nw <= 30)
 OR 100 * marked > 30 * nw OR (letters >= 20 AND 100 * upper > 70 * letters) OR 100 * stutters > 30 * nw) AS bad FROM f),
s AS (SELECT doc_id, count(CASE WHEN copy > 1 AND nw > 0 THEN 1 END) AS dup, count(CASE WHEN bad THEN 1 END) AS gone, coalesce(sum(CASE WHEN bad THEN chars END), 0) AS lost, coalesce(sum(CASE WHEN nw > 0 THEN chars END), 0) AS size FROM v GROUP BY 1),
r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count_of('t', SYMBOLS)} AS BIGINT) AS n_symbols, dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, gone AS n_lines_removed, CAST(lost AS BIGINT) AS chars_lost, size
 FROM d JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * chars_lost <= 30 * size AS kept, n_lines_removed, chars_lost FROM r"""

def bits(n: int) -> str:
    """CRC-32 of a list of bytes `b`, a bit at a time, as a list reduced by steps of eight bits."""
    step = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
    x = "y"
    for _ in range(n):
        x = f"({step.format(x=x)})" if x == "y" else f"list_transform([{x}], lambda y: {step.format(x='y')})[1]"
    return x


CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda r, x: list_transform([xor(r, x)], lambda y: {bits(8)})[1]), 4294967295)"

OP13 = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT c.c, base, CASE WHEN c.c = base THEN 0 ELSE h END AS h, count(t.p) AS lent FROM c LEFT JOIN t ON t.c = base AND c.c <> base AND t.p <= h GROUP BY ALL),
s AS (SELECT k.c, t.p AS d, role, text FROM k JOIN t ON t.c = base AND t.p <= lent WHERE lent > 0 UNION ALL SELECT k.c, lent + t.p - h, role, text FROM k JOIN t ON t.c = k.c AND t.p > h),
path AS (SELECT c, d, string_agg(md5(role) || md5(text), '' ORDER BY d) OVER w AS key, octet_length(encode(text)) AS size FROM s WINDOW w AS (PARTITION BY c ORDER BY d) UNION ALL SELECT c, 0, '', 0 FROM k),
ends AS (SELECT c, max(d) AS d FROM path GROUP BY 1),
node AS (SELECT key, d, min(size) AS size, min(c) AS conv_id, count(*) AS n FROM path GROUP BY 1, 2),
up AS (SELECT node.*, parent.key AS pkey, parent.conv_id AS pid FROM node LEFT JOIN node parent ON node.d > 0 AND parent.d = node.d - 1 AND parent.key = left(node.key, 64 * (node.d - 1))),
kids AS (SELECT pkey AS key, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
pairs AS (SELECT DISTINCT u.key, u.d, v.key AS vkey, v.d AS vd FROM path u JOIN path v ON u.c = v.c AND v.d >= u.d),
below AS (SELECT p.key, p.d, count(CASE WHEN kids.n IS NULL THEN 1 END) AS leaves, sum((node.n - 1) * node.size) AS saved FROM pairs p JOIN node ON node.key = p.vkey AND node.d = p.vd LEFT JOIN kids ON kids.key = p.vkey AND kids.d = p.vd GROUP BY 1, 2),
e AS (SELECT key, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM path JOIN ends USING (c, d) GROUP BY 1, 2)
SELECT up.conv_id, CAST(up.d AS BIGINT) AS depth, pid AS parent_conv_id, up.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM up JOIN below USING (key, d) LEFT JOIN kids USING (key, d) LEFT JOIN e USING (key, d)"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS w FROM documents),
q AS (SELECT row_number() OVER () AS j, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}'))) AS term FROM benchmark),
tf AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(w) AS term FROM d) GROUP BY 1, 2),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, big_n),
p AS (SELECT i, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(w) AS BIGINT) * big_n) // l))) AS part FROM tf JOIN df USING (term) JOIN d USING (i), s),
score AS (SELECT j, item_id, i, CAST(sum(part) AS BIGINT) AS score FROM p JOIN q USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM score JOIN d USING (i) WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op2_decontamination": OP2, "op5_quality_rules": OP5, "op10_block_dedup": OP10, "op12_lexical_search": OP12, "op13_prefix_trie": OP13}
