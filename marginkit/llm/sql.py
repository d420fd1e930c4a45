"""DuckDB SQL for the queries that SQL can express."""

from .decontaminate import WINDOW
from .prefix_trie import TIE
from .quality import BOILERPLATE, Rules
from .queries import URL_RULES

_R = Rules()
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+{_R.window - 1}], ' ') AS s
        FROM (SELECT r, w, unnest(range(1, len(w) - {_R.window - 2})) AS i FROM d WHERE len(w) >= {_R.window})),
rep AS (SELECT r, count(*) AS n FROM (
          SELECT DISTINCT r, i + k AS p FROM win JOIN (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1) USING (r, s),
                 (SELECT unnest(range(0, {_R.window})) AS k)) GROUP BY r),
lines AS (SELECT r, l, {_WORDS.format('l')} AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT r, l, len(w) AS n,
    100 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]|!!|\?\?'))) >= {_R.max_symbol_rate} * len(w)
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '^([|>/*<-]{{1,3}}|[·»«•›])$'))) >= greatest({_R.max_bar_rate} * len(w), 100)
    OR (len(w) >= {_R.long_line} AND NOT regexp_matches(l, '[.!?:;,…。、！？，：；।]'))
    OR (len(w) <= {_R.boilerplate_words} AND regexp_matches({_FOLD.format('l')}, '{"|".join(BOILERPLATE)}')) AS fails
  FROM lines WHERE len(w) > 0),
per AS (SELECT r, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM judged GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words)
  AND 100 * n_lost_words <= {_R.max_loss} * n_words AS kept
FROM a
"""

OP3 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
OP7 = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, {_FOLD.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {_RULES}) AS x(v, h, p)),
best AS (SELECT r, arg_max(h || p, length(h) * 10000 + length(p)) AS rule, arg_max(v, length(h) * 10000 + length(p)) AS verdict
         FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
k AS (SELECT *, cap / weight AS ratio, row_number() OVER f AS rn,
        (1.5 * sum(source_size) OVER () - sum(cap) OVER f + cap)::DOUBLE
        / (sum(weight) OVER () - sum(weight) OVER f + weight) AS lam
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(arg_min(lam, rn) FILTER (lam < ratio), 1e300) AS lam FROM k),
t AS (SELECT source, source_size, CASE WHEN cap <= lam * weight THEN cap::DOUBLE ELSE lam * weight END AS target FROM w, l),
q AS (SELECT doc_id, d.source, size, source_size, target, o,
        sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(run + p * source_size AS DOUBLE) / target AS v FROM q, (SELECT unnest([0, 1]) AS p) WHERE size > 0 AND target > 0),
m AS (SELECT doc_id, source, size, o, sum(size) OVER (ORDER BY v, o, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS used FROM c),
n AS (SELECT doc_id, source, size, o, count(*) AS copies FROM m WHERE used <= (SELECT 1.5 * sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target,
       CAST(coalesce(n.copies, 0) AS INTEGER) AS copies, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source IS NOT DISTINCT FROM n.source AND q.size = n.size AND q.o = n.o
"""

_ALNUM = r"list_filter(string_split_regex({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(_FOLD.format("coalesce(text, '')"))
OP10 = rf"""
WITH i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p+least(len(w), {WINDOW})-1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
x AS (SELECT r, p, n, array_to_string(w[p:p+n-1], ' ') AS s
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT r, p, x.n, item_id FROM x JOIN g USING (n, s)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


#: crc32 of an ASCII text: ``tbl`` is the table of the 256 remainders
_CRC_TABLE = """(SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tbl FROM range(256) AS t(i))"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS UBIGINT))),
    lambda a, b: xor(tbl[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8)), 4294967295)"""

_CRC_BYTES = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split({0}, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS UBIGINT)] ELSE [CAST(195 AS UBIGINT), CAST(unicode(c) - 64 AS UBIGINT)] END))),
    lambda a, b: xor(tbl[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8)), 4294967295)"""

OP11 = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, {_FOLD.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} AS r FROM documents),
k AS (SELECT d, r, count(*) AS c FROM runs WHERE length(r) >= 7 GROUP BY d, r),
h AS (SELECT r, c, CAST({_CRC_BYTES.format("d || ':' || r")} AS BIGINT) AS h FROM k, {_CRC_TABLE}),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
pairs AS (SELECT a.word, b.word AS o, b.n FROM x a JOIN x b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, first(o ORDER BY n DESC, o) AS o, max(n) AS m FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN o END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM f JOIN (SELECT word, root FROM chain WHERE root IN (SELECT word FROM f WHERE form IS NULL)) USING (word)
"""

OP12 = rf"""
WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, {TIE}),
                                sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS b, CAST({_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h
      FROM (SELECT DISTINCT conv_id FROM t), {_CRC_TABLE}),
k AS (SELECT conv_id, count(*) AS k FROM t GROUP BY 1),
r AS (SELECT c.conv_id, i AS d, g, n FROM c JOIN t ON t.conv_id = c.b AND i <= h
      UNION ALL SELECT c.conv_id, i - h + least(h, coalesce(k, 0)) AS d, g, n FROM c JOIN t USING (conv_id) LEFT JOIN k ON k.conv_id = c.b WHERE i > h),
p AS (SELECT conv_id, d, n, md5(string_agg(g, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, lag(path) OVER w AS up, lead(path) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (SELECT path, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(n) AS own, min(up) AS up, bool_and(last) AS leaf,
            string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY path),
s AS (SELECT a.path, sum(own) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE a.path = x.up) AS children
      FROM nodes x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.depth GROUP BY a.path)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, x.n_convs, children AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN s USING (path) LEFT JOIN nodes u ON u.path = x.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_warc": OP3, "op7_url_rules": OP7, "op8_mixing": OP8, "op10_decontaminate": OP10,
            "op11_spelling": OP11, "op12_prefix_trie": OP12}
