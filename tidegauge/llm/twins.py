"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from tidegauge.llm.licenses import NOTICES, PHRASES
from tidegauge.llm.urls import SITES, WORDS

LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOLID = r"[^\x20\x09-\x0D]+"


def words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({LOWERED.format(column)}, '{pattern}')"


def _templates() -> str:
    rows = []
    for tid, (body, label, exact) in enumerate([(p, x, True) for p, x in PHRASES.items()] + [(p, x, False) for p, x in NOTICES.items()]):
        w = body.split()
        rows += [f"({tid}, '{label}', {str(exact).lower()}, {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}')" for i in range(len(w) - 1)]
    return ", ".join(rows)


LICENSES = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, {words("text", WORD)} AS w FROM documents),
p AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos FROM w),
g AS (SELECT rid, a, pos, lead(a) OVER (PARTITION BY rid ORDER BY pos) AS b FROM p),
t(tid, label, exact, pairs, tpos, l, r) AS (VALUES {_templates()}),
v AS (SELECT DISTINCT rid, tid, label, exact, pairs, pos, tpos, pos - tpos AS diagonal FROM g JOIN t ON a = l AND b = r),
o AS (SELECT DISTINCT rid, tid, diagonal FROM v),
y AS (SELECT o.rid, o.tid, o.diagonal AS start, v.label, v.exact, v.pairs, v.pos, v.tpos FROM o JOIN v ON v.rid = o.rid AND v.tid = o.tid
      AND v.diagonal BETWEEN o.diagonal AND o.diagonal + CASE WHEN v.exact THEN 0 ELSE 3 END),
e AS (SELECT rid, tid, start FROM y GROUP BY ALL HAVING count(DISTINCT tpos) >= CASE WHEN any_value(exact) THEN 1 ELSE 0.6 END * any_value(pairs)),
q AS (SELECT y.* FROM y JOIN e USING (rid, tid, start)),
c(rid, tid, start, pos, tpos, held) AS (SELECT rid, tid, start, pos, tpos, 1 FROM q
      UNION SELECT q.rid, q.tid, q.start, q.pos, q.tpos, held + 1 FROM c JOIN q ON q.rid = c.rid AND q.tid = c.tid AND q.start = c.start AND q.pos > c.pos AND q.tpos > c.tpos),
h AS (SELECT rid, tid, start, max(held) AS held FROM c GROUP BY ALL),
s AS (SELECT rid, tid, start, label, exact, pairs, held, min(pos) AS f FROM q JOIN h USING (rid, tid, start) WHERE held >= CASE WHEN exact THEN 1 ELSE 0.6 END * pairs GROUP BY ALL),
n AS (SELECT *, CASE WHEN exact OR coalesce(start - lag(start) OVER (PARTITION BY rid, tid ORDER BY start) > 3, true) THEN 1 ELSE 0 END AS new FROM s),
m AS (SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY start) AS run FROM n),
k AS (SELECT rid, label, exact, pairs, max(held) AS held, arg_max(f, CAST(held AS BIGINT) * 1000000000 - start) AS f FROM m GROUP BY rid, tid, label, exact, pairs, run),
d AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(f) FILTER (exact) AS first_word, max(f) FILTER (exact) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      max(held / pairs) AS score FROM k GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN d USING (rid)
"""


def _urls() -> str:
    def site(r):
        host, _, rest = r.name.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"

    sites = sorted(SITES, key=lambda r: (-r.rank, r.name))
    by_rank = sorted(WORDS, key=lambda r: (r.rank, r.name), reverse=True)
    fits = "\n".join(f"WHEN {site(r)} THEN '{r.name}'" for r in sites)
    verdicts = "\n".join(f"WHEN {site(r)} THEN '{r.verdict}'" for r in sites)
    names = "\n".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}'" for r in by_rank)
    word_verdicts = "\n".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN '{r.verdict}'" for r in by_rank)
    return f"""
WITH u AS (SELECT page_id, {LOWERED.format("url")} AS low,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {fits} END AS rule,
       CASE {verdicts} {word_verdicts} ELSE 'allow' END AS verdict, CASE {names} END AS word_rule
FROM u
"""


URLS = _urls()

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text", WORD)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text", WORD)} AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
x AS (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM s),
q AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS t FROM x),
z AS (SELECT DISTINCT size FROM q),
y AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, z),
h AS (SELECT rid, pos, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS t FROM y),
f AS (SELECT rid, pos, h.size AS size, item FROM h JOIN q ON h.t = q.t AND h.size = q.size),
c AS (SELECT rid, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT rid, pos, size FROM f)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM c GROUP BY rid),
o AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (rid)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words("text", SOLID)} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 3), ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text", WORD)} AS w FROM documents),
i AS (SELECT item_id, {words("text", WORD)} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(w) AS t FROM i),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
f AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, c GROUP BY t, docs),
p AS (SELECT rid, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * docs) // total))) AS part FROM f JOIN w USING (t) JOIN d USING (rid), c),
s AS (SELECT item_id, rid, CAST(sum(part) AS BIGINT) AS score FROM p JOIN q USING (t) GROUP BY item_id, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN d USING (rid) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
