"""DuckDB SQL for the rows of the queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '{WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lowered("text")}, '{WORDS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS said
        FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS said
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
found AS (SELECT doc_id, item_id, a.k, i FROM spot a JOIN win ON win.said = a.said AND win.k = a.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _hex(first: int, digits: int) -> str:
    return f"('0x' || substr(m, {first}, {digits}))::int"


OP6 = f"""
WITH hosts AS (SELECT page_id, url, DATE '2023-01-01' + ((page_id * 7919) % 730)::int AS day, regexp_extract(lower(url), '{HOST}', 1) AS h,
               list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda s: s <> '') AS seg FROM pages),
known AS (SELECT DISTINCT h, seg, string_split(h, '.') AS lab FROM hosts WHERE h <> ''),
rules AS (
  SELECT 'ads' AS list, 'block' AS verdict, 'host:' || h AS pattern, 4 AS share FROM known
  UNION SELECT 'malware', 'block', 'domain:' || array_to_string(lab[greatest(1, len(lab) - 1):], '.'), 8 FROM known
  UNION SELECT 'adult', 'block', 'prefix:' || h || '/' || seg[1], 5 FROM known WHERE len(seg) > 0
  UNION SELECT 'trusted', 'allow', 'host:' || h, 2 FROM known),
dated AS (SELECT *, md5(list || '|' || pattern) AS m FROM rules),
days AS (SELECT *, DATE '2023-01-01' + {_hex(2, 3)} % 500 AS d1 FROM dated WHERE {_hex(1, 1)} < share),
days2 AS (SELECT *, d1 + 30 + {_hex(5, 3)} % 200 AS d2 FROM days),
days3 AS (SELECT *, d2 + 10 + {_hex(8, 3)} % 100 AS d3 FROM days2),
spans AS (SELECT list, verdict, pattern, d1 AS a, d2 AS z FROM days3 UNION ALL SELECT list, verdict, pattern, d3, NULL FROM days3 WHERE {_hex(11, 1)} < 8),
keyed AS (
  SELECT page_id, url, day, 'host:' || h AS k FROM hosts WHERE h <> ''
  UNION ALL SELECT page_id, url, day, 'domain:' || array_to_string(lab[i:], '.') FROM (SELECT page_id, url, day, string_split(h, '.') AS lab, unnest(range(1, len(string_split(h, '.')) + 1)) AS i FROM hosts WHERE h <> '')
  UNION ALL SELECT page_id, url, day, 'prefix:' || h || '/' || array_to_string(seg[:i], '/') FROM (SELECT page_id, url, day, h, seg, unnest(range(1, len(seg) + 1)) AS i FROM hosts WHERE h <> '')),
met AS (SELECT page_id, url, day, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(CASE verdict WHEN 'allow' THEN 2 ELSE 1 END) AS top
        FROM keyed JOIN spans ON k = pattern AND day >= a AND (z IS NULL OR day < z) GROUP BY ALL)
SELECT page_id, url, day::varchar AS day, n_captures, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists,
       CASE top WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'none' END AS verdict
FROM (SELECT page_id, url, day, count(*) AS n_captures FROM hosts GROUP BY ALL) LEFT JOIN met USING (page_id, url, day)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT page_id, strlen(html)::bigint AS n, digest, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""


def _escaped(column: str) -> str:
    from .chat import CONTROL

    out = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


def _op8() -> str:
    from .chat import BEGIN, END, TEXT, TURN

    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(BEGIN)} + sum({len(TURN + TEXT + END)} + length({_escaped("role")}) + length({_escaped("text")})))::bigint AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM t GROUP BY conv_id
"""


OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.said = y.said AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * met >= 75 * (p.n + q.n - met)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.b AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

#: Lines of any length but 0 repeat exactly; links are between lines of 20 characters or more.
OP4 = """
WITH RECURSIVE raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(0, len(parts))) AS pos, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS line FROM raw) WHERE line <> ''),
u AS (SELECT line, count(*) AS n, length(line) AS c, substr(line, 1, length(line) // 3) AS x, substr(line, length(line) // 3 + 1, length(line) // 3) AS y,
      substr(line, 2 * (length(line) // 3) + 1) AS z FROM l GROUP BY line),
links AS (
  SELECT a.line AS a, b.line AS b FROM u a JOIN u b ON a.line <> b.line AND a.c >= 20 AND b.c >= 20 AND b.c BETWEEN a.c - 2 AND a.c + 2
  WHERE (contains(b.line, a.x) OR contains(b.line, a.y) OR contains(b.line, a.z)) AND levenshtein(a.line, b.line) <= 2),
reach AS (SELECT DISTINCT a AS a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT a AS line, min(b) AS class FROM reach GROUP BY a),
t AS (SELECT l.*, n, coalesce(class, l.line) AS class FROM l JOIN u USING (line) LEFT JOIN class USING (line)),
gone AS (SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) AS k FROM t) WHERE k > 1)
SELECT doc_id, len(parts)::bigint AS n_lines, len(parts) - coalesce(lost, 0) AS n_kept, coalesce(near, 0) AS n_near, coalesce(places, '') AS dropped
FROM raw LEFT JOIN (SELECT doc_id, count(*) AS lost, count(*) FILTER (n = 1) AS near, string_agg(pos::varchar, ',' ORDER BY pos) AS places FROM gone GROUP BY doc_id) USING (doc_id)
"""

#: Exact search; the query equals it where its trees are small, as on sf0.01.
OP1 = """
WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id))
WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1, "op2_ngram_join": OP2, "op3_decontaminate": OP3, "op4_line_dedup": OP4, "op6_urls": OP6, "op7_warc": OP7, "op8_chat": _op8()}
