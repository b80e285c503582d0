"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = (
    f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT r, i, n, list_slice(w, i, i + n - 1) AS win
    FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT len(win) AS n FROM bw)
    )
),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (win)),
places AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS place FROM hits),
items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
),
counts AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counts USING (r) LEFT JOIN items USING (r)
"""

VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
linked AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e)
          / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
),
groups AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN groups USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_HOST = f"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = "regexp_replace(trim(url), '(?s)#.*$', '')"
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["'']?([^"''\s>]+)"""
_META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>"""
_META_URL = r"""(?is)\burl\s*=\s*["'']?([^"''\s>;]+)"""

#: Aliases with absolute addresses, the only ones a table of whole pages needs to follow here.
URLS = f"""
WITH RECURSIVE rules AS (
    SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        AS t(verdict, host, path)
),
links AS (
    SELECT {_NODE} AS a, unnest([
        regexp_extract(regexp_extract(html, '{_LINK}'), '{_HREF}', 1),
        regexp_extract(regexp_extract(html, '{_META}'), '{_META_URL}', 1)]) AS url
    FROM pages
),
edges AS (SELECT a, {_NODE} AS b FROM links WHERE url LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (
    SELECT DISTINCT node AS url FROM (SELECT a AS node FROM both_ways UNION SELECT {_NODE} FROM pages)
),
judged AS (
    SELECT url, {_HOST} AS host, {_PATH} AS path FROM nodes
),
ruled AS (
    SELECT j.url AS node, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
           max_by(r.verdict, length(r.host || r.path)) AS verdict
    FROM judged j JOIN rules r
      ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
    GROUP BY j.url
),
blocked AS (
    SELECT node FROM ruled WHERE verdict = 'block'
    UNION
    SELECT both_ways.b FROM blocked JOIN both_ways ON blocked.node = both_ways.a
),
pages_in AS (SELECT page_id, url, {_NODE} AS node FROM pages)
SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path, rule,
       coalesce(verdict, CASE WHEN node IN (SELECT node FROM blocked) THEN 'block' END, 'allow')
           AS verdict
FROM pages_in LEFT JOIN ruled USING (node)
"""

_ESCAPED = (
    r"regexp_replace(replace({0}, '\', '\\'), '([<\[])', '\1\\', 'g')"
)
_LOSS = "coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')"

CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES
        (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(length({_LOSS}) AS BIGINT) AS loss_chars,
       sha256({_LOSS}) AS loss_sha256,
       CAST(sum(length('<|turn|><|text|><|end|>') + length({_ESCAPED.format("role")})
           + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
           AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

_TERMS = (
    f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
)

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
totals AS (
    SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
),
weighted AS (
    SELECT item_id, term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM b JOIN df USING (term), totals
),
sized AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n) // l AS m FROM d, totals WHERE len(w) > 0),
scored AS (
    SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM weighted JOIN tf USING (term) JOIN sized USING (r) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER)
           AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES = {
    "op4_decontamination": CONTAMINATION,
    "op7_embeddings": VECTORS,
    "op8_urls": URLS,
    "op9_chat": CHAT,
    "op12_topk": TOP_K,
    "op13_lexical": LEXICAL,
}
