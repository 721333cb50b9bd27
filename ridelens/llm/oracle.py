"""DuckDB SQL for the queries of this package that SQL can express, each written from the
query's definition alone; constants are written out here once more."""

from __future__ import annotations

from importlib import resources

# Words are runs of characters other than blank and \x09-\x0D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
link AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same
  FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9
),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
per_doc AS (SELECT x, count(*) AS n_links, min(y) FILTER (same) AS copy FROM link GROUP BY x)
SELECT w.doc_id, least(w.doc_id, coalesce(copy, w.doc_id)) AS copy_of,
       least(w.doc_id, coalesce(low.y, w.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN per_doc ON per_doc.x = w.doc_id LEFT JOIN low ON low.x = w.doc_id
"""

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
first AS (SELECT s, min(doc_id) AS doc_id FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j
  FROM (SELECT win.doc_id, i FROM win JOIN first USING (s) WHERE first.doc_id < win.doc_id)
),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
  FROM words LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

PREFERENCE_FORMAT = """
WITH t AS (
  SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, ((conv_id % 2) + 2) % 2 AS side,
         list(DISTINCT {'turn': turn, 'role': role, 'text': text}) AS raw
  FROM conversations GROUP BY ALL
),
s AS (SELECT pair_id, side, list_sort(raw) AS turns FROM t),
p AS (SELECT pair_id, c.turns AS c, r.turns AS r FROM (FROM s WHERE side = 0) c JOIN (FROM s WHERE side = 1) r USING (pair_id)),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1),
              lambda i: c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1,
              least(len(c), len(r))) AS n
  FROM p
),
turns AS (
  SELECT pair_id, side, i, n, x.role AS role,
    '<|im_start|>' || coalesce(x.role, '') || chr(10) AS head,
    '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM (
    SELECT pair_id, n, 'c' AS side, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM n
    UNION ALL SELECT pair_id, n, 'r', unnest(r), unnest(range(1, len(r) + 1)) FROM n
  )
),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) FILTER (i > n) OVER (PARTITION BY pair_id, side ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM turns
)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(rendered, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off + length(rendered) AS BIGINT) AS VARCHAR), ',' ORDER BY i)
    FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off + length(rendered) AS BIGINT) AS VARCHAR), ',' ORDER BY i)
    FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (
  SELECT row_number() OVER () AS k, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT h.k, first(rh || rp ORDER BY length(rh || rp) DESC, length(rh) DESC, rh DESC, rp DESC, v DESC) AS rule,
         first(v ORDER BY length(rh || rp) DESC, length(rh) DESC, rh DESC, rp DESC, v DESC) AS verdict
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY h.k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (k)
"""

_TEXTS = resources.files(__package__) / "license_texts"


def _license_scan() -> str:
    """The four notice lines, and the license texts of ``license_texts/`` as ``<name> text``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = [(f.name, f.read_text("utf-8")) for f in _TEXTS.iterdir() if f.name.endswith(".txt")]
    values = ",\n  ".join(f"({quoted(name[:-4] + ' text')}, {quoted(text)})" for name, text in sorted(texts))
    return rf"""
WITH lines(license, text) AS (VALUES
  ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  ('MIT', 'Released under the MIT License.'),
  {values}),
lw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM lines),
ls AS (SELECT DISTINCT license, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT license, ws, unnest(range(1, len(ws) - 3)) AS i FROM lw)),
total AS (SELECT license, count(*) AS n FROM ls GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw WHERE len(ws) > 4)),
found AS (
  SELECT doc_id, license FROM ds JOIN ls USING (s) JOIN total USING (license) GROUP BY doc_id, license, n HAVING count(*) >= 0.8 * n
),
per_doc AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses
FROM documents d LEFT JOIN per_doc p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
"""


LICENSE_SCAN = _license_scan()

# Rows without a null vector, null component or non-finite component.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _vector_codes(rounds: int = 4) -> str:
    """One pair of relations (assignment, next codebook) for each round."""
    steps = []
    for k in range(rounds + 1):
        # Smallest distance first, then the lower entry; distances are whole numbers.
        steps.append(f"""
a{k} AS (
  SELECT rid, pos, v // 256 AS d, v % 256 AS e
  FROM (
    SELECT rid, p.pos, min(CAST(norm - 2 * list_inner_product(p.part, c.part) + list_inner_product(c.part, c.part) AS BIGINT) * 256 + e) AS v
    FROM p JOIN c{k} c USING (pos) GROUP BY rid, p.pos
  )
)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT pos, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS part
  FROM (
    SELECT pos, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT pos, e, unnest(part) AS x, unnest(range(len(part))) AS j FROM a{k} JOIN p USING (rid, pos)) GROUP BY ALL
  ) GROUP BY pos, e
),
c{k + 1} AS (SELECT pos, e, coalesce(m.part, c.part) AS part FROM c{k} c LEFT JOIN m{k} m USING (pos, e))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE {_FINITE}
),
q AS (SELECT rid, unnest(range(4)) AS pos, v FROM k),
p AS (
  SELECT rid, pos, part, list_inner_product(part, part) AS norm
  FROM (SELECT rid, pos, v[pos * len(v) // 4 + 1 : (pos + 1) * len(v) // 4] AS part FROM q)
),
c0 AS (SELECT pos, rid - 1 AS e, part FROM p WHERE rid <= 256),{','.join(steps)},
done AS (
  SELECT rid, string_agg(lpad(to_hex(CAST(e AS BIGINT)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rid
),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, j)) AS h
  FROM (SELECT pos, e, unnest(part) AS x, unnest(range(len(part))) AS j FROM c{rounds})
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM books) AS codebooks_sha256
FROM k JOIN done USING (rid)
"""


VECTOR_CODES = _vector_codes()

ARCHIVES = """
WITH r AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth, first(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first_id FROM r
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND nth > 1 THEN first_id END AS refers_to
FROM f
"""

HARD_NEGATIVES = f"""
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, pos.vec_id AS positive_id, s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, pos.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
