"""DuckDB's SQL for the operators' results where SQL can express them: plain, and quadratic where the operators are not."""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') AS phrase FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(words) - 12))) AS i) WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM d, lengths, LATERAL (SELECT unnest(generate_series(1, len(words) - n + 1)) AS i)),
hits AS (SELECT w.doc_id, w.i, w.n, p.item_id FROM windows w JOIN phrases p ON w.n = p.n AND w.phrase = p.phrase),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(words) - 4))) AS i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN sizes m ON p.a = m.doc_id JOIN sizes n ON p.b = n.doc_id WHERE 100 * c >= 85 * (m.n + n.n - c)),
reached(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) c ON d.doc_id = c.node LEFT JOIN sizes s ON d.doc_id = s.doc_id"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, LATERAL (SELECT unnest(generate_series(0, len(h) // 2 - 50)) AS i)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM starts GROUP BY s HAVING count(DISTINCT doc_id) > 1),
covered AS (SELECT DISTINCT t.doc_id, t.i + k AS i FROM starts t JOIN firsts f ON t.s = f.s AND f.first_doc < t.doc_id, LATERAL (SELECT unnest(generate_series(0, 49)) AS k)),
bytes AS (SELECT d.doc_id, b.i, substr(h, 2 * b.i + 1, 2) AS x FROM d SEMI JOIN covered c ON d.doc_id = c.doc_id, LATERAL (SELECT unnest(generate_series(0, len(h) // 2 - 1)) AS i) b),
marked AS (SELECT y.doc_id, y.i, y.x, c.i IS NOT NULL AS gone FROM bytes y LEFT JOIN covered c ON y.doc_id = c.doc_id AND y.i = c.i),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM marked),
sums AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN opens THEN 1 END) AS n_spans, string_agg(CASE WHEN NOT gone THEN x END, '' ORDER BY i) AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN s.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256 FROM d LEFT JOIN sums s ON d.doc_id = s.doc_id"""
