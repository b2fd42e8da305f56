"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licences

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((n - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= level * w AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (SELECT level FROM f WHERE NOT is_full ORDER BY cap / w, n LIMIT 1) END AS target FROM f),
k AS (SELECT *, md5('mix-1' || doc_id::VARCHAR) AS key, len(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, key) AS nth FROM k),
o AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.nth,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix-1/' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * nth + u) - floor(rate * (nth - 1) + u)) * size)::BIGINT AS taken FROM o
"""



URLS = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_at,
                  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host FROM pages),
n AS (SELECT pattern, md5(pattern) AS h FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS pattern FROM p WHERE host IS NOT NULL)),
m AS (SELECT pattern, CASE WHEN substr(h, 8, 1) < '8' THEN 'spam' ELSE 'adult' END AS category, substr(h, 7, 1) < '8' AS again,
             ('0x' || substr(h, 3, 2))::INT AS a, ('0x' || substr(h, 3, 2))::INT + ('0x' || substr(h, 5, 2))::INT + 1 AS b
      FROM n WHERE substr(h, 1, 1) < '4' OR pattern = 'cheap-pills.example.net'),
i AS (SELECT pattern, category, DATE '2024-01-01' + a AS f, DATE '2024-01-01' + b AS t FROM m
      UNION ALL SELECT pattern, category, DATE '2024-01-01' + b + 30, NULL FROM m WHERE again),
x AS (SELECT p.page_id, i.pattern, i.category FROM p JOIN i
      ON (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)) AND i.f <= p.fetched_at AND (i.t IS NULL OR p.fetched_at < i.t)),
g AS (SELECT page_id, count(*) AS n_active, arg_min(pattern, (-length(pattern), category, pattern)) AS pattern, arg_min(category, (-length(pattern), category, pattern)) AS category FROM x GROUP BY page_id)
SELECT p.page_id, p.host, g.page_id IS NOT NULL AS blocked, g.pattern, g.category, coalesce(n_active, 0)::BIGINT AS n_active
FROM p LEFT JOIN g USING (page_id)
"""


def licences_sql() -> str:
    rows = ", ".join("('{}', [{}], {}, {})".format(n, ", ".join(f"'{x}'" for x in b), w - 1, licences.block(w)) for n, b, w in licences.template_bigrams(licences.TEMPLATES))
    split = f"string_split(trim(regexp_replace(translate(unit, '{licences.UPPER}', '{licences.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t(name, grams, width, block) AS (VALUES {rows}),
whole AS (SELECT doc_id, {pairs} AS p FROM (SELECT doc_id, {split} AS w FROM (SELECT doc_id, text AS unit FROM documents))),
line AS (SELECT doc_id, {pairs} AS p FROM (SELECT doc_id, {split} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents))),
spot AS (SELECT doc_id, unnest(p) AS gram, generate_subscripts(p, 1) - 1 AS i FROM whole),
known AS (SELECT name, unnest(grams) AS gram, width, block FROM t),
start AS (SELECT doc_id, name, any_value(width) AS width, min(i) AS i FROM spot JOIN known USING (gram) GROUP BY doc_id, name, i // block),
unit AS (SELECT doc_id, name, p[i + 1 : i + width] AS p FROM start JOIN whole USING (doc_id)
         UNION ALL SELECT doc_id, name, p FROM (FROM whole UNION ALL FROM line), t WHERE list_has_any(p, grams)),
d AS (SELECT doc_id, name, len(grams) AS size, 2.0::DOUBLE * len(list_intersect(list_distinct(p), grams)) / (len(list_distinct(p)) + len(grams)) AS dice FROM unit JOIN t USING (name)),
m AS (SELECT doc_id, name, size, max(dice) AS dice FROM d WHERE dice >= {licences.THRESHOLD} GROUP BY doc_id, name, size),
g AS (SELECT doc_id, arg_min(name, (-dice, -size, name)) AS licence, max(dice) AS dice, count(*) AS n_matches FROM m GROUP BY doc_id)
SELECT doc_id, licence, dice, coalesce(n_matches, 0)::BIGINT AS n_matches FROM documents LEFT JOIN g USING (doc_id)
"""


JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op6_urls": URLS, "op8_licences": licences_sql(), "op9_vectors": VECTORS, "op10_jaccard": JACCARD}
