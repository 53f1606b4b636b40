"""DuckDB SQL of queries whose operators are not SQL themselves: plain
definitions of the same rows, checked on whole small tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, g.size, item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS l FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM d),
tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(r, o) AS (SELECT r, r FROM sets UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach USING (r) JOIN sets o ON o.r = reach.o GROUP BY s.r, s.doc_id, len(s.s)
"""

#: pieces and words as asked; every phrase is counted and scored plainly
COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
held AS (SELECT lang, w FROM pieces WHERE len(w) > 0),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM held GROUP BY lang),
grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM held, (VALUES (1), (2), (3)) x(k))),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS c FROM grams GROUP BY lang, k, g),
cand AS (SELECT lang, k, g, c AS a FROM f WHERE k > 1 AND c >= 10),
cuts AS (SELECT x.lang, x.k, x.g, x.a, y.k AS cut, y.c AS l, z.c AS r, CAST((1000000::HUGEINT * x.a * x.a) // (y.c::HUGEINT * z.c) AS BIGINT) AS score
  FROM cand x JOIN f y ON y.lang = x.lang AND y.k < x.k AND y.g = x.g[1:y.k] JOIN f z ON z.lang = x.lang AND z.k = x.k - y.k AND z.g = x.g[y.k + 1:x.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
wide AS (SELECT lang, w3[i:i + 1] AS g, max(a) AS a FROM (SELECT lang, g AS w3, a, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
left_over AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM best b LEFT JOIN wide x ON x.lang = b.lang AND x.g = b.g
  WHERE x.a IS NULL OR 100 * x.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def clustering(rounds: int = 5) -> str:
    """Lloyd rounds over integer vectors, as one chain of common table expressions."""
    steps, now = [], "c0"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, x.c, sum((v.x - x.x) * (v.x - x.x)) AS d FROM flat v JOIN {now} x ON x.i = v.i GROUP BY v.r, x.c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM {now} o LEFT JOIN (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN a{i} USING (r) GROUP BY c, i)) m USING (c, i))""")
            now = f"c{i + 1}"
    return """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
flat AS (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept QUALIFY c < 40),
c0 AS (SELECT c, i, x FROM starts JOIN flat USING (r)),
""" + ",\n".join(steps) + f""",
shas AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM {now} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN shas USING (c)
"""


ORACLE_SQL = {"op3_jaccard_join": JACCARD, "op8_decontaminate": DECONTAMINATION, "op12_collocations": COLLOCATIONS, "op13_clustering": clustering()}
