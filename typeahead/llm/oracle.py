"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t-\r]+'), lambda x: x <> '')"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def reached(nodes: str, edges: str) -> str:
    """reach(x, y): what links reach from each of the nodes; the edges stand both ways."""
    return f"reach(x, y) AS (SELECT id, id FROM {nodes} UNION SELECT reach.x, {edges}.v FROM reach JOIN {edges} ON {edges}.u = reach.y), least AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)"


REPEATS = f"""WITH d AS (SELECT doc_id, {SPLIT.format('text')} AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM spot),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win JOIN often USING (s)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {SPLIT.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
one AS (SELECT id, len(x) AS n, unnest(x) AS g FROM s),
pair AS (SELECT a.id AS u, b.id AS v, a.n AS m, b.n AS n, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
link AS (SELECT u, v FROM pair WHERE 100 * i >= 85 * (m + n - i)),
{reached('d', 'link')}
SELECT id AS doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM s JOIN least USING (id)"""

VECTORS = f"""WITH RECURSIVE d AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT id, label, v, sqrt(list_inner_product(v, v)) AS size FROM d WHERE label IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
link AS (SELECT a.id AS u, b.id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.size * b.size) >= CAST(0.98 AS DOUBLE)),
n AS (SELECT u AS id, count(*) AS n_links FROM link GROUP BY u),
{reached('d', 'link')}
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN n USING (id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": REPEATS,
    "op6_minhash_near_dedup": NEAR,
    "op10_embedding_near_dedup": VECTORS,
}
