"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}
BLANK = r"'[\t-\r\x1c-\x20]+'"

PART = """d0 AS (SELECT p_partkey AS id, p_name AS text, CAST(p_retailprice / (SELECT max(p_retailprice) FROM part) AS FLOAT) AS w,
  [p_brand, p_type] AS tags, [p_type] AS synonyms, [left(p_name, 1) || left(split_part(p_name, ' ', 2), 1)] AS abbreviations FROM part)"""
TITLES = """d0 AS (SELECT doc_id AS id, text,
  CAST(ln(1 + n_chars) / ln(1 + (SELECT max(n_chars) FROM documents)) AS FLOAT) AS w, [lang, source] AS tags,
  CAST([] AS VARCHAR[]) AS synonyms, CAST([] AS VARCHAR[]) AS abbreviations FROM documents)"""


def tables(source: str = PART) -> str:
    """d: documents; post: postings; freq: word counts; m: the score of the scale."""
    return f"""{source}, d AS (SELECT *, lower(text) AS title, least(length(text), 65535) AS len,
  list_filter(regexp_split_to_array(lower(text), {BLANK}), lambda x: x <> '') AS ws FROM d0),
occ AS (SELECT id, unnest(list_filter(ws, lambda x: length(x) >= 3)) AS word FROM d),
post AS (SELECT DISTINCT id, word FROM occ), freq AS (SELECT word, count(*) AS n FROM occ GROUP BY word),
sc AS (SELECT (CAST(150 AS DOUBLE) - CAST(0.1 AS DOUBLE) * len + CASE WHEN len(ws) = 1 THEN 25 ELSE 0 END) * (CAST(1 AS DOUBLE) + CAST(greatest(w, CAST(0 AS FLOAT)) AS DOUBLE) * CAST(4 AS DOUBLE)) AS s FROM d),
m AS (SELECT coalesce((SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM sc) WHERE r = (SELECT count(*) FROM sc) * 99 // 100), 750.0) AS top)"""


def queries(rows: list[tuple], limit: int = 10) -> str:
    """q: the query set, prepared; a row is (qid, query, wanted tags)."""
    values = ", ".join(f"({i}, '{t}', {list(c) if c else 'CAST([] AS VARCHAR[])'})" for i, t, c in rows)
    return f"""q0(qid, query, ctx) AS (VALUES {values}),
q AS (SELECT qid, query, ctx, {limit} AS lim, lower(query) AS ql, trim(lower(query)) AS q, length(trim(lower(query))) AS n,
  list_filter(string_split(lower(query), ' '), lambda x: x <> '') AS qw FROM q0),
c AS (SELECT *, list_filter(qw, lambda x: length(x) >= 3) AS lw, list_filter(qw, lambda x: length(x) < 3) AS sw,
  CASE WHEN n <= 3 THEN 10000 WHEN n <= 5 THEN greatest(50, 3 * lim) ELSE greatest(30, 2 * lim) END AS p_cap,
  CASE WHEN n <= 3 THEN 10000 WHEN n <= 5 THEN greatest(100, 5 * lim) ELSE greatest(50, 3 * lim) END AS i_cap FROM q)"""


PREFIX = """pre AS (SELECT qid, id FROM (SELECT qid, id, p_cap, row_number() OVER (PARTITION BY qid ORDER BY w DESC, encode(title) || '\\xFF'::BLOB, id) AS r
  FROM c JOIN d ON starts_with(title, ql) WHERE len(ctx) = 0 OR list_has_any(ctx, tags)) WHERE r <= p_cap)"""
EXACT = "exa AS (SELECT qid, id FROM c JOIN d ON title = q WHERE len(ctx) = 0 OR list_has_any(ctx, tags))"
ABBREVIATION = "abb AS (SELECT DISTINCT qid, id FROM c JOIN (SELECT *, lower(unnest(abbreviations)) AS a FROM d) ON a = q WHERE len(ctx) = 0 OR list_has_any(ctx, tags))"
INFIX = """scan AS (SELECT qid, post.id, i_cap, row_number() OVER (PARTITION BY qid ORDER BY encode(word) || '\\xFF'::BLOB, post.id) AS r
  FROM c JOIN post ON starts_with(word, lw[1]) JOIN d USING (id) WHERE len(lw) = 1 AND (len(ctx) = 0 OR list_has_any(ctx, tags))),
lws AS (SELECT qid, unnest(lw) AS t, generate_subscripts(lw, 1) AS k FROM c WHERE len(lw) > 1),
many AS (SELECT qid, id FROM lws JOIN post ON starts_with(word, t) GROUP BY qid, id HAVING count(DISTINCT k) = (SELECT len(lw) FROM c WHERE c.qid = lws.qid)),
cand AS (SELECT DISTINCT qid, id FROM scan WHERE r <= 5 * i_cap UNION ALL SELECT qid, id FROM many),
inf AS (SELECT qid, id FROM (SELECT qid, id, i_cap, row_number() OVER (PARTITION BY qid ORDER BY w DESC, id) AS r FROM cand JOIN c USING (qid) JOIN d USING (id)
  WHERE (len(ctx) = 0 OR list_has_any(ctx, tags)) AND len(list_filter(sw, lambda s: len(list_filter(ws, lambda x: starts_with(x, s))) = 0)) = 0) WHERE r <= i_cap)"""
RANK = """src AS (SELECT qid, id, 'p' AS s FROM pre UNION ALL SELECT qid, id, 'e' FROM exa UNION ALL SELECT qid, id, 'i' FROM inf UNION ALL SELECT qid, id, 'a' FROM abb),
flag AS (SELECT qid, id, bool_or(s = 'e') AS ex, bool_or(s IN ('p', 'e')) AS ti, bool_or(s = 'i') AS ins, bool_or(s = 'a') AS ab FROM src GROUP BY qid, id),
raw AS (SELECT qid, id, lim, len, CASE WHEN ex THEN 'exact' WHEN ab THEN 'abbreviation' WHEN ti THEN 'prefix' ELSE 'infix' END AS kind,
  (CASE WHEN ex THEN CAST(150 AS DOUBLE) WHEN ti OR (ab AND NOT ins) THEN 90 ELSE 30 END - CAST(len AS DOUBLE) * CAST(0.1 AS DOUBLE)
   + CASE WHEN strpos(q, ' ') = 0 AND len(ws) <> 1 AND EXISTS (SELECT 1 FROM post WHERE post.word = q AND post.id = flag.id) THEN 25 ELSE 0 END)
  * CAST(CAST(1 AS FLOAT) + greatest(w, CAST(0 AS FLOAT)) * CAST(4 AS FLOAT) AS DOUBLE) AS x FROM flag JOIN c USING (qid) JOIN d USING (id)),
hit AS (SELECT qid, id, kind, least(x / (SELECT top FROM m), 1.0) AS score, row_number() OVER (PARTITION BY qid ORDER BY x DESC, len, id) AS r, lim FROM raw)"""


def ranked(rows: list[tuple], limit: int = 10, source: str = PART, fetch: int | None = None) -> str:
    """Common table expressions that end in hit(qid, id, kind, score, r)."""
    return ",\n".join([tables(source), queries(rows, fetch or limit), PREFIX, EXACT, ABBREVIATION, INFIX, RANK])


def hits(rows: list[tuple], limit: int = 10, source: str = PART, fetch: int | None = None, f32: bool = False) -> str:
    score = "CAST(CAST(score AS FLOAT) AS DOUBLE)" if f32 else "score"
    return f"WITH {ranked(rows, limit, source, fetch)} SELECT CAST(qid AS BIGINT) AS qid, CAST(r AS INTEGER) AS rank, id, round({score}, 6) AS score, kind FROM hit WHERE r <= {limit}"
