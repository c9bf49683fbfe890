"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from plumbline.llm.secrets import RULES

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def secrets_sql() -> str:
    """Spans from the pieces between matches: a match starts where all pieces and matches before it end."""
    value = """regexp_extract(m[i], '["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)$', 1)"""
    kinds = []
    for k, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        least = f"length({value}) >= {rule.least}" if rule.of_value else f"length(m[i]) >= {rule.least}"
        kinds.append(f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (SELECT doc_id, m, i,
          list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM d)))
          WHERE {least}""")
    count = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}"
    line = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(kinds)})
    SELECT d.doc_id, {count('assign')}, {count('access')}, {count('hex')}, sha256(coalesce({line} FILTER (WHERE k < 3), '')) AS base_sha256, coalesce({line} FILTER (WHERE kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
t AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
x AS (SELECT DISTINCT doc_id, hash(s) AS h, s FROM t), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

RECOMPRESSION = f"""WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k, lead(pos, 19) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS whole FROM t),
r AS (SELECT doc_id, pos, word, whole AND row_number() OVER (PARTITION BY k, whole ORDER BY doc_id, pos) > 1 AS again FROM k),
g AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY ALL)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)"""

ORACLE_SQL = {"op2_secret_scan": secrets_sql(), "op4_jaccard_join": JACCARD, "op7_recompression": RECOMPRESSION}
