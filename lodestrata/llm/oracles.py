"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

#: Rows of equal id and text are one document, hence the distinct.
OP8 = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
     split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM docs),
     win AS (
       SELECT doc_id, text, i AS line, lines[i + 1] AS a, lines[i + 2] AS b, lines[i + 3] AS c
       FROM split, unnest(range(0, len(lines) - 2)) AS t(i)
     ),
     ranked AS (
       SELECT doc_id, text, line, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, text, line) AS n FROM win
     ),
     gone AS (SELECT DISTINCT doc_id, text, line + k AS line FROM ranked, unnest([0, 1, 2]) AS t(k) WHERE n > 1),
     flat AS (SELECT doc_id, text, i AS line, lines[i + 1] AS s FROM split, unnest(range(0, len(lines))) AS t(i)),
     kept AS (
       SELECT f.doc_id, f.text, string_agg(f.s, chr(10) ORDER BY f.line) FILTER (WHERE g.line IS NULL) AS new_text,
              count(*) AS n_lines, count(g.line) AS n_removed
       FROM flat f LEFT JOIN gone g ON f.doc_id IS NOT DISTINCT FROM g.doc_id AND f.text = g.text AND f.line = g.line
       GROUP BY f.doc_id, f.text
     )
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.new_text, '') END AS text, k.n_lines, k.n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""

SQL: dict[str, str] = {"op8_line_dedup": OP8}
