"""DuckDB statements for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

# Sets of 5-character pieces of the letters and digits of a text, by table.
KEPT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def pieces(table: str, text: str, where: str = "true") -> str:
    return f"SELECT DISTINCT record_id, s[i:i + 4] AS g FROM (SELECT record_id, s, unnest(generate_series(1, length(s) - 4)) AS i FROM (SELECT record_id, {KEPT.format(text)} AS s FROM {table} WHERE {text} IS NOT NULL AND {where})) "


def linked(left: str, right: str, where: str) -> str:
    """(a, b): the pairs of records of two piece tables that share at least 0.6 of their pieces."""
    return f"SELECT a, b FROM (SELECT x.record_id AS a, y.record_id AS b, count(*) AS c FROM {left} x JOIN {right} y USING (g) WHERE {where} GROUP BY 1, 2) JOIN (SELECT record_id AS a, count(*) AS na FROM {left} GROUP BY 1) USING (a) JOIN (SELECT record_id AS b, count(*) AS nb FROM {right} GROUP BY 1) USING (b) WHERE c >= 0.6 * (na + nb - c)"


LINES = "SELECT record_id, source, i - 1 AS line_no, regexp_replace(lower(a[i]), '[^\\p{L}]', '', 'g') AS l FROM (SELECT record_id, source, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT record_id, source, string_split(page_content, chr(10)) AS a FROM kb_document WHERE page_content IS NOT NULL AND source IS NOT NULL))"


def oracle_sql() -> dict[str, str]:
    group = "(SELECT DISTINCT a, b FROM r WHERE a < b)"
    p1 = f"WITH RECURSIVE p AS MATERIALIZED ({pieces('kb_document', 'page_content')}), l AS MATERIALIZED ({linked('p', 'p', 'x.record_id < y.record_id')}), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
    windows = lambda kind, key, table, text, n: f"SELECT {key}, s[i:i + {n - 1}] AS w, i FROM (SELECT {key}, s, unnest(generate_series(1, length(s) - {n - 1})) AS i FROM (SELECT {key}, regexp_replace(lower({text}), '[^{kind}]', '', 'g') AS s FROM {table} WHERE {text} IS NOT NULL))"
    share = (
        f"SELECT doc_id, letters, coalesce(repeated, 0) AS repeated, coalesce(repeated, 0) / greatest(letters, 1) AS share FROM (SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) AS letters FROM documents WHERE text IS NOT NULL) "
        f"LEFT JOIN (SELECT doc_id, CAST(sum(least(20, coalesce(following - i, 20))) AS BIGINT) AS repeated FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS n FROM ({windows('\\p{L}', 'doc_id', 'documents', 'text', 20)})) WHERE n > 1) GROUP BY 1) USING (doc_id)"
    )
    leaks = f"SELECT DISTINCT doc_id, item_id FROM ({windows('\\p{L}\\p{N}', 'doc_id', 'documents', 'text', 120)}) JOIN (SELECT DISTINCT item_id, w FROM ({windows('\\p{L}\\p{N}', 'item_id', 'eval_item', 'text', 120)})) USING (w)"
    batch = "coalesce(batch_no, 2147483647)"
    return {
        "p1_found": f"{p1} SELECT a AS record_id_a, b AS record_id_b FROM {group}",
        "p2_found": f"WITH k AS MATERIALIZED ({pieces('kb_document', 'page_content')}), n AS MATERIALIZED ({pieces('incoming_document', 'page_content')}), o AS (SELECT record_id, {batch} AS t FROM incoming_document), "
        f"m AS MATERIALIZED ({linked('n', 'n', 'x.record_id <> y.record_id')}) SELECT DISTINCT record_id FROM (SELECT b AS record_id FROM ({linked('k', 'n', 'true')}) UNION ALL SELECT b FROM m JOIN o x ON x.record_id = a JOIN o y ON y.record_id = b WHERE x.t < y.t OR (x.t = y.t AND a < b))",
        "p3_found": f"WITH l AS MATERIALIZED ({LINES}), n AS (SELECT source, count(*) AS records FROM kb_document WHERE page_content IS NOT NULL AND source IS NOT NULL GROUP BY 1), f AS (SELECT source, l FROM (SELECT source, l, count(DISTINCT record_id) AS c FROM l WHERE l <> '' GROUP BY 1, 2) JOIN n USING (source) WHERE c >= 10 AND c >= 0.3 * records) SELECT record_id, CAST(line_no AS INT) AS line_no FROM l JOIN f USING (source, l)",
        "p7_found": "SELECT record_id FROM kb_document WHERE length(page_content) > 1500",
        "p8_found": leaks,
        "p8_leaked_items": f"SELECT item_id, count(*) AS documents FROM ({leaks}) GROUP BY 1",
        "p10_share": share,
        "p10_found": f"SELECT doc_id FROM ({share}) WHERE share >= 0.3",
    }
