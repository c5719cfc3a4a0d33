"""Queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import collocations, cotraining, cube_mixing, cutting_stock, html_lstm, hyperminhash, multiset_hash, quality_rules, repair_tokens, role_repair, url_filter, vector_codes, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_cotraining": cotraining.query,
    "op3_multiset_hash": multiset_hash.query,
    "op4_html_lstm": html_lstm.query,
    "op5_cutting_stock": cutting_stock.query,
    "op6_hyperminhash": hyperminhash.query,
    "op7_repair_tokens": repair_tokens.query,
    "op8_url_filter": url_filter.query,
    "op9_role_repair": role_repair.query,
    "op10_cube_mixing": cube_mixing.query,
    "op11_collocations": collocations.query,
    "op12_winnowing": winnowing.query,
    "op13_vector_codes": vector_codes.query,
}
#: Exact sets, pairs and reachability.
_COMPONENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS shingle
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), l AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id
), m AS (
  SELECT id, min(c) AS c FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op6_hyperminhash": _COMPONENTS, "op8_url_filter": url_filter.oracle(), "op11_collocations": collocations.ORACLE, "op12_winnowing": winnowing.ORACLE, "op13_vector_codes": vector_codes.oracle()}
