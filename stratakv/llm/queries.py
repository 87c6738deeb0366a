"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_AT = {
    "op1_decision_list": "quality",
    "op2_offset_preserving": "pii",
    "op3_combined_automaton": "secret_scan",
    "op4_spaced_seeds": "decontamination",
    "op5_adaptive_prefix_join": "jaccard",
    "op6_factorization_machine": "toxicity",
    "op7_katz_backoff": "katz",
    "op8_positional_rare_tokens": "licences",
    "op9_sum_of_squares_packing": "packing",
    "op10_balanced_label_propagation": "sharding",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _AT.items()}

#: The join has SQL; the other queries learn, pack, move or search in ways that SQL does not express, and the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_adaptive_prefix_join": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM texts),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reached r WHERE r.a = doc_id), doc_id)) AS component_id FROM sets
""",
}
