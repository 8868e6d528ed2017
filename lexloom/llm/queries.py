"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import duplicates, languages, leaks, lookalike, packing, pages, pairs, toxicity, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lookalike.p1_found,
        "p1_classes": lookalike.p1_classes,
        "p1_consistent": lookalike.p1_consistent,
        "p2_found": pages.p2_found,
        "p2_repaired": pages.p2_repaired,
        "p3_found": pairs.p3_found,
        "p3_rates": pairs.p3_rates,
        "p4_found": languages.p4_found,
        "p4_segments": languages.p4_segments,
        "p5_found": duplicates.p5_found,
        "p5_classes": duplicates.p5_classes,
        "p6_found": truncation.p6_found,
        "p6_rates": truncation.p6_rates,
        "p7_containers": packing.p7_containers,
        "p7_fill": packing.p7_fill,
        "p8_found": leaks.p8_found,
        "p8_overlaps": leaks.p8_overlaps,
        "p8_items": leaks.p8_items,
        "p9_found": toxicity.p9_found,
        "p9_rates": toxicity.p9_rates,
    }


_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""


def oracle_sql() -> dict[str, str]:
    """Leaks are an exact condition that SQL can state; the other problems are tested in tests/llm."""
    return {
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
        "p8_items": _LEAKS + "SELECT item_id, count(*) AS documents FROM leaks GROUP BY item_id",
    }
