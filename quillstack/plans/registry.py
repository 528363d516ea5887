"""Registered queries and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contracts, oracles, structure
from . import queries as q

NAMES = """
coverage_by_item coverage_global source_copy_pairs margin_repetitions duplicate_blocks kind_counts role_inventory
upper_median_chars weighted_ratios selector_winner review_reasons context_window page_order paragraph_islands greedy_chunks
anchored_clusters first_use_numbers order_checks constraint_rules marker_ranges border_ranges missing_extra_ids response_join
one_to_one caption_parent glossary_hits set_ops_ids page_range_cover hash_pins exact_matches group_members uri_inventory
link_extract html_text word_counts heading_level json_pointer problem_ids page_split markdown_build protected_spans
placeholder_roundtrip rect_join rect_union_area gate_rollup next_actions source_gate translation_gate
""".split() + contracts.QUERIES + structure.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(next(m for m in (contracts, structure, q) if m is q or name in m.QUERIES), name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in {**oracles.ORACLES, **contracts.ORACLES, **structure.ORACLES}.items() if name in NAMES}
