"""Registered queries against their SQL twins at the smallest scale.

``FACTLOOM_ALL_QUERIES=1`` runs every query; otherwise a spread of them.
"""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF = os.environ.get("FACTLOOM_SF", "/root/testdata/sf0.001")
SPREAD = [
    "corpus_coverage", "extract_symbols", "extract_requirements", "extract_cross_refs", "parse_check_results", "coverage_diff",
    "traceability_matrix", "resolve_includes", "wire_reads", "goto_definition", "find_references", "detect_patterns",
    "compute_scopes", "scoped_nct_counts", "model_summary", "property_summary", "quality_gate", "all_diagnostics", "id_diff",
    "stream_event_windows", "stream_phase_transitions", "transitive_closure", "change_impact", "change_impact_variant",
    "scan_corpus", "scan_check_log", "written_var_counts", "completeness_score", "error_groups", "failure_reasons",
    "extract_writes", "extract_nested_symbols", "extract_variant_structs", "inherited_related",
]
NAMES = list(entry.queries()) if os.environ.get("FACTLOOM_ALL_QUERIES") else SPREAD

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert result.startswith(("ok", "rows", "EMPTY")), result


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["grouping", "value", "total", "covered"]
