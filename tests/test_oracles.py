"""A spread of registered queries against their DuckDB counterparts at the smallest scale; ``python -m
tests.oracle`` runs all of them at 0.01."""

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["drop_embedded_headers", "coerce_numeric", "dup_stats", "label_conflicts", "except_rows", "window_label_agg", "segment_gap",
         "purge_boundary", "join_offset_h", "growth_baseline", "sessionize_flows", "join_interval_match", "consistency_checks", "describe",
         "confusion_metrics", "roc_auc", "pr_auc", "trajectory_stats", "regression_extended", "stage_rules", "topk_per_row", "triage_level",
         "schema_family", "abs_rel_diff", "stream_segments", "scan_pcap",
         "version_coverage", "status_rollup", "contract_flow_table", "classify_columns", "profile_csv", "profile_labels", "provenance_tag"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    msg, _, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
