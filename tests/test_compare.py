"""Two versions of a table: matched keys, unmapped columns, repeated keys, odd numbers; attribution as evidence; provenance."""

import math

import pytest
from pyspark.sql import functions as F

from flowloom.operators import compare as cp
from flowloom.operators import flows as fl
from flowloom.operators import triage as tr


def _versions(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0, 2.0), (2, math.inf, 5.0, 3.0), (3, math.nan, 5.0, 4.0), (4, 10.0, None, 5.0), (5, 7.0, 7.0, 7.0)], "k int, x double, y double, z double")
    b = spark.createDataFrame([(1, 1.0, 5.0000004), (2, -math.inf, 6.0), (3, math.nan, 5.0), (4, 10.001, 5.0), (9, 0.0, 0.0), (9, 0.0, 0.0)], "k int, x double, y double")
    return a, b


def test_cells_and_status(spark):
    a, b = _versions(spark)
    causes = spark.createDataFrame([("q", "none")], "feature string, cause string")
    rows = {(r["k"], r["feature"]): r for r in cp.with_status(cp.cell_differences(cp.paired_cells(a, b, ["k"], ["x", "y", "z"])), causes).collect()}
    assert len(rows) == 12 and {k for k, _ in rows} == {1, 2, 3, 4}
    status = {k: r["status"] for k, r in rows.items()}
    assert all(status[k, "z"] == "NOT_REPRODUCIBLE" and rows[k, "z"]["abs_diff"] is None for k in (1, 2, 3, 4))
    assert [status[k, "x"] for k in (1, 2, 3, 4)] == ["VALIDATED"] * 3 + ["PARTIALLY_VALIDATED"]
    assert [status[k, "y"] for k in (1, 2, 3, 4)] == ["PARTIALLY_VALIDATED", "UNVALIDATED", "VALIDATED", "UNVALIDATED"]
    rolled = {r["feature"]: r["status"] for r in cp.status_rollup(cp.with_status(cp.cell_differences(cp.paired_cells(a, b, ["k"], ["x", "y", "z"])), causes)).collect()}
    assert rolled == {"x": "PARTIALLY_VALIDATED", "y": "UNVALIDATED", "z": "NOT_REPRODUCIBLE"}


def test_cells_are_joined_as_one_array_a_side(spark):
    a, b = _versions(spark)
    cells = cp.paired_cells(a, b, ["k"], ["x", "y", "z"])
    plan = cells._jdf.queryExecution()
    assert "explode([[0,x,true]" in plan.optimizedPlan().toString()  # a fixed list, nothing is built per row
    assert "BroadcastHashJoin" not in plan.executedPlan().toString()  # an array's size is not known to the planner
    assert sorted((r["k"], r["left_value"], r["right_value"]) for r in cells.where("feature = 'z'").collect()) == [(1, 2.0, None), (2, 3.0, None), (3, 4.0, None), (4, 5.0, None)]


def test_coverage(spark):
    a, b = _versions(spark)
    assert tuple(cp.key_coverage(a, b, ["k"]).first()) == (4, 1, 1, 1)
    assert tuple(cp.key_coverage(a.limit(0), b.limit(0), ["k"]).first()) == (0, 0, 0, 0)


def test_before_after_leaves_unmapped_columns_out(spark):
    a, b = _versions(spark)
    got = {r["feature"]: r["rows_differing"] for r in cp.before_after(a, b, ["k"], ["x", "y", "z"], []).collect()}
    assert got == {"x": 2, "y": 2}


def test_attribution_raises_evidence(spark):
    p = spark.createDataFrame([(i, 1, 0.9) for i in (1, 2)], "sequence_id int, horizon int, p double")
    st = spark.createDataFrame([(1, "Impact", 10.0), (2, "Impact", 10.0)], "sequence_id int, primary_stage string, primary_score double")
    why = spark.createDataFrame([(1,), (1,)], "sequence_id int")
    got = {r["sequence_id"]: r["evidence_quality"] for r in tr.triage(tr.triage_inputs(p, st, attribution=why), F.col("attribution_available")).collect()}
    assert got == {1: "HIGH", 2: "MEDIUM"}


def test_unknown_provenance(spark):
    with pytest.raises(ValueError, match="unknown provenance"):
        fl.with_provenance(spark.range(1), "guess")
