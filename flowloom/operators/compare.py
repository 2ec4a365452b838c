"""Cell-by-cell comparison of two versions of a flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, is_inf


def paired_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, mapped, left_value, right_value) of the keys in both versions. The join is on the row key with the columns of
    each side in one array; the unpivot comes after it, so the shuffle carries rows, not cells, and goes through a fixed list of
    features, so that a cell costs two look-ups. The planner takes an array for one value and would broadcast it, hence the
    hint. A column that the second version lacks is not mapped; keys in one version only
    are counted by ``key_coverage``."""
    have = [x in b.columns for x in columns]
    packed = lambda known: F.array(*[(F.col(f"`{x}`") if k else F.lit(None)).cast("double") for x, k in zip(columns, known)])
    j = a.select(*keys, packed([True] * len(columns)).alias("_x")).join(b.select(*keys, packed(have).alias("_y")).hint("merge"), list(keys))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("feature"), F.lit(k).alias("mapped")) for i, (x, k) in enumerate(zip(columns, have))])
    z = j.select(*keys, "_x", "_y", F.explode(names).alias("_c"))
    return z.select(*keys, "_c.feature", "_c.mapped", F.get("_x", F.col("_c.i")).alias("left_value"), F.get("_y", F.col("_c.i")).alias("right_value"))


def key_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both versions, in the first only, in the second only, and keys that a version holds more than once.
    Counts per key are added up map-side, so a repeated key is one row a task."""
    side = lambda df, left: df.select(*keys, F.lit(int(left)).alias("_l"), F.lit(int(not left)).alias("_r"))
    per = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    l, r = F.col("l"), F.col("r")
    return per.agg(F.count_if((l > 0) & (r > 0)).alias("matched"), F.count_if(r == 0).alias("left_only"), F.count_if(l == 0).alias("right_only"),
                   F.count_if((l > 1) | (r > 1)).alias("repeated"))


def cell_differences(cells: DataFrame) -> DataFrame:
    """Absolute and relative difference, exact and tolerant match. Inf equals any Inf and NaN equals NaN; such
    cells have no difference. Nothing matches a column that is not mapped."""
    x, y = F.col("left_value"), F.col("right_value")
    odd = is_inf(x) | is_inf(y) | F.coalesce(F.isnan(x), F.lit(False))
    both_inf, both_nan = is_inf(x) & is_inf(y), F.coalesce(F.isnan(x) & F.isnan(y), F.lit(False))
    diff = F.abs(x - y)
    rel = F.when(y != 0, diff / F.abs(y)).when(diff == 0, F.lit(0.0))
    exact = F.when(odd, both_inf | both_nan).otherwise(F.coalesce(diff == 0, F.lit(False)))
    near = F.when(odd, both_inf | both_nan).otherwise(F.coalesce((diff < 1e-6) | (rel < 1e-3), F.lit(False)))
    known = F.col("mapped")
    return cells.withColumns({"abs_diff": F.when(known & ~odd, diff), "rel_diff": F.when(known & ~odd, rel), "exact_match": known & exact, "tolerance_match": known & near})


def classify(exact: Column, near: Column, known: Column) -> Column:
    return F.when(exact, "VALIDATED").when(known, "UNVALIDATED").when(near, "PARTIALLY_VALIDATED").otherwise("UNVALIDATED")


def with_status(diffs: DataFrame, causes: DataFrame) -> DataFrame:
    """Adds the status; ``causes`` is a fixed table (feature, cause) of known convention differences."""
    j = diffs.join(F.broadcast(causes.select("feature", F.lit(True).alias("_known"))), "feature", "left")
    known = F.coalesce("_known", F.lit(False))
    return j.withColumn("known_cause", known).withColumn(
        "status", F.when(~F.col("mapped"), "NOT_REPRODUCIBLE").otherwise(classify(F.col("exact_match"), F.col("tolerance_match"), known))).drop("_known")


def status_rollup(rows: DataFrame) -> DataFrame:
    """Status of each feature over all its rows by precedence."""
    s = F.col("status")
    return rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.bool_and(s == "VALIDATED"), "VALIDATED").when(F.bool_or(s == "NOT_REPRODUCIBLE"), "NOT_REPRODUCIBLE")
        .when(F.bool_and(s.isin("VALIDATED", "PARTIALLY_VALIDATED")), "PARTIALLY_VALIDATED").otherwise("UNVALIDATED").alias("status"))


def before_after(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], changed: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Per column of both versions: identical within tolerance (NaN and Inf equal themselves), rows that differ, expected change."""
    x, y = F.col("left_value"), F.col("right_value")
    same = F.coalesce(x.eqNullSafe(y) | ((F.abs(x) < INF) & (F.abs(y) < INF) & (F.abs(x - y) <= tol)), F.lit(False))
    per = paired_cells(a, b, keys, columns).where("mapped").groupBy("feature").agg(F.count_if(~same).alias("rows_differing"))
    expected = F.col("feature").isin(*changed)
    return per.select("feature", "rows_differing", (F.col("rows_differing") == 0).alias("identical"), expected.alias("expected_to_change"),
                      (~expected & (F.col("rows_differing") > 0)).alias("unrelated_change"))


