"""Distinct numbers by typed keys: long numbers that are equal as doubles, signed zeros, NULL and NaN."""

import math

from flowloom.operators import profiling as pf


def test_distinct_numbers(spark):
    big = 2**60
    rows = [(big, 0.0, 1), (big + 1, -0.0, 1), (None, math.nan, None), (big, math.inf, 2), (3, None, 3)]
    df = spark.createDataFrame(rows, "a long, b double, c int").repartition(3)
    got = {r.column_name: r.num_unique for r in pf.distinct_numbers(df, ["a", "b", "c"]).collect()}
    assert got == {"a": 3, "b": 2, "c": 3}
    whole = {r.column_name: (r.num_unique, r.missing, r.infinite) for r in pf.inventory(df, ["a", "b", "c"]).collect()}
    assert whole == {"a": (3, 1, 0), "b": (2, 2, 1), "c": (3, 1, 0)}


def test_repeat_suspects(spark):
    """All rows that repeat others, nulls included, and none of the others."""
    from flowloom.operators import dedup as dd

    df = spark.createDataFrame([(i if i < 20 else None, str(i % 7) if i < 20 else None) for i in range(23)] + [(3, "3"), (4, "other")], "a int, b string")
    got = dd.repeat_suspects(df, ["a", "b"])
    assert sorted(map(str, got.collect())) == sorted(["Row(a=3, b='3')"] * 2 + ["Row(a=None, b=None)"] * 3)
    assert dd.duplicate_stats(got, ["a", "b"]).first() == dd.duplicate_stats(df, ["a", "b"]).first()


def test_csv_profile_parses_once(spark):
    """No count of the profile goes back to the CSV files."""
    from flowloom.plans.q_profile import profile_csv

    files = profile_csv(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [x for x in files if x.endswith(".csv")]
