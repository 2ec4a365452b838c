"""Leakage between splits: planted rows are counted, whatever NULLs and copies there are."""

import math

from pyspark.sql import functions as F

from flowloom.operators import splits as sp


def test_planted_leaks_are_counted(spark):
    rows = [("train", 1.0, None), ("train", 1.0, None), ("train", 2.0, math.nan), ("test", 1.0, None), ("test", 1.0, 0.0), ("test", 2.0, math.nan),
            ("test", 2.0, None), ("validation", 3.0, 3.0), (None, 1.0, None), *[("test", 1.0, None)] * 5]
    df = spark.createDataFrame(rows, "partition string, a double, b double").withColumn("fold", F.explode(F.array(F.lit("x"), F.lit("y"))))
    got = {(r.partition, r.offending) for r in sp.shared_rows(df.where("fold = 'x'"), "partition", ["a", "b"]).collect()}
    assert got == {("test", 7), ("validation", 0)}
    per = {(r.fold, r.partition): r.offending for r in sp.shared_rows(df.where("fold = 'x' OR partition = 'test'"), "partition", ["a", "b"], ["fold"]).collect()}
    assert per == {("x", "test"): 7, ("x", "validation"): 0, ("y", "test"): 0}


def test_unusable_cells(spark):
    df = spark.createDataFrame([(1.0, None), (math.inf, -math.inf), (math.nan, 2.0)], "a double, b double")
    assert sp.unusable_cells(df, ["a", "b"]).collect() == [(2, 2)]
    assert sp.unusable_cells(df.limit(0), ["a", "b"]).collect() == [(0, 0)]
