"""Raw rows to clean states: right rows, and no second pass over the raw files."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import chain
from flowloom.schema import ATTACK, BENIGN, DST_PORT, LABEL, PROTOCOL, RAW_COLUMNS, TIMESTAMP


def raw_rows(spark, label=ATTACK):
    """Four distinct rows of 40, one of them without a time, and a repeated header."""
    cell = lambda i, x: {TIMESTAMP: "no time" if i == 3 else f"0{i + 1}/01/2024 00:00:00", LABEL: label if i == 1 else BENIGN, PROTOCOL: "6", DST_PORT: str(i)}.get(x, str(i))
    rows = [tuple(cell(i % 4, x) for x in RAW_COLUMNS) for i in range(40)] + [tuple(RAW_COLUMNS)] * 2
    return spark.createDataFrame(rows, ", ".join(f"`{x}` string" for x in RAW_COLUMNS))


def test_raw_rows_are_gone_through_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    raw = raw_rows(spark)
    states = chain.clean_states(raw.mapInArrow(count, raw.schema), [BENIGN, ATTACK])
    got = states.select("dst_port", "label", F.col("timestamp").cast("string").alias("t"), "Protocol_6").collect()
    assert sorted(map(tuple, got)) == [(0, BENIGN, "2024-01-01 00:00:00", 1), (1, ATTACK, "2024-01-02 00:00:00", 1), (2, BENIGN, "2024-01-03 00:00:00", 1)]
    assert read.value == 42, read.value


def test_unexpected_label(spark):
    with pytest.raises(ValueError, match="unexpected labels"):
        chain.clean_states(raw_rows(spark, "Other"), [BENIGN, ATTACK])
