"""The CSV source: files bound by their headers, in a number of jobs that does not depend on the number of files."""

import duckdb

from flowloom.schema import RAW_COLUMNS
from flowloom.sources import tables as tb
from .oracle import compare


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


def test_headers_of_many_files(spark, tmp_path):
    turned = [*RAW_COLUMNS[5:], "More", *RAW_COLUMNS[:5]]
    for i in range(300):
        day = tmp_path / f"capture_day={i % 3}"
        day.mkdir(exist_ok=True)
        names = turned if i % 2 else RAW_COLUMNS
        end = "\r\n" if i % 7 == 0 else "\n"
        (day / f"{i}.csv").write_text(("﻿" if i % 5 == 0 else "") + ",".join(names) + end + ",".join(f"{i}" for _ in names) + end, newline="")
    (tmp_path / "capture_day=0" / "empty.csv").write_text("")
    few, more = tmp_path / "few", None
    few.mkdir()
    (few / "a.csv").write_text(",".join(RAW_COLUMNS) + "\n")
    _, one = jobs_of(spark, "one", lambda: tb.csv_headers(spark, str(few)))
    found, many = jobs_of(spark, "many", lambda: tb.csv_headers(spark, str(tmp_path / "capture_day=*")))
    assert {k: len(v) for k, v in found.items()} == {tuple(RAW_COLUMNS): 150, tuple(turned): 150}
    assert many <= one + 1, (one, many)
    rows = tb.good_rows(tb.read_flow_csv(spark, str(tmp_path / "capture_day=1"))).collect()
    assert sorted(int(r["Label"]) for r in rows) == list(range(1, 300, 3)) and all(r["Dst Port"] == r["Label"] for r in rows)


def test_scan_keeps_rows_with_negative_or_missing_numbers(spark, tmp_path):
    from flowloom.plans import catalog

    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT CAST(e AS BIGINT) AS event_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, 7 + abs(coalesce(e, 9)) AS user_id, 'view' AS event_type, 1.0E0 AS value,
        '{"k": 20}' AS props FROM (VALUES (-3), (-2), (-1), (0), (1), (2), (NULL)) t(e)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    for name, n in (("scan_csv_flows", 7), ("scan_csv_chunked", 1)):
        message, _, ok = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
        assert ok and message == f"ok n={n}", message
