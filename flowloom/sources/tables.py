"""Table sources and sinks: CSV days, Parquet stages, JSON reports, parameters."""

from __future__ import annotations

import csv
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_COLUMNS
from ..session import checkpoint_dir


def staging_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written stage: in the shared folder of the cluster, or a local one in local mode."""
    shared = checkpoint_dir(spark)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="spark-") + f"/{name}"


#: Holds the whole line where it has too few or too many fields.
CORRUPT = "_corrupt_line"


def located(path: str):
    """File system and name of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` by their header line. One job for any number of files: tasks read the first line of each, and
    files of one header come back together; their names go to the CSV reader."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path")

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = []
            for name in b["path"]:
                system, inner = located(name)
                with system.open_input_stream(inner) as f:
                    block, line = b"", b""
                    while b"\n" not in line and (block := f.read(1 << 16)):
                        line += block
                lines.append(line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace") if line else None)
            yield pd.DataFrame({"path": b["path"], "line": lines})

    groups = listed.mapInPandas(first_lines, "path string, line string").where("line IS NOT NULL").groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("files"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in groups.collect():
        names = tuple(x.strip() for x in next(csv.reader([row.line.removeprefix("\ufeff")])))
        found[names] = sorted([*found.get(names, []), *row.files])
    return found


def read_flow_csv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """A day folder (or a tree of capture_day=… folders) of flow CSV files, as text: nothing is inferred.

    Columns are bound by the header of each file, whatever its order; surplus columns are left out, a missing or
    repeated one fails with the file's name. Lines with another number of fields than their header are kept
    with their whole text in ``_corrupt_line``: ``good_rows`` and ``rejected_lines`` part the two.
    """
    groups = csv_headers(spark, path)
    for names, files in groups.items():
        wrong = [x for x in columns if names.count(x) != 1]
        if wrong:
            raise ValueError(f"{files[0]}: columns missing or repeated: {wrong}")
    out = None
    for names, files in groups.items():
        unique = [n if names.count(n) == 1 else f"{n} {i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*unique, CORRUPT]])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        # without pruning a line's fields are counted whichever columns are asked for
        part = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("basePath", path).csv(files)
        days = [x for x in part.columns if x not in unique and x != CORRUPT]
        part = part.select(*[F.col(f"`{x}`") for x in [*columns, *days]], CORRUPT)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in [*columns, CORRUPT]]))
    return out


def good_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_lines(raw: DataFrame) -> DataFrame:
    """Unreadable lines as they stand in the file.

    Spark refuses a plan that reads nothing but the corrupt-line column, so the condition looks at a second one.
    """
    both = F.length(F.concat_ws("", CORRUPT, F.col(f"`{raw.columns[0]}`"))) >= 0
    return raw.where(F.col(CORRUPT).isNotNull() & both).select(F.col(CORRUPT).alias("line"))



def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """Metric rows as JSON lines. Reports are aggregates of a few rows, so one file is fine."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_params(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def reload_check(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes a stage, reads it back and compares the row counts."""
    spark = df.sparkSession
    write_stage(df, path, partition_by)
    written = df.agg(F.count(F.lit(1)).alias("rows_before"))
    again = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_after"))
    return written.crossJoin(F.broadcast(again)).withColumn("equal", F.col("rows_before") == F.col("rows_after"))


def tag_days(days: dict[str, DataFrame], registry: DataFrame) -> DataFrame:
    """Several day tables in one, tagged with their day and the role and caveat of a small day registry."""
    out = None
    for day, df in days.items():
        part = df.withColumn("capture_day", F.lit(day))
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(registry), "capture_day", "left")
