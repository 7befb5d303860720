"""Reading and writing tables: CSV, Parquet, named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.schema import ColumnSpec, struct

def read_csv(spark: SparkSession, path: str, columns: Sequence[ColumnSpec], *, header: bool = True, delimiter: str = ",", malformed: str = "FAILFAST") -> DataFrame:
    """A CSV file or folder under a declared schema, on any file system Spark reads (local, hdfs://, object stores).

    ``malformed``: "FAILFAST" raises on a line that doesn't fit; "DROPMALFORMED" drops it, which also drops a header that is not
    declared. The schema is never inferred, so nothing is read twice.
    """
    lines = spark.read.schema(struct(columns)).option("header", header).option("delimiter", delimiter).option("enforceSchema", True).option("mode", malformed)
    out = lines.csv(path)

    return out

def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)

def write_csv(df: DataFrame, path: str, *, header: bool = True, delimiter: str = ",", mode: str = "overwrite") -> None:
    """A folder of part files, each with a header line unless told otherwise."""
    df.write.mode(mode).option("header", header).option("delimiter", delimiter).csv(path)

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)

def write_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: str | None = None, buckets: int = 64) -> None:
    """A named table; bucketed by a key, later joins and aggregates on that key need no shuffle."""
    w = df.write.mode(mode)
    (w.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else w).saveAsTable(name)

WRITERS = {"csv": write_csv, "parquet": write_parquet}

def store(df: DataFrame, path: str, kind: str = "csv", **options) -> None:
    WRITERS[kind](df, path, **options)
