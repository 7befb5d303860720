"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the session's own checkpoint folder. Only where driver and executors are
    one process (tests) is a temporary folder taken."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if top is None:
        if held.isDefined():
            top = held.get()
        elif sc._jsc.sc().isLocal():
            top = tempfile.mkdtemp(prefix="tessera-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not held.isDefined():
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed (on a cluster: install it or pass --py-files)."""
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), top)))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that operators have stored; for when their results have been read or written elsewhere."""
    remove(spark, f"{shared_dir(spark)}/tables")


class Scratch:
    """Tables that are needed only until the block ends; nothing that is still lazy then may read them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.top = spark, label, new_path(spark, label)

    def __enter__(self) -> "Scratch":
        return self

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        return stored(df, label, f"{self.top}/{label}-{uuid.uuid4().hex[:8]}")

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.top)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id and the text (and ``more``), under fixed names, whatever else ``docs`` carries."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it a name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that no more texts than these are Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[tuple]], schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow for row producers: ``fn(batch)`` yields tuples in the order of ``schema``; at most ``rows`` are held."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in sliced(batches):
            for row in fn(batch):
                held.append(row)
                if len(held) >= rows:
                    yield to_batch(held, out)
                    held = []
        if held:
            yield to_batch(held, out)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver only: the DDL is read by Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n
