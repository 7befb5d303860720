from pyspark.sql import functions as F

from tessera.streaming import aggregates
from tests.conftest import rows


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_grouped_streams_equal_the_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type")
    parts = []
    for i in (0, 1):
        e.where(F.col("event_id") % 2 == i).repartition(3).write.parquet(f"{tmp_path}/{i}")
        parts.append(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{i}"))
    got = drain(aggregates.grouped(parts, ["event_type"], None, "n"), "by_type", "complete")
    assert rows(got) == rows(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    got = drain(aggregates.grouped(parts[:1], ["event_type"], "event_id", "s"), "sums", "complete")
    assert rows(got) == rows(e.where("event_id % 2 = 0").groupBy("event_type").agg(F.sum("event_id").alias("s")))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:04:00", 1), ("2024-01-01 00:06:00", 1), ("2024-01-01 01:00:00", 2)], "ts string, k long").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    d.coalesce(1).write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/e")
    got = drain(aggregates.windowed(s, "ts", "5 minutes", ["k"], None, "n", "1 minute"), "closed", "append")
    assert [(r.k, r.n) for r in got.orderBy("start").collect()] == [(1, 2), (1, 1)]
