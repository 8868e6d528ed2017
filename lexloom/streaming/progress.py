"""Job progress as a stream. An extension: late reports are awaited up to a bound, repeated ones count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "job_id string, phase string, completed int, total int, ts timestamp, arrived_at timestamp"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The report files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def progress_by_window(stream: DataFrame, wait: str = "2 days", window: str = "1 hour") -> DataFrame:
    """(start, phase, reports, jobs): distinct reports per window of their own time; those later than `wait` are left out."""
    once = stream.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["job_id", "phase", "ts", "completed", "total"])
    by = once.groupBy(F.window("ts", window).alias("w"), "phase").agg(F.count("*").alias("reports"), F.approx_count_distinct("job_id").alias("jobs"))
    return by.select(F.col("w.start").alias("start"), "phase", "reports", "jobs")


def latest_into(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last report of each job and phase in a folder of numbered tables; the greatest number is the current one."""

    def upsert(batch: DataFrame, number: int) -> None:
        from lexloom.operators.progress import latest_rows

        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        # Only the first batch has nothing before it; a state that is missing or can't be read later fails the stream.
        now = latest_rows(spark.read.parquet(f"{folder}/n={number - 1}").unionByName(batch) if number else batch)
        now.write.mode("overwrite").parquet(f"{folder}/n={number}")
        # The state before stays for a batch that is run again; older ones are dropped.
        files.delete(path(f"{folder}/n={number - 2}"), True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
