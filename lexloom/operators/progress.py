"""Progress of jobs from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """(job_id, phase, completed, total): the last report of each phase by time; of reports of one instant the one that arrived last."""
    at = F.struct("ts", "arrived_at", F.coalesce("completed", F.lit(-1)), F.coalesce("total", F.lit(-1)))
    last = F.max_by(F.struct("completed", "total"), at)
    return events.distinct().groupBy("job_id", "phase").agg(last.alias("x")).select("job_id", "phase", "x.completed", "x.total")


def running_totals(events: DataFrame) -> DataFrame:
    """(job_id, ts, phase, so_far): the most completed in a phase up to each report."""
    w = Window.partitionBy("job_id", "phase").orderBy("ts", "arrived_at").rowsBetween(Window.unboundedPreceding, 0)
    return events.distinct().select("job_id", "phase", F.unix_micros("ts").alias("ts_us"), F.unix_micros("arrived_at").alias("arrived_us"), F.max("completed").over(w).alias("so_far"))


def lateness(events: DataFrame) -> DataFrame:
    """(phase, events, late): reports and those that arrived over an hour after their time."""
    late = (F.unix_micros("arrived_at") - F.unix_micros("ts")) > 3_600_000_000
    return events.distinct().groupBy("phase").agg(F.count("*").alias("events"), F.sum(late.cast("long")).alias("late"))


def latest_rows(events: DataFrame) -> DataFrame:
    """The whole last report of each job and phase, with all its columns."""
    at = F.struct("ts", "arrived_at", F.coalesce("completed", F.lit(-1)), F.coalesce("total", F.lit(-1)))
    return events.groupBy("job_id", "phase").agg(F.max_by(F.struct(*events.columns), at).alias("x")).select("x.*")
