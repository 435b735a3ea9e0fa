"""Streaming forms of the telemetry operators.

They take streaming DataFrames of the shapes in ``sources.projections`` and keep
state only as long as the watermark asks for. Run with ``availableNow`` they give
what the batch operators give, but for windows that are still open at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import epoch


def tumbling_usage(samples: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(run, start, samples, cpu_peak, ram_peak) per run and window of event time."""
    w = F.window("t", every)
    agg = samples.withWatermark("t", late).groupBy("run", w.alias("w")).agg(F.count("*").alias("samples"), F.max("cpu_pct").alias("cpu_peak"), F.max("ram_used").alias("ram_peak"))
    return agg.select("run", F.col("w.start").alias("start"), "samples", "cpu_peak", "ram_peak")


def idle_sessions(samples: DataFrame, *, idle: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(pid, start, end, samples): a process's samples until it has been silent for ``idle``."""
    w = F.session_window("t", idle)
    agg = samples.withWatermark("t", late).groupBy("pid", w.alias("w")).agg(F.count("*").alias("samples"))
    return agg.select("pid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def paired_calls(entered: DataFrame, left: DataFrame, *, longest: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(call, start, ended): entries with their exits, null where none came within ``longest``."""
    a = entered.select(F.col("call"), "start").withWatermark("start", late)
    b = left.select(F.col("call").alias("b_call"), F.col("end").alias("ended")).withWatermark("ended", late)
    on = (F.col("call") == F.col("b_call")) & (F.col("ended") >= F.col("start")) & (F.col("ended") <= F.col("start") + F.expr(f"interval {longest}"))
    return a.join(b, on, "left_outer").select("call", "start", "ended")


def call_samples(calls: DataFrame, samples: DataFrame, *, width: float = 3600.0, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(call, sample): samples of a call's run within its interval.

    A stream-stream join needs an equality: time buckets of ``width`` seconds, which should be no less than the
    longest call, and each call is tried in the bucket of its start and the next.
    """
    c = calls.where(F.col("end").isNotNull()).select("call", F.col("run").alias("c_run"), "start", "end").withWatermark("start", late)
    first = F.floor(epoch(F.col("start")) / width)
    c = c.withColumn("c_bucket", F.explode(F.array(first, first + 1)))
    s = samples.select("sample", "run", "t", F.floor(epoch(F.col("t")) / width).alias("bucket")).withWatermark("t", late)
    on = (F.col("c_run") == F.col("run")) & (F.col("c_bucket") == F.col("bucket")) & (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")) & (F.col("t") <= F.col("start") + F.expr(f"interval {longest}"))
    return c.join(s, on).select("call", "sample")


def latest_progress(changes: DataFrame) -> DataFrame:
    """(job, updated, state): the last state of every job; for update or complete mode."""
    return changes.groupBy("job").agg(F.max("at").alias("updated"), F.max_by("state", "at").alias("state"))
