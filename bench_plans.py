"""Naive against optimised plans of the same results, on the same rows: medians of timed runs after a warm-up.

The reference publishes no timings, so a plan is measured against the plain way of
"""

from __future__ import annotations

import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quireframe.operators import jobs, publish, stats, telemetry, text
from quireframe.sources import projections as P

RUNS = 3


def naive_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls against samples by a plain interval condition within the run."""
    s = P.samples(spark, sf).select("run", "t", "cpu_pct", "ram_used", "gpu_pct")
    c = telemetry._closed_calls(spark, sf).select("call", F.col("run").alias("c_run"), "start", "until")
    hit = c.join(s, (F.col("c_run") == F.col("run")) & F.col("t").between(F.col("start"), F.col("until")), "left")
    return hit.groupBy("call").agg(F.count("t").alias("samples"), F.round(F.avg("cpu_pct"), 4), F.max("ram_used"), F.round(F.avg("gpu_pct"), 4), F.max("gpu_pct"))


def naive_p95(spark: SparkSession, sf: str) -> DataFrame:
    """Every value ranked within its key."""
    w = W.partitionBy("event_type")
    e = P.table(spark, sf, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("n"))
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(0.95 * F.col("n"), 0).cast("long") - 1)) + 1
    return e.groupBy("event_type").agg(F.max("n"), F.max(F.when(F.col("k") == at, F.col("value"))), F.percentile("value", F.lit(0.5)), F.max("value"))


def naive_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """One window per source."""
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return P.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("image_"), F.lpad(k.cast("string"), 6, "0")), F.sha2(F.concat_ws("\x1f", "source", F.col("doc_id").cast("string"), F.lit("v1")).cast("binary"), 256))


def naive_newest(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs of a digest in order, the first kept."""
    j = P.jobs(spark, sf).where("state = 'SUCCEEDED'")
    return j.withColumn("k", F.row_number().over(W.partitionBy("dedupe").orderBy(F.desc("created"), "job"))).where("k = 1").select("dedupe", "job")


def naive_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The grammar once a row."""
    made = F.concat(F.lit(r"EQ \f("), F.col("p_size").cast("string"), F.lit(r",\r(2,"), (F.col("p_partkey") % 7).cast("string"), F.lit("))"))
    return P.table(spark, sf, "part").select("p_partkey", text.eq_latex(made)["latex"])


PAIRS: dict[str, tuple[str, Callable, str, Callable]] = {
    "call_sample_windows": ("interval condition within the run", naive_windows, "buckets by length", telemetry.call_sample_windows),
    "p95_by_rank": ("window over all values", naive_p95, "cells, then one cell sorted", stats.p95_by_rank),
    "asset_ids": ("window per source", naive_numbers, "numbers by ranges", publish.asset_ids),
    "newest_succeeded": ("row_number", naive_newest, "max_by, combined before the shuffle", jobs.newest_succeeded),
    "eq_fields": ("grammar per row", naive_fields, "grammar per distinct text", text.eq_fields),
}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(f: Callable) -> float:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            f(spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return statistics.median(took[1:])

    for name, (plain, a, better, b) in PAIRS.items():
        for plan, f in ((plain, a), (better, b)):
            print(f"| {name} | {sf.rsplit('/', 1)[-1].removeprefix('sf')} | 1 | {RUNS} | {seconds(f):.2f} | {plan} | local[{cpus}] |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
