"""Telemetry: resource samples, tool calls and model workers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import epoch, interval_join, range_totals
from ..registry import Registry
from ..sources import projections as P

R = Registry()


def _avg(name: str, alias: str):
    return F.round(F.avg(name), 4).alias(alias)


def summarize_tools(calls: DataFrame) -> DataFrame:
    """By name and action: calls, errors, unfinished calls, response times and the largest resident size at an end."""
    peak = F.greatest("rss_start", F.coalesce("rss_end", "rss_start"))
    return calls.groupBy("name", "action").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "running").alias("unfinished"),
        _avg("seconds", "seconds_avg"),
        F.max("seconds").alias("seconds_max"),
        F.max(peak).alias("rss_peak"),
    )


@R.add(f"""SELECT name, action, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'running') AS unfinished,
    round(avg(seconds), 4) AS seconds_avg, max(seconds) AS seconds_max, max(greatest(rss_start, coalesce(rss_end, rss_start))) AS rss_peak
    FROM ({P.CALLS}) GROUP BY name, action""")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_tools(P.calls(spark, sf_dir))


def closed(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Calls with the end that windows use: their own, else the run's, else the last sample's time ``now``."""
    r = runs.select("run", F.col("ended").alias("run_ended"), F.col("now"))
    return calls.join(r, "run").withColumn("until", F.coalesce("end", "run_ended", "now"))


def call_resources(calls: DataFrame, samples: DataFrame, *, width: float = 21600.0) -> DataFrame:
    """Samples of a call's run between its start and ``until``: totals of ranges for all calls, calls without samples included."""
    c = F.col
    micros = lambda n: F.unix_micros(c(n).cast("timestamp"))
    there = lambda n: c(n).isNotNull().cast("long")
    whole = {n: F.lit(-math.inf) if samples.schema[n].dataType.typeName() in ("double", "float") else F.lit(-(1 << 63)) for n in ("ram_used", "gpu_pct")}
    points = samples.select(
        "run", micros("t").alias("at"), F.lit(1).cast("long").alias("n"), there("cpu_pct").alias("cpu_n"), F.coalesce(F.round(c("cpu_pct") * 100).cast("long"), F.lit(0)).cast("long").alias("cpu"),
        there("gpu_pct").alias("gpu_n"), F.coalesce(c("gpu_pct"), F.lit(0)).alias("gpu"), there("ram_used").alias("ram_n"), *[F.coalesce(n, low).alias(f"{n}_peak") for n, low in whole.items()],
    )
    spans = calls.select("call", "run", micros("start").alias("start"), micros("until").alias("end"))
    r = range_totals(points, spans, key="run", id="call", sums=["n", "cpu_n", "cpu", "gpu_n", "gpu", "ram_n"], peaks=["ram_used_peak", "gpu_pct_peak"], width=int(width * 1_000_000))
    peak = lambda n, count: F.when(c(count) > 0, c(f"{n}_peak")).cast(samples.schema[n].dataType)
    return r.select(
        "call", c("n").alias("samples"), F.when(c("cpu_n") > 0, F.floor(c("cpu") * 100 / c("cpu_n")) / F.lit(10000.0)).alias("cpu_avg"), peak("ram_used", "ram_n").alias("ram_peak"),
        F.when(c("gpu_n") > 0, F.round(c("gpu") / c("gpu_n"), 4)).alias("gpu_avg"), peak("gpu_pct", "gpu_n").alias("gpu_peak"),
    )


_CLOSED = f"""(SELECT c.*, coalesce(c."end", r.ended, n.now) AS until FROM ({P.CALLS}) c JOIN ({P.RUNS}) r ON c.run = r.run
    JOIN (SELECT run, max(t) AS now FROM ({P.SAMPLES}) GROUP BY run) n ON n.run = c.run)"""


def _closed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = P.samples(spark, sf_dir).groupBy("run").agg(F.max("t").alias("now"))
    return closed(P.calls(spark, sf_dir), P.runs(spark, sf_dir).join(now, "run"))


@R.add(f"""WITH s AS ({P.SAMPLES}), c AS (SELECT * FROM {_CLOSED})
    SELECT c.call, count(s.sample) AS samples, floor(sum(CAST(round(cpu_pct * 100) AS BIGINT)) * 100 / CAST(count(cpu_pct) AS DOUBLE)) / 10000.0::DOUBLE AS cpu_avg, max(ram_used) AS ram_peak, round(avg(gpu_pct), 4) AS gpu_avg, max(gpu_pct) AS gpu_peak
    FROM c LEFT JOIN s ON s.run = c.run AND s.t BETWEEN c.start AND c.until GROUP BY c.call""")
def call_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_resources(_closed_calls(spark, sf_dir), P.samples(spark, sf_dir))


@R.add(f"""SELECT r.run, count(*) AS samples, round(avg(cpu_pct), 4) AS cpu_avg, max(ram_used) AS ram_peak, round(avg(gpu_pct), 4) AS gpu_avg, max(gpu_pct) AS gpu_peak,
    max(t) AS last_sample FROM ({P.RUNS}) r JOIN ({P.SAMPLES}) s ON s.run = r.run AND s.t >= r.started AND (r.ended IS NULL OR s.t <= r.ended) GROUP BY r.run""")
def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("t") >= F.col("started")) & (F.col("ended").isNull() | (F.col("t") <= F.col("ended")))
    hit = P.samples(spark, sf_dir).join(P.runs(spark, sf_dir), "run").where(inside)
    return hit.groupBy("run").agg(F.count("*").alias("samples"), _avg("cpu_pct", "cpu_avg"), F.max("ram_used").alias("ram_peak"), _avg("gpu_pct", "gpu_avg"), F.max("gpu_pct").alias("gpu_peak"), F.max("t").alias("last_sample"))


@R.add(f"""SELECT m.job, m.role, count(*) AS samples, round(avg(m.cpu_pct), 4) AS cpu_avg, max(m.rss) AS rss_peak, round(avg(s.gpu_pct), 4) AS gpu_avg,
    max(s.gpu_pct) AS gpu_peak, max(s.ram_used) AS ram_peak FROM ({P.MODELS}) m JOIN ({P.SAMPLES}) s ON s.sample = m.sample GROUP BY m.job, m.role""")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.samples(spark, sf_dir).select("sample", "gpu_pct", "ram_used")
    j = P.models(spark, sf_dir).join(s, "sample")
    return j.groupBy("job", "role").agg(F.count("*").alias("samples"), _avg("cpu_pct", "cpu_avg"), F.max("rss").alias("rss_peak"), _avg("gpu_pct", "gpu_avg"), F.max("gpu_pct").alias("gpu_peak"), F.max("ram_used").alias("ram_peak"))


def attribute_gpu(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the busiest engine's percentage summed over processes, at most 100, and the memory of all processes."""
    engine = counters.groupBy(*keys, "engine").agg(F.sum("engine_pct").alias("pct"), F.sum("dedicated_bytes").alias("bytes"))
    return engine.groupBy(*keys).agg(F.least(F.lit(100), F.max("pct")).cast("long").alias("engine_pct"), F.sum("bytes").cast("long").alias("dedicated_bytes"))


@R.add(f"""SELECT job, CAST(least(100, max(pct)) AS BIGINT) AS engine_pct, CAST(sum(b) AS BIGINT) AS dedicated_bytes FROM (
    SELECT m.job, g.engine, sum(g.engine_pct) AS pct, sum(g.dedicated_bytes) AS b FROM ({P.MODELS}) m JOIN ({P.PROCESS_GPU}) g
    ON g.sample = m.sample AND g.scope = 'worker_tree' AND g.pid = m.worker_pid GROUP BY m.job, g.engine) GROUP BY job""")
def gpu_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.process_gpu(spark, sf_dir).where("scope = 'worker_tree'")
    m = P.models(spark, sf_dir).select("sample", "job", F.col("worker_pid").alias("pid"))
    return attribute_gpu(g.join(m, ["sample", "pid"]), ["job"])


@R.add(f"""SELECT m.role, count(*) AS rows, count(DISTINCT m.sample) AS samples, max(g.engine_pct) AS engine_peak, max(g.dedicated_bytes) AS vram_peak, round(avg(g.engine_pct), 4) AS engine_avg
    FROM ({P.MODELS}) m JOIN ({P.SAMPLES}) s ON s.sample = m.sample LEFT JOIN ({P.PROCESS_GPU}) g ON g.sample = m.sample AND g.scope = 'worker_tree' AND g.pid = m.worker_pid GROUP BY m.role""")
def model_request_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.models(spark, sf_dir).withColumnRenamed("worker_pid", "pid")
    g = P.process_gpu(spark, sf_dir).where("scope = 'worker_tree'").drop("scope")
    j = m.join(P.samples(spark, sf_dir).select("sample"), "sample").join(g, ["sample", "pid"], "left")
    return j.groupBy("role").agg(F.count("*").alias("rows"), F.count_distinct("sample").alias("samples"), F.max("engine_pct").alias("engine_peak"), F.max("dedicated_bytes").alias("vram_peak"), _avg("engine_pct", "engine_avg"))


@R.add(f"""WITH s AS ({P.SAMPLES}), c AS (SELECT * FROM {_CLOSED})
    SELECT c.call, round(avg(g.engine_pct), 4) AS engine_avg, max(g.engine_pct) AS engine_peak, max(g.dedicated_bytes) AS vram_peak
    FROM c JOIN s ON s.run = c.run AND s.t BETWEEN c.start AND c.until JOIN ({P.PROCESS_GPU}) g ON g.sample = s.sample AND g.scope = 'tool_process' AND g.pid = c.pid GROUP BY c.call""")
def call_gpu_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.process_gpu(spark, sf_dir).where("scope = 'tool_process'").select("sample", "pid", "engine_pct", "dedicated_bytes")
    points = P.samples(spark, sf_dir).select("sample", "run", "t").join(g, "sample")
    spans = _closed_calls(spark, sf_dir).select("call", "run", "pid", "start", "until")
    hit = interval_join(points, spans, keys=["run", "pid"], at=epoch(F.col("t")), start=epoch(F.col("start")), end=epoch(F.col("until")), width=3600.0)
    return hit.groupBy("call").agg(_avg("engine_pct", "engine_avg"), F.max("engine_pct").alias("engine_peak"), F.max("dedicated_bytes").alias("vram_peak"))


def cpu_rates(df: DataFrame, *, keys: list[str], at: str, value: str) -> DataFrame:
    """``df`` with ``rate``: a counter's growth per second since the last row of the same identity, falls and stops count as 0, null for the first."""
    w = W.partitionBy(*keys).orderBy(at, "sample")
    grown, passed = F.col(value) - F.lag(value).over(w), epoch(F.col(at)) - epoch(F.lag(at).over(w))
    return df.withColumn("rate", F.when(grown.isNotNull(), F.when(passed > 0, F.greatest(F.lit(0.0), grown / passed)).otherwise(0.0)))


@R.add(f"""SELECT sample, pid, birth, CASE WHEN g IS NOT NULL THEN CASE WHEN s > 0 THEN round(greatest(0.0::DOUBLE, g / s), 6) ELSE 0.0::DOUBLE END END AS rate FROM (
    SELECT sample, pid, birth, ram_used - lag(ram_used) OVER w AS g, (epoch_us(t) - lag(epoch_us(t)) OVER w) / 1000000.0::DOUBLE AS s
    FROM (SELECT *, run AS birth FROM ({P.SAMPLES})) WINDOW w AS (PARTITION BY pid, birth ORDER BY t, sample))""")
def cpu_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process is its number and its birth (here the run); the counter stands for its processor seconds."""
    s = P.samples(spark, sf_dir).withColumn("birth", F.col("run"))
    return cpu_rates(s, keys=["pid", "birth"], at="t", value="ram_used").select("sample", "pid", "birth", F.round("rate", 6).alias("rate"))


@R.add(f"SELECT pid, min(start) AS since, count(*) AS running FROM ({P.CALLS}) WHERE status = 'running' GROUP BY pid")
def running_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calls(spark, sf_dir).where("status = 'running'").groupBy("pid").agg(F.min("start").alias("since"), F.count("*").alias("running"))


@R.add(f"SELECT * FROM (SELECT * FROM ({P.RUNS}) ORDER BY started DESC, run LIMIT 1)")
def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runs(spark, sf_dir).orderBy(F.desc("started"), "run").limit(1)


@R.add(f"SELECT call, name, status FROM ({P.CALLS}) WHERE run = 1 ORDER BY call LIMIT 30 OFFSET 20")
def call_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calls(spark, sf_dir).where("run = 1").orderBy("call").offset(20).limit(30).select("call", "name", "status")


@R.add(f"""SELECT r.run, CASE WHEN r.state = 'running' AND date_diff('second', m.t, n.t) > 5 THEN 'interrupted' ELSE r.state END AS state FROM ({P.RUNS}) r
    JOIN (SELECT run, max(t) AS t FROM ({P.SAMPLES}) GROUP BY run) m ON m.run = r.run, (SELECT max(t) AS t FROM ({P.SAMPLES})) n""")
def run_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.samples(spark, sf_dir)
    last = s.groupBy("run").agg(F.max("t").alias("t"))
    now = s.agg(F.max("t").alias("now"))
    j = P.runs(spark, sf_dir).join(last, "run").join(F.broadcast(now))  # one row
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("t").cast("timestamp"))
    return j.select("run", F.when((F.col("state") == "running") & (age > 5), "interrupted").otherwise(F.col("state")).alias("state"))


@R.add(f"""WITH m AS (SELECT m.job, m.role, s.t FROM ({P.MODELS}) m JOIN ({P.SAMPLES}) s ON s.sample = m.sample), o AS (SELECT job, role, max(t) AS last FROM m GROUP BY job, role), n AS (SELECT max(t) AS now FROM m)
    SELECT j.job, o.role, j.state FROM o JOIN n ON o.last >= n.now - INTERVAL 12 HOUR JOIN ({P.JOBS}) j ON j.job = o.job AND j.state IN ('QUEUED', 'RUNNING')""")
def worker_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of active jobs, by job and role, that have not closed: a worker has been seen in the last twelve hours."""
    seen = P.models(spark, sf_dir).select("sample", "job", "role").join(P.samples(spark, sf_dir).select("sample", "t"), "sample")
    last = seen.groupBy("job", "role").agg(F.max("t").alias("last"))
    now = last.agg(F.max("last").alias("now")).first()["now"]
    active = P.jobs(spark, sf_dir).where(F.col("state").isin("QUEUED", "RUNNING")).select("job", "state")
    return last.where(F.col("last") >= F.lit(now) - F.expr("interval 12 hours")).join(active, "job").select("job", "role", "state")
