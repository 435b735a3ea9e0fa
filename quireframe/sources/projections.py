"""The engine's entities as projections of the test tables, deterministic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, run, pid, t, cpu_pct, ram_used, gpu_pct)"""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(
        F.col("event_id").alias("sample"),
        (F.col("user_id") % 8).alias("run"),
        F.col("user_id").alias("pid"),
        F.col("ts").alias("t"),
        F.col("value").alias("cpu_pct"),
        F.col("event_id") * 1000 + F.col("user_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 101).alias("gpu_pct"),
    ).toDF("sample", "run", "pid", "t", "cpu_pct", "ram_used", "gpu_pct")


SAMPLES = """SELECT event_id AS sample, user_id % 8 AS run, user_id AS pid, ts AS t, value AS cpu_pct,
    event_id * 1000 + user_id AS ram_used, CASE WHEN event_id % 5 <> 0 THEN event_id % 101 END AS gpu_pct
    FROM events WHERE event_type IN ('view', 'click')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call, run, name, action, pid, start, end, seconds, status, rss_start, rss_end); an unfinished call has no end."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    open_ = F.col("event_id") % 7 == 0
    return e.select(
        F.col("event_id").alias("call"),
        (F.col("user_id") % 8).alias("run"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("a"), F.col("event_id") % 3).alias("action"),
        F.col("user_id").alias("pid"),
        F.col("ts").alias("start"),
        F.when(~open_, F.col("ts") + F.expr("interval 1 hour")).alias("end"),
        F.when(~open_, F.col("value")).alias("seconds"),
        F.when(open_, "running").when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (F.col("event_id") * 10).alias("rss_start"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 10 + F.col("user_id")).alias("rss_end"),
    )


CALLS = """SELECT event_id AS call, user_id % 8 AS run, event_type AS name, 'a' || (event_id % 3) AS action, user_id AS pid,
    ts AS start, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 1 HOUR END AS "end",
    CASE WHEN event_id % 7 <> 0 THEN value END AS seconds,
    CASE WHEN event_id % 7 = 0 THEN 'running' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    event_id * 10 AS rss_start, CASE WHEN event_id % 4 <> 0 THEN event_id * 10 + user_id END AS rss_end
    FROM events WHERE event_type IN ('purchase', 'error')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, started, ended, state): runs divisible by 3 are still open."""
    r = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("run")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"))
    open_ = F.col("run") % 3 == 0
    return r.select("run", "started", F.when(~open_, F.col("last")).alias("ended"), F.when(open_, "running").otherwise("stopped").alias("state"))


RUNS = """SELECT user_id % 8 AS run, min(ts) AS started, CASE WHEN user_id % 8 % 3 <> 0 THEN max(ts) END AS ended,
    CASE WHEN user_id % 8 % 3 = 0 THEN 'running' ELSE 'stopped' END AS state FROM events GROUP BY user_id % 8"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, run, job, role, worker_pid, cpu_pct, rss): the model workers seen with a sample."""
    s = samples(spark, sf_dir)
    return s.select(
        "sample", "run", (F.col("pid") % 12).alias("job"), F.element_at(F.array(F.lit("layout"), F.lit("formula"), F.lit("text")), (F.col("sample") % 3 + 1).cast("int")).alias("role"), F.col("pid").alias("worker_pid"), "cpu_pct", F.col("ram_used").alias("rss")
    )


MODELS = f"""SELECT sample, run, pid % 12 AS job, ['layout', 'formula', 'text'][sample % 3 + 1] AS role, pid AS worker_pid, cpu_pct,
    ram_used AS rss FROM ({SAMPLES})"""


def process_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, scope, pid, engine, engine_pct, dedicated_bytes): counters per process and engine."""
    s = samples(spark, sf_dir)
    scope = F.when(F.col("sample") % 3 == 0, "tool_process").otherwise("worker_tree")
    return s.select("sample", scope.alias("scope"), "pid", F.explode(F.array(F.lit(0), F.lit(1))).alias("engine"), F.col("ram_used").alias("ram")).select(
        "sample", "scope", "pid", "engine", ((F.col("sample") * (F.col("engine") + 3)) % 70).alias("engine_pct"), (F.col("ram") % 4096).alias("dedicated_bytes")
    )


PROCESS_GPU = f"""SELECT sample, CASE WHEN sample % 3 = 0 THEN 'tool_process' ELSE 'worker_tree' END AS scope, pid, engine,
    (sample * (engine + 3)) % 70 AS engine_pct, ram_used % 4096 AS dedicated_bytes FROM ({SAMPLES}), (VALUES (0), (1)) x(engine)"""

ACTIVE = ("QUEUED", "WAITING_RESOURCES", "STARTING", "RUNNING", "CANCEL_REQUESTED")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, public, dedupe, state, program, workspace, scope, created, deadline)"""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job"),
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("public"),
        (F.col("o_custkey") % 500).alias("dedupe"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderkey") % 11 == 0, "INTERRUPTED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING").alias("state"),
        F.col("o_orderpriority").alias("program"),
        (F.col("o_custkey") % 10).alias("workspace"),
        F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey") % 50).alias("scope"),
        F.col("o_orderdate").alias("created"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("deadline"),
    )


JOBS = """SELECT o_orderkey AS job, md5(CAST(o_orderkey AS VARCHAR)) AS public, o_custkey % 500 AS dedupe,
    CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderkey % 11 = 0 THEN 'INTERRUPTED' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS state,
    o_orderpriority AS program, o_custkey % 10 AS workspace, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey % 50 END AS scope,
    o_orderdate AS created, o_orderdate + INTERVAL 30 DAY AS deadline FROM orders"""

LABELS = ("text", "formula", "table", "image", "figure_title", "display_formula", "paragraph_title", "chart", "algorithm", "seal")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, region, ord, label, x0, y0, x1, y1, sha): boxes on pages; region is unique."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), ((F.col("l_partkey") + F.col("l_suppkey")) % len(LABELS) + 1).cast("int"))
    r = li.select("*", F.row_number().over(order).alias("ord"))
    return r.select(
        F.col("l_orderkey").alias("page"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("ord")).alias("region"),
        "ord",
        label.alias("label"),
        (F.col("l_partkey") % 40).alias("x0"),
        (F.col("l_suppkey") % 30).alias("y0"),
        (F.col("l_partkey") % 40 + F.col("l_quantity").cast("bigint")).alias("x1"),
        (F.col("l_suppkey") % 30 + 1 + 5 * F.col("l_linenumber")).alias("y1"),
        (F.col("l_partkey") % 6).alias("sha"),
    )


REGIONS = f"""SELECT page, page || '-' || ord AS region, ord, label, x0, y0, x1, y1, sha FROM (SELECT l_orderkey AS page,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord,
    {list(LABELS)}[(l_partkey + l_suppkey) % {len(LABELS)} + 1] AS label, l_partkey % 40 AS x0, l_suppkey % 30 AS y0,
    l_partkey % 40 + CAST(l_quantity AS BIGINT) AS x1, l_suppkey % 30 + 1 + 5 * l_linenumber AS y1, l_partkey % 6 AS sha FROM lineitem)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line, text): documents split at line ends, from 1."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc", (F.col("line") + 1).alias("line"), "text")


PAGE_LINES = "SELECT doc, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line, unnest(l) AS text FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS l FROM documents)"
