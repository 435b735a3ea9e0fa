"""Job store and task runs: listings, deduplication, expiry, bounded logs, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import latest, spread
from ..registry import Registry
from ..sources import projections as P

R = Registry()
_ACTIVE = ", ".join(f"'{x}'" for x in P.ACTIVE)
NOW = "1998-06-01"


@R.add(f"SELECT job, state, created FROM ({P.JOBS}) WHERE state IN ('QUEUED', 'RUNNING') ORDER BY created, job LIMIT 100")
def jobs_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = P.jobs(spark, sf_dir).where(F.col("state").isin("QUEUED", "RUNNING"))
    return j.orderBy("created", "job").limit(100).select("job", "state", "created")


@R.add(f"SELECT job, state, created FROM ({P.JOBS}) WHERE workspace = 3 ORDER BY created DESC, job LIMIT 100")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.jobs(spark, sf_dir).where("workspace = 3").orderBy(F.desc("created"), "job").limit(100).select("job", "state", "created")


@R.add(f"SELECT program, workspace, scope, job, created FROM (SELECT *, row_number() OVER (PARTITION BY program, workspace, scope ORDER BY created DESC, job) AS k FROM ({P.JOBS})) WHERE k = 1")
def newest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = P.jobs(spark, sf_dir)
    return latest(j, ["program", "workspace", "scope"], F.desc("created"), F.col("job")).select("program", "workspace", "scope", "job", "created")


def expire_waiting(jobs: DataFrame, now) -> DataFrame:
    """Jobs that wait beyond their deadline, with the event of their transition."""
    late = jobs.where(F.col("state").isin("QUEUED", "WAITING_RESOURCES") & (F.col("deadline") <= now))
    return late.select("job", F.col("state").alias("from"), F.lit("WAIT_EXPIRED").alias("to"), F.lit("RESOURCE_WAIT_TIMEOUT").alias("error"))


@R.add(f"SELECT job, state AS \"from\", 'WAIT_EXPIRED' AS \"to\", 'RESOURCE_WAIT_TIMEOUT' AS error FROM ({P.JOBS}) WHERE state IN ('QUEUED', 'WAITING_RESOURCES') AND deadline <= TIMESTAMP '{NOW}'")
def wait_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expire_waiting(P.jobs(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@R.add(f"SELECT job, CASE WHEN state IN ('STARTING', 'RUNNING', 'CANCEL_REQUESTED') THEN 'INTERRUPTED' ELSE state END AS state FROM ({P.JOBS})")
def restart_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.col("state").isin("STARTING", "RUNNING", "CANCEL_REQUESTED")
    return P.jobs(spark, sf_dir).select("job", F.when(lost, "INTERRUPTED").otherwise(F.col("state")).alias("state"))


@R.add(f"SELECT dedupe, count(*) AS active, min(job) AS first_job FROM ({P.JOBS}) WHERE state IN ({_ACTIVE}) GROUP BY dedupe HAVING count(*) > 1")
def active_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = P.jobs(spark, sf_dir).where(F.col("state").isin(*P.ACTIVE))
    return j.groupBy("dedupe").agg(F.count("*").alias("active"), F.min("job").alias("first_job")).where("active > 1")


@R.add(f"""SELECT job, CASE WHEN before IN ({_ACTIVE}) THEN 'DEDUPLICATED' WHEN before = 'INTERRUPTED' THEN 'RETRY_REQUIRED' ELSE 'SUBMITTED' END AS decision
    FROM (SELECT job, lag(state) OVER (PARTITION BY dedupe ORDER BY created, job) AS before FROM ({P.JOBS}))""")
def submit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What submitting each job would have said, given the newest job of its fingerprint before it."""
    before = F.lag("state").over(W.partitionBy("dedupe").orderBy("created", "job"))
    said = F.when(before.isin(*P.ACTIVE), "DEDUPLICATED").when(before == "INTERRUPTED", "RETRY_REQUIRED").otherwise("SUBMITTED")
    return P.jobs(spark, sf_dir).select("job", said.alias("decision"))


def lookup(jobs: DataFrame, prefixes: DataFrame, length: int) -> DataFrame:
    """(prefix, matches, job, problem): a public id's prefix finds one job, none or several."""
    keyed = jobs.select(F.substring("public", 1, length).alias("prefix"), "job")
    found = prefixes.join(keyed, "prefix", "left").groupBy("prefix").agg(F.count("job").alias("matches"), F.min("job").alias("one"))
    problem = F.when(F.col("matches") == 0, "UNKNOWN_JOB").when(F.col("matches") > 1, "AMBIGUOUS_PUBLIC_JOB_ID")
    return found.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("job"), problem.alias("problem"))


@R.add(f"""WITH p AS (SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS prefix FROM customer),
    f AS (SELECT p.prefix, count(j.job) AS matches, min(j.job) AS one FROM p LEFT JOIN ({P.JOBS}) j ON substr(j.public, 1, 4) = p.prefix GROUP BY p.prefix)
    SELECT prefix, matches, CASE WHEN matches = 1 THEN one END AS job, CASE WHEN matches = 0 THEN 'UNKNOWN_JOB' WHEN matches > 1 THEN 'AMBIGUOUS_PUBLIC_JOB_ID' END AS problem FROM f""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 4).alias("prefix")).distinct()
    return lookup(P.jobs(spark, sf_dir), c, 4)


@R.add("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 200")
def bounded_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events of every job are kept."""
    return latest(P.table(spark, sf_dir, "events"), ["user_id"], F.desc("event_id"), n=200).select("user_id", "event_id")


@R.add("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert on a key: the last row stays."""
    o = P.table(spark, sf_dir, "orders")
    return latest(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


@R.add(f"""SELECT l_suppkey % 40 AS task, count(DISTINCT j.job) AS jobs, count(DISTINCT CASE WHEN j.state IN ({_ACTIVE}) THEN j.job END) AS active
    FROM lineitem l JOIN ({P.JOBS}) j ON j.job = l.l_orderkey GROUP BY 1""")
def task_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = P.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("task"), F.col("l_orderkey").alias("job"))
    j = P.jobs(spark, sf_dir).select("job", F.coalesce(F.col("state").isin(*P.ACTIVE), F.lit(False)).alias("active"))
    # A job's links lie in one task, so its pairs are counted once there, and a row per task is moved.
    pairs = spread(links, "job").join(j, "job").groupBy("job", "task").agg(F.bool_or("active").alias("active"))
    return pairs.groupBy("task").agg(F.count("*").alias("jobs"), F.count_if("active").alias("active"))


@R.add(f"""SELECT j.job FROM ({P.JOBS}) j WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = j.job AND l.l_suppkey % 40 <> 7 AND l.l_returnflag = 'N')
    AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = j.job AND l.l_suppkey % 40 = 7)""")
def shared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of task 7 that an open task shares: they are spared when it drains."""
    links = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), (F.col("l_suppkey") % 40).alias("task"), "l_returnflag")
    j = P.jobs(spark, sf_dir).select("job")
    return j.join(links.where("task <> 7 AND l_returnflag = 'N'"), "job", "left_semi").join(links.where("task = 7"), "job", "left_semi")


@R.add(f"SELECT job FROM (SELECT job, row_number() OVER (ORDER BY created, job) AS k FROM ({P.JOBS}) WHERE state = 'QUEUED' AND deadline > TIMESTAMP '{NOW}') WHERE k = 1")
def next_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIFO admission to one slot: the oldest queued job whose wait has not run out."""
    j = P.jobs(spark, sf_dir).where((F.col("state") == "QUEUED") & (F.col("deadline") > F.lit(NOW).cast("timestamp_ntz")))
    return j.orderBy("created", "job").limit(1).select("job")


@R.add(f"SELECT workspace, max(created) AS updated, max_by(state, created * 1) AS state FROM (SELECT workspace, epoch(created) * 1000000 + job AS created, state FROM ({P.JOBS})) GROUP BY workspace")
def progress_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every workspace."""
    at = (F.unix_seconds(F.col("created").cast("timestamp")) * 1000000 + F.col("job")).cast("double")
    j = P.jobs(spark, sf_dir).select("workspace", at.alias("at"), "state")
    return j.groupBy("workspace").agg(F.max("at").alias("updated"), F.max_by("state", "at").alias("state"))


@R.add(f"SELECT dedupe, job FROM (SELECT dedupe, job, row_number() OVER (PARTITION BY dedupe ORDER BY created DESC, job) AS k FROM ({P.JOBS}) WHERE state = 'SUCCEEDED') WHERE k = 1")
def newest_succeeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest job that succeeded, by the digest of its source."""
    done = P.jobs(spark, sf_dir).where("state = 'SUCCEEDED'")
    return done.groupBy("dedupe").agg(F.max_by("job", F.struct("created", -F.col("job"))).alias("job"))
