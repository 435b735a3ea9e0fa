"""Jobs as a stream of guarded changes: state per key, a log of what took effect.

A change names the state it wants and the states it may replace (none: any). It
takes effect if the job's state is among them; a change that alters the state or
brings an error is logged. Errors stay until a job starts, runs or succeeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States of a job, and those that clear its error.
ACTIVE = ("QUEUED", "WAITING_RESOURCES", "STARTING", "RUNNING", "CANCEL_REQUESTED")
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELLED", "INTERRUPTED", "CAPACITY_INSUFFICIENT", "WAIT_EXPIRED")
CLEARS_ERROR = ("STARTING", "RUNNING", "SUCCEEDED")
LOG = "job long, seq long, before string, after string, error string"
STATE = "state string, error string"


def applied(current: tuple[str, str | None], changes: pd.DataFrame) -> tuple[tuple[str, str | None], list[tuple]]:
    """The state after changes in order of seq, and the rows of the log."""
    (state, error), log = current, []
    for c in changes.sort_values("seq").itertuples():
        expected = () if c.expected is None else tuple(c.expected)
        if expected and state not in expected:
            continue
        given = c.error if isinstance(c.error, str) else None
        if c.state != state or given is not None:
            log.append((c.job, c.seq, state, c.state, given))
        error = given if given is not None else None if c.state in CLEARS_ERROR else error
        state = c.state
    return (state, error), log


def transitions(changes: DataFrame) -> DataFrame:
    """The log of (job, seq, state, expected array, error); for append mode. A job's changes must come in order of seq, batch by batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        current = held.get if held.exists else ("QUEUED", None)
        after, log = applied(tuple(current), pd.concat(list(batches)))
        held.update(after)
        yield pd.DataFrame(log, columns=["job", "seq", "before", "after", "error"])

    return changes.groupBy("job").applyInPandasWithState(run, LOG, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(changes: DataFrame) -> DataFrame:
    """(job, state, error, log) of a whole table: one fold per job over its changes."""
    g = changes.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("seq", "state", "expected", "error"))).alias("all"))
    start = F.expr("named_struct('state', 'QUEUED', 'error', cast(null as string), 'log', cast(array() as array<struct<seq:bigint,before:string,after:string,error:string>>))")

    def step(a, c):
        ok = c["expected"].isNull() | (F.size(c["expected"]) == 0) | F.array_contains(c["expected"], a["state"])
        told = (c["state"] != a["state"]) | c["error"].isNotNull()
        entry = F.struct(c["seq"].alias("seq"), a["state"].alias("before"), c["state"].alias("after"), c["error"].alias("error"))
        error = F.coalesce(c["error"], F.when(~c["state"].isin(*CLEARS_ERROR), a["error"]))
        return F.struct(F.when(ok, c["state"]).otherwise(a["state"]).alias("state"), F.when(ok, error).otherwise(a["error"]).alias("error"), F.when(ok & told, F.array_append(a["log"], entry)).otherwise(a["log"]).alias("log"))

    return g.select("job", F.aggregate("all", start, step).alias("r")).select("job", "r.state", "r.error", "r.log")


def idle_jobs(samples: DataFrame, *, idle: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """(job, last) of workers that have been silent for ``idle``: each session's end."""
    w = F.session_window("t", idle)
    return samples.withWatermark("t", late).groupBy("job", w.alias("w")).agg(F.max("t").alias("last")).select("job", "last")


def stored_once(requests: DataFrame, path: str):
    """A writer for foreachBatch: a request's first digest is kept, repeats are dropped, other digests of it are set aside.

    Each batch writes its own folder, so a batch that runs again after a failure
    replaces what it wrote before.
    """
    spark = requests.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        ids = batch.groupBy("request").agg(F.min_by("digest", "at").alias("first"))
        schema = "request long, digest string, at timestamp"
        earlier = spark.read.schema(schema).parquet(*[f"{path}/kept/batch={i}" for i in range(number)]) if number else spark.createDataFrame([], schema)
        known = ids.join(earlier.select("request", F.col("digest").alias("stored")), "request", "left").withColumn("right", F.coalesce("stored", "first"))
        rows = batch.join(known, "request")
        rows.where("stored is null and digest = right").groupBy("request", "digest").agg(F.min("at").alias("at")).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        rows.where("digest <> right").select("request", "digest", "at").write.mode("overwrite").parquet(f"{path}/conflicts/batch={number}")

    return write
