"""Streams read to their end give what the batch forms give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireframe.sources import projections as P
from quireframe.streaming import telemetry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    """Batch tables and the same rows as streams of a few files, in order of time."""
    root = tmp_path_factory.mktemp("streams")

    def both(name, df, at):
        df = df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}).cache()
        df.repartitionByRange(3, at).sortWithinPartitions(at).write.parquet(f"{root}/{name}")
        return df, spark.readStream.schema(df.schema).parquet(f"{root}/{name}")

    return both("samples", P.samples(spark, SF), "t"), both("calls", P.calls(spark, SF), "start")


def finished(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_windows(spark, streams, tmp_path):
    samples, stream = streams[0]
    want = {tuple(r) for r in telemetry.tumbling_usage(samples).collect()}
    assert finished(spark, telemetry.tumbling_usage(stream), "usage", tmp_path, "complete") == want
    early = finished(spark, telemetry.tumbling_usage(stream), "usage_append", tmp_path)
    assert early <= want and len(early) >= 0.9 * len(want)


def test_sessions(spark, streams, tmp_path):
    samples, stream = streams[0]
    want = {tuple(r) for r in telemetry.idle_sessions(samples).collect()}
    got = finished(spark, telemetry.idle_sessions(stream), "sessions", tmp_path)
    assert got <= want and len(got) >= 0.8 * len(want)


def test_call_samples(spark, streams, tmp_path):
    (samples, s_stream), (calls, c_stream) = streams
    want = {(r["call"], r["sample"]) for r in calls.alias("c").join(samples.alias("s"), (F.col("c.run") == F.col("s.run")) & F.col("t").between(F.col("start"), F.col("end"))).select("call", "sample").collect()}
    assert want and finished(spark, telemetry.call_samples(c_stream, s_stream), "pairs", tmp_path) == want


def test_paired_calls(spark, streams, tmp_path):
    _, (calls, stream) = streams
    want = {(r["call"], r["start"], r["end"]) for r in calls.collect()}
    got = finished(spark, telemetry.paired_calls(stream, stream.where("end is not null")), "paired", tmp_path)
    closed = {x for x in want if x[2] is not None}
    assert closed <= got and got <= want
