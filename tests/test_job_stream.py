"""The job stream against the replay of a whole table, and receipts over batches that run twice."""

from __future__ import annotations

import random

from quireframe.streaming import jobs

CHANGES = "job long, seq long, state string, expected array<string>, error string"


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(8)
    states = jobs.ACTIVE + jobs.TERMINAL
    rows = [(i % 7, i, rng.choice(states), rng.choice([None, [], list(jobs.ACTIVE), rng.sample(states, 4)]), rng.choice([None, None, "e"])) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.transitions(stream).writeStream.format("memory").queryName("job_log").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("job_log").collect())
    replay = jobs.replayed(spark.createDataFrame(rows, CHANGES)).collect()
    assert got == sorted((r["job"], x["seq"], x["before"], x["after"], x["error"]) for r in replay for x in r["log"]) and got

    for r in replay:
        state, error = "QUEUED", None
        for _, _, to, expected, told in (x for x in rows if x[0] == r["job"]):
            if not expected or state in expected:
                state, error = to, told or (None if to in jobs.CLEARS_ERROR else error)
        assert (r["state"], r["error"]) == (state, error)


def test_receipts_survive_batches_that_run_twice(spark, tmp_path):
    schema = "request long, digest string, at timestamp"
    batch = lambda *rows: spark.createDataFrame([(r, d) for r, d in rows], "request long, digest string").selectExpr("request", "digest", "timestamp_seconds(monotonically_increasing_id()) as at")
    first, second = batch((1, "a"), (1, "a"), (2, "b")), batch((1, "a"), (1, "x"), (3, "c"))
    write = jobs.stored_once(first, str(tmp_path))
    for number, b in ((0, first), (0, first), (1, second), (1, second)):
        write(b, number)
    read = lambda what: sorted((r["request"], r["digest"]) for r in spark.read.schema(schema).parquet(f"{tmp_path}/{what}").collect())
    assert read("kept") == [(1, "a"), (2, "b"), (3, "c")] and read("conflicts") == [(1, "x")]
