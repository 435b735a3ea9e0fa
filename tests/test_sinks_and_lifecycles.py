"""Publishing as a whole or not at all, and lifecycles whose streams give what their batch forms give."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from quireframe.operators import writer
from quireframe.sinks import publish as sink
from quireframe.streaming import lifecycles as L

SF = "/root/testdata/sf0.001"


def test_published_documents_are_whole(spark, tmp_path):
    docs = writer.visual_documents(spark, SF).where("doc < 12")
    want = {str(r["doc"]): r["markdown"] for r in docs.collect()}
    target = f"{tmp_path}/packages/books"
    assert not sink.publish(docs, target).replaced
    got = {}
    for d, _, names in os.walk(f"{target}/documents"):
        for n in (n for n in names if n.startswith("part-")):
            got[os.path.basename(d).removeprefix("document_id=")] = open(f"{d}/{n}", encoding="utf-8", newline="").read()
    assert got == want
    assert sink.publish(docs.where("doc < 5"), target).replaced
    assert len([d for d in os.listdir(f"{target}/documents") if "=" in d]) == docs.where("doc < 5").count()


def test_failure_leaves_the_last_version(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\n"), (2, "two\n")], "doc long, markdown string")
    target = f"{tmp_path}/out/set"
    sink.publish(docs, target)
    before = sorted(os.listdir(f"{target}/documents"))

    def refuse(stage):
        assert os.path.exists(f"{stage}/manifest.json")
        raise ValueError("review refused")

    with pytest.raises(ValueError, match="refused"):
        sink.publish(docs.where("doc = 1"), target, check=refuse)
    assert sorted(os.listdir(f"{target}/documents")) == before and os.listdir(f"{tmp_path}/out/.failures")
    assert [n for n in os.listdir(f"{tmp_path}/out/.staging") if not n.startswith(".")] == []


def test_cleanup_removes_old_folders_only(spark, tmp_path):
    for name in ("old", "new"):
        os.makedirs(f"{tmp_path}/.staging/{name}")
    open(f"{tmp_path}/.staging/file", "w").close()
    os.utime(f"{tmp_path}/.staging/old", (1, 1))
    assert sink.cleanup_staging(spark, str(tmp_path), older_than=3600) == (["old"], ["file", "new"])
    assert sink.cleanup_staging(spark, str(tmp_path), older_than=0, now=time.time() + 9) == (["new"], ["file"])


def both(spark, tmp_path, name, rows, schema, stream, batch):
    """Rows of the batch form and of the stream, whose three files come in order of seq."""
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, batch(df).collect()))
    path = f"{tmp_path}/{name}"
    for i in range(3):
        df.where(F.col("seq") % 1000 * 3 >= i * len(rows)).where(F.col("seq") % 1000 * 3 < (i + 1) * len(rows)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(name).collect())) == want
    return want


def test_one_capture_runs_at_a_time(spark, tmp_path):
    rows = [(1, 0, "start", 0.0, 1.0, 100.0), (1, 1, "start", 3.0, 1.0, 100.0), (1, 2, "sample", 5.0, None, None), (1, 3, "start", 11.0, 1.0, 20.0), (1, 4, "sample", 15.0, None, None), (1, 5, "sample", 29.0, None, None), (1, 6, "start", 32.0, 90.0, 10.0), (1, 7, "start", 33.0, 1.0, 10.0), (1, 8, "stop", 34.0, None, None)]
    got = both(spark, tmp_path, "captures", rows, "workspace long, seq long, action string, at double, interval double, duration double", L.capture_stream, L.capture_log)
    assert [(s, state) for _, s, _, state in got] == [(0, "running"), (1, "shared"), (3, "interrupted"), (3, "running"), (5, "interrupted"), (6, "rejected"), (7, "running"), (8, "stopped")]


def test_task_runs_drain_before_they_close(spark, tmp_path):
    rows = [(1, 0, "enter", "c1", None), (1, 1, "job", "j1", "RUNNING"), (1, 2, "end", None, "complete"), (1, 3, "enter", "c2", None), (1, 4, "leave", "c1", None), (1, 5, "end", None, "cancel"), (1, 6, "job", "j1", "SUCCEEDED"), (1, 7, "job", "j2", "RUNNING"), (1, 8, "leave", "c1", None)]
    got = both(spark, tmp_path, "tasks", rows, "task long, seq long, action string, ref string, value string", L.task_stream, L.task_log)
    assert [(s, state) for _, s, state, _ in got] == [(3, "TASK_RUN_NOT_OPEN"), (5, "TASK_RUN_OUTCOME_CONFLICT"), (6, "COMPLETED")]
    shared = L.task_runs(("OPEN", "", "", ""), spark.createDataFrame([(1, 0, "job", "j", "RUNNING+shared"), (1, 1, "end", None, "cancel")], "task long, seq long, action string, ref string, value string").toPandas())[1]
    assert shared == [(1, "CANCELLED", 1)]


def test_one_slot_takes_the_oldest(spark, tmp_path):
    rows = [(0, 0, "submit", 7, 0.0, 50.0), (0, 1, "submit", 8, 1.0, 9.0), (0, 2, "submit", 9, 2.0, 60.0), (0, 3, "finish", 9, 3.0, None), (0, 4, "finish", 7, 10.0, None), (0, 5, "finish", 9, 11.0, None)]
    got = both(spark, tmp_path, "slots", rows, "slot long, seq long, action string, job long, at double, deadline double", L.admission_stream, L.admission_log)
    assert [(s, j, state) for _, s, j, state in got] == [(0, 7, "ADMITTED"), (0, 7, "QUEUED"), (1, 8, "QUEUED"), (2, 9, "QUEUED"), (4, 7, "FINISHED"), (4, 8, "WAIT_EXPIRED"), (4, 9, "ADMITTED"), (5, 9, "FINISHED")]


def test_one_session_is_open(spark, tmp_path):
    rows = [(0, 0, "open", "a", "text"), (0, 1, "open", "b", "text"), (0, 2, "infer", "a", "table"), (0, 3, "infer", "a", "text"), (0, 4, "close", "a", None), (0, 5, "close", "a", None), (0, 6, "open", "a", "text"), (0, 7, "infer", "c", "text"), (0, 8, "open", "b", "table")]
    got = both(spark, tmp_path, "sessions", rows, "gateway long, seq long, action string, session string, role string", L.session_stream, L.session_log)
    assert [a for *_, a in got] == ["OK", "GATEWAY_ANOTHER_SESSION_ACTIVE", "GATEWAY_SESSION_ROLE_CHANGED", "OK", "OK", "RECEIPT", "GATEWAY_SESSION_ALREADY_CLOSED", "GATEWAY_SESSION_UNKNOWN", "OK"]
