"""Models as plug-ins: once a content, in batches, with as many answers as items."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireframe import runtimes


class Upper:
    fingerprint = "upper-v1"

    def __init__(self, short: bool = False) -> None:
        self.short = short
        self.fingerprint = f"upper-{short}"

    def load(self):
        return str.upper

    def recognize_batch(self, model, crops):
        out = [f"{model(c.decode())}/{len(crops)}" for c in crops]
        return out[1:] if self.short else out


class Halves:
    def load(self):
        return None

    def detect(self, model, pages):
        return [[{"label": "text", "bbox": (0.2, 0.0, len(p) / 2, 1.5), "order": 1}] for p in pages]


def test_batches():
    assert list(runtimes.batches([1] * 5, items=2)) == [(0, 2), (2, 4), (4, 5)]
    assert list(runtimes.batches([3, 3, 3], most=6)) == [(0, 2), (2, 3)] and list(runtimes.batches([])) == []
    with pytest.raises(ValueError, match="exceeds"):
        list(runtimes.batches([9], most=6))


def test_every_content_is_read_once(spark):
    rows = [(i, bytes(f"c{i % 3}", "ascii")) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, content binary").coalesce(1)
    assert isinstance(Upper(), runtimes.TextRuntime)
    got = {r["id"]: r["text"] for r in runtimes.recognized(df, Upper()).collect()}
    assert len(got) == 30 and all(t.startswith(f"C{i % 3}/") and int(t[3:]) <= 3 for i, t in got.items())


def test_another_number_of_answers_is_an_error(spark):
    df = spark.createDataFrame([(1, b"a"), (2, b"b")], "id long, content binary")
    with pytest.raises(Exception, match="answers for"):
        runtimes.recognized(df, Upper(short=True)).collect()


def test_detected_boxes_are_whole_pixels(spark):
    df = spark.createDataFrame([(7, b"abc")], "page long, content binary")
    assert [tuple(r) for r in runtimes.detected(df, Halves(), name="halves").collect()] == [(7, "p0007-r0000", "text", 0, 0, 2, 2, 1)]
    assert isinstance(Halves(), runtimes.LayoutRuntime) and runtimes.detected(df, Halves(), name="halves").where(F.col("x1") > 2).count() == 0
