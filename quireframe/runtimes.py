"""Models as plug-ins: what a detector and a recogniser have to offer, and how their work runs over tables.

A runtime is an object that executors can unpickle. Its model is loaded once a Python
worker, by ``load``; rows go through it in batches, each distinct crop once, and an
answer of another length than its batch is an error, never a shift.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.joins import once_per_key

ITEMS, BYTES = 128, 64 << 20


class CardinalityError(RuntimeError):
    """A model stage failed or answered for another number of items."""


@runtime_checkable
class LayoutRuntime(Protocol):
    def load(self) -> Any: ...
    def detect(self, model: Any, pages: Sequence[bytes]) -> list[list[dict]]: ...


@runtime_checkable
class TextRuntime(Protocol):
    """A recogniser of formulas, tables or text."""

    fingerprint: str

    def load(self) -> Any: ...
    def recognize_batch(self, model: Any, crops: Sequence[bytes]) -> list[str]: ...


_LOADED: dict[str, Any] = {}


def _model(name: str, runtime: Any) -> Any:
    if name not in _LOADED:
        _LOADED[name] = runtime.load()
    return _LOADED[name]


def batches(sizes: Sequence[int], items: int = ITEMS, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Runs of at most so many items and bytes; an item that no batch can hold is an error."""
    start = held = 0
    for i, n in enumerate(sizes):
        if n > most:
            raise ValueError(f"an item of {n} bytes exceeds the batch limit of {most}")
        if i > start and (i - start >= items or held + n > most):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def recognized(crops: DataFrame, runtime: TextRuntime, *, content: str = "content", items: int = ITEMS) -> DataFrame:
    """``crops`` with ``text``: every distinct content is read once and its text given to all rows that have it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            model = _model(runtime.fingerprint, runtime)
            out: list[str] = []
            data = [bytes(c) for c in df[content]]
            for a, z in batches([len(d) for d in data], items):
                got = runtime.recognize_batch(model, data[a:z])
                if len(got) != z - a:
                    raise CardinalityError(f"{len(got)} answers for {z - a} items")
                out += got
            yield pd.DataFrame({"sha": df["sha"], "text": out})

    keyed = crops.withColumn("sha", F.sha2(content, 256))
    first = keyed.groupBy("sha").agg(F.first(content).alias(content))
    return once_per_key(keyed, ["sha"], lambda keys: keys.join(first, "sha").mapInPandas(run, "sha string, text string")).drop("sha")


def detected(pages: DataFrame, runtime: LayoutRuntime, *, name: str, content: str = "content", key: str = "page") -> DataFrame:
    """(key, region, label, x0, y0, x1, y1, ord) of what a detector finds on pages, boxes widened to whole pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = runtime.detect(_model(name, runtime), [bytes(c) for c in df[content]])
            if len(got) != len(df):
                raise CardinalityError(f"{len(got)} answers for {len(df)} pages")
            rows = [(k, f"p{k:04d}-r{i:04d}", r["label"], *r["bbox"], r["order"]) for k, found in zip(df[key], got, strict=True) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "region", "label", "a", "b", "c", "d", "ord"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, content).mapInPandas(run, f"{key} {kind}, region string, label string, a double, b double, c double, d double, ord int")
    return found.select(key, "region", "label", F.floor("a").alias("x0"), F.floor("b").alias("y0"), F.ceil("c").alias("x1"), F.ceil("d").alias("y1"), "ord")
