"""Joins that plain predicates would plan as nested loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone, as a double (microseconds kept)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


#: Bucket widths of an interval join grow by this factor, so many times.
COARSER, LEVELS = 32, 3


def interval_join(points: DataFrame, intervals: DataFrame, *, keys: list[str], at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Points within closed intervals, by an equi-join on ``keys`` and time buckets of ``width`` seconds and coarser ones.

    ``at`` is a column of ``points``, ``start`` and ``end`` of ``intervals`` (all in seconds). An interval goes to the
    finest level of which it touches at most COARSER + 1 buckets, a point to its bucket of every level, so that a long
    interval costs no more rows than a short one. The result has the columns of both sides, ``keys`` once.
    """
    widths = [width * COARSER**k for k in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(end - start <= COARSER * widths[k], k).otherwise(level)
    size = F.lit(width) * F.pow(F.lit(COARSER), F.col("__level"))
    p = points.withColumn("__at", at).withColumn("__cell", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("__at") / w).alias("bucket")) for k, w in enumerate(widths)])))
    p = p.withColumns({"__level": F.col("__cell.level"), "__bucket": F.col("__cell.bucket")}).drop("__cell")
    i = intervals.where(start <= end).withColumns({"__start": start, "__end": end, "__level": level.cast("int")})
    i = i.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__start") / size), F.floor(F.col("__end") / size))))
    joined = p.join(i, [*keys, "__level", "__bucket"]).where(F.col("__at").between(F.col("__start"), F.col("__end")))
    return joined.drop("__at", "__level", "__bucket", "__start", "__end")


def range_totals(points: DataFrame, intervals: DataFrame, *, key: str, id: str, sums: list[str], peaks: list[str], width: int) -> DataFrame:
    """(id, sums, peaks): sums and maxima of a key's points ``at`` within every closed interval ``start`` to ``end``, all whole numbers.

    No point meets an interval as a row: within cells of ``width`` both are answered from a tree of partial sums, and what
    an interval spans between its first and last cell from the sums of cells, once for all intervals that span the same.
    Intervals without points have sums of 0 and peaks as low as a point's type allows; ``sums`` and ``peaks`` are never null.
    """
    c = F.col
    cell = lambda at: F.floor(at / width)
    total = [*[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in peaks]]
    p = points.where(c(key).isNotNull() & c("at").isNotNull()).select(key, "at", *sums, *peaks).withColumn("__cell", cell(c("at")))
    # One without an end or a beginning holds nothing, as does one that ends before it starts.
    known = c("start").isNotNull() & c("end").isNotNull()
    i = intervals.select(id, key, *[F.when(known, c(n)).otherwise(F.lit(v)).cast("long").alias(n) for n, v in (("start", 1), ("end", 0))])
    i = i.withColumns({"__first": cell(c("start")), "__last": F.greatest(cell(c("start")), cell(c("end")))})
    ends = i.select(id, key, "start", "end", F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__cell"))
    within = _answered(p, ends, [key, "__cell"], id, sums, peaks)

    spans = i.where(c("__last") - c("__first") > 1).select(id, key, (c("__first") + 1).alias("start"), (c("__last") - 1).alias("end"))
    # A span of cells is known by its ends, as a number of its own.
    asked = spans.select(key, "start", "end").distinct().withColumn("__span", F.struct("start", "end").cast("string"))
    cells = p.groupBy(key, "__cell").agg(*total).withColumnRenamed("__cell", "at")
    answers = _answered(cells, asked, [key], "__span", sums, peaks, keep=[key])
    spans = spans.withColumn("__span", F.struct("start", "end").cast("string")).select(id, key, "__span")
    between = spans.join(answers, [key, "__span"]).select(id, *sums, *peaks)
    return within.unionByName(between).groupBy(id).agg(*total)


def _answered(points: DataFrame, intervals: DataFrame, keys: list[str], id: str, sums: list[str], peaks: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, id, sums, peaks): an interval's sums and maxima over the points of its keys; a group's points and intervals meet in one call."""
    kept = [*(keep or []), id]
    schema = intervals.select(*kept).schema
    for n in [*sums, *peaks]:
        schema = schema.add(n, points.schema[n].dataType)
    arrow = to_arrow_schema(schema)

    def of_group(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        at = at[order]
        low = np.searchsorted(at, right.column("start").to_numpy(), "left")
        high = np.maximum(low, np.searchsorted(at, right.column("end").to_numpy(), "right"))
        found = [over_ranges(left.column(n).to_numpy()[order], low, high, np.add if n in sums else np.maximum) for n in [*sums, *peaks]]
        return pa.table([*[right.column(n) for n in kept], *found], names=arrow.names).cast(arrow)

    return points.groupBy(*keys).cogroup(intervals.groupBy(*keys)).applyInArrow(of_group, schema)


def over_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray, op: np.ufunc) -> np.ndarray:
    """``op`` (sum or maximum) over values[low:high] of every range, by a tree of pairs: no range costs more steps than the tree has levels."""
    nothing = 0 if op is np.add else -np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).min
    out, low, high = np.full(len(low), nothing, values.dtype), low.copy(), high.copy()
    while (low < high).any():
        odd = (low & 1).astype(bool) & (low < high)
        out[odd] = op(out[odd], values[low[odd]])
        low[odd] += 1
        odd = (high & 1).astype(bool) & (low < high)
        high[odd] -= 1
        out[odd] = op(out[odd], values[high[odd]])
        if len(values) % 2:
            values = np.append(values, np.array(nothing, values.dtype))
        values, low, high = op(values[::2], values[1::2]), low >> 1, high >> 1
    return out


def islands(df: DataFrame, *, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """``df`` with the number of its run: a new one begins where ``breaks`` holds (null counts as no)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__break", breaks).withColumn(name, F.sum(F.when(F.col("__break"), 1).otherwise(0)).over(w)).drop("__break")


def numbered(df: DataFrame, key: str, order: str, *, width: int = 1 << 16, name: str = "number") -> DataFrame:
    """``df`` with the place of each row in its key, by a whole number ``order``; no key meets in one task.

    Rows are numbered within ranges of ``width`` and shifted by the counts of the ranges before; the window over counts
    has a row per range.
    """
    ranged = df.withColumn("__range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), ahead.alias("__ahead"))
    within = F.row_number().over(W.partitionBy(key, "__range").orderBy(order))
    placed = ranged.withColumn("__within", within).join(shifts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return placed.withColumn(name, F.col("__ahead") + F.col("__within")).drop("__range", "__key", "__at", "__ahead", "__within")


def once_per_key(df: DataFrame, keys: list[str], expensive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``expensive`` to the distinct keys and join its columns back: model calls are paid once per content."""
    done = expensive(df.select(*keys).distinct())
    extra = [c for c in done.columns if c not in keys]
    a, b = df.alias("a"), done.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left").select("a.*", *[F.col(f"b.{c}") for c in extra])


def per_group(df: DataFrame, key: str, order: list[str], of_group: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``of_group`` makes of each key's rows, named tuples in ``order``; groups are small, and many go through Python at a time.

    Groups come one after another from sorted partitions, so a group that two batches share is put together.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name="Row"):
                if held and getattr(held[0], key) != getattr(row, key):
                    out += of_group(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(of_group(held) if held else [], columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


#: Bytes of the input's files for each task of ``spread``; unpacked they are several times as many.
TASK_BYTES = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over as many tasks as its files ask for, so that a task's share does not grow with the input.

    Spark's own number of tasks is the least; it stays where no size is known, as of rows that a program holds. What is
    dealt out by the same keys of the same files already is not moved again.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = -(-sum(sizes) // TASK_BYTES)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, 4096), *keys) if least < n < 1 << 24 else df.repartition(*keys)


def latest(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in this order."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")
