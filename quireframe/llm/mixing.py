"""Mixing sources to target weights by systematic sampling.

The expected copies of a source's documents are prefix-summed in a fixed order, one
random offset is added, and a document is emitted once per integer boundary that its
share crosses: the floor or the ceiling of its expected copies. The offset is drawn
from a seed and the source's name, so reruns agree, and no document is favoured:
over all offsets each has its expected copies.

Expected copies are the source's target over its size, but for very long documents,
whose copies would make or break the target: a document with over one in ``LONG`` of
its source's words is expected the nearest whole number of times, and the others share
what that leaves. LONG is the first of a few numbers with which the others can do so;
if none will do, all documents are alike.

The order within a source is a hash bucket, then size (down in even buckets, up
in odd ones, so that neighbours are of like size and the words taken stay near
the target), then the row's hash. Prefix sums are taken inside buckets and
shifted by the counts of the buckets before, so no source meets in one task; the
number of buckets follows the square root of the number of documents. As documents
are taken whole, a source of a few documents may still miss its target.

Defined results: null text has size 0, null source is a source of its own and
comes last. A source of size 0 has target 0 and takes nothing. Equal rows are
separate documents, and their copies may differ by one, as may those of documents
that tie in size and hash. Texts of any length are counted whole. Other columns are
kept as they are, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_SEP, col, stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240607
LONG = (100, 50, 20, 10, 4)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size), one row per source.

    Targets share the whole size by weight and stop at ``cap`` times the source's size. With sources in
    ascending order of cap per weight, those that stop are the first ones: source i stops if sharing what the
    ones before it leave, by weight, would give it more than its cap. The windows run over one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    ranked = total.select("source", "n_docs", "source_size", weight.alias("w"))
    by_cap = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    stepped = ranked.select(
        "*", (left.cast("double") / rest.cast("double")).alias("level"), F.row_number().over(by_cap).alias("i")
    )
    limit = (cap * F.col("source_size")).cast("double")
    free = F.col("level") * F.col("w") <= limit
    stepped = stepped.select("*", F.min(F.when(free, F.struct("i", "level"))).over(whole).alias("f"))
    target = F.when(F.col("f").isNull() | (F.col("i") < F.col("f.i")), limit).otherwise(F.col("f.level") * F.col("w"))
    return stepped.select("source", "n_docs", "source_size", target.alias("target"))


def expected(sized: DataFrame, targets: DataFrame, cap: int = CAP, tiers: tuple[int, ...] = LONG) -> DataFrame:
    """(source, n_docs, source_size, target, tier, whole, each): long documents are those with over one in ``tier`` of the words, 0 for none."""
    t = targets.select(F.col("source").alias("t_source"), "source_size")
    j = sized.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    long = j.groupBy("source").agg(*[F.sum(F.when(F.col("size") * k > F.col("source_size"), F.col("size")).otherwise(0)).alias(f"g{k}") for k in tiers])
    long = long.withColumnRenamed("source", "l_source")
    alike = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(alike + 0.5).cast("double")
    choice = F.struct(F.lit(0).alias("tier"), alike.alias("each"))
    for k in reversed(tiers):
        rest = F.col("source_size") - F.col(f"g{k}")
        each = F.try_divide(F.col("target") - whole * F.col(f"g{k}").cast("double"), rest.cast("double"))
        choice = F.when((rest > 0) & (each >= 0) & (each <= cap), F.struct(F.lit(k).alias("tier"), each.alias("each"))).otherwise(choice)
    out = targets.join(long, F.col("source").eqNullSafe(F.col("l_source"))).withColumns({"choice": choice, "whole": whole})
    return out.select("source", "n_docs", "source_size", "target", "choice.tier", "whole", "choice.each")


def mix(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    columns: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``columns`` (all, unless given) in a struct ``doc``, and size, source_size, target, copies."""
    kept = F.struct(*[col(c) for c in (docs.columns if columns is None else columns)])
    size = F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(SPACE_SEP.replace("[", "[^", 1))).cast("long")
    row = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    spread = docs.select(
        kept.alias("doc"),
        col(source_col).alias("source"),
        size.alias("size"),
        row.alias("row"),
        F.xxhash64(col(text_col)).alias("tie"),
    )
    # Sizes are counted once; whole rows are read again, and dealt out once.
    slim = stored(spread.select("source", "size", "row"), "mixing-sizes")
    targets = stored(source_targets(slim, weights, cap), "mixing-targets")
    per_source = expected(slim, targets, cap)
    stats = stored(per_source, "mixing-expected").withColumnRenamed("source", "t_source")

    def bucketed(df: DataFrame) -> DataFrame:
        buckets = F.greatest(F.lit(1), F.floor(F.sqrt("n_docs") / 8))
        hashed = F.conv(F.substring("row", 1, 8), 16, 10).cast("long")
        joined = df.join(stats, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("bucket", hashed % buckets)
        return joined.withColumn("is_long", F.col("size") * F.col("tier") > F.col("source_size")).drop("t_source")

    counts = bucketed(slim).where("NOT is_long").groupBy("source", "bucket").count()
    ahead = F.sum("count").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = stored(counts.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(ahead, F.lit(0)).alias("ahead")), "mixing-buckets")
    way = F.when(F.col("bucket") % 2 == 0, -F.col("size")).otherwise(F.col("size"))
    within = W.partitionBy("source", "bucket", "is_long").orderBy(way, "row", "tie")
    named = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce("source", F.lit("null"))).cast("binary"))
    offset = F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ranked = bucketed(spread).withColumn("rank", F.row_number().over(within))
    on = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    # A bucket of long documents alone has no count.
    placed = ranked.join(offsets, on, "left").select("doc", "size", "source_size", "target", "is_long", "whole", (F.col("ahead") + F.col("rank")).alias("at"), "each", offset.alias("u"))
    crossed = F.floor(F.col("at") * F.col("each") + F.col("u")) - F.floor((F.col("at") - 1) * F.col("each") + F.col("u"))
    copies = F.when(F.col("is_long"), F.col("whole")).otherwise(crossed).cast("long")
    return placed.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document repeated as often as it was drawn, with the columns of ``docs``."""
    drawn = mix(docs, **options).where(F.col("copies") > 0)
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
