"""Limits: memory tiers, admission, padding of extreme shapes, requirements and request batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P

R = Registry()
MIB = 1 << 20
GIB = 1 << 30
#: Kept free for the host by every admission, 3 % of a GiB rounded up.
HOST_RESERVE = -(-3 * GIB // 100)

HOSTS = f"""SELECT s_suppkey AS host, (s_suppkey % 40 + 1) * {GIB} AS total, (s_suppkey % 40 + 1) * {GIB} * 5 // 4 AS commit_limit, (s_suppkey % 6 + 1) * {4 * GIB} AS gpu_total,
    (s_suppkey % 7) * {512 * MIB} AS used, (s_suppkey % 5) * {GIB} AS gpu_used FROM supplier"""
REQUESTS = f"""SELECT o_orderkey AS request, o_custkey AS host, (o_orderkey % 8) * {512 * MIB} AS private, (o_orderkey % 8) * {256 * MIB} AS physical, (o_orderkey % 5) * {GIB} AS gpu,
    o_orderkey % 4 = 0 AS waits FROM orders WHERE o_orderstatus = 'O'"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, total, commit_limit, gpu_total, used, gpu_used), in bytes."""
    s, k = P.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    total = (k % 40 + 1) * GIB
    return s.select(k.alias("host"), total.alias("total"), F.expr(f"(s_suppkey % 40 + 1) * {GIB} * 5 div 4").alias("commit_limit"), ((k % 6 + 1) * (4 * GIB)).alias("gpu_total"), ((k % 7) * (512 * MIB)).alias("used"), ((k % 5) * GIB).alias("gpu_used"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, host, private, physical, gpu, waits): what open requests need; waiting ones hold a reservation."""
    k = F.col("o_orderkey")
    return P.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        k.alias("request"), F.col("o_custkey").alias("host"), ((k % 8) * (512 * MIB)).alias("private"), ((k % 8) * (256 * MIB)).alias("physical"), ((k % 5) * GIB).alias("gpu"), (k % 4 == 0).alias("waits")
    )


def with_policy(h: DataFrame) -> DataFrame:
    """Adds a host's own limits: GiB that work may take, GiB that stay free, and bytes of its graphics memory."""
    installed = F.greatest(F.lit(1.0), F.bround(F.col("total") / GIB, 0))
    tier = F.when(F.col("installed") >= 24, 12.0).when(F.col("installed") >= 16, 8.0).when(F.col("installed") >= 8, 6.0).otherwise(F.greatest(F.lit(1.0), F.col("installed") / 2))
    h = h.withColumn("installed", installed).withColumn("tier", tier)
    h = h.withColumn("free_floor", F.least(F.lit(8.0), F.greatest(F.lit(2.0), F.col("installed") / 4)))
    h = h.withColumn("commit_floor", F.least(F.lit(9.0), F.greatest(F.lit(3.0), F.least("tier", F.col("installed") / 2) * 0.75)))
    h = h.withColumn("cap", F.greatest(F.lit(0.0), F.least(F.col("tier"), F.col("commit_limit") / GIB - F.col("commit_floor"))))
    step = 256 * MIB
    h = h.withColumn("gpu_reserve", F.greatest(F.lit(768 * MIB), F.ceil(F.col("gpu_total") * 0.15 / step) * step))
    return h.withColumn("gpu_cap", F.greatest(F.lit(0), F.col("gpu_total") - F.col("gpu_reserve")))


_POLICY = f"""i AS (SELECT *, greatest(1.0::DOUBLE, round_even(total / {GIB}, 0)) AS installed FROM ({HOSTS})),
    t AS (SELECT *, CASE WHEN installed >= 24 THEN 12.0::DOUBLE WHEN installed >= 16 THEN 8.0::DOUBLE WHEN installed >= 8 THEN 6.0::DOUBLE ELSE greatest(1.0::DOUBLE, installed / 2) END AS tier FROM i),
    f AS (SELECT *, least(8.0::DOUBLE, greatest(2.0::DOUBLE, installed / 4)) AS free_floor, least(9.0::DOUBLE, greatest(3.0::DOUBLE, least(tier, installed / 2) * 0.75::DOUBLE)) AS commit_floor FROM t),
    g AS (SELECT *, greatest(0.0::DOUBLE, least(tier, commit_limit / {GIB} - commit_floor)) AS cap, greatest({768 * MIB}, CAST(ceil(gpu_total * 0.15::DOUBLE / {256 * MIB}) AS BIGINT) * {256 * MIB}) AS gpu_reserve FROM f),
    p AS (SELECT *, greatest(0, gpu_total - gpu_reserve) AS gpu_cap FROM g)"""


@R.add(f"WITH {_POLICY} SELECT host, cap, free_floor, commit_floor, gpu_reserve, gpu_cap FROM p")
def memory_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_policy(hosts(spark, sf_dir)).select("host", "cap", "free_floor", "commit_floor", "gpu_reserve", "gpu_cap")


def reasons(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(bad, name) for name, bad in pairs])


def admitted(h: DataFrame, r: DataFrame) -> DataFrame:
    """A decision per request: no host of its kind could ever hold it, or it waits, or it goes in.

    Reservations are summed per host before the join, so a host joins one row
    however many requests wait for it.
    """
    held = r.where("waits").groupBy("host").agg(*[F.sum(c).alias(f"held_{c}") for c in ("private", "physical", "gpu")])
    x = r.join(with_policy(h).join(held, "host", "left").na.fill(0, ["held_private", "held_physical", "held_gpu"]), "host")
    c = F.col
    cap = c("cap") * GIB
    capacity = reasons(
        ("MODEL_PRIVATE_REQUIREMENT_EXCEEDS_PROJECT_CAP", c("private") + HOST_RESERVE > cap),
        ("MODEL_PHYSICAL_REQUIREMENT_EXCEEDS_CAPACITY", c("physical") > c("total") - c("free_floor") * GIB),
        ("MODEL_GPU_REQUIREMENT_EXCEEDS_CAPACITY", c("gpu") > c("gpu_cap")),
    )
    now = reasons(
        ("STAGE_PROJECTED_FAMILY_COMMIT_CAP", c("used") + c("private") + c("held_private") + HOST_RESERVE > cap),
        ("STAGE_PROJECTED_PHYSICAL_FREE_FLOOR", c("total") - c("used") - c("physical") - c("held_physical") < c("free_floor") * GIB),
        ("STAGE_PROJECTED_COMMIT_HEADROOM_FLOOR", c("commit_limit") - c("used") - c("private") - c("held_private") < c("commit_floor") * GIB),
        ("STAGE_PROJECTED_GPU_CAP_OR_RESERVE", (c("gpu_used") + c("gpu") + c("held_gpu") > c("gpu_cap")) | (c("gpu_total") - c("gpu_used") - c("gpu") - c("held_gpu") < c("gpu_reserve"))),
    )
    decision = F.when(capacity != "", "CAPACITY_INSUFFICIENT").when(now != "", "WAIT").otherwise("ADMIT")
    return x.select("request", "host", decision.alias("decision"), F.when(capacity != "", capacity).otherwise(now).alias("reasons"))


@R.add(f"""WITH {_POLICY}, q AS ({REQUESTS}), h AS (SELECT host, sum(private) AS hp, sum(physical) AS hw, sum(gpu) AS hg FROM q WHERE waits GROUP BY host),
    x AS (SELECT q.*, p.* EXCLUDE (host), coalesce(hp, 0) AS hp, coalesce(hw, 0) AS hw, coalesce(hg, 0) AS hg FROM q JOIN p USING (host) LEFT JOIN h USING (host)),
    y AS (SELECT request, host, concat_ws(',', CASE WHEN private + {HOST_RESERVE} > cap * {GIB} THEN 'MODEL_PRIVATE_REQUIREMENT_EXCEEDS_PROJECT_CAP' END, CASE WHEN physical > total - free_floor * {GIB} THEN 'MODEL_PHYSICAL_REQUIREMENT_EXCEEDS_CAPACITY' END,
        CASE WHEN gpu > gpu_cap THEN 'MODEL_GPU_REQUIREMENT_EXCEEDS_CAPACITY' END) AS a, concat_ws(',', CASE WHEN used + private + hp + {HOST_RESERVE} > cap * {GIB} THEN 'STAGE_PROJECTED_FAMILY_COMMIT_CAP' END,
        CASE WHEN total - used - physical - hw < free_floor * {GIB} THEN 'STAGE_PROJECTED_PHYSICAL_FREE_FLOOR' END, CASE WHEN commit_limit - used - private - hp < commit_floor * {GIB} THEN 'STAGE_PROJECTED_COMMIT_HEADROOM_FLOOR' END,
        CASE WHEN gpu_used + gpu + hg > gpu_cap OR gpu_total - gpu_used - gpu - hg < gpu_reserve THEN 'STAGE_PROJECTED_GPU_CAP_OR_RESERVE' END) AS b FROM x)
    SELECT request, host, CASE WHEN a <> '' THEN 'CAPACITY_INSUFFICIENT' WHEN b <> '' THEN 'WAIT' ELSE 'ADMIT' END AS decision, CASE WHEN a <> '' THEN a ELSE b END AS reasons FROM y""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(hosts(spark, sf_dir), requests(spark, sf_dir))


#: Shapes beyond this ratio are padded; the short edge grows to at least SHORT_EDGE; results stay within PIXELS.
RATIO, SHORT_EDGE, PIXELS = 200, 32, 40_000_000


@R.add(f"""WITH s AS (SELECT p_partkey, p_partkey % 9000 + 1 AS w, p_size AS h FROM part), n AS (SELECT *, greatest({SHORT_EDGE}, CAST(ceil(greatest(w, h) / {RATIO}) AS BIGINT)) AS need, greatest(w, h) > {RATIO} * least(w, h) AS far FROM s),
    o AS (SELECT *, CASE WHEN far AND w < h THEN greatest(w, need) ELSE w END AS out_w, CASE WHEN far AND w >= h THEN greatest(h, need) ELSE h END AS out_h FROM n)
    SELECT p_partkey, out_w, CAST(out_h AS BIGINT) AS out_h, (out_w - w) // 2 AS at_x, CAST((out_h - h) // 2 AS BIGINT) AS at_y, CASE WHEN out_w * out_h > {PIXELS} THEN 'PIXEL_BUDGET_EXCEEDED' WHEN far THEN 'PADDED' ELSE 'UNCHANGED' END AS status FROM o""")
def aspect_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    s = P.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 9000 + 1).alias("w"), F.col("p_size").cast("long").alias("h"))
    far, need = F.greatest(w, h) > RATIO * F.least(w, h), F.greatest(F.lit(SHORT_EDGE), F.ceil(F.greatest(w, h) / RATIO))
    o = s.withColumn("out_w", F.when(far & (w < h), F.greatest(w, need)).otherwise(w)).withColumn("out_h", F.when(far & (w >= h), F.greatest(h, need)).otherwise(h))
    status = F.when(F.col("out_w") * F.col("out_h") > PIXELS, "PIXEL_BUDGET_EXCEEDED").when(far, "PADDED").otherwise("UNCHANGED")
    return o.select("p_partkey", "out_w", "out_h", F.expr("(out_w - w) div 2").alias("at_x"), F.expr("(out_h - h) div 2").alias("at_y"), status.alias("status"))


@R.add("""SELECT ps_n AS supplier, min(q) AS max_items, min(b) AS max_bytes, string_agg(DISTINCT r, ',' ORDER BY r) AS roles
    FROM (SELECT l_suppkey AS ps_n, CAST(l_quantity AS BIGINT) AS q, l_partkey * 1024 AS b, l_returnflag AS r FROM lineitem) GROUP BY ps_n""")
def capability_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all upstreams of a key can do: their least limits, and every role that one of them has."""
    li = P.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.min(F.col("l_quantity").cast("long")).alias("max_items"), F.min(F.col("l_partkey") * 1024).alias("max_bytes"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("roles")
    )


def batched(items: DataFrame, *, key: str, order: str, size: str, max_items: int, max_bytes: int) -> DataFrame:
    """(key, order, batch): greedy batches of a key's items in order.

    A batch closes before the item that would overfill it; an item that no batch
    can hold has none. A running sum with resets is no window, so sorted rows pass
    through Python with a batch's number and sums, and no key is ever held whole.
    """
    rows = items.select(key, F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, count, held = None, 0, 0, 0
        for frame in frames:
            out: list[int | None] = []
            for k, n in zip(frame[key], frame["n"], strict=True):
                if k != at:
                    at, batch, count, held = k, 0, 0, 0
                if n > max_bytes:
                    out.append(None)
                    continue
                if count and (count >= max_items or held + n > max_bytes):
                    batch, count, held = batch + 1, 0, 0
                count, held = count + 1, held + n
                out.append(batch)
            yield pd.DataFrame({key: frame[key], order: frame["o"], "batch": pd.array(out, "Int64")})

    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "o").mapInPandas(run, f"{key} {kind}, {order} long, batch long")


@R.add("""WITH RECURSIVE t AS (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
    f AS (SELECT request, k, CASE WHEN n > 45 THEN 0 ELSE 1 END AS items, CASE WHEN n > 45 THEN 0 ELSE n END AS bytes, CAST(0 AS BIGINT) AS batch, n <= 45 AS fits FROM t WHERE k = 1
    UNION ALL SELECT t.request, t.k, CASE WHEN t.n > 45 THEN f.items WHEN f.items > 0 AND (f.items >= 3 OR f.bytes + t.n > 45) THEN 1 ELSE f.items + 1 END,
        CASE WHEN t.n > 45 THEN f.bytes WHEN f.items > 0 AND (f.items >= 3 OR f.bytes + t.n > 45) THEN t.n ELSE f.bytes + t.n END,
        CASE WHEN t.n <= 45 AND f.items > 0 AND (f.items >= 3 OR f.bytes + t.n > 45) THEN f.batch + 1 ELSE f.batch END, t.n <= 45 FROM f JOIN t ON t.request = f.request AND t.k = f.k + 1)
    SELECT request, CASE WHEN fits THEN batch END AS batch, count(*) AS items FROM f GROUP BY ALL""")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as items of a request: at most three, and 45 in size, to a batch."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity"))
    items = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), k.cast("long").alias("k"), F.col("l_quantity").alias("n"))
    return batched(items, key="request", order="k", size="n", max_items=3, max_bytes=45).groupBy("request", "batch").agg(F.count("*").alias("items"))
