"""Region algebra: boxes on pages, their roles, owners, overlaps and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import islands
from ..registry import Registry
from ..sources import projections as P

R = Registry()

# Layout labels by role.
FORMULA_LABELS = ("formula", "display_formula", "inline_formula", "formula_number", "equation")
TEXT_LABELS = ("text", "paragraph_title", "doc_title", "abstract", "content", "figure_title", "reference", "reference_content", "footnote", "header", "footer", "aside_text", "number")
PRESERVED_LABELS = ("table", "algorithm")

_F = ", ".join(f"'{x}'" for x in FORMULA_LABELS)
_T = ", ".join(f"'{x}'" for x in TEXT_LABELS)
_REG = f"r AS ({P.REGIONS})"


def area(a: str = "") -> Column:
    c = lambda n: F.col(f"{a}{n}")
    return F.greatest(F.lit(0), c("x1") - c("x0")) * F.greatest(F.lit(0), c("y1") - c("y0"))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def contains(a: str, b: str, slack: int = 0) -> Column:
    """The first box holds the second, borders included."""
    c = F.col
    return (c(f"{a}x0") - slack <= c(f"{b}x0")) & (c(f"{a}y0") - slack <= c(f"{b}y0")) & (c(f"{a}x1") + slack >= c(f"{b}x1")) & (c(f"{a}y1") + slack >= c(f"{b}y1"))


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of a page side by side, columns prefixed a_ and b_, never a box with itself; the page is the join's key."""
    left, right = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    return left.join(right, (F.col("a_page") == F.col("b_page")) & (F.col("a_region") != F.col("b_region")))


#: Side of the cells that boxes are dealt into before they meet.
CELL = 64


def touching(a: DataFrame, b: DataFrame, slack: int = 0) -> DataFrame:
    """As pairs(), but only boxes that meet, borders included, once b's have grown by ``slack`` on every side.

    Boxes meet by page and cell, so that a crowded page is no quadratic group, and a pair is kept in the cell of the
    first corner that both share, which is one.
    """
    def dealt(df: DataFrame, prefix: str, grown: int) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - grown) / CELL), F.floor((F.col(hi) + grown) / CELL)))
        cells = df.withColumn("__cx", span("x0", "x1")).withColumn("__cy", span("y0", "y1"))
        return cells.select("__cx", "__cy", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    corner = lambda axis: F.greatest(F.col(f"a_{axis}0"), F.col(f"b_{axis}0") - slack)
    end = lambda axis: F.least(F.col(f"a_{axis}1"), F.col(f"b_{axis}1") + slack)
    left, right = dealt(a, "a_", 0), dealt(b, "b_", slack).withColumnsRenamed({"__cx": "__dx", "__cy": "__dy"})
    on = (F.col("a_page") == F.col("b_page")) & (F.col("__cx") == F.col("__dx")) & (F.col("__cy") == F.col("__dy"))
    meet = (F.col("a_region") != F.col("b_region")) & (corner("x") <= end("x")) & (corner("y") <= end("y"))
    once = (F.col("__cx") == F.floor(corner("x") / CELL)) & (F.col("__cy") == F.floor(corner("y") / CELL))
    return left.join(right, on).where(meet & once).drop("__cx", "__cy", "__dx", "__dy")


def role() -> Column:
    return F.when(F.col("label").isin(*FORMULA_LABELS), "formula").when(F.col("label").isin(*TEXT_LABELS), "text").otherwise("preserved")


def deduplicate(regions: DataFrame) -> DataFrame:
    """One row of each (page, box, role, crop), the first in order, with the others' ids in ``aliases``; images and charts are alike."""
    kind = F.when(F.col("label").isin("image", "chart"), "figure").otherwise(F.col("label"))
    grouped = regions.groupBy("page", "x0", "y0", "x1", "y1", kind.alias("kind"), "sha").agg(F.sort_array(F.collect_list(F.struct("ord", "region", "label"))).alias("all"))
    first = F.col("all")[0]
    aliases = F.transform(F.slice("all", 2, F.size("all")), lambda x: x["region"])
    return grouped.select("page", first["region"].alias("region"), first["ord"].alias("ord"), first["label"].alias("label"), "x0", "y0", "x1", "y1", "sha", aliases.alias("aliases"))


_DEDUP = """d AS (SELECT page, min_by(region, ord) AS region, min(ord) AS ord, min_by(label, ord) AS label, x0, y0, x1, y1, sha,
    list(region ORDER BY ord)[2:] AS aliases FROM r GROUP BY page, x0, y0, x1, y1, CASE WHEN label IN ('image', 'chart') THEN 'figure' ELSE label END, sha)"""


@R.add(f"WITH {_REG}, {_DEDUP} SELECT region, label, array_to_string(aliases, ',') AS aliases FROM d")
def region_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(P.regions(spark, sf_dir)).select("region", "label", F.array_join("aliases", ",").alias("aliases"))


def owned_by_tables(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables that no other table holds, (region, owner) of all they hold).

    Containment is transitive, so a table is kept just if no larger or earlier one holds it. Of several owners the
    last in the tables' order (large first) counts.
    """
    tables = regions.where("label = 'table'").withColumn("area", area())
    held = touching(tables, tables).where(contains("b_", "a_")).where((F.col("b_area") > F.col("a_area")) | ((F.col("b_area") == F.col("a_area")) & (F.col("b_ord") < F.col("a_ord"))))
    kept = tables.join(held.select(F.col("a_region").alias("region")).distinct(), "region", "left_anti")
    inside = touching(regions, kept).where(contains("b_", "a_"))
    owner = F.max_by("b_region", F.struct(-F.col("b_area"), "b_ord"))
    return kept, inside.groupBy(F.col("a_region").alias("region")).agg(owner.alias("owner"))


_TABLES = """t AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM r WHERE label = 'table'),
    k AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.page = a.page AND b.region <> a.region AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
        AND (b.area > a.area OR b.area = a.area AND b.ord < a.ord))),
    o AS (SELECT region, owner FROM (SELECT r.region, k.region AS owner, row_number() OVER (PARTITION BY r.region ORDER BY k.area, k.ord DESC) AS n FROM r JOIN k
        ON r.page = k.page AND r.region <> k.region AND k.x0 <= r.x0 AND k.y0 <= r.y0 AND k.x1 >= r.x1 AND k.y1 >= r.y1) WHERE n = 1)"""


@R.add(f"WITH {_REG}, {_TABLES} SELECT region, owner FROM o")
def table_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_by_tables(P.regions(spark, sf_dir))[1]


def plan_roles(regions: DataFrame) -> DataFrame:
    """(page, region, role): table, owned, formula, text, overlapped (text that meets a formula) or preserved."""
    kept, owned = owned_by_tables(regions)
    marked = regions.join(owned, "region", "left").join(kept.select("region", F.lit(True).alias("kept")), "region", "left")
    base = F.when(F.col("owner").isNotNull(), "owned").when(F.col("kept"), "table").otherwise(role())
    roled = marked.select("page", "region", "x0", "y0", "x1", "y1", base.alias("role"))
    texts, formulas = roled.where("role = 'text'"), roled.where("role = 'formula'")
    met = touching(texts, formulas).where(overlap("a_", "b_") > 0).select(F.col("a_region").alias("region"), F.lit(True).alias("met")).distinct()
    return roled.join(met, "region", "left").select("page", "region", F.when(F.col("met"), "overlapped").otherwise(F.col("role")).alias("role"))


_ROLES = f"""p AS (SELECT r.*, CASE WHEN o.owner IS NOT NULL THEN 'owned' WHEN k.region IS NOT NULL THEN 'table' WHEN r.label IN ({_F}) THEN 'formula'
    WHEN r.label IN ({_T}) THEN 'text' ELSE 'preserved' END AS role FROM r LEFT JOIN o ON o.region = r.region LEFT JOIN k ON k.region = r.region),
    q AS (SELECT p.page, p.region, CASE WHEN role = 'text' AND EXISTS (SELECT 1 FROM p f WHERE f.role = 'formula' AND f.page = p.page AND least(f.x1, p.x1) > greatest(f.x0, p.x0)
        AND least(f.y1, p.y1) > greatest(f.y0, p.y0)) THEN 'overlapped' ELSE role END AS role FROM p)"""


@R.add(f"WITH {_REG}, {_TABLES}, {_ROLES} SELECT page, region, role FROM q")
def region_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_roles(P.regions(spark, sf_dir))


@R.add(f"WITH {_REG}, {_TABLES}, {_ROLES} SELECT role, count(*) AS regions, count(DISTINCT page) AS pages FROM q GROUP BY role")
def region_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_roles(P.regions(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("regions"), F.count_distinct("page").alias("pages"))


@R.add(f"""WITH {_REG}, c AS (SELECT a.region AS caption, b.region AS figure, count(*) OVER (PARTITION BY a.region) AS n FROM r a JOIN r b ON a.page = b.page AND a.label = 'figure_title'
    AND b.label IN ('chart', 'image') AND 2 * b.x0 <= a.x0 + a.x1 AND a.x0 + a.x1 <= 2 * b.x1 AND abs(a.y0 - b.y1) <= 2 * (a.y1 - a.y0)) SELECT caption, figure FROM c WHERE n = 1""")
def caption_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions whose centre is in one figure's width, near its foot; two candidates make none."""
    r = P.regions(spark, sf_dir)
    centre = F.col("a_x0") + F.col("a_x1")
    near = F.abs(F.col("a_y0") - F.col("b_y1")) <= 2 * (F.col("a_y1") - F.col("a_y0"))
    hit = pairs(r.where("label = 'figure_title'"), r.where("label in ('chart', 'image')")).where((2 * F.col("b_x0") <= centre) & (centre <= 2 * F.col("b_x1")) & near)
    return hit.groupBy(F.col("a_region").alias("caption")).agg(F.count("*").alias("n"), F.min("b_region").alias("figure")).where("n = 1").drop("n")


@R.add(f"""WITH {_REG} SELECT o_orderkey AS page, CASE WHEN count(r.region) = 0 THEN 'NO_LAYOUT_REGIONS_TEXT_FALLBACK_REVIEW' ELSE 'IMAGE_ONLY_PAGE_TEXT_FALLBACK_REVIEW' END AS reason FROM orders LEFT JOIN r ON r.page = o_orderkey
    GROUP BY o_orderkey HAVING count(CASE WHEN label IN ({_F}, {_T}, 'table', 'algorithm') THEN 1 END) = 0""")
def page_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without any region that can be transcribed."""
    usable = F.col("label").isin(*FORMULA_LABELS, *TEXT_LABELS, *PRESERVED_LABELS)
    per_page = P.regions(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"))
    pages = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).distinct()
    reason = F.when(F.col("n").isNull(), "NO_LAYOUT_REGIONS_TEXT_FALLBACK_REVIEW").otherwise("IMAGE_ONLY_PAGE_TEXT_FALLBACK_REVIEW")
    return pages.join(per_page, "page", "left").where("coalesce(usable, 0) = 0").select("page", reason.alias("reason"))


@R.add(f"""WITH {_REG} SELECT a.region FROM r a WHERE a.label IN ('chart', 'image') AND NOT EXISTS (SELECT 1 FROM r b WHERE b.page = a.page AND b.region <> a.region AND least(a.x1, b.x1) > greatest(a.x0, b.x0)
    AND least(a.y1 + greatest(3, least(40, (a.y1 - a.y0) // 6)), b.y1) > greatest(a.y1, b.y0))""")
def figure_edges_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that may grow down by a sixth of their height, 3 rows at least and 40 at most: no other box is in the strip."""
    r = P.regions(spark, sf_dir)
    figures = r.where("label in ('chart', 'image')")
    # The strips alone meet the boxes, so that neither is dealt into cells that it does not touch.
    foot = F.col("y1") + F.greatest(F.lit(3), F.least(F.lit(40), F.expr("(y1 - y0) div 6")))
    strips = figures.select("page", "region", "x0", F.col("y1").alias("y0"), "x1", foot.alias("y1"))
    open_ = lambda axis: F.least(f"a_{axis}1", f"b_{axis}1") > F.greatest(f"a_{axis}0", f"b_{axis}0")
    boxes = r.select("page", "region", "x0", "y0", "x1", "y1")
    blocked = touching(strips, boxes).where(open_("x") & open_("y")).select(F.col("a_region").alias("region")).distinct()
    return figures.select("region").join(blocked, "region", "left_anti")


@R.add(f"""WITH {_REG}, b AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 THEN 1 ELSE 0 END AS cut FROM r),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS band FROM b) SELECT page, CAST(band AS BIGINT) AS band, count(*) AS regions, min(y0) AS top, max(y1) AS bottom FROM i GROUP BY page, band""")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in horizontal bands: a gap of more than three rows begins another."""
    above = F.max("y1").over(W.partitionBy("page").orderBy("y0", "ord").rowsBetween(W.unboundedPreceding, -1))
    r = islands(P.regions(spark, sf_dir).withColumn("above", above), keys=["page"], order=["y0", "ord"], breaks=F.col("y0") - F.col("above") > 3, name="band")
    return r.groupBy("page", "band").agg(F.count("*").alias("regions"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))


@R.add(f"""WITH {_REG} SELECT page, array_to_string(list(v ORDER BY ord), ' ') AS assembled, sha256(array_to_string(list(v ORDER BY ord), ' ')) AS digest
    FROM (SELECT page, ord, CASE WHEN label IN ({_F}) THEN '$' || region || '$' ELSE region END AS v FROM r) GROUP BY page""")
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's parts in reading order, formulas between dollar signs."""
    part = F.when(F.col("label").isin(*FORMULA_LABELS), F.concat(F.lit("$"), "region", F.lit("$"))).otherwise(F.col("region"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("v")))), lambda x: x["v"]), " ")
    return P.regions(spark, sf_dir).groupBy("page").agg(joined.alias("assembled")).withColumn("digest", F.sha2(F.col("assembled").cast("binary"), 256))
