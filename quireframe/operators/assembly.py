"""Spatial assembly: which prose a formula belongs to, what repeats, what blocks it, and the parts of a page in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import per_group
from ..registry import Registry
from ..sources import projections as P
from .regions import FORMULA_LABELS, TEXT_LABELS, area, contains, overlap, touching

R = Registry()
_F = ", ".join(f"'{x}'" for x in FORMULA_LABELS)
_T = ", ".join(f"'{x}'" for x in TEXT_LABELS)
#: What the regions of the test tables read, by a prefix: longer ones hold shorter ones.
READING = "kt=5v"
_READ = f"r AS (SELECT *, left('{READING}', CAST(sha AS INTEGER)) AS text FROM ({P.REGIONS}))"
_AREA = "greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0)"


def read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the text that was read from them."""
    return P.regions(spark, sf_dir).withColumn("text", F.left(F.lit(READING), F.col("sha").cast("int")))


def lexical(value: Column) -> Column:
    """LaTeX without what makes no difference: blanks, primes, fonts of units, braces around one letter.

    Units keep their symbols.
    """
    # The units whose font and thin space do not count.
    units = "kg|km/h|cm|mm|m/s|s|Hz|Pa"
    value = F.replace(F.regexp_replace(value, r"\s+", ""), F.lit(r"^{\prime}"), F.lit("'"))
    value = F.regexp_replace(value, rf"~?\\(?:mathrm|text)\{{({units})\}}", r"\\unit{$1}")
    return F.regexp_replace(value, r"\{([A-Za-z](?:_\{[^{}]+\})?)\}", "$1")


def contained(regions: DataFrame, key: Column) -> DataFrame:
    """(child, owner): boxes whose text is part of that of a box around them; the largest counts, the first of equal ones.

    A box half as wide again may miss a pixel at each side.
    """
    r = regions.withColumn("key", key)
    same = (F.col("a_x0") == F.col("b_x0")) & (F.col("a_y0") == F.col("b_y0")) & (F.col("a_x1") == F.col("b_x1")) & (F.col("a_y1") == F.col("b_y1"))
    wide = 2 * (F.col("b_x1") - F.col("b_x0")) >= 3 * (F.col("a_x1") - F.col("a_x0"))
    hit = touching(r.where("key <> ''"), r, 1).where(~same & (contains("b_", "a_") | (wide & contains("b_", "a_", 1))) & F.col("b_key").contains(F.col("a_key")))
    return hit.groupBy(F.col("a_region").alias("child")).agg(F.max_by("b_region", F.struct(area("b_"), -F.col("b_ord"))).alias("owner"))


_CONTAINED = f"""c AS (SELECT a.region AS child, arg_max(b.region, {_AREA.format("b")} * 1000 - b.ord) AS owner FROM r a JOIN r b ON a.page = b.page AND a.region <> b.region AND a.text <> ''
    AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1) AND (b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
    OR 2 * (b.x1 - b.x0) >= 3 * (a.x1 - a.x0) AND b.x0 - 1 <= a.x0 AND b.y0 - 1 <= a.y0 AND b.x1 + 1 >= a.x1 AND b.y1 + 1 >= a.y1) AND contains(b.text, a.text) GROUP BY a.region)"""


@R.add(f"WITH {_READ}, {_CONTAINED} SELECT child, owner FROM c")
def formula_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read_regions(spark, sf_dir), lexical(F.col("text")))


def _overhangs(a: str, b: str) -> Column:
    """Box a leaves box b at its foot only, by more than two pixels."""
    c = lambda n: F.col(n)
    return (c(f"{b}x0") - 2 <= c(f"{a}x0")) & (c(f"{b}y0") - 2 <= c(f"{a}y0")) & (c(f"{b}x1") + 2 >= c(f"{a}x1")) & (c(f"{a}y1") > c(f"{b}y1") + 2)


def body_shared(a: str, b: str) -> Column:
    """Three quarters of box a's height and its centre lie in box b, and no more than a quarter hangs out."""
    height, out = F.col(f"{a}y1") - F.col(f"{a}y0"), F.col(f"{a}y1") - F.col(f"{b}y1")
    inside = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    centre = F.col(f"{a}y0") + F.col(f"{a}y1")
    return (height > 0) & (4 * inside >= 3 * height) & (out > 0) & (4 * out <= height) & (2 * F.col(f"{b}y0") <= centre) & (centre <= 2 * F.col(f"{b}y1"))


def overhang_blockers(hanging: DataFrame, texts: DataFrame) -> DataFrame:
    """(formula, parent, blocker): text of the same column between a formula and the prose it hangs out of.

    ``hanging`` has columns prefixed a_ (formula) and b_ (parent). A blocker stands between both in reading order, or
    at or after the parent and beside what hangs out.
    """
    o = texts.select(*[F.col(c).alias(f"o_{c}") for c in texts.columns])
    shared = F.least("b_x1", "o_x1") - F.greatest("b_x0", "o_x0")
    column = 2 * shared > F.least(F.col("b_x1") - F.col("b_x0"), F.col("o_x1") - F.col("o_x0"))
    between = (F.col("b_ord") < F.col("o_ord")) & (F.col("o_ord") < F.col("a_ord"))
    beside = (F.col("o_ord") >= F.col("b_ord")) & (F.col("o_y0") < F.col("a_y1")) & (F.col("o_y1") > F.col("b_y1"))
    j = hanging.join(o, (F.col("a_page") == F.col("o_page")) & (F.col("o_region") != F.col("b_region"))).where(column & (between | beside))
    return j.select(F.col("a_region").alias("formula"), F.col("b_region").alias("parent"), F.col("o_region").alias("blocker"))


def hanging_pairs(regions: DataFrame) -> DataFrame:
    formulas, texts = (regions.where(F.col("label").isin(*labels)) for labels in (FORMULA_LABELS, TEXT_LABELS))
    return touching(formulas, texts, 2).where(_overhangs("a_", "b_") & body_shared("a_", "b_"))


_HANG = f"""f AS (SELECT * FROM r WHERE label IN ({_F})), t AS (SELECT * FROM r WHERE label IN ({_T})),
    h AS (SELECT f.region AS formula, t.region AS parent, f.page, f.ord AS f_ord, f.y1 AS f_y1, t.ord AS t_ord, t.x0, t.x1, t.y1 FROM f JOIN t ON f.page = t.page AND f.region <> t.region
        AND t.x0 - 2 <= f.x0 AND t.y0 - 2 <= f.y0 AND t.x1 + 2 >= f.x1 AND f.y1 > t.y1 + 2 AND f.y1 > f.y0 AND 4 * (least(f.y1, t.y1) - greatest(f.y0, t.y0)) >= 3 * (f.y1 - f.y0)
        AND 4 * (f.y1 - t.y1) <= f.y1 - f.y0 AND 2 * t.y0 <= f.y0 + f.y1 AND f.y0 + f.y1 <= 2 * t.y1),
    b AS (SELECT h.formula, h.parent, o.region AS blocker FROM h JOIN t o ON o.page = h.page AND o.region <> h.parent AND 2 * (least(h.x1, o.x1) - greatest(h.x0, o.x0)) > least(h.x1 - h.x0, o.x1 - o.x0)
        AND (h.t_ord < o.ord AND o.ord < h.f_ord OR o.ord >= h.t_ord AND o.y0 < h.f_y1 AND o.y1 > h.y1))"""


@R.add(f"WITH {_READ}, {_HANG} SELECT formula, parent, blocker FROM b")
def reading_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_regions(spark, sf_dir)
    return overhang_blockers(hanging_pairs(r), r.where(F.col("label").isin(*TEXT_LABELS)))


def prose_parents(regions: DataFrame, key: Column) -> DataFrame:
    """(formula, parent): the one prose box that a formula belongs to.

    Formulas without text, and those contained in others, have none. A formula that meets one text box belongs to it
    if it lies within it, two pixels aside, or hangs out of its foot with nothing in between; one that meets several
    has no parent; one that meets none belongs to the only box that holds it.
    """
    formulas, texts = (regions.where(F.col("label").isin(*labels)) for labels in (FORMULA_LABELS, TEXT_LABELS))
    hidden = contained(formulas, key).select(F.col("child").alias("region"))
    active = formulas.where("text <> ''").join(hidden, "region", "left_anti")
    near = touching(active, texts, 2)
    holds = contains("b_", "a_", 2)
    met = near.where(overlap("a_", "b_") > 0)
    hanging = met.where(_overhangs("a_", "b_") & body_shared("a_", "b_") & (F.col("b_ord") < F.col("a_ord")))
    blocked = overhang_blockers(hanging, texts).select("formula", "parent").distinct()
    clear = hanging.select(F.col("a_region").alias("formula"), F.col("b_region").alias("parent")).join(blocked, ["formula", "parent"], "left_anti")
    per = near.groupBy(F.col("a_region").alias("formula")).agg(
        F.count_if(overlap("a_", "b_") > 0).alias("met"), F.count_if(holds).alias("held"), F.max(F.when(overlap("a_", "b_") > 0, F.col("b_region"))).alias("one"), F.max(F.when(holds, F.col("b_region"))).alias("holder")
    )
    by_hanging = per.where("met = 1").join(clear, "formula").select("formula", "parent")
    within = met.where(holds).select(F.col("a_region").alias("formula"), F.col("b_region").alias("parent"))
    by_meeting = per.where("met = 1").join(within, "formula").select("formula", "parent")
    alone = per.where("met = 0 AND held = 1").select("formula", F.col("holder").alias("parent"))
    return by_meeting.unionByName(by_hanging).unionByName(alone).distinct()


@R.add(f"""WITH {_READ}, {_HANG}, e AS (SELECT a.region FROM f a JOIN f b ON a.page = b.page AND a.region <> b.region AND a.text <> '' AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1)
        AND (b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 OR 2 * (b.x1 - b.x0) >= 3 * (a.x1 - a.x0) AND b.x0 - 1 <= a.x0 AND b.y0 - 1 <= a.y0 AND b.x1 + 1 >= a.x1 AND b.y1 + 1 >= a.y1) AND contains(b.text, a.text)),
    n AS (SELECT f.region AS formula, t.region AS parent, least(f.x1, t.x1) > greatest(f.x0, t.x0) AND least(f.y1, t.y1) > greatest(f.y0, t.y0) AS met, t.x0 - 2 <= f.x0 AND t.y0 - 2 <= f.y0 AND t.x1 + 2 >= f.x1 AND t.y1 + 2 >= f.y1 AS holds
        FROM f JOIN t ON f.page = t.page AND f.region <> t.region WHERE f.text <> '' AND f.region NOT IN (SELECT region FROM e)),
    k AS (SELECT *, count(*) FILTER (met) OVER (PARTITION BY formula) AS m, count(*) FILTER (holds) OVER (PARTITION BY formula) AS s FROM n)
    SELECT formula, parent FROM k WHERE m = 1 AND met AND (holds OR EXISTS (SELECT 1 FROM h WHERE h.formula = k.formula AND h.parent = k.parent AND h.t_ord < h.f_ord) AND NOT EXISTS (SELECT 1 FROM b WHERE b.formula = k.formula AND b.parent = k.parent))
    OR m = 0 AND s = 1 AND holds""")
def formula_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_parents(read_regions(spark, sf_dir), lexical(F.col("text")))


@R.add(f"""WITH {_READ} SELECT DISTINCT t.region FROM r t JOIN r b ON t.page = b.page AND t.region <> b.region AND t.label IN ({_T}) AND b.label = 'table' AND b.text <> ''
    AND least(t.x1, b.x1) > greatest(t.x0, b.x0) AND least(t.y1, b.y1) > greatest(t.y0, b.y0)""")
def table_masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that meets an accepted table, one with content."""
    r = read_regions(spark, sf_dir)
    met = touching(r.where(F.col("label").isin(*TEXT_LABELS)), r.where("label = 'table' AND text <> ''")).where(overlap("a_", "b_") > 0)
    return met.select(F.col("a_region").alias("region")).distinct()


@R.add(f"""WITH {_READ}, m AS (SELECT t.region, f.region AS formula, 100 * (least(t.x1, f.x1) - greatest(t.x0, f.x0)) * (least(t.y1, f.y1) - greatest(t.y0, f.y0)) >= 98 * (t.x1 - t.x0) * (t.y1 - t.y0) AS covers
        FROM r t JOIN r f ON t.page = f.page AND t.label IN ({_T}) AND f.label IN ({_F}) AND t.text <> '' AND t.text = f.text AND least(t.x1, f.x1) > greatest(t.x0, f.x0) AND least(t.y1, f.y1) > greatest(t.y0, f.y0))
    SELECT region, min(formula) AS formula FROM m GROUP BY region HAVING count(*) = 1 AND bool_and(covers)""")
def math_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes whose output is that of the one formula box with the same reading, if this covers 98% of them."""
    r = read_regions(spark, sf_dir).where("text <> ''")
    met = touching(r.where(F.col("label").isin(*TEXT_LABELS)), r.where(F.col("label").isin(*FORMULA_LABELS))).where((overlap("a_", "b_") > 0) & (F.col("a_text") == F.col("b_text")))
    covers = 100 * overlap("a_", "b_") >= 98 * area("a_")
    return met.groupBy(F.col("a_region").alias("region")).agg(F.count("*").alias("n"), F.bool_and(covers).alias("covers"), F.min("b_region").alias("formula")).where("n = 1 AND covers").select("region", "formula")


@R.add(f"""WITH {_READ} SELECT f.region, f.region || '__text_fallback' AS fallback FROM r f WHERE f.label IN ({_F}) AND f.text = '' AND NOT EXISTS (SELECT 1 FROM r t WHERE t.label IN ({_T})
    AND t.page = f.page AND 100 * greatest(0, least(t.x1, f.x1) - greatest(t.x0, f.x0)) * greatest(0, least(t.y1, f.y1) - greatest(t.y0, f.y0)) >= 98 * (f.x1 - f.x0) * (f.y1 - f.y0))""")
def formula_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that gave nothing and that no text box covers by 98% become text."""
    r = read_regions(spark, sf_dir)
    failed = r.where(F.col("label").isin(*FORMULA_LABELS) & (F.col("text") == ""))
    covered = touching(failed, r.where(F.col("label").isin(*TEXT_LABELS))).where(100 * overlap("a_", "b_") >= 98 * area("a_"))
    lost = failed.join(covered.select(F.col("a_region").alias("region")).distinct(), "region", "left_anti")
    return lost.select("region", F.concat("region", F.lit("__text_fallback")).alias("fallback"))


def duplicate_text(regions: DataFrame) -> DataFrame:
    """(region, retained): text that a retained box around it, 95% of its area, already has.

    Whether a box is retained depends on larger ones, so a page's boxes are taken in turn, large ones first; a page is
    one group.
    """

    def page(rows: list) -> list[tuple]:
        size = lambda r: max(0, r.x1 - r.x0) * max(0, r.y1 - r.y0)
        keyed = [(r, re.sub(r"\s+", "", r.text or "")) for r in rows]
        kept: list[tuple] = []
        out = []
        for r, key in sorted((x for x in keyed if x[1]), key=lambda x: (-size(x[0]), x[0].ord, x[0].region)):
            shared = lambda o, r=r: max(0, min(r.x1, o.x1) - max(r.x0, o.x0)) * max(0, min(r.y1, o.y1) - max(r.y0, o.y0))
            owner = next((o for o, k in kept if key in k and size(r) and 100 * shared(o) >= 95 * size(r)), None)
            if owner is None:
                kept.append((r, key))
            else:
                out.append((r.region, owner.region))
        return out

    return per_group(regions.select("page", "region", "ord", "text", "x0", "y0", "x1", "y1"), "page", ["ord"], page, "region string, retained string")


@R.add()
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome is a fixpoint over a page's boxes, which the checking engine's SQL does not state."""
    return duplicate_text(read_regions(spark, sf_dir).where(F.col("label").isin(*TEXT_LABELS)))


@R.add(f"""WITH {_READ} SELECT region, x1 > x0 AND y1 > y0 AS box_ok, region <> '' AS id_ok, sha BETWEEN 1 AND 4 AS crop_ok,
    CASE WHEN region = '' THEN 'VISUAL_REGION_ID_REQUIRED' WHEN x1 <= x0 OR y1 <= y0 THEN 'VISUAL_REGION_BBOX_INVALID' WHEN NOT sha BETWEEN 1 AND 4 THEN 'VISUAL_REGION_CROP_SHA256_REQUIRED' END AS problem FROM r""")
def region_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contract that a region breaks, null if none; here a crop's digest is there if its number is from 1 to 4."""
    c = F.col
    crop, box = c("sha").between(1, 4), (c("x1") > c("x0")) & (c("y1") > c("y0"))
    problem = F.when(c("region") == "", "VISUAL_REGION_ID_REQUIRED").when(~box, "VISUAL_REGION_BBOX_INVALID").when(~crop, "VISUAL_REGION_CROP_SHA256_REQUIRED")
    return read_regions(spark, sf_dir).select("region", box.alias("box_ok"), (c("region") != "").alias("id_ok"), crop.alias("crop_ok"), problem.alias("problem"))


def outward(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """A fractional box widened to whole pixels."""
    return [F.floor(x0).alias("x0"), F.floor(y0).alias("y0"), F.ceil(x1).alias("x1"), F.ceil(y1).alias("y1")]


@R.add(f"""WITH q AS (SELECT region, label, ord, x0 / 4.0::DOUBLE AS a, y0 / 4.0::DOUBLE AS b, x1 / 4.0::DOUBLE AS c, y1 / 4.0::DOUBLE AS d FROM ({P.REGIONS}))
    SELECT region, a >= 0 AND a < c AND c <= 20 AND b >= 0 AND b < d AND d <= 15 AND label <> '' AS valid, CAST(floor(a) AS BIGINT) AS x0, CAST(floor(b) AS BIGINT) AS y0, CAST(ceil(c) AS BIGINT) AS x1, CAST(ceil(d) AS BIGINT) AS y1 FROM q""")
def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes on a page of 20 by 15: finite, inside, labelled; widened to whole pixels."""
    q = P.regions(spark, sf_dir).select("region", "label", *[(F.col(c) / 4.0).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), "abcd", strict=True)])
    c = F.col
    valid = (c("a") >= 0) & (c("a") < c("c")) & (c("c") <= 20) & (c("b") >= 0) & (c("b") < c("d")) & (c("d") <= 15) & (c("label") != "")
    return q.select("region", valid.alias("valid"), *outward(c("a"), c("b"), c("c"), c("d")))


@R.add(f"""WITH r AS ({P.REGIONS}), m AS (SELECT t.region, f.region AS formula, greatest(t.x0, f.x0) - t.x0 AS l, greatest(t.y0, f.y0) - t.y0 AS u, least(t.x1, f.x1) - t.x0 AS rr, least(t.y1, f.y1) - t.y0 AS d, t.x1 - t.x0 AS w, t.y1 - t.y0 AS h
        FROM r t JOIN r f ON t.page = f.page AND t.label IN ({_T}) AND f.label IN ({_F}) AND least(t.x1, f.x1) > greatest(t.x0, f.x0) AND least(t.y1, f.y1) > greatest(t.y0, f.y0))
    SELECT region, formula, greatest(0, l * 300 // w) AS px0, greatest(0, u * 100 // h) AS py0, least(299, (rr * 300 + w - 1) // w - 1) AS px1, least(99, (d * 100 + h - 1) // h - 1) AS py1 FROM m""")
def mask_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to paint over in a text's crop of 300 by 100 pixels: the shared box, its start rounded down and its end up, both inclusive."""
    r = P.regions(spark, sf_dir)
    m = touching(r.where(F.col("label").isin(*TEXT_LABELS)), r.where(F.col("label").isin(*FORMULA_LABELS))).where(overlap("a_", "b_") > 0)
    m = m.selectExpr("a_region AS region", "b_region AS formula", "greatest(a_x0, b_x0) - a_x0 AS l", "greatest(a_y0, b_y0) - a_y0 AS u", "least(a_x1, b_x1) - a_x0 AS r", "least(a_y1, b_y1) - a_y0 AS d", "a_x1 - a_x0 AS w", "a_y1 - a_y0 AS h")
    return m.selectExpr("region", "formula", "greatest(0, l * 300 div w) AS px0", "greatest(0, u * 100 div h) AS py0", "least(299, (r * 300 + w - 1) div w - 1) AS px1", "least(99, (d * 100 + h - 1) div h - 1) AS py1")


@R.add(f"""WITH r AS ({P.REGIONS}), f AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM r WHERE label IN ({_F}))
    SELECT page, coalesce(edge, 0) AS x0, x0 AS x1 FROM f WHERE x0 > coalesce(edge, 0) UNION ALL SELECT page, max(x1), 100 FROM f GROUP BY page HAVING max(x1) < 100""")
def slot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns between a page's formulas, on a page 100 wide, where text may stand."""
    f = P.regions(spark, sf_dir).where(F.col("label").isin(*FORMULA_LABELS))
    edge = F.coalesce(F.max("x1").over(W.partitionBy("page").orderBy("x0", "ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    between = f.withColumn("edge", edge).where("x0 > edge").select("page", F.col("edge").alias("x0"), F.col("x0").alias("x1"))
    last = f.groupBy("page").agg(F.max("x1").alias("x0")).where("x0 < 100").select("page", "x0", F.lit(100).cast("long").alias("x1"))
    return between.select("page", F.col("x0").cast("long"), F.col("x1").cast("long")).unionByName(last)


def assembled(parts: DataFrame) -> DataFrame:
    """(parent, text) of (parent, row, ord, part): parts of a row by blanks, rows by blank lines."""
    joined = lambda sep, *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x["v"]), sep)
    rows = parts.groupBy("parent", "row").agg(joined(" ", "ord", F.col("part").alias("v")).alias("line"))
    return rows.groupBy("parent").agg(joined("\n\n", "row", F.col("line").alias("v")).alias("text"))


@R.add(f"""WITH {_READ}, p AS (SELECT page AS parent, y0 // 10 AS row, ord, CASE WHEN label IN ({_F}) THEN '$' || text || '$' ELSE text END AS part FROM r),
    l AS (SELECT parent, row, string_agg(part, ' ' ORDER BY ord) AS line FROM p GROUP BY ALL) SELECT parent, sha256(string_agg(line, chr(10) || chr(10) ORDER BY row)) AS digest FROM l GROUP BY parent""")
def slot_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's slots put together, formulas between dollar signs."""
    part = F.when(F.col("label").isin(*FORMULA_LABELS), F.concat(F.lit("$"), "text", F.lit("$"))).otherwise(F.col("text"))
    parts = read_regions(spark, sf_dir).select(F.col("page").alias("parent"), F.expr("y0 div 10").alias("row"), "ord", part.alias("part"))
    return assembled(parts).select("parent", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@R.add(f"""WITH r AS (SELECT * FROM ({P.REGIONS}) WHERE label IN ({_T})), n AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(y1 - y0) OVER w AS ph, median(y1 - y0) OVER (PARTITION BY page) AS m FROM r WINDOW w AS (PARTITION BY page ORDER BY y0, ord)),
    b AS (SELECT *, CASE WHEN px0 IS NOT NULL AND 100 * (y1 - y0) BETWEEN 65 * m AND 150 * m AND 100 * ph BETWEEN 65 * m AND 150 * m AND 10 * (y0 - py1) <= 9 * m AND 2 * (least(x1, px1) - greatest(x0, px0)) >= least(x1 - x0, px1 - px0) THEN 0 ELSE 1 END AS cut FROM n),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY y0, ord ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT page, CAST(run AS BIGINT) AS run, count(*) AS rows, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY page, run HAVING count(*) > 1""")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of text that go on in the next one: of usual height, close, and sharing half of the narrower one's width."""
    w = W.partitionBy("page").orderBy("y0", "ord")
    r = P.regions(spark, sf_dir).where(F.col("label").isin(*TEXT_LABELS)).withColumn("h", F.col("y1") - F.col("y0"))
    r = r.select("*", *[F.lag(c).over(w).alias(f"p{c}") for c in ("x0", "x1", "y1", "h")], F.median("h").over(W.partitionBy("page")).alias("m"))
    usual = lambda h: (100 * F.col(h) >= 65 * F.col("m")) & (100 * F.col(h) <= 150 * F.col("m"))
    shared = F.least("x1", "px1") - F.greatest("x0", "px0")
    goes_on = F.col("px0").isNotNull() & usual("h") & usual("ph") & (10 * (F.col("y0") - F.col("py1")) <= 9 * F.col("m")) & (2 * shared >= F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0")))
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = r.withColumn("run", run).groupBy("page", "run").agg(F.count("*").alias("rows"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.where("rows > 1")


# Fixed value: a mark in brackets, with half or full width brackets, that tells how many points an answer is worth.
SCORE = r"[（(]\s*\d+(?:\.\d+)?\s*分\s*[)）]"


def score_rows(blocks: DataFrame) -> DataFrame:
    """(page, ord, content) after scores have gone to the answers beside them; a block that moved is empty.

    ``blocks`` has page, ord, label, content and a box. A score that stands alone follows the answer to its left on the
    same row; a score at the end of a text goes behind the formula that was masked out of it and comes next. Both
    share 0.7 of the lower box's height and differ in height by no more than three times. Merges blank later blocks,
    so a page's blocks are taken in turn.
    """
    score = re.compile(SCORE)

    def same_row(a, b) -> bool:
        small, large = sorted((a.y1 - a.y0, b.y1 - b.y0))
        return small > 0 and 10 * (min(a.y1, b.y1) - max(a.y0, b.y0)) >= 7 * small and large <= 3 * small

    def inline(text: str) -> str:
        text = text.strip()
        return f"${text[2:-2].strip()}$" if text.startswith("$$") and text.endswith("$$") and len(text) > 4 else text

    def page(rows: list) -> list[tuple]:
        content = [r.content or "" for r in rows]
        for i in range(len(rows) - 1):
            a, b, left, right = rows[i], rows[i + 1], content[i], content[i + 1]
            found = score.search(left)
            pieces = None
            if not left:
                continue
            if b.label == "formula_number" and score.fullmatch(right):
                if a.label in (*FORMULA_LABELS, "text") and a.x1 <= b.x0 and "\n\n" not in left.strip():
                    pieces = [left, right]
            elif found and not left[found.end() :].strip() and "\n" not in left.strip() and b.label in FORMULA_LABELS and a.x0 <= b.x0 < b.x1 <= a.x1:
                pieces = [left[: found.start()], right, found[0]]
            if pieces and same_row(a, b):
                content[i], content[i + 1] = " ".join(filter(None, map(inline, pieces))), ""
        return [(r.page, r.ord, c) for r, c in zip(rows, content, strict=True)]

    return per_group(blocks.select("page", "ord", "label", "content", "x0", "y0", "x1", "y1"), "page", ["ord"], page, "page long, ord int, content string")


@R.add()
def score_row_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts here end in a score, and a formula number is one."""
    content = F.when(F.col("label") == "text", F.concat("text", F.lit(" (5分)"))).when(F.col("label") == "seal", "（3 分）").otherwise(F.concat(F.lit("$$"), "text", F.lit("$$")))
    label = F.when(F.col("label") == "seal", "formula_number").otherwise(F.col("label"))
    r = read_regions(spark, sf_dir).select("page", F.col("ord").cast("int").alias("ord"), label.alias("label"), content.alias("content"), "x0", "y0", "x1", "y1")
    return score_rows(r)
