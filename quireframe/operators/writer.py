"""Documents from regions: Markdown in reading order, the manifest of what was kept as pictures, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P
from .assembly import READING, read_regions
from .regions import FORMULA_LABELS, pairs

R = Registry()
_F = ", ".join(f"'{x}'" for x in FORMULA_LABELS)
#: Labels of which nothing is read, so that their pictures stay.
UNREAD = ("image", "chart", "seal")


def captions(regions: DataFrame) -> DataFrame:
    """(caption, figure, c_ord, c_value): captions with text whose centre is in just one figure's width, near its foot."""
    centre = F.col("a_x0") + F.col("a_x1")
    near = F.abs(F.col("a_y0") - F.col("b_y1")) <= 2 * (F.col("a_y1") - F.col("a_y0"))
    hit = pairs(regions.where("label = 'figure_title' AND value <> ''"), regions.where("label in ('chart', 'image')")).where((2 * F.col("b_x0") <= centre) & (centre <= 2 * F.col("b_x1")) & near)
    return hit.groupBy(F.col("a_region").alias("caption")).agg(F.count("*").alias("n"), F.min("b_region").alias("figure"), F.min("a_ord").alias("c_ord"), F.min("a_value").alias("c_value")).where("n = 1").drop("n")


def blocks(regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc, number, ord, region, label, asset, content) of (doc, page, number, region, ord, label, value and a box).

    A region without text is kept as a picture, numbered through its document, under its captions; a caption that
    belongs to a figure is no block of its own. With ``pages`` (doc, number) the anchors of all pages are blocks too, so
    that a document's blocks need not be moved again to be joined with them.
    """
    c = F.col
    owned = captions(regions)
    told = owned.groupBy(c("figure").alias("region")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_ord", "c_value"))), lambda x: x["c_value"]), " ").alias("caption"))
    r = regions.select("doc", "number", "ord", "region", "label", "value").join(owned.select(c("caption").alias("region")), "region", "left_anti").join(told, "region", "left")
    if pages is not None:
        anchor = F.concat(F.lit("\n<!-- page:"), F.col("number").cast("string"), F.lit(" -->\n"))
        r = r.unionByName(pages.select("doc", "number", F.lit(0).cast(r.schema["ord"].dataType).alias("ord"), anchor.alias("anchor")), allowMissingColumns=True)
    kept = F.when(c("value") == "", 1).otherwise(0)
    before = F.sum(kept).over(W.partitionBy("doc").orderBy("number", "ord").rowsBetween(W.unboundedPreceding, 0))
    r = r.withColumn("asset", F.when(c("value") == "", F.concat(F.lit("image_"), F.lpad(before.cast("string"), 6, "0"))))
    picture = F.concat(F.coalesce(F.concat("caption", F.lit("\n\n")), F.lit("")), F.lit("!["), "label", F.lit("](assets/"), "asset", F.lit(".png)"))
    content = (
        F.when(c("value") == "", picture)
        .when(c("label") == "inline_formula", F.concat(F.lit("$"), "value", F.lit("$")))
        .when(c("label").isin(*FORMULA_LABELS), F.concat(F.lit("$$\n"), "value", F.lit("\n$$")))
        .when(c("label") == "doc_title", F.concat(F.lit("# "), "value"))
        .when(c("label") == "paragraph_title", F.concat(F.lit("## "), "value"))
        .otherwise(c("value"))
    )
    if pages is not None:
        content = F.coalesce("anchor", content)
    return r.select("doc", "number", "ord", "region", "label", "asset", content.alias("content"))


def markdown(parts: DataFrame) -> DataFrame:
    """(doc, markdown) of blocks with anchors: every page's anchor and blocks in order, with blank lines between; pages without blocks have their anchor."""
    listed = F.sort_array(F.collect_list(F.struct("number", F.col("ord").cast("int").alias("ord"), "content")))
    joined = F.array_join(F.transform(listed, lambda x: x["content"]), "\n\n")
    return parts.groupBy("doc").agg(F.concat(F.btrim(joined, F.lit("\n ")), F.lit("\n")).alias("markdown"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer's document."""
    o = P.table(spark, sf_dir, "orders")
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("doc"), number.alias("number"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("label").isin(*UNREAD), "").otherwise(F.col("text"))
    return read_regions(spark, sf_dir).withColumn("value", value).join(_pages(spark, sf_dir), "page")


_UNREAD = ", ".join(f"'{x}'" for x in UNREAD)
_BLOCKS = f"""p AS (SELECT o_orderkey AS page, o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
    r AS (SELECT q.*, p.doc, p.number, CASE WHEN label IN ({_UNREAD}) THEN '' ELSE left('{READING}', CAST(sha AS INTEGER)) END AS value FROM ({P.REGIONS}) q JOIN p ON p.page = q.page),
    k AS (SELECT a.region AS caption, b.region AS figure, a.ord, a.value, count(*) OVER (PARTITION BY a.region) AS n FROM r a JOIN r b ON a.page = b.page AND a.label = 'figure_title' AND a.value <> '' AND b.label IN ('chart', 'image')
        AND 2 * b.x0 <= a.x0 + a.x1 AND a.x0 + a.x1 <= 2 * b.x1 AND abs(a.y0 - b.y1) <= 2 * (a.y1 - a.y0)),
    c AS (SELECT figure, string_agg(value, ' ' ORDER BY ord) AS caption FROM k WHERE n = 1 GROUP BY figure),
    n AS (SELECT r.*, c.caption, 'image_' || lpad(CAST(sum(CASE WHEN value = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY number, ord) AS VARCHAR), 6, '0') AS asset FROM r LEFT JOIN c ON c.figure = r.region WHERE r.region NOT IN (SELECT caption FROM k WHERE n = 1)),
    b AS (SELECT doc, number, ord, region, label, CASE WHEN value = '' THEN asset END AS asset, CASE WHEN value = '' THEN coalesce(caption || chr(10) || chr(10), '') || '![' || label || '](assets/' || asset || '.png)' WHEN label = 'inline_formula' THEN '$' || value || '$'
        WHEN label IN ({_F}) THEN '$$' || chr(10) || value || chr(10) || '$$' WHEN label = 'doc_title' THEN '# ' || value WHEN label = 'paragraph_title' THEN '## ' || value ELSE value END AS content FROM n)"""


@R.add(f"""WITH {_BLOCKS}, e AS (SELECT doc, number, ord, content FROM b UNION ALL SELECT doc, number, 0, chr(10) || '<!-- page:' || number || ' -->' || chr(10) FROM p)
    SELECT doc, trim(string_agg(content, chr(10) || chr(10) ORDER BY number, ord), chr(10) || ' ') || chr(10) AS markdown FROM e GROUP BY doc""")
def visual_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(blocks(_regions(spark, sf_dir), _pages(spark, sf_dir)))


@R.add(f"""WITH {_BLOCKS} SELECT doc, asset, 'visual:' || doc || ':' || region AS uid, label AS semantic_type, 'page:' || number AS source_part, 'assets/' || asset || '.png' AS path FROM b WHERE asset IS NOT NULL""")
def visual_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per picture that a package keeps."""
    b = blocks(_regions(spark, sf_dir)).where("asset is not null")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    return b.select("doc", "asset", text("visual:", F.col("doc").cast("string"), ":", F.col("region")).alias("uid"), F.col("label").alias("semantic_type"), text("page:", F.col("number").cast("string")).alias("source_part"), text("assets/", F.col("asset"), ".png").alias("path"))


@R.add(f"""WITH {_BLOCKS}, i AS (SELECT doc, CASE WHEN label IN ('table', 'algorithm') THEN 'STRUCTURED_REGION_PRESERVED_AS_IMAGE' WHEN label IN ('image', 'chart') THEN 'VISUAL_REGION_TEXT_CONTENT_UNVERIFIED' WHEN label = 'seal' THEN NULL ELSE 'EMPTY_OCR_SOURCE_PRESERVED' END AS reason FROM b WHERE asset IS NOT NULL),
    g AS (SELECT doc, count(reason) AS n, count(*) FILTER (reason = 'EMPTY_OCR_SOURCE_PRESERVED') AS empty, count(*) FILTER (reason = 'VISUAL_REGION_TEXT_CONTENT_UNVERIFIED') AS visual FROM i GROUP BY doc)
    SELECT d.doc, coalesce(n, 0) AS review_items, coalesce(empty, 0) AS empty_readings, coalesce(visual, 0) AS unverified_pictures, CASE WHEN coalesce(n, 0) > 0 THEN 'COMPLETED_WITH_REVIEW_ITEMS' ELSE 'COMPLETED_WITH_WARNINGS' END AS quality_status FROM (SELECT DISTINCT doc FROM p) d LEFT JOIN g ON g.doc = d.doc""")
def visual_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document leaves to review."""
    label = F.col("label")
    reason = F.when(label.isin("table", "algorithm"), "STRUCTURED_REGION_PRESERVED_AS_IMAGE").when(label.isin("image", "chart"), "VISUAL_REGION_TEXT_CONTENT_UNVERIFIED").when(label != "seal", "EMPTY_OCR_SOURCE_PRESERVED")
    i = blocks(_regions(spark, sf_dir)).where("asset is not null").select("doc", reason.alias("reason"))
    n = lambda r: F.count_if(F.col("reason") == r)
    g = i.groupBy("doc").agg(F.count("reason").alias("n"), n("EMPTY_OCR_SOURCE_PRESERVED").alias("e"), n("VISUAL_REGION_TEXT_CONTENT_UNVERIFIED").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = _pages(spark, sf_dir).select("doc").distinct().join(g, "doc", "left")
    return d.select("doc", zero(F.col("n")).alias("review_items"), zero(F.col("e")).alias("empty_readings"), zero(F.col("v")).alias("unverified_pictures"), F.when(zero(F.col("n")) > 0, "COMPLETED_WITH_REVIEW_ITEMS").otherwise("COMPLETED_WITH_WARNINGS").alias("quality_status"))
