"""Drawings: what a group is, affine placement, extents, crops and sizes of pictures, and simple SVG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P

R = Registry()
#: English metric units an inch; most pixels of a picture.
EMU, PIXELS = 914_400, 40_000_000

GROUPS = """SELECT p_partkey, p_size % 4 AS labels, p_size % 3 AS shapes, p_partkey % 3 AS groups, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS fills, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS images, p_size % 2 = 0 AS spread FROM part"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, labels, shapes, groups, fills, images, spread): a drawing's features, counted."""
    k, n = F.col("p_partkey"), F.col("p_size")
    one = lambda c: F.when(c, 1).otherwise(0)
    return P.table(spark, sf_dir, "part").select(k, (n % 4).alias("labels"), (n % 3).alias("shapes"), (k % 3).alias("groups"), one(k % 5 == 0).alias("fills"), one(k % 7 == 0).alias("images"), (n % 2 == 0).alias("spread"))


def drawing_kind(labels: Column, shapes: Column, group_count: Column, marks: Column, images: Column, spread: Column) -> Column:
    """Visual groups have visible labels and more than one thing or drawn geometry; pictures within them are not supported.

    A single labelled shape without geometry is a text container; what shows nothing is decoration.
    """
    drawn = marks > 0
    visual = (labels > 0) & ((group_count > 0) | (shapes > 1) | drawn | spread)
    text = (labels > 0) & (shapes == 1) & (group_count == 0) & (images == 0) & ~drawn
    return F.when(visual & (images > 0), "UNSUPPORTED_VISUAL_GROUP").when(visual, "VISUAL_DIAGRAM_GROUP").when(text, "PURE_TEXT_CONTAINER").otherwise("DECORATIVE_OR_EMPTY")


@R.add(f"""SELECT p_partkey, CASE WHEN v AND images > 0 THEN 'UNSUPPORTED_VISUAL_GROUP' WHEN v THEN 'VISUAL_DIAGRAM_GROUP' WHEN labels > 0 AND shapes = 1 AND groups = 0 AND images = 0 AND fills = 0 THEN 'PURE_TEXT_CONTAINER' ELSE 'DECORATIVE_OR_EMPTY' END AS kind
    FROM (SELECT *, labels > 0 AND (groups > 0 OR shapes > 1 OR fills > 0 OR spread) AS v FROM ({GROUPS}))""")
def drawing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return groups(spark, sf_dir).select("p_partkey", drawing_kind(c("labels"), c("shapes"), c("groups"), c("fills"), c("images"), c("spread")).alias("kind"))


Matrix = tuple[Column, Column, Column, Column, Column, Column]


def composed(p: Matrix, q: Matrix) -> Matrix:
    """First q, then p; (a, b, c, d, e, f) takes (x, y) to (a x + c y + e, b x + d y + f)."""
    (a, b, c, d, e, f), (g, h, i, j, k, m) = p, q
    return a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * m + e, b * k + d * m + f


def applied(p: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = p
    return a * x + c * y + e, b * x + d * y + f


def placed(x: Column, y: Column, width: Column, height: Column, scale: Matrix, flip_h: Column, flip_v: Column, degrees: Column) -> Matrix:
    """``scale`` followed by flips and a turn about the centre of a box."""
    zero = F.lit(0.0)
    cx, cy = x + width / 2, y + height / 2
    sign = lambda flip: F.when(flip, -1.0).otherwise(1.0)
    h, v = sign(flip_h), sign(flip_v)
    mirrored = composed((h, zero, zero, v, cx - h * cx, cy - v * cy), scale)
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return composed((cos, sin, -sin, cos, cx - cos * cx + sin * cy, cy - sin * cx - cos * cy), mirrored)


def group_matrix(x: Column, y: Column, width: Column, height: Column, child: tuple[Column, Column, Column, Column], flip_h: Column, flip_v: Column, degrees: Column) -> Matrix:
    """From a group's child coordinates to its own."""
    cx, cy, cw, ch = child
    sx, sy = width / cw, height / ch
    return placed(x, y, width, height, (sx, F.lit(0.0), F.lit(0.0), sy, x - cx * sx, y - cy * sy), flip_h, flip_v, degrees)


@R.add("""WITH g AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x, (p_size % 20)::DOUBLE AS y, (p_size + 10)::DOUBLE AS w, (p_partkey % 30 + 5)::DOUBLE AS h, p_partkey % 2 = 0 AS fh, p_size % 3 = 0 AS fv, (p_partkey % 4 * 30)::DOUBLE AS rot FROM part),
    s AS (SELECT *, x + (7.0::DOUBLE - 1.0::DOUBLE) * w / 40.0::DOUBLE AS px, y + (9.0::DOUBLE - 2.0::DOUBLE) * h / 25.0::DOUBLE AS py, x + w / 2 AS mx, y + h / 2 AS my FROM g),
    m AS (SELECT *, CASE WHEN fh THEN 2 * mx - px ELSE px END AS qx, CASE WHEN fv THEN 2 * my - py ELSE py END AS qy FROM s)
    SELECT p_partkey, round(mx + cos(radians(rot)) * (qx - mx) - sin(radians(rot)) * (qy - my), 6) + 0.0::DOUBLE AS x, round(my + sin(radians(rot)) * (qx - mx) + cos(radians(rot)) * (qy - my), 6) + 0.0::DOUBLE AS y FROM m""")
def group_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point (7, 9) of groups whose children live in a box of 40 by 25 from (1, 2)."""
    k, n = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    m = group_matrix(d(k % 50), d(n % 20), d(n + 10), d(k % 30 + 5), (F.lit(1.0), F.lit(2.0), F.lit(40.0), F.lit(25.0)), k % 2 == 0, n % 3 == 0, d(k % 4 * 30))
    x, y = applied(m, F.lit(7.0), F.lit(9.0))
    return P.table(spark, sf_dir, "part").select("p_partkey", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"))


@R.add(f"""WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 100 - 300)::DOUBLE END AS bw, (p_partkey % 40 * 50)::DOUBLE AS bh, (p_size % 5 * 72)::DOUBLE AS inch, (p_partkey % 9 * {EMU // 2})::DOUBLE AS ew, (p_size % 7 * {EMU // 4})::DOUBLE AS eh FROM part),
    k AS (SELECT *, coalesce(bw > 0 AND bh > 0 AND inch > 0, FALSE) AS placeable, ew > 0 AND eh > 0 AS extent FROM g), s AS (SELECT p_partkey, CASE WHEN placeable THEN 'placeable_header' WHEN extent THEN 'word_extent' END AS basis, CASE WHEN placeable THEN bw / inch WHEN extent THEN ew / {EMU} END AS w, CASE WHEN placeable THEN bh / inch WHEN extent THEN eh / {EMU} END AS h FROM k)
    SELECT p_partkey, basis, round(w, 9) AS width, round(h, 9) AS height, least(1.0::DOUBLE, round(2000.0::DOUBLE / (w * 600), 9), round(2000.0::DOUBLE / (h * 600), 9)) AS scale FROM s WHERE basis IS NOT NULL""")
def metafile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inches of a metafile by its placeable header, else by its extent, and what keeps 600 dots an inch within 2,000 pixels a side."""
    k, n = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    g = P.table(spark, sf_dir, "part").select(k, F.when(k % 3 != 0, d(n * 100 - 300)).alias("bw"), d(k % 40 * 50).alias("bh"), d(n % 5 * 72).alias("inch"), d(k % 9 * (EMU // 2)).alias("ew"), d(n % 7 * (EMU // 4)).alias("eh"))
    placeable = F.coalesce((F.col("bw") > 0) & (F.col("bh") > 0) & (F.col("inch") > 0), F.lit(False))
    extent = (F.col("ew") > 0) & (F.col("eh") > 0)
    by = lambda a, b: F.when(placeable, F.col(a) / F.col("inch")).when(extent, F.col(b) / EMU)
    s = g.select("p_partkey", F.when(placeable, "placeable_header").when(extent, "word_extent").alias("basis"), by("bw", "ew").alias("w"), by("bh", "eh").alias("h")).where("basis is not null")
    side = lambda c: F.round(F.lit(2000.0) / (F.col(c) * 600), 9)
    return s.select("p_partkey", "basis", F.round("w", 9).alias("width"), F.round("h", 9).alias("height"), F.least(F.lit(1.0), side("w"), side("h")).alias("scale"))


@R.add(f"""WITH g AS (SELECT p_partkey, p_partkey % 900 + 1 AS w, p_size * 10 AS h, p_partkey % 60 - 20 AS l, p_size % 40 AS t, p_partkey % 70 AS r, p_size % 50 AS b, (p_size % 4 + 1) AS cx, (p_partkey % 5 + 1) AS cy FROM part),
    c AS (SELECT *, CAST(ceil(l * w / 100.0::DOUBLE) AS BIGINT) AS x0, CAST(ceil(t * h / 100.0::DOUBLE) AS BIGINT) AS y0, CAST(floor((100 - r) * w / 100.0::DOUBLE) AS BIGINT) AS x1, CAST(floor((100 - b) * h / 100.0::DOUBLE) AS BIGINT) AS y1 FROM g),
    v AS (SELECT *, x1 - x0 AS cw, y1 - y0 AS ch FROM c) SELECT p_partkey, cw, ch, CASE WHEN cw <= 0 OR ch <= 0 OR cw * ch > {PIXELS} THEN 'WORD_PICTURE_EMPTY_OR_EXCESSIVE_CROP' END AS problem,
    CASE WHEN cw > 0 AND ch > 0 THEN greatest(cw, CAST(ceil(ch * cx / cy::DOUBLE) AS BIGINT)) END AS out_w, CASE WHEN cw > 0 AND ch > 0 THEN greatest(ch, CAST(ceil(cw * cy / cx::DOUBLE) AS BIGINT)) END AS out_h FROM v""")
def picture_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shows of a picture cropped by hundredths, and its pixels at the displayed aspect without losing any."""
    k, n = F.col("p_partkey"), F.col("p_size")
    g = P.table(spark, sf_dir, "part").select(k, (k % 900 + 1).alias("w"), (n * 10).alias("h"), (k % 60 - 20).alias("l"), (n % 40).alias("t"), (k % 70).alias("r"), (n % 50).alias("b"), (n % 4 + 1).alias("cx"), (k % 5 + 1).alias("cy"))
    up, down = (lambda c: F.ceil(c).cast("long")), (lambda c: F.floor(c).cast("long"))
    c = F.col
    v = g.withColumns({"cw": down((100 - c("r")) * c("w") / 100.0) - up(c("l") * c("w") / 100.0), "ch": down((100 - c("b")) * c("h") / 100.0) - up(c("t") * c("h") / 100.0)})
    seen = (c("cw") > 0) & (c("ch") > 0)
    problem = F.when(~seen | (c("cw") * c("ch") > PIXELS), "WORD_PICTURE_EMPTY_OR_EXCESSIVE_CROP")
    return v.select("p_partkey", "cw", "ch", problem.alias("problem"), F.when(seen, F.greatest("cw", up(c("ch") * c("cx") / c("cy")))).alias("out_w"), F.when(seen, F.greatest("ch", up(c("cw") * c("cy") / c("cx")))).alias("out_h"))


def svg(shapes: DataFrame) -> DataFrame:
    """(drawing, svg) of (drawing, ord, kind, x, y, w, h, text): rectangles, ellipses, lines and text in order."""
    c = lambda n: F.col(n).cast("string")
    half = lambda a, b: (F.col(a) + F.col(b) / 2).cast("string")
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = (
        F.when(F.col("kind") == "rect", join('<rect x="', c("x"), '" y="', c("y"), '" width="', c("w"), '" height="', c("h"), '"/>'))
        .when(F.col("kind") == "ellipse", join('<ellipse cx="', half("x", "w"), '" cy="', half("y", "h"), '" rx="', (F.col("w") / 2).cast("string"), '" ry="', (F.col("h") / 2).cast("string"), '"/>'))
        .when(F.col("kind") == "line", join('<line x1="', c("x"), '" y1="', c("y"), '" x2="', (F.col("x") + F.col("w")).cast("string"), '" y2="', (F.col("y") + F.col("h")).cast("string"), '"/>'))
        .otherwise(join('<text x="', c("x"), '" y="', c("y"), '">', safe, "</text>"))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", tag.alias("t")))), lambda s: s["t"]), "")
    size = join('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ', F.max(F.col("x") + F.col("w")).cast("string"), " ", F.max(F.col("y") + F.col("h")).cast("string"), '">')
    return shapes.groupBy("drawing").agg(F.concat(size, body, F.lit("</svg>")).alias("svg"))


@R.add(f"""WITH s AS (SELECT page, ord, x0, y0, (x1 - x0) * 2 AS w, (y1 - y0) * 2 AS h, CASE sha % 4 WHEN 0 THEN '<rect x="' || x0 || '" y="' || y0 || '" width="' || ((x1 - x0) * 2) || '" height="' || ((y1 - y0) * 2) || '"/>' WHEN 1 THEN '<text x="' || x0 || '" y="' || y0 || '">' || label || '</text>'
    ELSE '<line x1="' || x0 || '" y1="' || y0 || '" x2="' || (x0 + (x1 - x0) * 2) || '" y2="' || (y0 + (y1 - y0) * 2) || '"/>' END AS t FROM ({P.REGIONS}))
    SELECT page, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || max(x0 + w) || ' ' || max(y0 + h) || '">' || string_agg(t, '' ORDER BY ord) || '</svg>' AS svg FROM s GROUP BY page""")
def page_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("sha") % 4 == 0, "rect").when(F.col("sha") % 4 == 1, "text").otherwise("line")
    s = P.regions(spark, sf_dir).select(F.col("page").alias("drawing"), "ord", kind.alias("kind"), F.col("x0").alias("x"), F.col("y0").alias("y"), ((F.col("x1") - F.col("x0")) * 2).alias("w"), ((F.col("y1") - F.col("y0")) * 2).alias("h"), F.col("label").alias("text"))
    return svg(s).select(F.col("drawing").alias("page"), "svg")


@R.add("""SELECT p_brand AS groups, max(p_size) AS density, min(p_partkey % 100) * max(p_size) AS x0, max(p_partkey % 100 + p_size) * max(p_size) AS x1, bool_or(p_size % 10 = 7) AS rejected FROM part GROUP BY p_brand""")
def group_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canvas a group: its members' extent at the densest member's scale; groups with a turned member are refused."""
    k, n = F.col("p_partkey") % 100, F.col("p_size")
    g = P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("groups")).agg(F.max(n).alias("density"), F.min(k).alias("a"), F.max(k + n).alias("b"), F.bool_or(n % 10 == 7).alias("rejected"))
    return g.select("groups", "density", (F.col("a") * F.col("density")).alias("x0"), (F.col("b") * F.col("density")).alias("x1"), "rejected")
