"""Pixels as rows: ink, marks, blank pictures, runs of rows, edges and repeated slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P

R = Registry()
#: Side of the rasters that the test tables' vectors make.
SIDE = 8

PIXELS = f"""SELECT vec_id AS raster, (i - 1) // {SIDE} AS y, (i - 1) % {SIDE} AS x, v > 0.0625::DOUBLE AS ink, label FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster, y, x, ink, label): a vector as a square picture, ink where it is over a sixteenth."""
    p = P.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return p.select(F.col("vec_id").alias("raster"), F.expr(f"cast(i div {SIDE} as bigint)").alias("y"), (F.col("i") % SIDE).cast("long").alias("x"), (F.col("v").cast("double") > 0.0625).alias("ink"), "label")


def longest_strokes(ink: DataFrame) -> DataFrame:
    """(raster, stroke): the longest run of ink down a column."""
    run = F.col("y") - F.row_number().over(W.partitionBy("raster", "x").orderBy("y"))
    runs = ink.withColumn("run", run).groupBy("raster", "x", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("raster").agg(F.max("n").alias("stroke"))


def fragment_reason(ref: Column, width: Column, height: Column, n: Column, stroke: Column, edge: Column) -> Column:
    """Why a residual piece is left out, null if it stays: signs wider than high and long strokes stay.

    ``ref`` is the height of the line's letters; parts of it are hundredths.
    """
    sign = (100 * width >= 35 * ref) & (10 * width >= 25 * height)
    mark = (100 * width <= 32 * ref) & (100 * height <= 32 * ref) & (100 * n <= 6 * ref * ref)
    sliver = edge & (100 * width <= 22 * ref) & (100 * n <= 18 * ref * ref) & (2 * stroke < ref)
    return F.when(n == 0, "EMPTY").when(~sign & mark, "ISOLATED_LOW_INFORMATION_MARK").when(~sign & sliver, "SPARSE_CUT_EDGE_SLIVER")


@R.add(f"""WITH p AS ({PIXELS}), k AS (SELECT * FROM p WHERE ink AND x < 1 + raster % 3 AND y < 2 + raster % 7), i AS (SELECT raster, count(*) AS n, min(x) AS a, min(y) AS b, max(x) + 1 AS c, max(y) + 1 AS d FROM k GROUP BY raster),
    s AS (SELECT raster, max(n) AS stroke FROM (SELECT raster, x, g, count(*) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY raster, x ORDER BY y) AS g FROM k) GROUP BY raster, x, g) GROUP BY raster),
    r AS (SELECT DISTINCT raster, CAST(12 + raster % 9 AS BIGINT) AS ref FROM p), m AS (SELECT r.raster, ref, coalesce(n, 0) AS n, coalesce(c - a, 0) AS w, coalesce(d - b, 0) AS h, coalesce(stroke, 0) AS stroke, coalesce(a = 0 OR c = {SIDE}, FALSE) AS edge FROM r LEFT JOIN i USING (raster) LEFT JOIN s USING (raster))
    SELECT raster, n, stroke, CASE WHEN n = 0 THEN 'EMPTY' WHEN 100 * w >= 35 * ref AND 10 * w >= 25 * h THEN NULL WHEN 100 * w <= 32 * ref AND 100 * h <= 32 * ref AND 100 * n <= 6 * ref * ref THEN 'ISOLATED_LOW_INFORMATION_MARK'
        WHEN edge AND 100 * w <= 22 * ref AND 100 * n <= 18 * ref * ref AND 2 * stroke < ref THEN 'SPARSE_CUT_EDGE_SLIVER' END AS reason FROM m""")
def fragment_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at the left of each raster, up to three columns wide, beside letters of 12 to 20 pixels."""
    p = pixels(spark, sf_dir)
    k = p.where(F.col("ink") & (F.col("x") < 1 + F.col("raster") % 3) & (F.col("y") < 2 + F.col("raster") % 7))
    box = k.groupBy("raster").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    m = p.select("raster").distinct().join(box, "raster", "left").join(longest_strokes(k), "raster", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    m = m.select("raster", zero(F.col("n")).alias("n"), zero(F.col("c") - F.col("a")).alias("w"), zero(F.col("d") - F.col("b")).alias("h"), zero(F.col("stroke")).alias("stroke"), F.coalesce((F.col("a") == 0) | (F.col("c") == SIDE), F.lit(False)).alias("edge"))
    ref = 12 + F.col("raster") % 9
    return m.select("raster", "n", "stroke", fragment_reason(ref, F.col("w"), F.col("h"), F.col("n"), F.col("stroke"), F.col("edge")).alias("reason"))


_COLOURS = f"""SELECT raster, CASE raster % 5 WHEN 0 THEN 7 WHEN 1 THEN x % 2 WHEN 2 THEN 1 + x % 2 ELSE (x * 3 + y) % 9 END AS colour, CASE WHEN raster % 7 = 0 THEN 0 ELSE 255 END AS alpha, label FROM ({PIXELS})"""


def blank_reasons(colours: DataFrame) -> DataFrame:
    """(raster, reason): pictures without content, null for others; colour 0 is black.

    All transparent, all of one colour, or of two colours neither of which is a visible black.
    """
    g = colours.groupBy("raster").agg(F.max("alpha").alias("alpha"), F.count_distinct("colour", "alpha").alias("n"), F.max((F.col("colour") == 0) & (F.col("alpha") > 0)).alias("black"))
    reason = F.when(F.col("alpha") == 0, "FULLY_TRANSPARENT").when(F.col("n") == 1, "SINGLE_COLOR").when((F.col("n") == 2) & ~F.col("black"), "TWO_COLOR_NO_BLACK")
    return g.select("raster", reason.alias("reason"))


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x, y = F.col("raster"), F.col("x"), F.col("y")
    colour = F.when(k % 5 == 0, 7).when(k % 5 == 1, x % 2).when(k % 5 == 2, 1 + x % 2).otherwise((x * 3 + y) % 9)
    return pixels(spark, sf_dir).select("raster", colour.alias("colour"), F.when(k % 7 == 0, 0).otherwise(255).alias("alpha"), "label")


_BLANK = f"""b AS (SELECT raster, max(label) AS label, CASE WHEN max(alpha) = 0 THEN 'FULLY_TRANSPARENT' WHEN count(DISTINCT (colour, alpha)) = 1 THEN 'SINGLE_COLOR'
    WHEN count(DISTINCT (colour, alpha)) = 2 AND NOT bool_or(colour = 0 AND alpha > 0) THEN 'TWO_COLOR_NO_BLACK' END AS reason FROM ({_COLOURS}) GROUP BY raster)"""


@R.add(f"WITH {_BLANK} SELECT raster, reason FROM b")
def blank_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blank_reasons(_colours(spark, sf_dir))


@R.add(f"WITH {_BLANK} SELECT raster, CASE WHEN label % 3 = 0 THEN 'FORMULA' ELSE 'IMAGE' END AS kind FROM b WHERE NOT (label % 3 <> 0 AND reason IS NOT NULL)")
def blocks_without_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that stay: blank pictures go, but not those that stand for something unread."""
    blank = blank_reasons(_colours(spark, sf_dir)).where("reason is not null").select("raster", F.lit("IMAGE").alias("kind"))
    kind = F.when(F.col("label") % 3 == 0, "FORMULA").otherwise("IMAGE")
    blocks = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("raster"), kind.alias("kind"))
    return blocks.join(blank, ["raster", "kind"], "left_anti")


_ROWS = f"SELECT raster, y, bool_or(ink AND x < 2) AS used FROM ({PIXELS}) GROUP BY raster, y"


def row_runs(rows: DataFrame, least: int = 1) -> DataFrame:
    """(raster, top, height): runs of used rows of at least ``least``."""
    used = rows.where("used").withColumn("run", F.col("y") - F.row_number().over(W.partitionBy("raster").orderBy("y")))
    return used.groupBy("raster", "run").agg(F.min("y").alias("top"), F.count("*").alias("height")).where(F.col("height") >= least).drop("run")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("raster", "y").agg(F.bool_or(F.col("ink") & (F.col("x") < 2)).alias("used"))


@R.add(f"WITH r AS ({_ROWS}), g AS (SELECT raster, y, y - row_number() OVER (PARTITION BY raster ORDER BY y) AS g FROM r WHERE used) SELECT raster, min(y) AS top, count(*) AS height FROM g GROUP BY raster, g HAVING count(*) >= 2")
def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_runs(_rows(spark, sf_dir), 2)


@R.add(f"WITH r AS ({_ROWS}), g AS (SELECT raster, y, y - row_number() OVER (PARTITION BY raster ORDER BY y) AS g FROM r WHERE used), h AS (SELECT raster, count(*) AS n FROM g GROUP BY raster, g) SELECT raster, median(n)::DOUBLE AS height FROM h GROUP BY raster")
def reference_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual height of a raster's runs: their median."""
    return row_runs(_rows(spark, sf_dir)).groupBy("raster").agg(F.median("height").cast("double").alias("height"))


def next_blank(rows: DataFrame, start: int, blanks: int = 2) -> DataFrame:
    """(raster, at): the first of ``blanks`` unused rows in a row from ``start`` on."""
    w = W.partitionBy("raster").orderBy("y")
    after = ~F.col("used")
    for k in range(1, blanks):
        after = after & (F.lead("used", k).over(w) == F.lit(False))
    return rows.withColumn("free", after).where(F.col("free") & (F.col("y") >= start)).groupBy("raster").agg(F.min("y").alias("at"))


@R.add(f"WITH r AS (SELECT *, lead(used) OVER (PARTITION BY raster ORDER BY y) AS follows FROM ({_ROWS})), c AS (SELECT raster FROM r WHERE y = 1 AND used) SELECT raster, min(y) + 2 AS new_bottom FROM r JOIN c USING (raster) WHERE y >= 2 AND NOT used AND follows = FALSE GROUP BY raster")
def figure_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures cut at their second row grow to the end of the first two blank rows below."""
    r = _rows(spark, sf_dir)
    cut = r.where("y = 1 AND used").select("raster")
    return next_blank(r, 2).join(cut, "raster").select("raster", (F.col("at") + 2).alias("new_bottom"))


@R.add(f"""WITH r AS ({_ROWS}), u AS (SELECT raster, coalesce(max(y) FILTER (NOT used AND y <= 4), -1) + 1 AS top, coalesce(min(y) FILTER (NOT used AND y >= 4), {SIDE}) AS bottom FROM r GROUP BY raster) SELECT raster, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom FROM u WHERE top < bottom""")
def line_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line around the fifth row: up and down to the next blank rows."""
    up, down = F.max(F.when(~F.col("used") & (F.col("y") <= 4), F.col("y"))), F.min(F.when(~F.col("used") & (F.col("y") >= 4), F.col("y")))
    u = _rows(spark, sf_dir).groupBy("raster").agg((F.coalesce(up, F.lit(-1)) + 1).cast("long").alias("top"), F.coalesce(down, F.lit(SIDE)).cast("long").alias("bottom"))
    return u.where("top < bottom")


@R.add(f"""WITH k AS (SELECT raster, y, x, label FROM ({PIXELS}) WHERE ink AND x < 2 AND y < 2) SELECT a.raster, a.raster + 1 AS retained FROM k a LEFT JOIN k b ON b.raster = a.raster + 1 AND b.y = a.y AND b.x = a.x GROUP BY a.raster HAVING count(*) = count(b.raster)""")
def slot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots all of whose ink lies on ink of the next one; here corners of two by two pixels."""
    k = pixels(spark, sf_dir).where("ink AND x < 2 AND y < 2").select("raster", "y", "x")
    on = k.select((F.col("raster") - 1).alias("raster"), "y", "x", F.lit(True).alias("met"))
    g = k.join(on, ["raster", "y", "x"], "left").groupBy("raster").agg(F.count("*").alias("n"), F.count("met").alias("met"))
    return g.where("n = met").select("raster", (F.col("raster") + 1).alias("retained"))


def alphabet_array(value: Column) -> Column:
    """Whether an output is nothing but an array of six or more capitals in order, as models make from noise."""
    body = F.regexp_replace(F.regexp_replace(value, r"\s+", ""), r"^\$+|\$+$", "")
    letters = F.array_join(F.regexp_extract_all(body, F.lit(r"\\text\{([A-Z])\}"), F.lit(1)), "")
    wanted = F.concat(F.lit(r"\text{"), F.array_join(F.split(letters, ""), r"}\quad\text{"), F.lit("}"))
    made = [F.concat(F.lit(rf"\begin{{array}}{{{a}}}"), wanted, F.lit(r"\end{array}")) for a in "clr"]
    return (F.length(letters) >= 6) & F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").startswith(letters) & body.isin(*made)


@R.add(r"""WITH s AS (SELECT p_partkey, p_size % 9 + 1 AS n FROM part), v AS (SELECT p_partkey, n, array_to_string(list_transform(range(0, n), lambda i: '\text{' || chr(CAST(65 + i AS INTEGER)) || '}'), '\quad') AS a FROM s)
    SELECT p_partkey, n >= 6 AND p_partkey % 4 <> 3 AS alphabet FROM v""")
def alphabet_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of up to nine letters; every fourth has a sign behind it and is none."""
    n = (F.col("p_size") % 9 + 1).cast("int")
    cells = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(r"\text{"), F.char(65 + i), F.lit("}"))), r"\quad")
    value = F.concat(F.lit(r"$\begin{array}{c} "), cells, F.when(F.col("p_partkey") % 4 == 3, F.lit("+")).otherwise(F.lit("")), F.lit(r" \end{array}$"))
    return P.table(spark, sf_dir, "part").select("p_partkey", alphabet_array(value).alias("alphabet"))
