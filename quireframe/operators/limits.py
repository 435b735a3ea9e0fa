"""Limits and digests: pictures, logs, caches, configurations, fingerprints, conversions and retries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.eq import to_latex
from ..functions.vectorized import vectorized
from ..registry import Registry
from ..sources import projections as P

R = Registry()
# What a picture may have in bytes and pixels, and how its first bytes begin, by suffix.
BYTES, PIXELS = 128 << 20, 40_000_000
SIGNATURES = {"png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "bmp": b"BM", "jpg": b"\xff\xd8\xff", "tif": b"II*\0", "webp": b"RIFF"}


def raster_problem(data: Column, suffix: Column, width: Column, height: Column, frames: Column) -> Column:
    """The first limit that a picture breaks, null if none: size, suffix, pixels, frames."""
    kinds = F.create_map(*[F.lit(x) for k, v in SIGNATURES.items() for x in (k, v.hex().upper())])
    wanted = kinds[F.lower(suffix)]
    return (
        F.when(F.octet_length(data) > BYTES, "IMAGE_TOO_LARGE")
        .when(wanted.isNull(), "IMAGE_TYPE_UNSUPPORTED")
        .when(~F.hex(data).startswith(wanted), "IMAGE_FORMAT_DOES_NOT_MATCH_SUFFIX")
        .when(width * height > PIXELS, "IMAGE_PIXELS_EXCEEDED")
        .when(frames != 1, "IMAGE_HAS_SEVERAL_FRAMES")
    )


@R.add(f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 'IMAGE_TYPE_UNSUPPORTED' WHEN p_size % 6 = 0 THEN 'IMAGE_FORMAT_DOES_NOT_MATCH_SUFFIX' WHEN (p_size * 400) * 4000 > {PIXELS} THEN 'IMAGE_PIXELS_EXCEEDED' WHEN p_size % 5 = 0 THEN 'IMAGE_HAS_SEVERAL_FRAMES' END AS problem FROM part""")
def raster_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % 7 + 1).cast("int"))
    head = F.when(n % 6 == 0, F.lit(b"none")).otherwise(pick([*SIGNATURES.values(), b"%PDF"]))
    return P.table(spark, sf_dir, "part").select("p_partkey", raster_problem(F.concat(head, F.lit(b"rest")), pick([*SIGNATURES, "pdf"]), n * 400, F.lit(4000), F.when(n % 5 == 0, 2).otherwise(1)).alias("problem"))


@R.add("""SELECT p_brand AS package, max(p_size * 40) AS width, max(p_partkey % 500 * 3) AS height, max(p_size * 40 * (p_partkey % 500 * 3)) AS pixels, count(*) FILTER (p_size * 40 > 1500 OR p_partkey % 500 * 3 > 1200) AS over FROM part GROUP BY p_brand""")
def image_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sides and areas of a package's pictures, and how many are over a side's limit."""
    w, h = F.col("p_size") * 40, F.col("p_partkey") % 500 * 3
    return P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package")).agg(F.max(w).alias("width"), F.max(h).alias("height"), F.max(w * h).alias("pixels"), F.count_if((w > 1500) | (h > 1200)).alias("over"))


def related(relationships: DataFrame, suffix: str) -> DataFrame:
    """(owner, id, part) of relationships whose type ends so and that stay within the package."""
    return relationships.where(F.col("type").endswith(suffix) & F.col("part").isNotNull()).select("owner", "id", "part")


@R.add("SELECT o_custkey AS owner, o_orderkey AS id, 'word/' || o_orderkey || '.xml' AS part FROM orders WHERE o_orderpriority LIKE '%SPECIFIED' AND o_orderkey % 4 <> 0")
def related_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders")
    part = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("word/"), F.col("o_orderkey").cast("string"), F.lit(".xml")))
    return related(o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), part.alias("part")), "SPECIFIED")


# The roles that a set of model endpoints has, and the older set.
ROLES, OLD_ROLES = ("formula", "layout", "table", "text"), ("formula", "layout", "text")


@R.add(f"""WITH c AS (SELECT o_custkey AS config, list_sort(list_distinct(list(['formula', 'layout', 'table', 'text'][o_orderkey % 4 + 1]))) AS roles, max(o_orderkey % 700) AS timeout, bool_or(o_orderkey % 97 = 0) AS remote FROM orders GROUP BY o_custkey)
    SELECT config, CASE WHEN roles NOT IN ({list(ROLES)}, {list(OLD_ROLES)}) THEN 'MODEL_API_ROLES_INVALID' WHEN remote THEN 'MODEL_API_URL_NOT_LOCAL' WHEN timeout > 600 THEN 'MODEL_API_TIMEOUT_INVALID' END AS problem FROM c""")
def api_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of endpoints with all roles, or those of the older form, on this machine, with a timeout of ten minutes at most."""
    k = F.col("o_orderkey")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (k % 4 + 1).cast("int"))
    url = F.when(k % 97 == 0, F.lit("http://models.example.org/v1")).otherwise(F.lit("http://127.0.0.1:8000/v1"))
    local = F.parse_url(url, F.lit("HOST")).isin("127.0.0.1", "localhost", "[::1]")
    g = P.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("config")).agg(F.sort_array(F.collect_set(role)).alias("roles"), F.bool_and(local).alias("local"), F.max(k % 700).alias("timeout"))
    known = (F.col("roles") == F.array(*[F.lit(r) for r in ROLES])) | (F.col("roles") == F.array(*[F.lit(r) for r in OLD_ROLES]))
    return g.select("config", F.when(~known, "MODEL_API_ROLES_INVALID").when(~F.col("local"), "MODEL_API_URL_NOT_LOCAL").when(F.col("timeout") > 600, "MODEL_API_TIMEOUT_INVALID").alias("problem"))


def newest_within(df: DataFrame, key: str, order: list[Column], size: str, *, most: int, rows: int | None = None) -> DataFrame:
    """A key's first rows in an order, as long as their sizes sum to at most ``most`` and they are no more than ``rows``."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = df.withColumns({"__sum": F.sum(size).over(w), "__n": F.count("*").over(w)}).where(F.col("__sum") <= most)
    return (kept if rows is None else kept.where(F.col("__n") <= rows)).drop("__sum", "__n")


@R.add("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(length(props) + 20) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 600")
def rotated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest lines of a log that its files have room for."""
    e = P.table(spark, sf_dir, "events").select("user_id", "event_id", (F.length("props") + 20).alias("size"))
    return newest_within(e, "user_id", [F.desc("event_id")], "size", most=600).drop("size")


@R.add("""WITH u AS (SELECT l_suppkey AS cache, l_partkey AS entry, max(l_orderkey * 10 + l_linenumber) AS used, max(l_partkey % 90 + 1) AS chars FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(chars) OVER (PARTITION BY cache ORDER BY used DESC, entry ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY cache ORDER BY used DESC, entry) AS k FROM u)
    SELECT cache, entry FROM s WHERE n <= 400 AND k <= 12""")
def cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache that forgets the least recently used holds: entries and characters are bounded."""
    u = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cache"), F.col("l_partkey").alias("entry")).agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("used"), F.max(F.col("l_partkey") % 90 + 1).alias("chars"))
    return newest_within(u, "cache", [F.desc("used"), F.col("entry")], "chars", most=400, rows=12).select("cache", "entry")


@R.add("""SELECT source, count(*) AS occurrences, count(DISTINCT sha256(text)) AS payloads, count(*) - count(DISTINCT sha256(text)) AS first_level_hits, count(DISTINCT CASE WHEN n_chars % 3 = 0 THEN sha256(text) END) AS second_level_hits FROM documents GROUP BY source""")
def cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats answered within a run, and contents that a store of earlier runs has (here by their length)."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    g = P.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("occurrences"), F.count_distinct(sha).alias("payloads"), F.count_distinct(F.when(F.col("n_chars") % 3 == 0, sha)).alias("second_level_hits"))
    return g.select("source", "occurrences", "payloads", (F.col("occurrences") - F.col("payloads")).alias("first_level_hits"), "second_level_hits")


@vectorized("status string, component string, latex string")
def formula_adapters(kinds: pd.Series, payloads: pd.Series) -> pd.DataFrame:
    """What becomes of a formula by its kind: fields are converted here, and kinds whose parsers are not here keep their source."""
    rows = []
    for kind, payload in zip(kinds, payloads, strict=True):
        latex = to_latex(payload)[0] if kind == "eq" else None
        rows.append(("CONVERTED" if latex else "FAILED_PRESERVED", "eq_fields" if kind == "eq" else f"{kind}_parser_absent", latex))
    return pd.DataFrame(rows, columns=["status", "component", "latex"])


@R.add(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 4 <> 0 THEN 'CONVERTED' ELSE 'FAILED_PRESERVED' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'eq_fields' WHEN p_partkey % 3 = 1 THEN 'mtef_parser_absent' ELSE 'mathml_parser_absent' END AS component,
    CASE WHEN p_partkey % 3 = 0 AND p_size % 4 <> 0 THEN '\frac{' || p_size || '}{2}' END AS latex FROM part""")
def formula_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, a fourth of which do not close, and equations of two other kinds."""
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "eq").when(k % 3 == 1, "mtef").otherwise("mathml")
    payload = F.concat(F.lit(r"EQ \f("), n.cast("string"), F.when(n % 4 == 0, F.lit(",2")).otherwise(F.lit(",2)")))
    return P.table(spark, sf_dir, "part").select("p_partkey", formula_adapters(kind, payload).alias("a")).select("p_partkey", "a.*")


@R.add("""SELECT doc_id, sha256('{"config":{"batch":' || (doc_id % 4 + 1) || '},"png_sha256":"' || sha256(text) || '","runtime":"v1"}') AS key FROM documents WHERE text IS NOT NULL""")
def benchmark_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of stored results: content, runtime and settings as canonical JSON."""
    d = P.table(spark, sf_dir, "documents").where("text is not null")
    body = F.concat(F.lit('{"config":{"batch":'), (F.col("doc_id") % 4 + 1).cast("string"), F.lit('},"png_sha256":"'), F.sha2(F.col("text").cast("binary"), 256), F.lit('","runtime":"v1"}'))
    return d.select("doc_id", F.sha2(body.cast("binary"), 256).alias("key"))


@R.add("""SELECT conv_id AS tree, sha256(string_agg(lpad(CAST(turn AS VARCHAR), 4, '0') || '.md' || chr(0) || text, '' ORDER BY turn, text)) AS tree_sha, sha256('[' || string_agg('["' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.md","' || sha256(text) || '"]', ',' ORDER BY turn, text) || ']') AS code_sha FROM conversations GROUP BY conv_id""")
def tree_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two digests of a folder: over paths and contents, and over paths and contents' digests as JSON."""
    name = F.concat(F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".md"))
    c = P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), "turn", "text", name.alias("name"))
    folded = lambda sep, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", v.alias("v")))), lambda x: x["v"]), sep)
    line = F.concat(F.lit('["'), "name", F.lit('","'), F.sha2(F.col("text").cast("binary"), 256), F.lit('"]'))
    g = c.groupBy("tree").agg(folded("", F.concat("name", F.lit("\0"), "text")).alias("a"), folded(",", line).alias("b"))
    return g.select("tree", F.sha2(F.col("a").cast("binary"), 256).alias("tree_sha"), F.sha2(F.concat(F.lit("["), "b", F.lit("]")).cast("binary"), 256).alias("code_sha"))


@R.add("""SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN 'empty' WHEN p_size * 100 * (p_partkey % 90) > 300000 THEN 'resource_limit' WHEN p_partkey % 90 = 0 THEN 'unsupported_geometry' WHEN p_size % 11 = 0 THEN 'failed' ELSE 'success' END AS status FROM part""")
def render_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a metafile's rendering comes to, from its size and what it holds."""
    n, h = F.col("p_size"), F.col("p_partkey") % 90
    status = F.when(n % 8 == 0, "empty").when(n * 100 * h > 300_000, "resource_limit").when(h == 0, "unsupported_geometry").when(n % 11 == 0, "failed").otherwise("success")
    return P.table(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@R.add("""WITH c AS (SELECT l_orderkey AS metafile, CASE l_suppkey % 3 WHEN 0 THEN 'Design Science, Inc.' ELSE 'App' || (l_suppkey % 3) END AS app, string_agg(l_partkey, '' ORDER BY l_linenumber, l_partkey) AS payload, count(*) AS chunks FROM lineitem GROUP BY ALL)
    SELECT metafile, arg_min(app, CASE WHEN app LIKE 'Design%' THEN '0' ELSE '1' END || app) AS app, arg_min(payload, CASE WHEN app LIKE 'Design%' THEN '0' ELSE '1' END || app) AS payload FROM c GROUP BY metafile""")
def metafile_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that programs left in a metafile, put together by program; one maker's equations come first."""
    app = F.when(F.col("l_suppkey") % 3 == 0, F.lit("Design Science, Inc.")).otherwise(F.concat(F.lit("App"), (F.col("l_suppkey") % 3).cast("string")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), "")
    c = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("metafile"), app.alias("app")).agg(body.alias("payload"))
    first = F.struct(~F.col("app").startswith("Design"), "app")
    return c.groupBy("metafile").agg(F.min_by("app", first).alias("app"), F.min_by("payload", first).alias("payload"))


@R.add("""WITH t AS (SELECT user_id AS task, event_id AS tick, event_type = 'error' AS failed FROM events), n AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY task ORDER BY tick ROWS UNBOUNDED PRECEDING) AS done FROM t)
    SELECT task, tick, count(*) OVER (PARTITION BY task, done ORDER BY tick ROWS UNBOUNDED PRECEDING) AS tries FROM n WHERE failed""")
def retry_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed advances of a task with how many have failed in a row: each tick tries again."""
    w = W.partitionBy("task").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    t = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("tick"), (F.col("event_type") == "error").alias("failed"))
    t = t.withColumn("done", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    run = F.count_if(F.col("failed")).over(W.partitionBy("task", "done").orderBy("tick").rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("tries", run).where("failed").select("task", "tick", "tries")


@R.add("""SELECT p_partkey, sha256('{"groups":' || (p_partkey % 3) || ',"labels":' || (p_size % 4) || ',"shapes":' || (p_size % 3) || '}') AS fingerprint FROM part""")
def drawing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing's features in canonical form, by digest: equal drawings share it wherever they stand."""
    k, n = F.col("p_partkey"), F.col("p_size")
    body = F.concat(F.lit('{"groups":'), (k % 3).cast("string"), F.lit(',"labels":'), (n % 4).cast("string"), F.lit(',"shapes":'), (n % 3).cast("string"), F.lit("}"))
    return P.table(spark, sf_dir, "part").select("p_partkey", F.sha2(body.cast("binary"), 256).alias("fingerprint"))


@R.add(f"""SELECT c.call, c.rss_end - c.rss_start AS rss_growth, CASE WHEN c.rss_end IS NULL THEN 'OPEN' WHEN c.rss_end > c.rss_start THEN 'GREW' ELSE 'STEADY' END AS memory FROM ({P.CALLS}) c""")
def call_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readings before and after a call say."""
    a, b = F.col("rss_start"), F.col("rss_end")
    return P.calls(spark, sf_dir).select("call", (b - a).alias("rss_growth"), F.when(b.isNull(), "OPEN").when(b > a, "GREW").otherwise("STEADY").alias("memory"))
