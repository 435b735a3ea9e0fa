"""Publication: inventories, manifests, identities, paths and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.joins import numbered
from ..registry import Registry
from ..sources import projections as P

R = Registry()
_INV = "SELECT source || '/' || doc_id || '.md' AS path, min(sha256(text)) AS sha FROM documents"


def inventory(docs: DataFrame) -> DataFrame:
    """(path, sha): a file per document."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.groupBy(path.alias("path")).agg(F.min(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))


def inventory_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change) of every path that is not the same in both."""
    x, y = a.select("path", F.col("sha").alias("a")), b.select("path", F.col("sha").alias("b"))
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED")
    return x.join(y, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


@R.add(f"""WITH a AS ({_INV} WHERE doc_id % 11 <> 0 GROUP BY 1), b AS (SELECT source || '/' || doc_id || '.md' AS path, min(sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END)) AS sha FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.sha IS NULL THEN 'ADDED' WHEN b.sha IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha""")
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents")
    edited = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return inventory_diff(inventory(d.where("doc_id % 11 <> 0")), inventory(edited.where("doc_id % 7 <> 0")))


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that should be unique and are not."""
    return P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@R.add("SELECT doc_id, 'image_' || lpad(CAST(k AS VARCHAR), 6, '0') AS asset, sha256(source || chr(31) || doc_id || chr(31) || 'v1') AS uid FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in reading order, and identities by content."""
    k = F.col("number")
    uid = F.sha2(F.concat_ws("\x1f", "source", F.col("doc_id").cast("string"), F.lit("v1")).cast("binary"), 256)
    return numbered(P.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", F.concat(F.lit("image_"), F.lpad(k.cast("string"), 6, "0")).alias("asset"), uid.alias("uid"))


@R.add("SELECT source, doc_id // 50 AS package, string_agg(doc_id || ':' || substr(sha256(text), 1, 12), ',' ORDER BY doc_id) AS manifest, count(*) AS artifacts FROM documents GROUP BY ALL")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per package, which holds what fifty ids in a row have of one source: its artifacts with their digests, in order."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12))
    g = P.table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 50").alias("package")).agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("v")))).alias("all"), F.count("*").alias("artifacts"))
    return g.select("source", "package", F.array_join(F.transform("all", lambda x: x["v"]), ",").alias("manifest"), "artifacts")


@R.add("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nobody has decided yet."""
    return P.table(spark, sf_dir, "documents").select("doc_id").join(P.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@R.add("""SELECT doc_id, substr(text, 101, 50) AS part, CASE WHEN length(text) > 150 THEN 150 END AS next_offset FROM documents""")
def text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty characters from the hundredth on, and where to go on, null at the end."""
    return P.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 101, 50).alias("part"), F.when(F.length("text") > 150, 150).alias("next_offset"))


# Names of devices, which no file may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def safe_path(path: Column) -> Column:
    """Relative, with no drive, empty or parent segment, no reserved character and no device's name."""
    parts = F.split(path, "/")
    reserved = lambda x: F.upper(F.split_part(x, F.lit("."), F.lit(1))).isin(*RESERVED)
    return ~path.rlike(r'^/|^[A-Za-z]:|[<>"\\|?*\x00-\x1f]') & ~F.exists(parts, lambda x: x.isin("", ".", "..") | reserved(x))


@R.add(rf"""SELECT page_id, NOT regexp_matches(p, '^/|^[A-Za-z]:|[<>"\\|?*\x00-\x1f]') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..') OR upper(split_part(x, '.', 1)) IN {RESERVED})) = 0 AS safe
    FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'con.txt/' WHEN page_id % 6 = 1 THEN 'console/' ELSE '' END || regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of addresses, a sixth of them below a device's name."""
    head = F.when(F.col("page_id") % 6 == 0, "con.txt/").when(F.col("page_id") % 6 == 1, "console/").otherwise("")
    return P.table(spark, sf_dir, "pages").select("page_id", safe_path(F.concat(head, F.regexp_replace("url", "^https?://", ""))).alias("safe"))


@R.add("""SELECT n_nationkey, c_mktsegment, coalesce(m.label, r.r_name) AS label FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey, (SELECT DISTINCT c_mktsegment FROM customer) c
    LEFT JOIN (SELECT c_nationkey, c_mktsegment AS s, max(c_name) AS label FROM customer WHERE c_acctbal > 9000 GROUP BY 1, 2) m ON m.c_nationkey = n.n_nationkey AND m.s = c.c_mktsegment""")
def override_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's own override, else the default of its kind."""
    n = P.table(spark, sf_dir, "nation").join(P.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = P.table(spark, sf_dir, "customer")
    kinds = c.agg(F.sort_array(F.collect_set("c_mktsegment")).alias("kinds")).first()["kinds"]  # a part's kinds are few
    wanted = n.withColumn("c_mktsegment", F.explode(F.array(*[F.lit(x) for x in kinds]))) if kinds else n.withColumn("c_mktsegment", F.lit("")).limit(0)
    own = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.max("c_name").alias("label"))
    return wanted.join(own, ["n_nationkey", "c_mktsegment"], "left").select("n_nationkey", "c_mktsegment", F.coalesce("label", "r_name").alias("label"))
