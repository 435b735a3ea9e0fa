"""Analytics on outputs: percentiles, length buckets, repeated payloads, candidate comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P

R = Registry()
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def length_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Population, interpolated percentiles, extremes and mean of ``value`` per key."""
    return df.groupBy(key).agg(F.count("*").alias("population"), *[F.percentile(value, F.lit(q)).alias(n) for n, q in QUANTILES.items()], F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))


@R.add("SELECT source, count(*) AS population, " + ", ".join(f"quantile_cont(n_chars, {q}) AS {n}" for n, q in QUANTILES.items()) + ", min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def output_length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_summary(P.table(spark, sf_dir, "documents"), "source", "n_chars")


@R.add("""WITH p AS (SELECT lang, quantile_cont(n_chars, 0.5) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents GROUP BY lang)
    SELECT lang, bucket, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT d.lang, d.n_chars, CASE WHEN n_chars <= a THEN 'SHORT' WHEN n_chars <= b THEN 'MEDIUM' ELSE 'LONG' END AS bucket
    FROM documents d JOIN p ON p.lang IS NOT DISTINCT FROM d.lang) GROUP BY lang, bucket""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents").select("lang", "n_chars")
    p = d.groupBy(F.col("lang").alias("p_lang")).agg(F.percentile("n_chars", F.lit(0.5)).alias("a"), F.percentile("n_chars", F.lit(0.75)).alias("b"))
    bucket = F.when(F.col("n_chars") <= F.col("a"), "SHORT").when(F.col("n_chars") <= F.col("b"), "MEDIUM").otherwise("LONG")
    return d.join(p, F.col("lang").eqNullSafe(F.col("p_lang"))).groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@R.add("""SELECT event_type, max(n) AS n, max(CASE WHEN k = greatest(0, least(n - 1, CAST(round_even(0.95 * n, 0) AS BIGINT) - 1)) + 1 THEN value END) AS p95, quantile_cont(value, 0.5) AS median, max(value) AS most
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def p95_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at rank round-half-even(0.95 n), no interpolation.

    Values are counted in cells of one unit first; only the cell that holds the rank is sorted, so that few keys do not
    mean few tasks.
    """
    e = P.table(spark, sf_dir, "events").select("event_type", "value", F.floor("value").alias("cell"))
    cells = e.groupBy("event_type", "cell").agg(F.count("*").alias("c"))
    w = W.partitionBy("event_type")
    upto = F.sum("c").over(w.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.select("event_type", "cell", upto.alias("upto"), (upto - F.col("c")).alias("before"), F.sum("c").over(w).alias("n"))
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(0.95 * F.col("n"), 0).cast("long") - 1)) + 1
    home = cells.withColumn("at", at).where("before < at AND at <= upto").select("event_type", "cell", (F.col("at") - F.col("before")).alias("k"))
    inside = e.join(home, ["event_type", "cell"]).withColumn("r", F.row_number().over(W.partitionBy("event_type", "cell").orderBy("value"))).where("r = k")
    most = e.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("most"))
    return most.join(inside.select("event_type", F.col("value").alias("p95")), "event_type").select("event_type", "n", "p95", "median", "most")


@R.add("SELECT sha, n FROM (SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) ORDER BY n DESC, sha LIMIT 20")
def repeated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("n")).where("n > 1")
    return g.orderBy(F.desc("n"), "sha").limit(20)


@R.add("""WITH s AS (SELECT p_brand AS id, sum(CAST(p_retailprice * 100 AS BIGINT)) / count(*) / 100.0::DOUBLE AS latency, max(p_size) AS vram, min(p_size) AS setup, count(*) AS n FROM part GROUP BY p_brand),
    b AS (SELECT * FROM s WHERE id = 'Brand#1'), c AS (SELECT c.id, b.latency / c.latency AS speedup, (c.vram - b.vram) * 100.0::DOUBLE / b.vram AS vram_pct, b.latency - c.latency AS saving, c.setup - b.setup AS penalty, c.n % 3 = 0 AS parity,
    c.latency AS cl, c.setup AS cs FROM s c, b WHERE c.id <> b.id)
    SELECT id, round(speedup, 6) AS speedup, round(vram_pct, 6) AS vram_pct, CASE WHEN saving > 0 THEN CAST(greatest(0, ceil(penalty / saving - 1e-12)) AS BIGINT) END AS break_even, round(cs + cl * 100, 6) AS seconds_100,
    concat_ws(',', CASE WHEN NOT parity THEN 'NORMALIZED_PARITY_NOT_100_PERCENT' END, CASE WHEN speedup < 1.05 AND vram_pct > -10 THEN 'BENEFIT_BELOW_SHORTLIST_THRESHOLD' END) AS reasons FROM c""")
def candidate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the baseline: speed-up, memory, break-even and why it is not short-listed."""
    s = P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(
        (F.sum((F.col("p_retailprice") * 100).cast("decimal(20,0)").cast("long")) / F.count("*") / F.lit(100.0)).alias("latency"), F.max("p_size").alias("vram"), F.min("p_size").alias("setup"), F.count("*").alias("n")
    )
    b = s.where("id = 'Brand#1'").select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    j = s.join(F.broadcast(b), F.col("id") != F.col("b_id"))  # one row
    speedup, vram = F.col("b_latency") / F.col("latency"), (F.col("vram") - F.col("b_vram")) * F.lit(100.0) / F.col("b_vram")
    saving, penalty = F.col("b_latency") - F.col("latency"), F.col("setup") - F.col("b_setup")
    reasons = F.concat_ws(",", F.when(F.col("n") % 3 != 0, "NORMALIZED_PARITY_NOT_100_PERCENT"), F.when((speedup < 1.05) & (vram > -10), "BENEFIT_BELOW_SHORTLIST_THRESHOLD"))
    even = F.when(saving > 0, F.greatest(F.lit(0), F.ceil(penalty / saving - 1e-12)))
    return j.select("id", F.round(speedup, 6).alias("speedup"), F.round(vram, 6).alias("vram_pct"), even.alias("break_even"), F.round(F.col("setup") + F.col("latency") * 100, 6).alias("seconds_100"), reasons.alias("reasons"))


@R.add("SELECT ext, count(*) AS n FROM (SELECT lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(\\?.*)?$', 1)) AS ext FROM pages) GROUP BY ext")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(\?.*)?$", 1))
    return P.table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@R.add("SELECT source, doc_id // 50 AS folder, sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS fingerprint, count(*) AS files FROM documents GROUP BY ALL")
def directory_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over (path, content digest) in order of path; a folder has fifty ids of a source at most."""
    g = P.table(spark, sf_dir, "documents").select("source", F.expr("doc_id div 50").alias("folder"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\x00"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\n")).alias("line"))
    folded = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "")
    return g.groupBy("source", "folder").agg(folded.alias("all"), F.count("*").alias("files")).select("source", "folder", F.sha2(F.col("all").cast("binary"), 256).alias("fingerprint"), "files")


@R.add("""SELECT count(*) AS occurrences, count(DISTINCT text) AS payloads, count(*) - count(DISTINCT text) AS duplicates, max(n) AS most FROM (SELECT text, count(*) OVER (PARTITION BY text) AS n FROM documents)""")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("occurrences"), F.count("*").alias("payloads"), (F.sum("n") - F.count("*")).alias("duplicates"), F.max("n").alias("most"))


def representative(rows: DataFrame, *, key: str, dims: list[str], count: int) -> DataFrame:
    """(key, position): ``count`` rows that cover as many dimension values as can be, greedily; ties go by the id's digest.

    Only the ``count`` least digests of each combination of values can be chosen, so the greedy loop sees those and
    not the rows; combinations are as many as the domains allow. ``dims`` may hold arrays.
    """
    spark = rows.sparkSession
    values = F.concat(*[F.transform(F.col(d), lambda x, d=d: F.concat(F.lit(f"{d}="), x)) if rows.schema[d].dataType.typeName() == "array" else F.array(F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")))) for d in dims])
    r = rows.select(F.col(key).alias("id"), F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("digest"), F.array_sort(F.array_distinct(values)).alias("dims"))
    first = r.withColumn("n", F.row_number().over(W.partitionBy("dims").orderBy("digest"))).where(F.col("n") <= count)
    groups: dict[tuple, list] = {}
    for x in first.orderBy("digest").toLocalIterator():
        groups.setdefault(tuple(x["dims"]), []).append((x["digest"], x["id"]))
    heads, covered, chosen = {d: iter(v) for d, v in groups.items()}, set(), []
    front = {d: next(it) for d, it in heads.items()}
    while front and len(chosen) < count:
        best = min(front, key=lambda d: (-len(set(d) - covered), front[d]))
        chosen.append((front[best][1], len(chosen)))
        covered.update(best)
        front[best] = next(heads[best], None)
        if front[best] is None:
            del front[best]
    return spark.createDataFrame(chosen, f"{key} {rows.schema[key].dataType.simpleString()}, position int")


@R.add()
def representative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents that cover sources, languages and lengths."""
    length = F.when(F.col("n_chars") <= 500, "SHORT").when(F.col("n_chars") <= 2000, "MEDIUM").otherwise("LONG")
    d = P.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", length.alias("length"))
    return representative(d, key="doc_id", dims=["source", "lang", "length"], count=100)


def frozen(rows: DataFrame, *, key: str, dims: list[str], counts: tuple[int, int] = (100, 80)) -> DataFrame:
    """(subset, key, position, lock): two representative subsets, the second of what the first left, under one digest of both.

    The lock is over the ids in their order, as canonical JSON, so that a later run can tell whether it has the same rows.
    """
    first = representative(rows, key=key, dims=dims, count=counts[0])
    rest = rows.join(first.select(key), key, "left_anti")
    second = representative(rest, key=key, dims=dims, count=counts[1])
    both = first.select(F.lit(1).alias("subset"), key, "position").unionByName(second.select(F.lit(2).alias("subset"), key, "position"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("subset", "position", F.col(key).cast("string").alias("k")))), lambda x: F.concat(F.lit("["), x["subset"].cast("string"), F.lit(',"'), x["k"], F.lit('"]'))), ",")
    lock = both.agg(F.sha2(F.concat(F.lit("["), ids, F.lit("]")).cast("binary"), 256).alias("lock")).first()["lock"]  # at most the counts' rows
    return both.withColumn("lock", F.lit(lock))


@R.add()
def frozen_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred and eighty documents, frozen."""
    length = F.when(F.col("n_chars") <= 500, "SHORT").when(F.col("n_chars") <= 2000, "MEDIUM").otherwise("LONG")
    d = P.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", length.alias("length"))
    return frozen(d, key="doc_id", dims=["source", "lang", "length"])
