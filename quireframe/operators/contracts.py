"""Contracts between tools: registries, requests, receipts, packages, caches, observations and set comparisons."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized
from ..plans.joins import spread
from ..registry import Registry
from ..sources import projections as P

R = Registry()

# Capabilities by the task names of the older registry, and what an entry of it has where it says nothing.
TASKS = {"layout_detection": "layout", "text_detection": "ocr_text", "text_recognition": "ocr_text", "formula_ocr": "ocr_formula", "table_classification": "table_classifier", "table_structure_recognition": "table_structure", "table_cell_detection": "table_cell_detection"}
CAPABILITIES = ("layout", "ocr_text", "ocr_formula", "table_classifier", "table_structure", "table_cell_detection", "asr", "embedding")
DEFAULTS = {"precision": "fp32", "revision": "LEGACY_MANIFEST_AUTHORITY", "status": "MODEL_READY", "platform": "windows-x86_64"}

_MODELS = f"""SELECT p_partkey, 'model-' || (p_partkey % 150) AS model_id, p_partkey % 2 AS v1, {list(TASKS)}[p_partkey % {len(TASKS)} + 1] AS task, {list(CAPABILITIES)}[p_size % {len(CAPABILITIES)} + 1] AS capability,
    p_name AS artifact, CASE WHEN p_size % 3 = 0 THEN 'fp16' END AS prec, p_size % 5 <> 0 AS complete FROM part"""


def registered(rows: DataFrame) -> DataFrame:
    """Entries of both registry versions as one table, from JSON: (key, model_id, capability, artifact, manifest, precision, status, legacy, problem)."""
    schema = "schema string, model_id string, capability string, task string, artifact string, manifest string, fingerprint string, precision string, status string"
    r = rows.select("key", F.from_json("entry", schema).alias("e")).select("key", "e.*")
    tasks = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    legacy = F.col("schema") == "v1"
    capability = F.when(legacy, F.coalesce(tasks[F.col("task")], F.lit("ocr_text"))).otherwise(F.col("capability"))
    manifest = F.when(legacy, F.coalesce("manifest", F.concat("artifact", F.lit("/MODEL_MANIFEST.json")))).otherwise(F.col("manifest"))
    problem = F.when(~F.col("schema").isin("v1", "v2"), "UNKNOWN_MODEL_REGISTRY_SCHEMA").when(F.col("model_id").isNull() | F.col("artifact").isNull() | F.col("fingerprint").isNull(), "INVALID_MODEL_REGISTRY").when(~legacy & (F.col("manifest").isNull() | ~F.col("capability").isin(*CAPABILITIES)), "INVALID_MODEL_REGISTRY")
    return r.select("key", "model_id", capability.alias("capability"), "artifact", manifest.alias("manifest"), F.coalesce("precision", F.lit(DEFAULTS["precision"])).alias("precision"), F.coalesce("status", F.lit(DEFAULTS["status"])).alias("status"), legacy.alias("legacy"), problem.alias("problem"))


@R.add(f"""SELECT p_partkey, model_id, CASE WHEN v1 = 1 THEN {{{", ".join(f"'{k}': '{v}'" for k, v in TASKS.items())}}}[task] ELSE capability END AS capability, CASE WHEN v1 = 1 THEN artifact || '/MODEL_MANIFEST.json' ELSE 'm/' || artifact END AS manifest, coalesce(prec, 'fp32') AS precision, v1 = 1 AS legacy,
    CASE WHEN NOT complete THEN 'INVALID_MODEL_REGISTRY' END AS problem FROM ({_MODELS})""".replace("{'layout", "MAP {'layout"))
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries as JSON of both versions, migrated."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    v1 = k % 2 == 1
    entry = F.to_json(
        F.struct(
            F.when(v1, "v1").otherwise("v2").alias("schema"), F.concat(F.lit("model-"), (k % 150).cast("string")).alias("model_id"), F.when(~v1, pick(CAPABILITIES, n % len(CAPABILITIES))).alias("capability"), F.when(v1, pick(list(TASKS), k % len(TASKS))).alias("task"),
            F.col("p_name").alias("artifact"), F.when(~v1, F.concat(F.lit("m/"), "p_name")).alias("manifest"), F.when(n % 5 != 0, F.lit("f" * 64)).alias("fingerprint"), F.when(n % 3 == 0, "fp16").alias("precision"),
        )
    )
    r = registered(P.table(spark, sf_dir, "part").select(k.alias("key"), entry.alias("entry")))
    return r.select(F.col("key").alias("p_partkey"), "model_id", "capability", "manifest", "precision", "legacy", "problem")


@R.add(f"SELECT model_id, count(*) AS entries FROM ({_MODELS}) GROUP BY model_id HAVING count(*) > 1")
def repeated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that a registry names more than once, which rejects it."""
    k = F.concat(F.lit("model-"), (F.col("p_partkey") % 150).cast("string"))
    return P.table(spark, sf_dir, "part").groupBy(k.alias("model_id")).agg(F.count("*").alias("entries")).where("entries > 1")


_RUNTIMES = """SELECT s_suppkey AS runtime, CASE WHEN s_suppkey % 4 = 0 THEN 'linux' ELSE 'windows' END AS platform, s_suppkey % 3 <> 0 AS gpu, s_suppkey % 5 <> 0 AS ready, s_suppkey % 7 AS lock FROM supplier"""


@R.add(f"""SELECT p_partkey, CASE WHEN r.runtime IS NULL THEN 'RUNTIME_NOT_REGISTERED' WHEN p_size % 2 = 0 AND platform <> 'windows' THEN 'PLATFORM_UNSUPPORTED' WHEN NOT gpu THEN 'RUNTIME_UNAVAILABLE' WHEN NOT ready THEN 'RUNTIME_UNAVAILABLE'
    WHEN p_partkey % 7 <> lock THEN 'DEPENDENCY_LOCK_MISMATCH' ELSE 'RESOLVED' END AS outcome FROM part LEFT JOIN ({_RUNTIMES}) r ON r.runtime = p_partkey % 23""")
def runtime_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that a model's runtime fails: registered, platform, device, state, lock."""
    k = F.col("s_suppkey")
    r = P.table(spark, sf_dir, "supplier").select(k.alias("runtime"), F.when(k % 4 == 0, "linux").otherwise("windows").alias("platform"), (k % 3 != 0).alias("gpu"), (k % 5 != 0).alias("ready"), (k % 7).alias("lock"))
    j = P.table(spark, sf_dir, "part").withColumn("runtime", F.col("p_partkey") % 23).join(r, "runtime", "left")
    wrong = (F.col("p_size") % 2 == 0) & (F.col("platform") != "windows")
    outcome = F.when(F.col("gpu").isNull(), "RUNTIME_NOT_REGISTERED").when(wrong, "PLATFORM_UNSUPPORTED").when(~F.col("gpu") | ~F.col("ready"), "RUNTIME_UNAVAILABLE").when(F.col("p_partkey") % 7 != F.col("lock"), "DEPENDENCY_LOCK_MISMATCH").otherwise("RESOLVED")
    return j.select("p_partkey", outcome.alias("outcome"))


@R.add(f"""WITH m AS (SELECT p_partkey % 23 AS runtime, count(*) AS models FROM part GROUP BY 1) SELECT coalesce(r.runtime, m.runtime) AS runtime, coalesce(models, 0) AS models, CASE WHEN r.runtime IS NULL THEN 'FAIL' WHEN ready THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_RUNTIMES}) r FULL JOIN m ON m.runtime = r.runtime""")
def doctor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every runtime that is registered or wanted, with the models that want it."""
    k = F.col("s_suppkey")
    r = P.table(spark, sf_dir, "supplier").select(k.alias("runtime"), (k % 5 != 0).alias("ready"))
    m = P.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 23).alias("runtime")).agg(F.count("*").alias("models"))
    return r.join(m, "runtime", "full_outer").select("runtime", F.coalesce("models", F.lit(0)).cast("long").alias("models"), F.when(F.coalesce("ready", F.lit(False)), "PASS").otherwise("FAIL").alias("status"))


def bound(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch, bound): whether a batch's answers have just the ids of its items, each once."""
    side = lambda df, asked: df.select("batch", "item", F.lit(asked).alias("asked"), F.lit(1 - asked).alias("given"))
    both = spread(side(requests, 1).unionByName(side(responses, 0)), "batch", "item")
    j = both.groupBy("batch", "item").agg(F.sum("asked").alias("asked"), F.sum("given").alias("given"))
    # An id that is null answers none.
    known = F.col("batch").isNotNull() & F.col("item").isNotNull()
    return j.groupBy("batch").agg(F.bool_and(known & (F.col("asked") == 1) & (F.col("given") == 1)).alias("bound"))


@R.add("""WITH a AS (SELECT l_orderkey AS batch, l_partkey AS item, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS batch, l_partkey AS item, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 9 <> 0 GROUP BY ALL)
    SELECT coalesce(a.batch, b.batch) AS batch, bool_and(coalesce(a.n, 0) = 1 AND coalesce(b.n, 0) = 1) AS bound FROM a FULL JOIN b ON a.batch = b.batch AND a.item = b.item GROUP BY 1""")
def response_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, a ninth of whose lines get no answer."""
    l = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 != 0).alias("kept"))
    return bound(l, l.where("kept"))


@R.add("""SELECT l_orderkey AS batch, count(*) AS items, CASE WHEN count(*) > 6 THEN 'TOO_MANY_ITEMS' WHEN count(DISTINCT l_partkey) < count(*) THEN 'REPEATED_ITEM_ID' END AS problem FROM lineitem GROUP BY l_orderkey""")
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one to six items with ids of their own."""
    g = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.count("*").alias("items"), F.count_distinct("l_partkey").alias("ids"))
    return g.select("batch", "items", F.when(F.col("items") > 6, "TOO_MANY_ITEMS").when(F.col("ids") < F.col("items"), "REPEATED_ITEM_ID").alias("problem"))


@R.add("""WITH w AS (SELECT event_id, ['load', 'infer', 'unload', 'health', 'stats', 'reset'][event_id % 6 + 1] AS op, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, value - 5 AS latency, event_type = 'error' AND event_id % 2 = 0 AS told FROM events)
    SELECT event_id, CASE WHEN op = 'reset' THEN 'RUNTIME_WORKER_OPERATION_INVALID' WHEN latency < 0 THEN 'RUNTIME_WORKER_RESPONSE_INVALID' WHEN status = 'ERROR' AND NOT told THEN 'RUNTIME_WORKER_ERROR_REQUIRED' END AS problem FROM w""")
def worker_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contract that a worker's exchange breaks: operation, status and latency, an error's description."""
    k = F.col("event_id")
    error = F.col("event_type") == "error"
    problem = F.when(k % 6 == 5, "RUNTIME_WORKER_OPERATION_INVALID").when(F.col("value") - 5 < 0, "RUNTIME_WORKER_RESPONSE_INVALID").when(error & (k % 2 != 0), "RUNTIME_WORKER_ERROR_REQUIRED")
    return P.table(spark, sf_dir, "events").select("event_id", problem.alias("problem"))


@R.add("""WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'unload' WHEN 'error' THEN 'health' ELSE 'load' END AS op, value FROM events), s AS (SELECT *, sum(CASE WHEN op = 'unload' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM o),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(life, 0), op ORDER BY event_id) AS k, count(*) FILTER (op = 'load') OVER (PARTITION BY user_id, coalesce(life, 0)) AS loads FROM s)
    SELECT user_id, count(*) FILTER (op = 'load' AND k = 1) AS loads, count(*) FILTER (op = 'load' AND k > 1) AS reuses, count(*) FILTER (op = 'unload' AND loads > 0) AS unloads, round(coalesce(sum(CASE WHEN op = 'load' AND k = 1 THEN value END), 0), 4) AS load_ms FROM n GROUP BY user_id""")
def runtime_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads, reuses and unloads by worker: a load while loaded is a reuse, an unload while unloaded nothing."""
    op = F.when(F.col("event_type") == "signup", "unload").when(F.col("event_type") == "error", "health").otherwise("load")
    w = W.partitionBy("user_id").orderBy("event_id")
    o = P.table(spark, sf_dir, "events").select("user_id", "event_id", op.alias("op"), "value")
    o = o.withColumn("life", F.coalesce(F.sum(F.when(F.col("op") == "unload", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    o = o.withColumn("k", F.row_number().over(W.partitionBy("user_id", "life", "op").orderBy("event_id"))).withColumn("loads", F.count_if(F.col("op") == "load").over(W.partitionBy("user_id", "life")))
    first = (F.col("op") == "load") & (F.col("k") == 1)
    return o.groupBy("user_id").agg(F.count_if(first).alias("loads"), F.count_if((F.col("op") == "load") & (F.col("k") > 1)).alias("reuses"), F.count_if((F.col("op") == "unload") & (F.col("loads") > 0)).alias("unloads"), F.round(F.coalesce(F.sum(F.when(first, F.col("value"))), F.lit(0)), 4).alias("load_ms"))


def receipts(artifacts: DataFrame, scope: str) -> DataFrame:
    """(package, receipt) of (package, name, sha): the digests of what was delivered by name, as JSON; no review is claimed."""
    if scope not in ("CONVERTER_ARTIFACTS", "HANDOFF_ARTIFACTS"):
        raise ValueError("Unsupported delivery completion scope")
    listed = F.transform(F.array_sort(F.collect_set(F.struct("name", "sha"))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('":"'), x["sha"], F.lit('"')))
    body = F.concat(F.lit('{"schema":"delivery-stage-v1","complete_scope":"' + scope + '","artifact_sha256":{'), F.array_join(listed, ","), F.lit('},"agent_review":"NOT_RECORDED","content_acceptance":"NOT_RECORDED"}'))
    return artifacts.groupBy("package").agg(body.alias("receipt"))


@R.add("""SELECT conv_id AS package, '{"schema":"delivery-stage-v1","complete_scope":"HANDOFF_ARTIFACTS","artifact_sha256":{' || string_agg('"' || name || '":"' || sha || '"', ',' ORDER BY name) || '},"agent_review":"NOT_RECORDED","content_acceptance":"NOT_RECORDED"}' AS receipt
    FROM (SELECT DISTINCT conv_id, lpad(CAST(turn AS VARCHAR), 4, '0') || '.md' AS name, sha256(text) AS sha FROM conversations) GROUP BY conv_id""")
def delivery_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".md"))
    return receipts(P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("package"), name.alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "HANDOFF_ARTIFACTS")


@R.add("SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'REMOVED' ELSE 'RETAINED' END AS outcome FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'RETAINED' FROM orders WHERE o_orderkey % 3 <> 0")
def staging_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging folders (every third order) not touched since a time go; files stay."""
    old = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp"))
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.when(old, "REMOVED").otherwise("RETAINED").alias("outcome"))


def asset_problems(rows: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(package, asset, problem): where a manifest, the files and the links of a text disagree, in either direction."""
    m, f, r = (spread(x, "package", "asset") for x in (rows.select("package", "asset", F.col("sha").alias("m")), files.select("package", "asset", F.col("sha").alias("f")), refs.select("package", "asset")))
    r = r.distinct().withColumn("r", F.lit(True))
    j = m.join(f, ["package", "asset"], "full_outer").join(r, ["package", "asset"], "full_outer")
    m, f, r = F.col("m"), F.col("f"), F.col("r")
    found = F.array_compact(
        F.array(
            F.when(m.isNotNull() & f.isNull(), "RESOLVED_ASSET_MISSING"), F.when(m.isNotNull() & f.isNotNull() & (m != f), "ASSET_SHA_MISMATCH"), F.when(m.isNotNull() & r.isNull(), "ASSET_NOT_REFERENCED"),
            F.when(m.isNull() & r.isNotNull(), "LINK_NOT_DECLARED"), F.when(m.isNull() & f.isNotNull(), "FILE_NOT_DECLARED"),
        )
    )
    return j.select("package", "asset", F.explode(found).alias("problem"))


_ASSETS = """a AS (SELECT DISTINCT l_orderkey AS package, l_partkey AS asset FROM lineitem), m AS (SELECT package, asset, sha256(CAST(asset AS VARCHAR)) AS sha FROM a WHERE asset % 13 <> 0), f AS (SELECT package, asset, sha256(CAST(asset AS VARCHAR) || CASE WHEN asset % 17 = 0 THEN 'x' ELSE '' END) AS sha FROM a WHERE asset % 11 <> 0), r AS (SELECT * FROM a WHERE asset % 7 <> 0)"""


@R.add(f"""WITH {_ASSETS}, j AS (SELECT package, asset, m.sha AS m, f.sha AS f, r.asset IS NOT NULL AS r FROM a LEFT JOIN m USING (package, asset) LEFT JOIN f USING (package, asset) LEFT JOIN r USING (package, asset))
    SELECT package, asset, 'RESOLVED_ASSET_MISSING' AS problem FROM j WHERE m IS NOT NULL AND f IS NULL UNION ALL SELECT package, asset, 'ASSET_SHA_MISMATCH' FROM j WHERE m <> f UNION ALL SELECT package, asset, 'ASSET_NOT_REFERENCED' FROM j WHERE m IS NOT NULL AND NOT r
    UNION ALL SELECT package, asset, 'LINK_NOT_DECLARED' FROM j WHERE m IS NULL AND r UNION ALL SELECT package, asset, 'FILE_NOT_DECLARED' FROM j WHERE m IS NULL AND f IS NOT NULL""".replace("r.asset IS NOT NULL AS r FROM a", "k.package IS NOT NULL AS r FROM a").replace("LEFT JOIN r USING (package, asset))", "LEFT JOIN r k ON k.package = a.package AND k.asset = a.asset)").replace("SELECT package, asset, m.sha", "SELECT a.package, a.asset, m.sha"))
def asset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.col("l_partkey").alias("asset"))
    a = spread(a, "package", "asset").distinct()
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha")
    k = F.col("asset")
    m = a.where(k % 13 != 0).select("package", "asset", sha(k.cast("string")))
    f = a.where(k % 11 != 0).select("package", "asset", sha(F.concat(k.cast("string"), F.when(k % 17 == 0, "x").otherwise(""))))
    return asset_problems(m, f, a.where(k % 7 != 0))


# Kinds of visible assets, and the type of a file by its suffix.
KINDS = ("EMBEDDED_IMAGE", "DRAWINGML_GROUP", "VML_IMAGE", "FORMULA_FALLBACK", "EXTERNAL_LINKED_IMAGE", "OTHER_VISUAL")
MIMES = {".png": "image/png", ".jpg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".svg": "image/svg+xml"}
_OCC = f"SELECT l_orderkey AS doc, l_linenumber AS ord, {list(KINDS)}[l_suppkey % {len(KINDS)} + 1] AS kind, {[*MIMES, '.emf', '']}[l_partkey % {len(MIMES) + 2} + 1] AS suffix, l_partkey AS id, l_quantity % 9 <> 0 AS there FROM lineitem"


def finalized(occurrences: DataFrame) -> DataFrame:
    """(doc, id, asset, path, mime, uid) of (doc, ord, id, kind, suffix, there): numbers in reading order, a drawing being SVG; what is not there has no path."""
    c = F.col
    asset = F.concat(F.lit("image_"), F.lpad(F.row_number().over(W.partitionBy("doc").orderBy("ord", "id", "kind", "there")).cast("string"), 6, "0"))
    suffix = F.when(~c("there"), "").when(c("kind") == "DRAWINGML_GROUP", ".svg").when(c("suffix") == "", ".bin").otherwise(c("suffix"))
    o = occurrences.select("*", asset.alias("asset"), suffix.alias("ext"))
    mime = F.when(c("ext") != "", F.coalesce(F.create_map(*[F.lit(x) for kv in MIMES.items() for x in kv])[c("ext")], F.lit("application/octet-stream")))
    return o.select("doc", "ord", "id", "kind", "there", "asset", F.when(c("ext") != "", F.concat(F.lit("assets/"), "asset", "ext")).alias("path"), mime.alias("mime"), _uid().alias("uid"))


def _uid() -> Column:
    return F.sha2(F.concat_ws("\x1f", F.col("doc").cast("string"), F.col("id").cast("string"), F.col("kind")).cast("binary"), 256)


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    l = spread(P.table(spark, sf_dir, "lineitem"), "l_orderkey")
    return l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("id"), pick(KINDS, F.col("l_suppkey") % len(KINDS)).alias("kind"), pick([*MIMES, ".emf", ""], F.col("l_partkey") % (len(MIMES) + 2)).alias("suffix"), (F.col("l_quantity") % 9 != 0).alias("there")).distinct()


_FINAL = f"""o AS (SELECT DISTINCT * FROM ({_OCC})), n AS (SELECT *, 'image_' || lpad(CAST(row_number() OVER (PARTITION BY doc ORDER BY ord, id, kind, there) AS VARCHAR), 6, '0') AS asset, CASE WHEN NOT there THEN '' WHEN kind = 'DRAWINGML_GROUP' THEN '.svg' WHEN suffix = '' THEN '.bin' ELSE suffix END AS ext FROM o)"""


@R.add(f"""WITH {_FINAL} SELECT doc, id, kind, max(asset) AS asset, max(CASE WHEN ext <> '' THEN 'assets/' || asset || ext END) AS path, max(CASE ext WHEN '' THEN NULL {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIMES.items())} ELSE 'application/octet-stream' END) AS mime, sha256(doc || chr(31) || id || chr(31) || kind) AS uid FROM n GROUP BY doc, id, kind""")
def final_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalized(_occurrences(spark, sf_dir)).groupBy("doc", "id", "kind").agg(F.max("asset").alias("asset"), F.max("path").alias("path"), F.max("mime").alias("mime")).withColumn("uid", _uid())


@R.add(f"""WITH {_FINAL} SELECT doc, count(*) AS total_visible, count(*) FILTER (there) AS resolved, count(*) FILTER (NOT there) AS unresolved, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}" for k in KINDS)} FROM n GROUP BY doc""")
def asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return finalized(_occurrences(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("total_visible"), F.count_if(c("there")).alias("resolved"), F.count_if(~c("there")).alias("unresolved"), *[F.count_if(c("kind") == k).alias(k.lower()) for k in KINDS])


@R.add("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 10 ELSE o_custkey % 3 + o_custkey % 5 + o_orderkey % 2 + o_orderkey % 7 END AS items FROM orders""")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much there is to review: the number that a report states, else the sum of its parts."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    stated = F.when(c % 4 == 0, c % 10)
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(stated, c % 3 + c % 5 + o % 2 + o % 7).alias("items"))


@R.add("""SELECT o_orderkey, greatest(o_orderkey % 8, o_custkey % 5) AS private, greatest(o_orderkey % 6, o_custkey % 9) AS physical, greatest(o_orderkey % 4, 0) AS gpu, CASE WHEN o_custkey % 11 = 0 THEN 'UNKNOWN_REQUIREMENT_FIELD' END AS problem FROM orders""")
def merged_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field the larger of what is asked and what is registered; fields nobody knows are refused."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    asked = F.create_map(F.lit("private"), o % 8, F.lit("physical"), o % 6, F.lit("gpu"), o % 4)
    asked = F.when(c % 11 == 0, F.map_concat(asked, F.create_map(F.lit("disk"), F.lit(1).cast("long")))).otherwise(asked)
    registered_ = F.create_map(F.lit("private"), c % 5, F.lit("physical"), c % 9)
    r = P.table(spark, sf_dir, "orders").select("o_orderkey", asked.alias("a"), registered_.alias("b"))
    both = lambda k: F.greatest(F.coalesce(F.col("a")[k], F.lit(0)), F.coalesce(F.col("b")[k], F.lit(0))).alias(k)
    unknown = F.size(F.array_except(F.map_keys("a"), F.array(*[F.lit(k) for k in ("private", "physical", "gpu")]))) > 0
    return r.select("o_orderkey", both("private"), both("physical"), both("gpu"), F.when(unknown, "UNKNOWN_REQUIREMENT_FIELD").alias("problem"))


@R.add("""SELECT a.o_orderkey AS a, a.o_custkey % 40 = b.o_custkey % 40 AND a.o_orderpriority = b.o_orderpriority AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def policy_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two policies are one but for what changes with every sample."""
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("cap"), (F.col("o_custkey") % 40).cast("string"), F.lit("mode"), F.col("o_orderpriority"), F.lit("sample_epoch"), F.col("o_orderdate").cast("string")).alias("p"))
    lasting = o.select("o_orderkey", F.map_filter("p", lambda k, v: ~k.isin("sample_epoch", "observer")).alias("p"))
    b = lasting.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("p").alias("q"))
    same = lambda k: F.col("p")[k] == F.col("q")[k]
    return lasting.join(b, "o_orderkey").select(F.col("o_orderkey").alias("a"), (same("cap") & same("mode")).alias("same"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'CAPACITY_INSUFFICIENT' ELSE 'ADMIT' END AS decision, CASE WHEN o_orderkey % 5 > 0 THEN 'EXTERNAL_API_CANNOT_OWN_LOCAL_GPU' ELSE '' END AS reason FROM orders")
def external_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that runs elsewhere goes in unless it asks for graphics memory here."""
    asks = F.col("o_orderkey") % 5 > 0
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.when(asks, "CAPACITY_INSUFFICIENT").otherwise("ADMIT").alias("decision"), F.when(asks, "EXTERNAL_API_CANNOT_OWN_LOCAL_GPU").otherwise("").alias("reason"))


@R.add(f"""WITH s AS (SELECT s_suppkey, (s_suppkey % 40 + 1) * 1024 AS total, s_suppkey % 33 * 1024 AS free, 8192 AS gpu, s_suppkey % 9 * 1100 AS gfree, s_suppkey % 4 * 1500 AS gused, s_suppkey % 6 AS uuid FROM supplier)
    SELECT s_suppkey, CASE WHEN uuid = 5 THEN 'GPU_IDENTITY_CHANGED' WHEN free > total THEN 'PHYSICAL_OBSERVATION_INVALID' WHEN gfree > gpu OR gused > gpu THEN 'GPU_OBSERVATION_INVALID' WHEN gfree + gused > gpu + 1 THEN 'GPU_OBSERVATION_INCONSISTENT' END AS problem FROM s""")
def observation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way in which a sample of memory cannot be true; in MiB, with one to spare between what is free and used."""
    k = F.col("s_suppkey")
    total, free, gpu, gfree, gused = (k % 40 + 1) * 1024, k % 33 * 1024, F.lit(8192), k % 9 * 1100, k % 4 * 1500
    problem = F.when(k % 6 == 5, "GPU_IDENTITY_CHANGED").when(free > total, "PHYSICAL_OBSERVATION_INVALID").when((gfree > gpu) | (gused > gpu), "GPU_OBSERVATION_INVALID").when(gfree + gused > gpu + 1, "GPU_OBSERVATION_INCONSISTENT")
    return P.table(spark, sf_dir, "supplier").select("s_suppkey", problem.alias("problem"))


# Fields that no task's payload may have, at any depth.
FORBIDDEN = ("env", "environment", "argv", "shell", "command", "interpreter", "script", "token", "password", "secret", "api_key", "authorization")


@vectorized("boolean")
def payload_unsafe(texts: pd.Series) -> pd.Series:
    """Whether a JSON text names a forbidden field anywhere."""

    def bad(value) -> bool:
        if isinstance(value, dict):
            return any(str(k).lower() in FORBIDDEN for k in value) or any(map(bad, value.values()))
        return isinstance(value, list) and any(map(bad, value))

    return texts.map(lambda t: t is not None and bad(json.loads(t)))


@R.add(f"SELECT event_id, event_id % 10 >= 5 AND list_contains({list(FORBIDDEN)}, {[*FORBIDDEN, 'note', 'text']}[event_id % {len(FORBIDDEN) + 2} + 1]) AS unsafe FROM events")
def payload_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose third level has a field in question in half of the cases."""
    k = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in [*FORBIDDEN, "note", "text"]]), (k % (len(FORBIDDEN) + 2) + 1).cast("int"))
    inner = F.when(k % 10 >= 5, F.upper(name)).otherwise("fine")
    payload = F.concat(F.lit('{"a": [{"b": {"'), inner, F.lit('": 1}}]}'))
    return P.table(spark, sf_dir, "events").select("event_id", payload_unsafe(payload).alias("unsafe"))


@R.add("SELECT s_suppkey, s_suppkey % 4 AS idx, 'GPU-' || s_suppkey AS uuid, s_name AS name, s_suppkey * 10 AS total_mib FROM supplier WHERE s_suppkey % 4 = 2")
def gpu_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of comma-separated counters of devices, the visible one of them."""
    k = F.col("s_suppkey")
    line = F.concat_ws(", ", k % 4, F.concat(F.lit("GPU-"), k.cast("string")), "s_name", F.concat((k * 10).cast("string"), F.lit(".0")))
    d = P.table(spark, sf_dir, "supplier").select("s_suppkey", F.from_csv(line, F.lit("idx long, uuid string, name string, total double"), {"ignoreLeadingWhiteSpace": "true"}).alias("d"))
    return d.where("d.idx = 2").select("s_suppkey", "d.idx", "d.uuid", "d.name", F.col("d.total").cast("long").alias("total_mib"))


@R.add("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS item, o_custkey % 7 = 0 AS broken FROM orders WHERE o_orderkey % 10 <> 0")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of JSON lines: blank ones skipped, lines that are no object told."""
    k = F.col("o_custkey")
    line = F.when(F.col("o_orderkey") % 10 == 0, "  ").when(k % 7 == 0, "[1, 2").otherwise(F.concat(F.lit('{"item": '), k.cast("string"), F.lit("}")))
    l = P.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")).where(F.trim("line") != "")
    row = F.from_json("line", "item long")
    return l.select("o_orderkey", row["item"].alias("item"), row["item"].isNull().alias("broken"))


def first_of(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of least ``rank``, the newest and then the least path of equal ones."""
    w = W.partitionBy(*keys).orderBy("rank", F.desc("at"), "path")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@R.add("""WITH c AS (SELECT o_custkey AS source, 1 AS rank, 'catalog/' || o_orderkey AS path, o_orderdate AS made FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_custkey, 2, 'cache/' || o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_custkey, 3, 'job/' || o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, made DESC, path) AS n FROM c)
    SELECT c_custkey AS source, coalesce(path, '') AS path, CASE WHEN path IS NULL THEN 'CONVERSION_REQUIRED' ELSE 'FOUND' END AS status FROM customer LEFT JOIN n ON n.source = c_custkey AND n.n = 1""")
def package_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a source's package is: the catalogue, the cache, else the newest job that succeeded; or it has to be converted."""
    o = P.table(spark, sf_dir, "orders")
    at = lambda cond, rank, name: o.where(cond).select(F.col("o_custkey").alias("source"), F.lit(rank).alias("rank"), F.concat(F.lit(name), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("at"))
    c = at("o_orderkey % 17 = 0", 1, "catalog/").union(at("o_orderkey % 5 = 0", 2, "cache/")).union(at("o_orderstatus = 'F'", 3, "job/"))
    found = first_of(c, ["source"]).select("source", "path")
    s = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"))
    return s.join(found, "source", "left").select("source", F.coalesce("path", F.lit("")).alias("path"), F.when(F.col("path").isNull(), "CONVERSION_REQUIRED").otherwise("FOUND").alias("status"))


@R.add("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'arg' END, CASE WHEN c_custkey % 5 = 0 THEN 'env' END, CASE WHEN c_custkey % 3 = 0 THEN 'file' END, 'cwd') AS root FROM customer")
def config_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings come from the call, else the environment, else the nearest file, else the working folder."""
    k = F.col("c_custkey")
    return P.table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.when(k % 7 == 0, "arg"), F.when(k % 5 == 0, "env"), F.when(k % 3 == 0, "file"), F.lit("cwd")).alias("root"))


@R.add("""WITH w AS (SELECT 'dir' || i AS path FROM range(0, 60) r(i)), h AS (SELECT DISTINCT 'dir' || (c_custkey % 70) AS path, c_custkey % 70 % 9 = 0 AS is_file FROM customer WHERE c_custkey % 70 % 4 <> 0) SELECT w.path, CASE WHEN h.path IS NULL THEN 'MISSING' WHEN is_file THEN 'CONFLICT' ELSE 'PRESENT' END AS state FROM w LEFT JOIN h USING (path)""")
def workspace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a workspace needs: there, missing, or a file in their place."""
    k = F.col("c_custkey") % 70
    have = P.table(spark, sf_dir, "customer").where(k % 4 != 0).select(F.concat(F.lit("dir"), k.cast("string")).alias("path"), (k % 9 == 0).alias("is_file")).distinct()
    need = spark.range(60).select(F.concat(F.lit("dir"), F.col("id").cast("string")).alias("path"))
    return need.join(have, "path", "left").select("path", F.when(F.col("is_file").isNull(), "MISSING").when(F.col("is_file"), "CONFLICT").otherwise("PRESENT").alias("state"))


def in_scope(path: Column, roots: list[str]) -> Column:
    """A path below one of the roots, whatever segments of itself it names."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | path.startswith(f"{r}/")
    return inside & ~path.rlike(r"(^|/)\.\.(/|$)")


@R.add(r"""SELECT page_id, (starts_with(p, 'books/') OR starts_with(p, 'notes/')) AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') AS allowed FROM (SELECT page_id, ['books/', 'notes/', 'bookshelf/', 'books/../'][page_id % 4 + 1] || regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def path_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("books/", "notes/", "bookshelf/", "books/../")]), (F.col("page_id") % 4 + 1).cast("int"))
    p = F.concat(head, F.regexp_replace("url", "^https?://", ""))
    return P.table(spark, sf_dir, "pages").select("page_id", in_scope(p, ["books", "notes"]).alias("allowed"))


@R.add("""WITH a AS (SELECT o_custkey AS k, o_orderkey % 6 AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderkey % 6 AS v FROM orders WHERE o_orderkey % 2 = 1), g AS (SELECT k, list_sort(list(v)) AS x, list_sort(list_distinct(list(v))) AS sx FROM a GROUP BY k), h AS (SELECT k, list_sort(list(v - 1)) AS y, list_sort(list_distinct(list(v - 1))) AS sy FROM b GROUP BY k)
    SELECT k, x = y AS same_multiset, sx = sy AS same_set, len(list_intersect(sx, sy)) > 0 AS meet, len(list_filter(sx, lambda e: NOT list_contains(sy, e))) = 0 AS subset FROM g JOIN h USING (k)""")
def set_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists a key: equal as they are, equal as sets, meeting, one within the other."""
    o = P.table(spark, sf_dir, "orders")
    side = lambda odd, v, a: o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(v)).alias(a), F.sort_array(F.collect_set(v)).alias(f"s{a}"))
    v = F.col("o_orderkey") % 6
    j = side(0, v, "x").join(side(1, v - 1, "y"), "k")
    c = F.col
    return j.select("k", (c("x") == c("y")).alias("same_multiset"), (c("sx") == c("sy")).alias("same_set"), F.arrays_overlap("sx", "sy").alias("meet"), (F.size(F.array_except("sx", "sy")) == 0).alias("subset"))


@R.add(f"""WITH r AS ({P.REGIONS}) SELECT region, 'formula' AS part FROM r WHERE label LIKE '%formula' UNION ALL SELECT region, 'table' FROM r WHERE label = 'table' UNION ALL SELECT region, 'text' FROM r WHERE label IN ('text', 'paragraph_title', 'figure_title') UNION ALL SELECT region, 'preserved' FROM r WHERE label IN ('image', 'chart', 'algorithm', 'seal')""")
def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's lists of regions as one, each with the list it comes from."""
    r = P.regions(spark, sf_dir)
    part = lambda cond, name: r.where(cond).select("region", F.lit(name).alias("part"))
    return part("label like '%formula'", "formula").unionByName(part("label = 'table'", "table")).unionByName(part("label in ('text', 'paragraph_title', 'figure_title')", "text")).unionByName(part("label in ('image', 'chart', 'algorithm', 'seal')", "preserved"))


@R.add("SELECT doc_id, quality FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 50 OFFSET 10")
def pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the queue: at most fifty from the offset on."""
    return P.table(spark, sf_dir, "labels").where("quality = 0").orderBy("doc_id").offset(10).limit(50).select("doc_id", "quality")


@R.add("""SELECT source, max(n) FILTER (kind = 'xml') AS xml, max(n) FILTER (kind = 'media') AS media, max(n) FILTER (kind = 'ole') AS ole, CAST(sum(n) AS BIGINT) AS total, max(n * 1000 // (doc % 90 + 10)) AS ratio_milli FROM (SELECT source, doc_id AS doc, ['xml', 'media', 'ole', 'other'][doc_id % 4 + 1] AS kind, n_chars AS n FROM documents) GROUP BY source""")
def package_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest part of every kind in a package, their sum, and the largest compression ratio in thousandths."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("xml", "media", "ole", "other")]), (k % 4 + 1).cast("int"))
    d = P.table(spark, sf_dir, "documents").select("source", kind.alias("kind"), F.col("n_chars").alias("n"), F.expr("n_chars * 1000 div (doc_id % 90 + 10)").alias("ratio"))
    most = lambda x: F.max(F.when(F.col("kind") == x, F.col("n"))).alias(x)
    return d.groupBy("source").agg(most("xml"), most("media"), most("ole"), F.sum("n").alias("total"), F.max("ratio").alias("ratio_milli"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey AS num, s.s_name AS style, coalesce(n.n_name, CAST(l_suppkey AS VARCHAR)) AS abstract FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN supplier s ON s.s_suppkey = l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey % 2 = 0""")
def numbering_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs with their list's definition, and the name of its style, the id where it has none."""
    l = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    n = P.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    j = l.join(P.table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("num"), F.col("s_name").alias("style"), F.coalesce("n_name", F.col("l_suppkey").cast("string")).alias("abstract"))


def rehydrated(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (id, key) with the ``value`` of valid cache rows of its key; state tells hits, invalid rows and misses."""
    c = cache.select("key", "value", "valid")
    j = wanted.join(c, "key", "left")
    return j.select("id", F.when(F.col("valid"), F.col("value")).alias("value"), F.when(F.col("valid").isNull(), "MISS").when(F.col("valid"), "HIT").otherwise("INVALID").alias("state"))


@R.add("""WITH c AS (SELECT DISTINCT md5(CAST(p_size AS VARCHAR)) AS key, p_size * 2 AS value, p_size % 7 <> 0 AS valid FROM part WHERE p_size % 3 <> 0) SELECT o_orderkey AS id, CASE WHEN valid THEN value END AS value, CASE WHEN valid IS NULL THEN 'MISS' WHEN valid THEN 'HIT' ELSE 'INVALID' END AS state FROM orders LEFT JOIN c ON c.key = md5(CAST(o_custkey % 50 AS VARCHAR))""")
def cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.md5(c.cast("string").cast("binary")).alias("key")
    cache = P.table(spark, sf_dir, "part").where("p_size % 3 <> 0").select(key(F.col("p_size")), (F.col("p_size") * 2).alias("value"), (F.col("p_size") % 7 != 0).alias("valid")).distinct()
    return rehydrated(P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), key(F.col("o_custkey") % 50)), cache)


@R.add(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4000 THEN 'FAILED_PRESERVED' WHEN octet_length(encode(text)) > 2000 AND doc_id % 2 = 0 THEN 'FAILED_PRESERVED' ELSE 'ACCEPTED' END AS status FROM documents WHERE text IS NOT NULL")
def payload_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers over a size, and payloads over half of it, are kept as they are."""
    n = F.octet_length("text")
    return P.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when((n > 4000) | ((n > 2000) & (F.col("doc_id") % 2 == 0)), "FAILED_PRESERVED").otherwise("ACCEPTED").alias("status"))


@R.add("""WITH e AS (SELECT user_id AS page, event_id AS seq, CASE event_type WHEN 'view' THEN 'flag' WHEN 'click' THEN 'resolve' WHEN 'purchase' THEN 'approve' ELSE 'edit' END AS action FROM events),
    k AS (SELECT *, max(CASE WHEN action = 'edit' THEN seq END) OVER (PARTITION BY page) AS edited, max(CASE WHEN action = 'flag' THEN seq END) OVER (PARTITION BY page) AS flagged FROM e)
    SELECT page, count(*) FILTER (action = 'flag') AS issues, count(*) FILTER (action = 'resolve' AND seq > coalesce(edited, -1)) AS decisions, coalesce(max(CASE WHEN action = 'approve' THEN seq END) > greatest(coalesce(max(edited), -1), coalesce(max(flagged), -1)), FALSE) AS approved FROM k GROUP BY page""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as a fold over events: an edit undoes earlier decisions of its page, and an approval holds until the next edit or flag."""
    kind = F.when(F.col("event_type") == "view", "flag").when(F.col("event_type") == "click", "resolve").when(F.col("event_type") == "purchase", "approve").otherwise("edit")
    e = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), kind.alias("action"))
    return reviewed(e)


def reviewed(events: DataFrame) -> DataFrame:
    """(page, issues, decisions, approved) of (page, seq, action); a page's last edit is found first, so that no history is collected."""
    last = lambda action: F.coalesce(F.max(F.when(F.col("action") == action, F.col("seq"))), F.lit(-1))
    ends = events.groupBy("page").agg(last("edit").alias("edited"), last("flag").alias("flagged"), last("approve").alias("approval"), F.count_if(F.col("action") == "flag").alias("issues"))
    lasting = events.where("action = 'resolve'").join(ends.select("page", "edited"), "page").where("seq > edited").groupBy("page").agg(F.count("*").alias("decisions"))
    return ends.join(lasting, "page", "left").select("page", "issues", F.coalesce("decisions", F.lit(0)).cast("long").alias("decisions"), ((F.col("approval") >= 0) & (F.col("approval") > F.greatest("edited", "flagged"))).alias("approved"))


@R.add("""WITH j AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice FROM orders) SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS state, o_custkey % 4 = 0 AS cleanup_confirmed, CASE WHEN o_orderstatus <> 'F' THEN 'exit ' || (o_custkey % 3 + 1) END AS error FROM j""")
def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of jobs whose process has ended: cancelled if asked to, else by its exit code."""
    c = F.col("o_custkey")
    done = F.col("o_orderstatus") == "F"
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.when(c % 9 == 0, "CANCELLED").when(done, "SUCCEEDED").otherwise("FAILED").alias("state"), (c % 4 == 0).alias("cleanup_confirmed"), F.when(~done, F.concat(F.lit("exit "), (c % 3 + 1).cast("string"))).alias("error"))


@R.add("""SELECT sha256(text) AS address, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def source_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One backup per content, by its digest."""
    return P.table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("address")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@R.add("""WITH o AS (SELECT l_partkey AS asset, l_orderkey AS parent, md5(l_orderkey || '/' || l_partkey || '/crop') AS key, l_linenumber AS made, l_quantity % 5 = 0 AS retryable FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY made DESC, retryable) AS n FROM o) SELECT key, CASE WHEN retryable THEN 'RUN_AGAIN' ELSE 'REUSE' END AS action FROM n WHERE n = 1""")
def image_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived pictures by parent, asset and operation: the newest state is used again unless it may be retried."""
    key = F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.lit("crop")).cast("binary"))
    o = P.table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_linenumber").alias("at"), (F.col("l_quantity") % 5 == 0).alias("retryable"))
    n = F.row_number().over(W.partitionBy("key").orderBy(F.desc("at"), "retryable"))
    return o.withColumn("n", n).where("n = 1").select("key", F.when(F.col("retryable"), "RUN_AGAIN").otherwise("REUSE").alias("action"))
