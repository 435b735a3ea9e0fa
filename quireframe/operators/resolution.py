"""What stands for what: visible occurrences, references, evidence, ladders of candidates, and bindings by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources import projections as P
from .regions import TEXT_LABELS, touching

R = Registry()
_T = ", ".join(f"'{x}'" for x in TEXT_LABELS)
# States of a formula that its picture stands for.
VISIBLE = ("RENDERED_FALLBACK", "FAILED_PRESERVED", "OCR_REVIEW_REQUIRED", "OCR_REJECTED_PRESERVE_IMAGE", "OCR_INFERENCE_FAILED_PRESERVE_IMAGE")
STATES = (*VISIBLE, "UNRESOLVED", "CONVERTED", "OCR_ACCEPTED")
_STATES = list(STATES)
_V = ", ".join(f"'{x}'" for x in VISIBLE)

NODES = f"""SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord, l_partkey AS node, CASE l_suppkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'formula' ELSE 'text' END AS kind,
    {_STATES}[l_partkey % {len(STATES)} + 1] AS state, l_suppkey % 4 <> 0 AS rendered, l_suppkey % 5 = 0 AS preview, CASE l_partkey % 7 WHEN 0 THEN 'link' WHEN 1 THEN 'embedded' ELSE 'block' END AS holder FROM lineitem"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, ord, node, kind, state, rendered, preview, holder): inlines of documents in reading order."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("ord"), k.alias("node"), pick(("image", "formula", "text"), s % 3).alias("kind"), pick(STATES, k % len(STATES)).alias("state"),
        (s % 4 != 0).alias("rendered"), (s % 5 == 0).alias("preview"), F.when(k % 7 == 0, "link").when(k % 7 == 1, "embedded").otherwise("block").alias("holder"),
    )


def seen(kind: Column, state: Column, preview: Column) -> Column:
    """Pictures show always; formulas in the states that a picture stands for, and unresolved ones with a preview."""
    return (kind == "image") | ((kind == "formula") & (state.isin(*VISIBLE) | ((state == "UNRESOLVED") & preview)))


@R.add(f"""WITH n AS ({NODES}), v AS (SELECT *, row_number() OVER (PARTITION BY doc, node ORDER BY ord) AS k FROM n WHERE kind = 'image' OR kind = 'formula' AND (state IN ({_V}) OR state = 'UNRESOLVED' AND preview))
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord) AS INTEGER) AS number, node, CASE WHEN kind = 'formula' THEN 'FORMULA_FALLBACK' ELSE 'EMBEDDED_IMAGE' END AS semantic_type, CASE WHEN rendered THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM v WHERE k = 1""")
def visible_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shows in a document, each node once, in order."""
    v = nodes(spark, sf_dir).where(seen(F.col("kind"), F.col("state"), F.col("preview")))
    v = v.withColumn("k", F.row_number().over(W.partitionBy("doc", "node").orderBy("ord"))).where("k = 1")
    number = F.row_number().over(W.partitionBy("doc").orderBy("ord"))
    return v.select("doc", number.alias("number"), "node", F.when(F.col("kind") == "formula", "FORMULA_FALLBACK").otherwise("EMBEDDED_IMAGE").alias("semantic_type"), F.when(F.col("rendered"), "RESOLVED").otherwise("UNRESOLVED").alias("status"))


@R.add(f"WITH n AS ({NODES}) SELECT doc, CAST(ord AS INTEGER) AS ord, node, state FROM n WHERE kind = 'formula' AND holder <> 'embedded'")
def formula_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in blocks and links; what stands within pictures' content is left to these."""
    return nodes(spark, sf_dir).where("kind = 'formula' AND holder <> 'embedded'").select("doc", "ord", "node", "state")


@R.add(f"""WITH n AS ({NODES}) SELECT doc, CAST(ord AS INTEGER) AS ord, CASE WHEN (state IN ({_V}) OR state = 'UNRESOLVED') AND rendered THEN 'assets/' || node || '.png' END AS final_ref, state LIKE 'OCR_ACCEPTED%' AND rendered AS suppressed FROM n WHERE kind = 'formula' AND holder <> 'embedded'""")
def formula_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture that a formula refers to in the end: none once its text is accepted, whose picture is kept back."""
    f = nodes(spark, sf_dir).where("kind = 'formula' AND holder <> 'embedded'")
    shows = (F.col("state").isin(*VISIBLE) | (F.col("state") == "UNRESOLVED")) & F.col("rendered")
    return f.select("doc", "ord", F.when(shows, F.concat(F.lit("assets/"), F.col("node").cast("string"), F.lit(".png"))).alias("final_ref"), (F.col("state").startswith("OCR_ACCEPTED") & F.col("rendered")).alias("suppressed"))


@R.add(f"""WITH n AS ({NODES}), c AS (SELECT p_partkey AS node, p_brand AS origin, p_size AS width FROM part WHERE p_partkey % 3 <> 0) SELECT doc, CAST(ord AS INTEGER) AS ord, CASE WHEN state LIKE '%INFERENCE_FAILED%' THEN 'PRESERVE_IMAGE' ELSE 'RECORDED' END AS outcome, coalesce(origin, 'UNKNOWN') AS origin, width FROM n LEFT JOIN c ON c.node = n.node WHERE kind = 'formula'""")
def formula_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a formula comes from, by its candidate's record; one whose reading failed keeps its picture."""
    c = P.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("origin"), F.col("p_size").alias("width"))
    j = nodes(spark, sf_dir).where("kind = 'formula'").join(c, "node", "left")
    return j.select("doc", "ord", F.when(F.col("state").contains("INFERENCE_FAILED"), "PRESERVE_IMAGE").otherwise("RECORDED").alias("outcome"), F.coalesce("origin", F.lit("UNKNOWN")).alias("origin"), "width")


def ladder(payload: Column, embedded: Column, empty: Column, picture: Column) -> Column:
    """How an object is shown: its equation, the equation within its metafile, nothing, its picture, or as it is."""
    return F.when(payload, "OLE_EQUATION").when(embedded, "METAFILE_EQUATION").when(empty, "EMPTY_PLACEHOLDER").when(picture, "RENDERED_FALLBACK").otherwise("PRESERVED_UNRESOLVED")


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'OLE_EQUATION' WHEN p_size % 7 = 0 THEN 'METAFILE_EQUATION' WHEN p_size % 3 = 0 THEN 'EMPTY_PLACEHOLDER' WHEN p_partkey % 2 = 0 THEN 'RENDERED_FALLBACK' ELSE 'PRESERVED_UNRESOLVED' END AS source FROM part")
def object_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    return P.table(spark, sf_dir, "part").select("p_partkey", ladder(k % 5 == 0, n % 7 == 0, n % 3 == 0, k % 2 == 0).alias("source"))


@R.add("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'PAYLOAD_CORRUPTED' WHEN p_size % 4 = 1 THEN 'UNKNOWN_OBJECT' ELSE 'EQUATION' END AS state FROM part")
def payload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the streams that they have: an equation's stream that does not read is corrupt, objects without one unknown."""
    streams = F.when(F.col("p_size") % 4 == 1, F.array(F.lit("Contents"))).otherwise(F.array(F.lit("Equation Native"), F.lit("CompObj")))
    reads = F.col("p_size") % 4 >= 2
    has = F.array_contains(streams, "Equation Native")
    return P.table(spark, sf_dir, "part").select("p_partkey", F.when(has & ~reads, "PAYLOAD_CORRUPTED").when(~has, "UNKNOWN_OBJECT").otherwise("EQUATION").alias("state"))


@R.add("SELECT l_partkey AS part, l_returnflag AS role, 'assets/' || l_partkey || '-' || l_returnflag || '.bin' AS path, count(*) AS uses FROM lineitem GROUP BY l_partkey, l_returnflag")
def asset_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export per part and role, however often it is used."""
    path = F.concat(F.lit("assets/"), F.col("part").cast("string"), F.lit("-"), "role", F.lit(".bin"))
    return P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("role")).agg(F.count("*").alias("uses")).select("part", "role", path.alias("path"), "uses")


@R.add(f"""SELECT region, CASE WHEN x0 / 2.0::DOUBLE = floor(x0 / 2.0::DOUBLE) AND y0 / 2.0::DOUBLE = floor(y0 / 2.0::DOUBLE) AND x1 / 2.0::DOUBLE = floor(x1 / 2.0::DOUBLE) AND y1 / 2.0::DOUBLE = floor(y1 / 2.0::DOUBLE) AND x0 >= 0 AND y0 >= 0 AND x1 <= 80 AND y1 <= 60 THEN 'WHOLE_PIXELS' ELSE 'REVIEW' END AS state FROM ({P.REGIONS})""")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, here halved, that are whole pixels of a page of 40 by 30."""
    whole = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        whole = whole & (F.col(c) / 2.0 == F.floor(F.col(c) / 2.0))
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= 80) & (F.col("y1") <= 60)
    return P.regions(spark, sf_dir).select("region", F.when(whole & inside, "WHOLE_PIXELS").otherwise("REVIEW").alias("state"))


@R.add(f"""WITH r AS (SELECT * FROM ({P.REGIONS}) WHERE label IN ({_T})), c AS (SELECT a.region AS upper, b.region AS lower, a.page, b.y0 AS top, a.y1 AS bottom, greatest(a.x0, b.x0) AS l, least(a.x1, b.x1) AS rr FROM r a JOIN r b ON a.page = b.page AND a.region <> b.region AND a.ord < b.ord AND a.y0 < b.y0 AND b.y0 < a.y1 AND a.y1 < b.y1
        AND 10 * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= 9 * least(a.x1 - a.x0, b.x1 - b.x0))
    SELECT upper, lower, bottom - top AS shared FROM c WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.page = c.page AND o.region <> c.upper AND o.region <> c.lower AND least(o.x1, c.rr) > greatest(o.x0, c.l) AND least(o.y1, c.bottom) > greatest(o.y0, c.top))""")
def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes whose end lies in the next one, on nine tenths of the narrower width, with nothing else in what they share."""
    c = F.col
    r = P.regions(spark, sf_dir).where(c("label").isin(*TEXT_LABELS))
    near = touching(r, r).where((c("a_ord") < c("b_ord")) & (c("a_y0") < c("b_y0")) & (c("b_y0") < c("a_y1")) & (c("a_y1") < c("b_y1")))
    left, right = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    near = near.where(10 * (right - left) >= 9 * F.least(c("a_x1") - c("a_x0"), c("b_x1") - c("b_x0"))).select(c("a_region").alias("upper"), c("b_region").alias("lower"), c("a_page").alias("page"), c("b_y0").alias("top"), c("a_y1").alias("bottom"), left.alias("l"), right.alias("r"))
    o = r.select(*[c(n).alias(f"o_{n}") for n in ("page", "region", "x0", "y0", "x1", "y1")])
    inside = (F.least("o_x1", "r") > F.greatest("o_x0", "l")) & (F.least("o_y1", "bottom") > F.greatest("o_y0", "top"))
    blocked = near.join(o, c("page") == c("o_page")).where((c("o_region") != c("upper")) & (c("o_region") != c("lower")) & inside).select("upper", "lower").distinct()
    return near.join(blocked, ["upper", "lower"], "left_anti").select("upper", "lower", (c("bottom") - c("top")).alias("shared"))


@R.add(f"""WITH l AS ({P.PAGE_LINES}), h AS (SELECT doc, line, regexp_extract(text, '^(#{{1,6}}) ', 1) AS marks, CASE WHEN line % 4 = 1 THEN repeat('#', CAST(line % 6 + 1 AS INTEGER)) END AS made, text FROM l)
    SELECT doc, CAST(line AS INTEGER) AS line, CASE WHEN regexp_matches(text, '^([0-9]+[.、 ]|第.+节)') THEN 2 ELSE least(4, greatest(2, length(coalesce(made, marks)))) END AS level FROM h WHERE coalesce(made, marks) <> ''""")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of headings within a section: numbered ones are 2, others from 2 to 4; here every fourth line is a heading."""
    marks = F.regexp_extract("text", "^(#{1,6}) ", 1)
    made = F.when(F.col("line") % 4 == 1, F.repeat(F.lit("#"), (F.col("line") % 6 + 1).cast("int")))
    h = P.page_lines(spark, sf_dir).withColumn("m", F.coalesce(made, marks)).where("m <> ''")
    level = F.when(F.col("text").rlike("^([0-9]+[.、 ]|第.+节)"), 2).otherwise(F.least(F.lit(4), F.greatest(F.lit(2), F.length("m"))))
    return h.select("doc", "line", level.cast("long").alias("level"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 <> 0 THEN 'SAME' ELSE 'INPUT_CHANGED' END AS identity FROM orders")
def package_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages whose source and three artifacts have the digests that their manifest names."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    parts = ("source", "document", "manifest", "report")
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[sha(F.concat(k, F.lit(p))) for p in parts]).alias("named"), F.array(*[sha(F.concat(k, F.lit(p), F.when((F.col("o_orderstatus") != "F") if p == "source" else (c % 5 == 0) if p == "report" else F.lit(False), "!").otherwise(""))) for p in parts]).alias("found"))
    same = F.forall(F.arrays_zip("named", "found"), lambda x: x["named"] == x["found"])
    return o.select("o_orderkey", F.when(same, "SAME").otherwise("INPUT_CHANGED").alias("identity"))


@R.add(f"""SELECT c.c_custkey, j.job, CASE WHEN j.job IS NULL THEN 'SUBMIT' WHEN j.state IN ('QUEUED', 'RUNNING') THEN 'ADOPT' ELSE 'REUSE' END AS action FROM customer c LEFT JOIN (SELECT scope, workspace, job, state, row_number() OVER (PARTITION BY scope, workspace ORDER BY created DESC, job) AS k FROM ({P.JOBS}) WHERE scope IS NOT NULL) j
    ON j.scope = c.c_custkey % 60 AND j.workspace = c.c_custkey % 10 AND j.k = 1""")
def submission_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest job of a submission's scope and workspace: used again, adopted while it works, or none."""
    j = P.jobs(spark, sf_dir).where("scope is not null").groupBy("scope", "workspace").agg(F.max_by(F.struct("job", "state"), F.struct("created", -F.col("job"))).alias("j"))
    c = P.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("scope"), (F.col("c_custkey") % 10).alias("workspace"))
    action = F.when(F.col("j").isNull(), "SUBMIT").when(F.col("j.state").isin("QUEUED", "RUNNING"), "ADOPT").otherwise("REUSE")
    return c.join(j, ["scope", "workspace"], "left").select("c_custkey", F.col("j.job").alias("job"), action.alias("action"))


@R.add("SELECT page_id, CASE WHEN l < r AND u < d AND r <= 1 AND d <= 1 AND dpi IN (144, 216, 288) THEN CAST(floor(l * 595 * dpi / 72) AS BIGINT) END AS x0, CASE WHEN l < r AND u < d AND r <= 1 AND d <= 1 AND dpi IN (144, 216, 288) THEN CAST(ceil(r * 595 * dpi / 72) AS BIGINT) END AS x1 FROM (SELECT page_id, (page_id % 8) / 16.0::DOUBLE AS l, (page_id % 5) / 8.0::DOUBLE AS u, (page_id % 20) / 16.0::DOUBLE AS r, (page_id % 7 + 1) / 8.0::DOUBLE AS d, 144 + page_id % 4 * 72 AS dpi FROM pages)")
def evidence_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a page in fractions of it, as pixels at one of three resolutions; others are refused."""
    k = F.col("page_id")
    p = P.table(spark, sf_dir, "pages").select("page_id", (k % 8 / 16.0).alias("l"), (k % 5 / 8.0).alias("u"), (k % 20 / 16.0).alias("r"), ((k % 7 + 1) / 8.0).alias("d"), (144 + k % 4 * 72).alias("dpi"))
    ok = F.expr("l < r AND u < d AND r <= 1 AND d <= 1 AND dpi IN (144, 216, 288)")
    return p.select("page_id", F.when(ok, F.floor(F.col("l") * 595 * F.col("dpi") / 72)).alias("x0"), F.when(ok, F.ceil(F.col("r") * 595 * F.col("dpi") / 72)).alias("x1"))


@R.add(f"""SELECT m.job, max(s.ram_used) AS ram_peak, max(s.cpu_pct) AS cpu_peak, min(s.gpu_pct) AS gpu_least, max(s.ram_used) > 500000 AS exceeded FROM ({P.MODELS}) m JOIN ({P.SAMPLES}) s ON s.sample = m.sample GROUP BY m.job""")
def job_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and least observations of a job, and whether it went over its limit."""
    s = P.samples(spark, sf_dir).select("sample", F.col("cpu_pct").alias("cpu"), "ram_used", "gpu_pct")
    return P.models(spark, sf_dir).join(s, "sample").groupBy("job").agg(F.max("ram_used").alias("ram_peak"), F.max("cpu").alias("cpu_peak"), F.min("gpu_pct").alias("gpu_least"), (F.max("ram_used") > 500_000).alias("exceeded"))


@R.add("""WITH m AS (SELECT conv_id AS book, turn // 3 AS module, turn, max(text) AS text FROM conversations GROUP BY ALL), b AS (SELECT book, module, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, min(turn) AS first FROM m GROUP BY ALL)
    SELECT book, printf('%02d', module + 1) || '-module.md' AS path, sha256('# Module ' || (module + 1) || chr(10) || chr(10) || body || chr(10)) AS sha, first + 1 AS first_page FROM b""")
def curriculum_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of three pages each with their files' digests and first pages, as an index lists them."""
    m = P.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book"), "turn").agg(F.max("text").alias("text")).withColumn("module", F.expr("turn div 3"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    b = m.groupBy("book", "module").agg(body.alias("body"), (F.min("turn") + 1).alias("first_page"))
    text = F.concat(F.lit("# Module "), (F.col("module") + 1).cast("string"), F.lit("\n\n"), "body", F.lit("\n"))
    return b.select("book", F.concat(F.format_string("%02d", F.col("module") + 1), F.lit("-module.md")).alias("path"), F.sha2(text.cast("binary"), 256).alias("sha"), "first_page")


@R.add("""SELECT p_brand AS program, sha256(string_agg(p_name || ':' || p_size, ',' ORDER BY p_partkey)) AS fingerprint, max(CASE WHEN p_type = 'ECONOMY' THEN 512 ELSE 8192 END) AS memory_mib, count(*) AS files FROM part GROUP BY p_brand""")
def program_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by the digest of their files in order, and what they need: less where the work is done elsewhere."""
    line = F.concat_ws(":", "p_name", F.col("p_size").cast("string"))
    g = P.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("program")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("v")))).alias("all"), F.max(F.when(F.col("p_type") == "ECONOMY", 512).otherwise(8192)).alias("memory_mib"), F.count("*").alias("files"))
    return g.select("program", F.sha2(F.array_join(F.transform("all", lambda x: x["v"]), ",").cast("binary"), 256).alias("fingerprint"), "memory_mib", "files")


@R.add("""SELECT o_custkey AS package, count(*) AS diagnostics, count(*) FILTER (o_orderpriority LIKE '1%') AS errors, count(*) FILTER (o_orderstatus = 'F') = count(*) AS complete, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_custkey""")
def handoff_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's diagnostics in short."""
    c = F.col
    return P.table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("package")).agg(F.count("*").alias("diagnostics"), F.count_if(c("o_orderpriority").startswith("1")).alias("errors"), F.bool_and(c("o_orderstatus") == "F").alias("complete"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@R.add(r"""SELECT page_id, '{"path":"' || regexp_replace(url, '^https?://[^/]+/', '') || '","items":[{"source_path":"' || page_id || '.md"}]}' AS relative FROM pages""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root made relative wherever a JSON object names them."""
    root = F.regexp_extract("url", "^(https?://[^/]+/)", 1)
    text = F.concat(F.lit('{"path":"'), "url", F.lit('","items":[{"source_path":"'), root, F.col("page_id").cast("string"), F.lit('.md"}]}'))
    p = P.table(spark, sf_dir, "pages").select("page_id", root.alias("root"), text.alias("text"))
    return p.select("page_id", F.replace("text", F.col("root"), F.lit("")).alias("relative"))
