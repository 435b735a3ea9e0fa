"""Markdown parts: cleaning, escapes, blocks and inlines, links, page joins, spans, headings and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import canonical_sha, cleaned, document_ids
from ..registry import Registry
from ..sources import projections as P

R = Registry()
_LINES = f"l AS ({P.PAGE_LINES})"


@R.add()
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the scans: math removed, marks removed, whole formulas peeled, prose told from formulas."""
    d = P.table(spark, sf_dir, "documents").select("doc_id", cleaned(F.col("text")).alias("c"))
    return d.select("doc_id", F.sha2(F.col("c.without").cast("binary"), 256).alias("without_sha"), "c.removed", F.sha2(F.col("c.bare").cast("binary"), 256).alias("bare_sha"), "c.wrappers", "c.markdown")


# Characters that prose never keeps.
NOISE = "\x18﻿"


@R.add("""SELECT doc_id, len(string_split(t, '')) AS n, sha256(translate(t, chr(24) || chr(65279), '')) AS normalized_sha, list_filter(range(0, length(t)), lambda i: substr(t, i + 1, 1) IN (chr(24), chr(65279)))::VARCHAR AS removed
    FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN left(text, 20) || chr(24) || substr(text, 21, 30) || chr(65279) ELSE left(text, 60) END AS t FROM documents)""")
def prose_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose without control noise, and where, in code points, it stood; here every ninth document has some."""
    noisy = F.concat(F.left("text", F.lit(20)), F.lit("\x18"), F.substring("text", 21, 30), F.lit("﻿"))
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, noisy).otherwise(F.left("text", F.lit(60))).alias("t"))
    chars = F.split("t", "")
    at = F.filter(F.transform(chars, lambda c, i: F.when(c.isin(*NOISE), i)), lambda i: i.isNotNull())
    removed = F.concat(F.lit("["), F.array_join(at, ", "), F.lit("]"))
    return d.select("doc_id", F.size(chars).cast("long").alias("n"), F.sha2(F.translate("t", NOISE, "").cast("binary"), 256).alias("normalized_sha"), removed.alias("removed"))


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*\[\]])", r"\\$1")


def escaped_url(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("%29"))


def inline(kind: Column, text: Column, target: Column, bold: Column, italic: Column, align: Column) -> Column:
    """Markdown of a text, break, link, image or formula; raised and lowered text is HTML."""
    html = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    plain = F.when(align == "superscript", F.concat(F.lit("<sup>"), html, F.lit("</sup>"))).when(align == "subscript", F.concat(F.lit("<sub>"), html, F.lit("</sub>"))).otherwise(escaped_text(text))
    strong = F.when(bold & (plain != ""), F.concat(F.lit("**"), plain, F.lit("**"))).otherwise(plain)
    slanted = F.when(italic & (strong != ""), F.concat(F.lit("*"), strong, F.lit("*"))).otherwise(strong)
    return (
        F.when(kind == "text", slanted)
        .when(kind == "break", F.lit("  \n"))
        .when(kind == "link", F.concat(F.lit("["), escaped_text(text), F.lit("]("), escaped_url(target), F.lit(")")))
        .when(kind == "image", F.concat(F.lit("!["), F.replace(text, F.lit("]"), F.lit("\\]")), F.lit("]("), escaped_url(target), F.lit(")")))
        .when(kind == "formula", F.concat(F.lit("$"), text, F.lit("$")))
    )


def serialized(blocks: DataFrame) -> DataFrame:
    """(doc, markdown) of (doc, block, kind, level, ordinal, content): headings, list items and paragraphs with blank lines between."""
    c = F.col
    mark = F.when(c("ordinal").isNotNull(), F.concat(c("ordinal").cast("string"), F.lit("."))).otherwise(F.lit("-"))
    line = F.when(c("kind") == "heading", F.concat(F.repeat(F.lit("#"), c("level")), F.lit(" "), "content")).when(c("kind") == "item", F.concat(F.repeat(F.lit("  "), c("level")), mark, F.lit(" "), "content")).otherwise(c("content"))
    parts = blocks.select("doc", "block", line.alias("line")).where("line <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "\n\n")
    return parts.groupBy("doc").agg(F.concat(F.rtrim(joined), F.lit("\n")).alias("markdown"))


_KINDS = "['text', 'link', 'image', 'formula', 'break'][doc_id % 5 + 1]"


@R.add(rf"""WITH s AS (SELECT doc_id, left(text, 40) AS t, {_KINDS} AS kind FROM documents), e AS (SELECT *, regexp_replace(t, '([\\`*\[\]])', '\\\1', 'g') AS esc,
        replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, replace(replace(t, ' ', '%20'), ')', '%29') AS url FROM s),
    p AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '<sup>' || html || '</sup>' WHEN doc_id % 7 = 1 THEN '<sub>' || html || '</sub>' ELSE esc END AS a FROM e),
    b AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND a <> '' THEN '**' || a || '**' ELSE a END AS bold FROM p)
    SELECT doc_id, CASE kind WHEN 'text' THEN CASE WHEN doc_id % 3 = 0 AND bold <> '' THEN '*' || bold || '*' ELSE bold END WHEN 'break' THEN '  ' || chr(10) WHEN 'link' THEN '[' || esc || '](' || url || ')'
        WHEN 'image' THEN '![' || replace(t, ']', '\]') || '](' || url || ')' ELSE '$' || t || '$' END AS md FROM b""")
def inline_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "link", "image", "formula", "break")]), (k % 5 + 1).cast("int"))
    align = F.when(k % 7 == 0, "superscript").when(k % 7 == 1, "subscript").otherwise("")
    t = F.left("text", F.lit(40))
    return P.table(spark, sf_dir, "documents").select("doc_id", inline(kind, t, t, k % 2 == 0, k % 3 == 0, align).alias("md"))


@R.add(f"""WITH {_LINES}, b AS (SELECT doc, line, CASE WHEN text = '' THEN '' WHEN line % 4 = 1 THEN repeat('#', CAST(line % 3 + 1 AS INTEGER)) || ' ' || text WHEN line % 4 = 2 THEN repeat('  ', CAST(line % 3 AS INTEGER)) || CASE WHEN line % 8 = 2 THEN line || '.' ELSE '-' END || ' ' || text ELSE text END AS v FROM l)
    SELECT doc, sha256(rtrim(string_agg(v, chr(10) || chr(10) ORDER BY line), ' ') || chr(10)) AS digest FROM b WHERE v <> '' GROUP BY doc""")
def block_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as headings, items and paragraphs, put together; the digest covers the content."""
    l, n = P.page_lines(spark, sf_dir), F.col("line")
    kind = F.when(F.col("text") == "", "none").when(n % 4 == 1, "heading").when(n % 4 == 2, "item").otherwise("paragraph")
    level = F.when(kind == "heading", n % 3 + 1).otherwise(n % 3).cast("int")
    b = l.select("doc", n.alias("block"), kind.alias("kind"), level.alias("level"), F.when(n % 8 == 2, n).alias("ordinal"), F.col("text").alias("content"))
    return serialized(b).select("doc", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """(table, markdown) of (table, row, col, content): a pipe table, short rows filled up, the first row its head."""
    width = cells.groupBy("table").agg(F.max("col").alias("width"))
    by = F.map_from_entries(F.collect_list(F.struct("col", F.replace("content", F.lit("|"), F.lit("\\|")))))
    rows = cells.groupBy("table", "row").agg(by.alias("at")).join(width, "table")
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), "width"), lambda i: F.coalesce(F.element_at("at", i), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    g = rows.select("table", "row", "width", line.alias("line")).groupBy("table", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
    body = F.slice("lines", 2, F.size("lines"))
    return g.select("table", F.concat(F.element_at("lines", 1), rule, F.when(F.size(body) > 0, F.concat(F.lit("\n"), F.array_join(body, "\n"))).otherwise("")).alias("markdown"))


@R.add(f"""WITH r AS ({P.REGIONS}), c AS (SELECT page AS t, CAST((ord - 1) // 3 AS INTEGER) AS row, CAST((ord - 1) % 3 + 1 AS INTEGER) AS col, label || '|' || x0 AS v FROM r), w AS (SELECT t, max(col) AS w FROM c GROUP BY t),
    g AS (SELECT w.t, w.w, k.row, unnest(range(1, w.w + 1)) AS col FROM w JOIN (SELECT DISTINCT t, row FROM c) k ON k.t = w.t),
    l AS (SELECT g.t, g.w, g.row, '| ' || string_agg(coalesce(replace(v, '|', '\\|'), ''), ' | ' ORDER BY g.col) || ' |' AS line FROM g LEFT JOIN c ON c.t = g.t AND c.row = g.row AND c.col = g.col GROUP BY ALL)
    SELECT t AS page, sha256(max(CASE WHEN row = 0 THEN line END) || chr(10) || '| ' || array_to_string(list_transform(range(0, max(w)), lambda x: '---'), ' | ') || ' |' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY row) FILTER (row > 0), '')) AS digest FROM l GROUP BY t""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.regions(spark, sf_dir)
    c = r.select(F.col("page").alias("table"), F.expr("cast((ord - 1) div 3 as int)").alias("row"), ((F.col("ord") - 1) % 3 + 1).cast("int").alias("col"), F.concat_ws("|", "label", "x0").alias("content"))
    return table_markdown(c).select(F.col("table").alias("page"), F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))


# Commands that make an alternative text LaTeX, and signs of a plain equation.
COMMANDS = "dfrac frac tfrac sqrt sum prod int oint begin left right alpha beta gamma delta epsilon lambda mu nu pi rho sigma theta phi omega vec overline underline mathrm text".split()
RELATIONS = "=≈≠≤≥<>"


def latex_alt(value: Column) -> Column:
    """certain_latex, likely_latex or not_latex: by marks around it, commands, scripts, or the look of an equation."""
    t = F.trim(value)
    marked = F.lit(False)
    for a, b in (("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")):
        marked = marked | (t.startswith(a) & t.endswith(b) & (F.length(t) > len(a) + len(b)))
    command = F.exists(F.regexp_extract_all(t, F.lit(r"\\([A-Za-z]+)"), F.lit(1)), lambda x: x.isin(*COMMANDS))
    script = t.rlike(r"[A-Za-z0-9}\]][\^_][{A-Za-z0-9]") & ~t.rlike(r"[一-鿿]{2}")
    equation = (F.length(t) <= 256) & t.rlike(f"[{RELATIONS}]") & ~t.rlike(r"[一-鿿]") & ~t.rlike("[A-Za-z]{4}") & (F.length(F.regexp_replace(t, "[^A-Za-z0-9Α-Ωα-ω]", "")) >= 2)
    return F.when(F.coalesce(t, F.lit("")) == "", "not_latex").when(marked | command, "certain_latex").when(script | equation, "likely_latex").otherwise("not_latex")


@R.add(rf"""WITH s AS (SELECT doc_id, trim(CASE doc_id % 6 WHEN 0 THEN '$' || left(text, 5) || '$' WHEN 1 THEN '\frac' || left(text, 4) WHEN 2 THEN 'x_' || (doc_id % 9) WHEN 3 THEN 'a = ' || (doc_id % 100) ELSE left(text, 30) END) AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'not_latex' WHEN starts_with(t, '$') AND ends_with(t, '$') AND length(t) > 2 OR len(list_filter(regexp_extract_all(t, '\\([A-Za-z]+)', 1), lambda x: x IN {tuple(COMMANDS)})) > 0 THEN 'certain_latex'
        WHEN regexp_matches(t, '[A-Za-z0-9}}\]][\^_][{{A-Za-z0-9]') OR length(t) <= 256 AND regexp_matches(t, '[{RELATIONS}]') AND NOT regexp_matches(t, '[A-Za-z]{{4}}') AND length(regexp_replace(t, '[^A-Za-z0-9Α-Ωα-ω]', '', 'g')) >= 2 THEN 'likely_latex' ELSE 'not_latex' END AS kind FROM s""")
def latex_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    alt = F.when(k % 6 == 0, F.concat(F.lit("$"), F.left(t, F.lit(5)), F.lit("$"))).when(k % 6 == 1, F.concat(F.lit("\\frac"), F.left(t, F.lit(4)))).when(k % 6 == 2, F.concat(F.lit("x_"), (k % 9).cast("string"))).when(k % 6 == 3, F.concat(F.lit("a = "), (k % 100).cast("string"))).otherwise(F.left(t, F.lit(30)))
    return P.table(spark, sf_dir, "documents").select("doc_id", latex_alt(alt).alias("kind"))


def joined_pages(pages: DataFrame, joins: DataFrame) -> DataFrame:
    """(book, page, text, problem): reviewed tails of pages joined to the heads of the next ones.

    ``joins`` has book, page, tail, head, separator. Tail and head must stand once on their pages, and a tail must
    begin its page or a paragraph. The tail moves to the next page, whose margins and the page's own give way.
    """
    def once(text: str, part: str) -> Column:
        return (F.length(text) - F.length(F.replace(F.col(text), F.col(part), F.lit("")))) == F.length(part)

    nxt = pages.select("book", (F.col("page") - 1).alias("page"), F.col("text").alias("next_text"))
    j = joins.join(pages, ["book", "page"]).join(nxt, ["book", "page"])
    left, right = F.rtrim("text"), F.ltrim("next_text")
    j = j.withColumns({"text": left, "next_text": right})
    before = F.expr("substring(text, 1, locate(tail, text) - 1)")
    after = F.expr("substring(next_text, locate(head, next_text) + length(head))")
    ok = once("text", "tail") & once("next_text", "head") & ((F.trim(before) == "") | before.endswith("\n\n"))
    j = j.select("book", "page", "tail", "head", "separator", before.alias("before"), after.alias("after"), F.when(~ok, "AMBIGUOUS_PAGE_JOIN").alias("problem"))
    good = j.where("problem is null")
    shortened = good.select("book", "page", F.rtrim("before").alias("new"))
    marker = F.concat(F.lit("<!-- joined-pages:"), F.col("page").cast("string"), F.lit("-"), (F.col("page") + 1).cast("string"), F.lit(" -->\n\n"))
    lengthened = good.select("book", (F.col("page") + 1).alias("page"), F.concat(marker, "tail", "separator", "head", "after").alias("longer"))
    bad = j.where("problem is not null").select("book", "page", "problem")
    out = pages.join(shortened, ["book", "page"], "left").join(lengthened, ["book", "page"], "left").join(bad, ["book", "page"], "left")
    return out.select("book", "page", F.coalesce("longer", "new", "text").alias("text"), "problem")


@R.add("""WITH p AS (SELECT conv_id AS book, CAST(turn AS INTEGER) AS page, max(text) AS text FROM conversations GROUP BY ALL),
    k AS (SELECT *, lead(text) OVER (PARTITION BY book ORDER BY page) AS nt, lead(page) OVER (PARTITION BY book ORDER BY page) AS np FROM p),
    j AS (SELECT book, page, rtrim(text) AS t, ltrim(nt) AS n, right(rtrim(text), 5) AS tail, left(ltrim(nt), 6) AS head FROM k WHERE book % 3 = 0 AND page % 2 = 0 AND np = page + 1),
    o AS (SELECT *, length(t) - length(replace(t, tail, '')) = length(tail) AND length(n) - length(replace(n, head, '')) = length(head) AND (trim(left(t, strpos(t, tail) - 1)) = '' OR ends_with(left(t, strpos(t, tail) - 1), chr(10) || chr(10))) AS ok FROM j)
    SELECT p.book, p.page, CASE WHEN NOT o.ok THEN 'AMBIGUOUS_PAGE_JOIN' END AS problem, sha256(CASE WHEN b.ok THEN '<!-- joined-pages:' || b.page || '-' || (b.page + 1) || ' -->' || chr(10) || chr(10) || b.tail || ' ' || b.head || substr(b.n, strpos(b.n, b.head) + length(b.head))
        WHEN o.ok THEN rtrim(left(o.t, strpos(o.t, o.tail) - 1)) ELSE p.text END) AS digest FROM p LEFT JOIN o ON o.book = p.book AND o.page = p.page LEFT JOIN o b ON b.book = p.book AND b.page = p.page - 1""")
def page_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages; every third conversation has joins after its even ones."""
    p = P.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("page")).agg(F.max("text").alias("text"))
    nxt = p.select("book", (F.col("page") - 1).alias("page"), F.col("text").alias("n"))
    joins = p.join(nxt, ["book", "page"]).where("book % 3 = 0 AND page % 2 = 0").select("book", "page", F.right(F.rtrim("text"), F.lit(5)).alias("tail"), F.left(F.ltrim("n"), F.lit(6)).alias("head"), F.lit(" ").alias("separator"))
    return joined_pages(p, joins).select("book", "page", "problem", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@R.add("""SELECT doc_id, n = 1 AS applied, sha256(CASE WHEN n = 1 THEN replace(text, old, 'NEW') ELSE text END) AS digest FROM (SELECT *, (length(text) - length(replace(text, old, ''))) // length(old) AS n
    FROM (SELECT doc_id, text, substr(text, 3, 6) AS old FROM documents WHERE length(text) >= 8))""")
def unique_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose target stands once are made; others leave the text as it is."""
    d = P.table(spark, sf_dir, "documents").where(F.length("text") >= 8).select("doc_id", "text", F.substring("text", 3, 6).alias("old"))
    n = F.expr("(length(text) - length(replace(text, old, ''))) div length(old)")
    return d.select("doc_id", (n == 1).alias("applied"), F.sha2(F.when(n == 1, F.replace("text", F.col("old"), F.lit("NEW"))).otherwise(F.col("text")).cast("binary"), 256).alias("digest"))


@R.add(r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages), a AS (SELECT DISTINCT ref, 'DIAGRAMS/' || left(sha256(ref), 12) AS target FROM m WHERE starts_with(ref, '/'))
    SELECT page_id, count(*) AS links, count(target) AS rewritten, count(DISTINCT target) AS targets FROM m LEFT JOIN a USING (ref) GROUP BY page_id""")
def link_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links of a page and the content addresses that they get."""
    m = P.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ref"))
    local = m.where(F.col("ref").startswith("/")).select("ref").distinct().withColumn("target", F.concat(F.lit("DIAGRAMS/"), F.left(F.sha2(F.col("ref").cast("binary"), 256), F.lit(12))))
    return m.join(local, "ref", "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count("target").alias("rewritten"), F.count_distinct("target").alias("targets"))


@R.add(f"""WITH {_LINES}, s AS (SELECT doc, line, text, octet_length(encode(text)) AS n, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc ORDER BY line) - octet_length(encode(text)) - 1 AS a FROM l),
    v AS (SELECT *, a + n + CASE WHEN line % 11 = 0 THEN 2 ELSE 0 END AS b FROM s), w AS (SELECT *, lag(b) OVER (PARTITION BY doc ORDER BY line) AS before FROM v)
    SELECT doc, CAST(line AS INTEGER) AS line, CASE WHEN coalesce(before, 0) > a OR a >= b THEN 'Invalid compact Markdown byte range' END AS problem FROM w""")
def span_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges that are empty or overlap the one before; here every eleventh claims two bytes too many."""
    n = F.octet_length("text")
    w = W.partitionBy("doc").orderBy("line")
    s = P.page_lines(spark, sf_dir).withColumn("a", F.sum(n + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - n - 1)
    s = s.withColumn("b", F.col("a") + n + F.when(F.col("line") % 11 == 0, 2).otherwise(0)).withColumn("before", F.lag("b").over(w))
    return s.select("doc", "line", F.when((F.coalesce("before", F.lit(0)) > F.col("a")) | (F.col("a") >= F.col("b")), "Invalid compact Markdown byte range").alias("problem"))


@R.add(f"""WITH r AS ({P.REGIONS}), k AS (SELECT *, CASE WHEN label IN ('text', 'figure_title', 'formula') THEN list_distinct([sha, x0 % 4 + 10]) ELSE [] END AS ids FROM r),
    n AS (SELECT *, lag(ids) OVER w AS pids, lead(ids) OVER w AS nids FROM k WINDOW w AS (PARTITION BY page ORDER BY ord))
    SELECT region, coalesce(list_has_any(ids, pids), FALSE) AS joins_previous, label = 'formula' AND (coalesce(list_has_any(ids, pids), FALSE) OR coalesce(list_has_any(ids, nids), FALSE)) AS is_inline FROM n""")
def inline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring blocks that share a source line: all ids that a block has are taken together first."""
    w = W.partitionBy("page").orderBy("ord")
    ids = F.when(F.col("label").isin("text", "figure_title", "formula"), F.array_union(F.array("sha"), F.array(F.col("x0") % 4 + 10))).otherwise(F.array().cast("array<bigint>"))
    k = P.regions(spark, sf_dir).withColumn("ids", ids)
    k = k.withColumns({"p": F.lag("ids").over(w), "n": F.lead("ids").over(w)})
    meets = lambda c: F.coalesce(F.arrays_overlap("ids", c), F.lit(False))
    return k.select("region", meets("p").alias("joins_previous"), ((F.col("label") == "formula") & (meets("p") | meets("n"))).alias("is_inline"))


@R.add("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'heading ' || (p_size % 7) WHEN 1 THEN '标题 ' || (p_size % 9 + 1) WHEN 2 THEN 'Title' WHEN 3 THEN p_name ELSE 'Heading' || (p_size % 4 + 1) END AS style, ['1', 'true', 'on', '0', 'false', 'off', ''][p_partkey % 7 + 1] AS flag FROM part)
    SELECT p_partkey, TRY_CAST(nullif(regexp_extract(lower(style), '^(heading|标题) *([1-6])$', 2), '') AS INTEGER) AS level, lower(flag) NOT IN ('0', 'false', 'off', 'none') AS bold FROM p""")
def style_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels by style name, and switches that are on unless they say no."""
    k, n = F.col("p_partkey"), F.col("p_size")
    style = F.when(k % 6 == 0, F.concat(F.lit("heading "), (n % 7).cast("string"))).when(k % 6 == 1, F.concat(F.lit("标题 "), (n % 9 + 1).cast("string"))).when(k % 6 == 2, "Title").when(k % 6 == 3, F.col("p_name")).otherwise(F.concat(F.lit("Heading"), (n % 4 + 1).cast("string")))
    flag = F.element_at(F.array(*[F.lit(x) for x in ("1", "true", "on", "0", "false", "off", "")]), (k % 7 + 1).cast("int"))
    level = F.regexp_extract(F.lower(style), "^(heading|标题) *([1-6])$", 2)
    return P.table(spark, sf_dir, "part").select("p_partkey", F.when(level != "", level.cast("int")).alias("level"), (~F.lower(flag).isin("0", "false", "off", "none")).alias("bold"))


@R.add(f"""WITH {_LINES}, h AS (SELECT doc, line, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM l WHERE line <= 3 AND NOT regexp_matches(text, '^\\s*$')), f AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY line) AS n FROM h),
    b AS (SELECT doc, lower(regexp_replace(string_agg(text, ' ' ORDER BY line), '\\s+', '', 'g')) AS body FROM l WHERE line > 3 GROUP BY doc)
    SELECT f.doc, CAST(f.line AS INTEGER) AS line, NOT coalesce(starts_with(body, replace(key, ' ', '')), FALSE) AS kept FROM f LEFT JOIN b ON b.doc = f.doc WHERE n = 1""")
def header_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in a document's first three lines, each once whatever its blanks and case, and not kept if the body begins with it."""
    l = P.page_lines(spark, sf_dir)
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    h = l.where((F.col("line") <= 3) & ~F.col("text").rlike(r"^\s*$")).select("doc", "line", key.alias("key"))
    h = h.withColumn("n", F.row_number().over(W.partitionBy("doc", "key").orderBy("line"))).where("n = 1")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    b = l.where("line > 3").groupBy("doc").agg(F.lower(F.regexp_replace(joined, r"\s+", "")).alias("body"))
    return h.join(b, "doc", "left").select("doc", "line", (~F.coalesce(F.col("body").startswith(F.replace("key", F.lit(" "), F.lit(""))), F.lit(False))).alias("kept"))


@R.add(f"""WITH {_LINES}, x AS (SELECT doc, line, regexp_extract_all(text, '([A-Za-z]{{4,}})[.!?]? ?([0-9]+)', 1) AS k, regexp_extract_all(text, '([A-Za-z]{{4,}})[.!?]? ?([0-9]+)', 2) AS v FROM l), r AS (SELECT doc, line, unnest(k) AS prefix, unnest(v) AS value FROM x),
    n AS (SELECT doc, prefix, count(*) AS n, max(CASE WHEN CAST(line AS BIGINT) % 2 = 0 THEN value || '0' ELSE value END) AS native FROM r GROUP BY doc, prefix)
    SELECT r.doc, CAST(r.line AS INTEGER) AS line, r.prefix, r.value AS reading, n.native FROM r JOIN n ON n.doc = r.doc AND n.prefix = r.prefix WHERE n.n = 1 AND n.native <> r.value""")
def numeric_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers after a word that differ from the one such number in the page's native text; even lines' native numbers have a digit more."""
    pattern = F.lit("([A-Za-z]{4,})[.!?]? ?([0-9]+)")
    x = P.page_lines(spark, sf_dir).select("doc", "line", F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("prefix"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("value")).alias("z"))
    r = x.select("doc", "line", F.inline("z"))
    native = r.select("doc", "prefix", F.when(F.col("line") % 2 == 0, F.concat("value", F.lit("0"))).otherwise(F.col("value")).alias("native"))
    one = native.groupBy("doc", "prefix").agg(F.count("*").alias("n"), F.max("native").alias("native")).where("n = 1")
    return r.join(one, ["doc", "prefix"]).where("native <> value").select("doc", "line", "prefix", F.col("value").alias("reading"), "native")


# The prompts of the recognition profiles, by stand-ins of the same shape.
PROFILES = {"formula": "Transcribe the formula as LaTeX.", "table": "Transcribe the table as HTML.", "text": "Transcribe the text as Markdown."}


@R.add(f"""SELECT region, profile, sha256('prompt-v1' || chr(0) || profile || chr(0) || CASE profile {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROFILES.items())} END) AS fingerprint
    FROM (SELECT region, CASE WHEN label IN ('formula', 'display_formula') THEN 'formula' WHEN label = 'table' THEN 'table' ELSE 'text' END AS profile FROM ({P.REGIONS}))""")
def prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = F.when(F.col("label").isin("formula", "display_formula"), "formula").when(F.col("label") == "table", "table").otherwise("text")
    prompts = F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv])
    r = P.regions(spark, sf_dir).select("region", profile.alias("profile"))
    return r.select("region", "profile", F.sha2(F.concat_ws("\0", F.lit("prompt-v1"), "profile", prompts[F.col("profile")]).cast("binary"), 256).alias("fingerprint"))


@R.add(r"SELECT page_id, regexp_replace(lower(url), '[^A-Za-z0-9_.-]+', '_', 'g') AS label FROM pages")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.lower("url"), "[^A-Za-z0-9_.-]+", "_").alias("label"))


@R.add(r"""SELECT page_id, left(CASE WHEN s = '' THEN 'document' ELSE s END, 80) || '__' || left(sha256(html), 12) AS id FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(nfc_normalize(url), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', '_', 'g'), ' ._') AS s FROM pages) WHERE length(s) < 78""")
def package_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of packages: a safe name and the content's digest; names short enough to be kept whole."""
    d = P.table(spark, sf_dir, "pages").select("page_id", document_ids(F.col("url"), F.sha2(F.col("html").cast("binary"), 256)).alias("id"))
    return d.where(F.length("id") < 78 + 14)


@R.add("""SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS digest FROM events""")
def state_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of JSON texts in canonical form."""
    return P.table(spark, sf_dir, "events").select("event_id", canonical_sha(F.col("props")).alias("digest"))


@R.add(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<table')) AS tables, len(regexp_extract_all(html, '<h[1-6]>')) AS headings FROM pages""")
def part_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs, items, tables and headings a part has beside its body."""
    n = lambda p, a: F.regexp_count("html", F.lit(p)).cast("long").alias(a)
    return P.table(spark, sf_dir, "pages").select("page_id", n("<p>", "paragraphs"), n("<li>", "items"), n("<table", "tables"), n("<h[1-6]>", "headings"))


@R.add("SELECT doc_id, base64(encode(text)) AS body, sha256(text) AS sha, TRUE AS verified FROM documents WHERE text IS NOT NULL")
def content_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as base64 with their digest, checked after decoding."""
    d = P.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.base64(F.col("text").cast("binary")).alias("body"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    d = d.withColumn("body", F.regexp_replace("body", r"\r?\n", ""))
    return d.select("doc_id", "body", "sha", (F.sha2(F.unbase64("body"), 256) == F.col("sha")).alias("verified"))
