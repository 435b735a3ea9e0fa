"""Secret scans with an incremental blob ledger.

Texts are content-addressed by SHA-256. The ledger has a row per blob: the
rule-version pairs that have scanned it and their findings. A scan runs only the
pairs that a blob has not seen, once per blob however many documents hold it,
and joins the findings back to every document.

A cheap gate, the alternation of what every rule needs, reads each row, so that only
texts which may hold a finding are shuffled to be deduplicated; addresses alone meet
the ledger. Spark has no function for the places of all matches, so a text is split
at the matches: a running sum over the lengths of pieces and matches gives the places.

Defined results: null text is an empty one. Offsets are code points, ends are
exclusive. Findings that start together come in the rules' order. Rows equal in id
and text are separate rows of the result. Rows of the ledger given that have one
address count as one. Texts of any length are scanned whole. Other columns are never
read, whatever their names. No documents give no rows and leave the ledger as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, col, stored


@dataclass(frozen=True)
class Rule:
    """kind: name in findings. pattern: leftmost, non-overlapping. group, least: this group has so many characters."""

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns of well-known credential formats. The first three are the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}", r"k_(?:live|test)_"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("url_login", r"://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{1,64}@", r"://[^\x00-\x20:/@]{1,64}:"),
)
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "sha string, scanned array<string>, findings array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (kind, ord, at, before, length, ok): the matches with the number of characters before each."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    picked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.slice(F.split(text, rule.pattern, -1), 1, F.greatest(F.size(found), F.lit(0)))
    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("found"), picked.alias("picked"))
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(order).alias("ord"),
            i.alias("at"),
            F.length(x["piece"]).cast("long").alias("before"),
            F.length(x["found"]).cast("long").alias("length"),
            (F.length(x["picked"]) >= rule.least).alias("ok"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, findings) of (sha, text, todo); findings sorted by start, then kind in the rules' order; only blobs with any."""
    empty = F.array().cast("array<struct<kind:string,ord:int,at:int,before:bigint,length:bigint,ok:boolean>>")
    each = [
        F.when(F.array_contains("todo", r.key), _matches(F.col("text"), r, i)).otherwise(empty)
        for i, r in enumerate(rules)
    ]
    m = blobs.select("sha", F.explode(F.concat(*each)).alias("m")).select("sha", "m.*")
    upto = W.partitionBy("sha", "ord").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(upto)
    placed = m.select("sha", "kind", "ord", "ok", "length", end.alias("end")).where("ok")
    finding = F.struct((F.col("end") - F.col("length")).alias("start"), "ord", "end", "kind")
    return placed.groupBy("sha").agg(F.sort_array(F.collect_list(finding)).alias("findings"))


def scan(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """(findings by document, the ledger after the scan).

    The first has a row per row of ``docs``: id, sha, findings (those of the current rule versions). The second has
    LEDGER's columns for every blob of ``docs`` and of the ledger given; write it to use it in the next scan.
    """
    spark = docs.sparkSession
    no_keys, none = F.array().cast("array<string>"), F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    current, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    rows = docs.select(col(id_col).alias("doc"), address(col(text_col)).alias("sha"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    gated = rows.where(F.col("text").rlike("|".join(r.gate for r in rules))).select("sha", "text").dropDuplicates(["sha"])
    held = rows.select("sha").distinct().withColumn("here", F.lit(True))
    old = spark.range(0).select(F.lit("").alias("sha"), no_keys.alias("scanned"), none.alias("findings")) if ledger is None else ledger
    merge = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    old = old.groupBy("sha").agg(merge("scanned").alias("o_scanned"), merge("findings").alias("o_findings"))
    both = held.join(old, "sha", "full_outer").select("sha", F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("o_scanned", no_keys).alias("o_scanned"), F.coalesce("o_findings", none).alias("o_findings"))
    both = both.withColumn("todo", F.when(F.col("here"), F.array_except(current, "o_scanned")).otherwise(no_keys))
    if ledger is None:
        unseen = gated.withColumn("todo", current)
    else:
        both = stored(both, "ledger-pairs")
        unseen = gated.join(both.where(F.size("todo") > 0).select("sha", "todo"), "sha")
    fresh = checkpoint(scan_blobs(unseen, rules)).withColumnRenamed("findings", "new")
    # A finding of an earlier version of a rule gives way once the current version has scanned the blob.
    again = F.transform("todo", lambda g: F.split_part(g, F.lit("@"), F.lit(1)))
    lasting = F.filter("o_findings", lambda x: ~F.array_contains(again, x["kind"]))
    known = both.join(fresh, "sha", "left").select(
        "sha", F.array_union("o_scanned", "todo").alias("scanned"), F.sort_array(F.concat(lasting, F.coalesce("new", none))).alias("findings")
    )
    if ledger is None:
        found = fresh.select(F.col("sha").alias("f_sha"), F.col("new").alias("findings"))
    else:
        found = known.where(F.size("findings") > 0).select(F.col("sha").alias("f_sha"), F.filter("findings", lambda x: F.array_contains(kinds, x["kind"])).alias("findings"))
    by_doc = rows.select("doc", "sha").join(found, F.col("sha") == F.col("f_sha"), "left")
    return by_doc.select(F.col("doc").alias(id_col), "sha", F.coalesce("findings", none).alias("findings")), known
