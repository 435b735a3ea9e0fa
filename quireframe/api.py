"""What a user calls: conversion of packages to Markdown, checks of what was written, queries by name, cleanup.

Sources are read and written through Spark, so any store that it reaches will do; a
failing source is a row with its problems and stops nothing, unless it is asked to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.markup import document_ids
from .operators.markup import serialized
from .sinks.publish import Published, cleanup_staging, inventory, publish
from .sources import packages

__all__ = ["ConversionError", "cleanup_staging", "convert_documents", "converted", "package_markdown", "queries", "run_query", "validate_package"]


class ConversionError(RuntimeError):
    pass


def package_markdown(read: DataFrame) -> DataFrame:
    """(path, markdown) of packages read by ``sources.packages``: headings by style, items by list, tables as pipe tables."""
    b = packages.rows(read, "blocks", "path")
    level = F.regexp_extract(F.lower(F.coalesce("style", F.lit(""))), "^(?:heading|标题) ?([1-6])$", 1)
    text = F.coalesce("text", F.lit(""))
    p = b.where("kind <> 'cell'").select("path", "block", F.when(level != "", "heading").when(F.col("num_id").isNotNull(), "item").otherwise("paragraph").alias("kind"), F.when(level != "", level.cast("int")).otherwise(F.coalesce("level", F.lit(0))).alias("level"), text.alias("content"))
    cells = b.where("kind = 'cell'").groupBy("path", "block", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.replace(text, F.lit("|"), F.lit("\\|")).alias("t")))), lambda x: x["t"]), " | ").alias("line"), F.max("col").alias("last"))
    wide = cells.groupBy("path", "block").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    bar = lambda x: F.concat(F.lit("| "), x, F.lit(" |"))
    head = F.concat(bar(F.element_at("lines", 1)["line"]), F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), (F.col("last") + 1).cast("int")), " | "), F.lit(" |"))
    rest = F.transform(F.slice("lines", 2, F.size("lines")), lambda x: bar(x["line"]))
    t = wide.select("path", "block", F.lit("table").alias("kind"), F.lit(0).alias("level"), F.array_join(F.concat(F.array(head), rest), "\n").alias("content"))
    both = p.select("path", "block", "kind", F.col("level").cast("int"), "content").unionByName(t)
    return serialized(both.select(F.col("path").alias("doc"), "block", "kind", "level", F.lit(None).cast("int").alias("ordinal"), "content")).withColumnRenamed("doc", "path")


def converted(spark: SparkSession, source: str, pattern: str = "*.docx") -> DataFrame:
    """(path, document_id, status, problems, markdown) of every file below ``source``; a file that cannot be read says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
    read = files.select("path", F.sha2("content", 256).alias("sha"), packages.package("content").alias("package"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    state = F.when(F.size("package.problems") > 0, "FAILED").otherwise("SUCCEEDED")
    listed = read.select("path", document_ids(stem, F.col("sha")).alias("document_id"), state.alias("status"), F.col("package.problems").alias("problems"))
    return listed.join(package_markdown(read.where(F.size("package.problems") == 0)), "path", "left")


@dataclass(frozen=True)
class Converted:
    published: Published
    succeeded: int
    failed: int
    not_run: int


def convert_documents(spark: SparkSession, source: str, target: str, *, pattern: str = "*.docx", stop_on_error: bool = False) -> Converted:
    """Convert all files below ``source`` and publish their Markdown under ``target`` as one set.

    With ``stop_on_error`` what comes after the first failing file, by path, is not run, which its rows say.
    """
    c = converted(spark, source, pattern)
    if stop_on_error:
        failed = F.max((F.col("status") == "FAILED").cast("int")).over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1))
        # A row per file, without contents: an order of all files is what stopping at the first one means.
        states = c.select("path", "status").withColumn("stopped", F.coalesce(failed, F.lit(0)) == 1).select(F.col("path").alias("s_path"), "stopped")
        c = c.join(states, F.col("path") == F.col("s_path")).withColumn("status", F.when(F.col("stopped"), "NOT_RUN").otherwise(F.col("status"))).drop("s_path", "stopped")
    done = c.where("status = 'SUCCEEDED'")
    counts = {r["status"]: r["count"] for r in c.groupBy("status").count().collect()}
    out = publish(done.select("document_id", F.coalesce("markdown", F.lit("\n")).alias("markdown")), target, id_col="document_id")
    return Converted(out, counts.get("SUCCEEDED", 0), counts.get("FAILED", 0), counts.get("NOT_RUN", 0))


def validate_package(spark: SparkSession, target: str) -> list[str]:
    """What is wrong with a published set: files that its inventory lacks, that it names in vain, or that have changed."""
    said = spark.read.schema("path string, length long, sha string").json(f"{target}/inventory")
    found = inventory(spark, f"{target}/documents")
    a, b = said.select("path", F.col("sha").alias("a")), found.select("path", F.col("sha").alias("b"))
    j = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    problem = F.when(F.col("a").isNull(), "FILE_NOT_DECLARED").when(F.col("b").isNull(), "FILE_MISSING").otherwise("SHA_MISMATCH")
    return [f"{r['problem']}: {r['path']}" for r in j.select("path", problem.alias("problem")).orderBy("path").limit(1000).toLocalIterator()]


def queries() -> dict:
    """All queries of the engine by name, those of training data beside the others if they are installed."""
    from .operators import REGISTRIES

    return {name: q for r in REGISTRIES for name, q in r.queries.items()}


def run_query(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    found = queries()
    if name not in found:
        raise ConversionError(f"unknown query {name}")
    return found[name](spark, sf_dir)
