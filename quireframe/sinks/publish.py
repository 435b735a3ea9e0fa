"""Publishing of written results: staged first, then swapped in by renames, with the last version put back on failure.

Everything goes through Spark's writers and Hadoop's file system, so any store that
Spark reaches will do. A published folder has the data, ``manifest.json`` with the
digests of its files, and nothing of earlier versions.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """A store's folders, by paths as Spark takes them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot rename {a} to {b}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def children(self, path: str) -> list[tuple[str, bool, float]]:
        """(name, is a folder, seconds of its last change), by name."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path)))

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def write_documents(documents: DataFrame, path: str, *, id_col: str = "doc", text_col: str = "markdown") -> None:
    """A folder per document with its whole text as one file, which ends with a line end."""
    rows = documents.select(F.col(id_col).alias("document_id"), F.regexp_replace(text_col, r"\n\z", "").alias("value"))
    rows.write.partitionBy("document_id").option("lineSep", "\n").text(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha) of the files below a folder, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+(?:/[^/]+)?)$", 1)
    return files.where(~F.col("path").contains("/_")).select(name.alias("path"), "length", F.sha2("content", 256).alias("sha"))


@dataclass(frozen=True)
class Published:
    target: str
    replaced: bool


def publish(documents: DataFrame, target: str, *, scope: str = "HANDOFF_ARTIFACTS", check=None, **columns) -> Published:
    """Write, check and swap in a set of documents.

    ``check`` may raise after the staged folder is written. Whatever fails, the target is what it was, and a receipt
    of the failure stands beside it.
    """
    spark = documents.sparkSession
    files, name = Files(spark, target), os.urandom(6).hex()
    root, base = target.rstrip("/").rsplit("/", 1)
    stage, backup = f"{root}/.staging/{base}-{name}", f"{root}/.staging/{base}-{name}-before"
    files.make(f"{root}/.staging")
    replaced = False
    try:
        write_documents(documents, f"{stage}/documents", **columns)
        total = inventory(spark, f"{stage}/documents").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        inventory(spark, f"{stage}/documents").write.json(f"{stage}/inventory")
        files.write(f"{stage}/manifest.json", json.dumps({"schema": "delivery-stage-v1", "complete_scope": scope, "files": total["files"], "bytes": total["bytes"], "complete": True}, sort_keys=True))
        if check is not None:
            check(stage)
        if files.exists(target):
            files.rename(target, backup)
            replaced = True
        files.rename(stage, target)
    except BaseException as e:
        if replaced and not files.exists(target):
            files.rename(backup, target)
        files.delete(stage)
        files.write(f"{root}/.failures/{base}-{name}.json", json.dumps({"error": type(e).__name__, "message": str(e)[:500], "at": time.time()}))
        raise
    if replaced:
        files.delete(backup)
    return Published(target, replaced)


def cleanup_staging(spark: SparkSession, root: str, *, older_than: float = 24 * 3600, now: float | None = None) -> tuple[list[str], list[str]]:
    """(removed, retained) names of staged folders: those not touched for so many seconds go, files stay."""
    if older_than < 0:
        raise ValueError("older_than must not be negative")
    files = Files(spark, root)
    cutoff = (time.time() if now is None else now) - older_than
    removed, retained = [], []
    for name, folder, changed in files.children(f"{root}/.staging"):
        if folder and changed <= cutoff:
            files.delete(f"{root}/.staging/{name}")
            removed.append(name)
        else:
            retained.append(name)
    return removed, retained
