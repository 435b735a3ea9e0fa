"""Command line: ``convert``, ``validate``, ``query``, ``serve``, ``cleanup``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api, server


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quireframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="packages below a folder to published Markdown")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--pattern", default="*.docx")
    c.add_argument("--stop-on-error", action="store_true")
    v = sub.add_parser("validate", help="check a published set")
    v.add_argument("target")
    q = sub.add_parser("query", help="write a query's result")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--out", help="where to write Parquet; else the first rows are shown")
    s = sub.add_parser("serve", help="answer JSON requests, one a line")
    s.add_argument("tables")
    u = sub.add_parser("cleanup", help="remove staged folders that are a day old")
    u.add_argument("root")
    u.add_argument("--older-than", type=float, default=24 * 3600)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quireframe").getOrCreate()
    if a.command == "convert":
        c = api.convert_documents(spark, a.source, a.target, pattern=a.pattern, stop_on_error=a.stop_on_error)
        print(json.dumps({"succeeded": c.succeeded, "failed": c.failed, "not_run": c.not_run, "target": a.target}))
        return int(c.failed > 0)
    if a.command == "validate":
        problems = api.validate_package(spark, a.target)
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    if a.command == "query":
        df = api.run_query(spark, a.name, a.tables)
        df.write.parquet(a.out) if a.out else df.show(20, truncate=60)
    elif a.command == "serve":
        server.serve(spark, a.tables)
    else:
        removed, retained = api.cleanup_staging(spark, a.root, older_than=a.older_than)
        print(json.dumps({"removed": removed, "retained": retained}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
