"""A tool server: one JSON request a line in, one JSON answer a line out.

Requests are those of JSON-RPC 2.0: ``initialize``, ``tools/list`` and ``tools/call``.
Answers are pages of rows; whole results go to a table that the request names.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from . import api

PAGE = 50


def _rows(df: DataFrame, offset: int, limit: int) -> dict[str, Any]:
    if not 0 <= offset or not 1 <= limit <= PAGE:
        raise ValueError(f"offset must not be negative, limit from 1 to {PAGE}")
    found = df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]).offset(offset).limit(limit + 1).toJSON().collect()
    rows = [json.loads(r) for r in found[:limit]]
    return {"rows": rows, "next_offset": offset + limit if len(found) > limit else None}


class Tools:
    """The tools, each a function of its arguments."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.all: dict[str, tuple[str, Callable[..., dict]]] = {
            "info": ("Names of all queries.", lambda: {"queries": sorted(api.queries())}),
            "query": ("A page of a query's rows.", self.query),
            "save": ("A query's whole result as a table.", self.save),
            "runtime_monitor": ("Summary, calls, samples or models of a capture.", self.monitor),
            "runtime_jobs": ("Listing, lookups and decisions of the job store.", self.jobs),
            "textbook_import": ("Inspection, pending issues, evidence, preview and review of books.", self.imports),
            "knowledge_workspace": ("State, inventory and paths of a workspace.", self.workspace),
            "read": ("A window of a document's text.", lambda offset=0, limit=PAGE: self.query("text_window", offset, limit)),
            "convert": ("Packages below a folder to published Markdown.", self.convert),
            "validate": ("What is wrong with a published set.", lambda target: {"problems": api.validate_package(self.spark, target)}),
            "cleanup": ("Staged folders that nobody has touched for a day.", lambda root: dict(zip(("removed", "retained"), api.cleanup_staging(self.spark, root), strict=True))),
        }

    def query(self, name: str, offset: int = 0, limit: int = PAGE) -> dict:
        return _rows(api.run_query(self.spark, name, self.sf_dir), offset, limit)

    def save(self, name: str, path: str) -> dict:
        api.run_query(self.spark, name, self.sf_dir).write.parquet(path)
        return {"path": path}

    def monitor(self, action: str = "summary", offset: int = 0, limit: int = PAGE) -> dict:
        names = {"summary": "tool_summary", "status": "run_liveness", "calls": "call_sample_windows", "samples": "run_windows", "models": "model_windows"}
        return self.query(names[action], offset, limit)

    def jobs(self, action: str = "list", offset: int = 0, limit: int = PAGE) -> dict:
        names = {"list": "jobs_newest", "queue": "jobs_fifo", "lookup": "prefix_lookup", "decide": "submit_decisions", "expire": "wait_expiry", "status": "progress_records"}
        return self.query(names[action], offset, limit)

    def imports(self, action: str = "inspect", offset: int = 0, limit: int = PAGE) -> dict:
        names = {"inspect": "review_states", "pending": "pending_issues", "evidence": "evidence_crops", "preview": "book_files", "outline": "book_outline", "mismatches": "numeric_mismatches", "unmatched": "unmatched_entries", "resolve": "package_resolution"}
        return self.query(names[action], offset, limit)

    def workspace(self, action: str = "inspect", offset: int = 0, limit: int = PAGE) -> dict:
        names = {"inspect": "workspace_state", "files": "extension_histogram", "changes": "inventory_changes", "paths": "path_scopes", "doctor": "doctor_report"}
        return self.query(names[action], offset, limit)

    def convert(self, source: str, target: str, stop_on_error: bool = False) -> dict:
        c = api.convert_documents(self.spark, source, target, stop_on_error=stop_on_error)
        return {"target": target, "succeeded": c.succeeded, "failed": c.failed, "not_run": c.not_run}


def answers(tools: Tools, lines: Iterable[str]) -> Iterator[str]:
    """An answer for every request; a notification, which has no id, gets none."""
    for line in lines:
        if not line.strip():
            continue
        number = None
        try:
            r = json.loads(line)
            number, method, params = r.get("id"), r["method"], r.get("params") or {}
            if method == "initialize":
                result: dict = {"server": "quireframe", "capabilities": {"tools": {}}}
            elif method == "tools/list":
                result = {"tools": [{"name": n, "description": d} for n, (d, _) in tools.all.items()]}
            elif method == "tools/call":
                result = tools.all[params["name"]][1](**(params.get("arguments") or {}))
            else:
                yield json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method}"}})
                continue
            if number is not None:
                yield json.dumps({"jsonrpc": "2.0", "id": number, "result": result}, ensure_ascii=False)
        except (ValueError, KeyError, TypeError, AttributeError, RuntimeError) as e:
            yield json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32700 if number is None else -32602, "message": f"{type(e).__name__}: {e}"}})


def serve(spark: SparkSession, sf_dir: str, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for a in answers(Tools(spark, sf_dir), source):
        print(a, file=sink, flush=True)
