"""Conversion, validation, the command line and the tool server."""

from __future__ import annotations

import json
import os

import pytest

from quireframe import api, server
from quireframe.__main__ import main
from quireframe.sources.packages import build

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    os.makedirs(f"{tmp_path}/in/deep")
    for name, paragraphs in {"a.docx": [("Heading1", "One"), ("Normal", "Text *here*")], "deep/c.docx": [("Normal", "Only")]}.items():
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(build(paragraphs))
    with open(f"{tmp_path}/in/b.docx", "wb") as f:
        f.write(b"no package")
    return tmp_path


def test_conversion_goes_on_after_a_bad_file(spark, folder):
    c = api.convert_documents(spark, f"{folder}/in", f"{folder}/out/set")
    assert (c.succeeded, c.failed, c.not_run) == (2, 1, 0)
    texts = {r["document_id"].split("__")[0]: r["markdown"] for r in api.converted(spark, f"{folder}/in").where("status = 'SUCCEEDED'").collect()}
    assert texts == {"a": "# One\n\nText *here*\n", "c": "Only\n"}
    assert api.validate_package(spark, f"{folder}/out/set") == []
    (d,) = [d for d in os.listdir(f"{folder}/out/set/documents") if d.startswith("document_id=a__")]
    part = next(n for n in os.listdir(f"{folder}/out/set/documents/{d}") if n.startswith("part-"))
    with open(f"{folder}/out/set/documents/{d}/{part}", "a") as f:
        f.write("more")
    os.path.exists(crc := f"{folder}/out/set/documents/{d}/.{part}.crc") and os.remove(crc)
    assert [p.split(":")[0] for p in api.validate_package(spark, f"{folder}/out/set")] == ["SHA_MISMATCH"]


def test_conversion_stops_at_the_first_bad_file_if_asked(spark, folder):
    c = api.convert_documents(spark, f"{folder}/in", f"{folder}/out/set", stop_on_error=True)
    assert (c.succeeded, c.failed, c.not_run) == (1, 1, 1)


def test_command_line(spark, folder, capsys):
    assert main(["convert", f"{folder}/in", f"{folder}/out/set"], spark) == 1
    assert json.loads(capsys.readouterr().out)["succeeded"] == 2
    assert main(["validate", f"{folder}/out/set"], spark) == 0
    assert main(["query", "tool_summary", SF, "--out", f"{folder}/q"], spark) == 0 and spark.read.parquet(f"{folder}/q").count() == 6
    assert main(["cleanup", f"{folder}/out"], spark) == 0


def test_tool_server(spark):
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [ask(1, "initialize"), ask(2, "tools/list"), ask(3, "tools/call", name="runtime_monitor", arguments={"action": "summary", "limit": 4}), ask(4, "tools/call", name="query", arguments={"name": "nothing"}), ask(5, "other"), "", "{", json.dumps({"method": "initialize"})]
    got = [json.loads(a) for a in server.answers(server.Tools(spark, SF), lines)]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None]
    assert {"query", "runtime_monitor", "convert"} <= {t["name"] for t in got[1]["result"]["tools"]}
    assert len(got[2]["result"]["rows"]) == 4 and got[2]["result"]["next_offset"] == 4
    assert "unknown query" in got[3]["error"]["message"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700
