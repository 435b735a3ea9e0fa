"""Plans whose work, moved bytes and memory of a task must not outgrow the input."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quireframe.operators import REGISTRIES, contracts, packages, regions, textbook
from quireframe.plans import joins
from quireframe.plans.joins import range_totals

SF = "/root/testdata/sf0.001"
ALL = {n: q for r in REGISTRIES for n, q in r.queries.items()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_books_are_read_once(spark):
    for name in ("book_files", "book_outline", "unmatched_entries"):
        p = plan(ALL[name](spark, SF))
        assert p.count("FileScan parquet") == 1 and p.count("Exchange hashpartitioning") == 1, name


def test_sections_of_own_outline_equal_those_of_given_parts(spark):
    rng = random.Random(11)
    lines = ["# 第1章", "第1章", "第1章 力 ..... 2", "# 附录", "附录 …… 9", "目录", "x", "", None, "![](a.png)", "# 索引", "见第2章"]
    rows = [(f"b{b}" if b else None, p, n, rng.choice(lines)) for b in range(60) for p in range(rng.choice([0, 1, 1, 4]), 7) for n in range(1, rng.randrange(2, 9))]
    df = spark.createDataFrame(rows, "book string, page int, line int, text string")
    names = ["book", "section", "title", "kind", "body"]
    own, given = (sorted(map(str, d.select(names).collect())) for d in (textbook.sections(df), textbook.sections(df, textbook.outline(df))))
    assert own == given and len(own) > 100
    # A section has just the lines between its beginning and the next one's.
    parts = {}
    for r in textbook.outline(df).where("book is not null").collect():
        parts.setdefault(r["book"], []).append((r["page"], r["line"], r["kind"] != "FRONT_MATTER", r["title"]))
    want = {}
    for b, p, n, t in rows:
        begun = [x for x in parts.get(b, []) if x[:2] <= (p, n)]
        if t is not None and begun:
            want.setdefault((b, len(begun), max(begun)[3]), []).append(t)
    assert {(r["book"], r["section"], r["title"]): r["body"] for r in textbook.sections(df).collect()} == {k: "\n".join(v) for k, v in want.items()}


def test_unmatched_entries_of_odd_books(spark):
    rows = [("a", 1, 1, "目录"), ("a", 1, 2, "第1章 力 ... 2"), ("a", 1, 3, "附录 9"), ("a", 1, 4, "第3节 热 ... 5"), ("a", 2, 1, "第1章 力"), ("b", 1, 1, "第2章 4"), ("b", 2, 1, None), (None, 1, 1, "索引 .. 3")]
    got = textbook.unmatched_contents(spark.createDataFrame(rows, "book string, page int, line int, text string")).collect()
    assert {tuple(r) for r in got} == {("a", "附录"), ("b", "第2章"), (None, "索引")}


def test_lines_are_looked_at_once_a_text_and_sorted_twice(spark, monkeypatch):
    """Lines reach Python after one numbering of regions and one search for pages, and there once a text, not once a row."""
    for name in ("book_files", "book_outline", "unmatched_entries"):
        p = plan(ALL[name](spark, SF))
        assert (p.count("Window ["), p.count("Sort [")) == (2, 3), name
    seen = []
    monkeypatch.setattr(textbook, "_of_short", lambda t: seen.append(t) or textbook._of_line(t))
    rows = [(b, p, "# 第1章" if p == 2 else "正文") for b in range(500) for p in (1, 2, 3)]
    table = pa.table({n: pa.array(c) for n, c in zip(("book", "page", "text"), zip(*rows, strict=True), strict=True)})
    found = list(textbook._with_parts(iter(table.to_batches(max_chunksize=700))))
    assert sum(len(f.at) for f in found) == 500 and len(seen) <= 2 * len(found) <= 8


def test_parts_do_not_hang_on_batches(spark):
    """Books and pages that several batches share, pages out of order and null books give what whole books in one batch give."""
    rng = random.Random(5)
    lines = ["# 第1章", "第1章", "第1章 力 ..... 2", "第2章 热 ..... 3", "# 第2章", "# 附录", "附录 …… 9", "目录", "x", "", None, "![](a.png)", "# 第3节 光", "短"]
    rows = []
    for b in range(80):
        pages = [rng.choice([1, 2, 3, n]) for n in range(1, rng.randrange(3, 9))]
        rows += [(f"b{b}" if b else None, 100 * i + n, f"<!-- page:{p} -->" if n == 0 else rng.choice(lines)) for i, p in enumerate(pages) for n in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "book string, at int, text string")
    made = (textbook.outline, textbook.unmatched_contents, textbook.sections)
    want = [sorted(map(str, f(textbook.paged(df)).collect())) for f in made]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [[sorted(map(str, f(read(df)).collect())) for f in made] for read in (textbook.paged, textbook.in_pages)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [want, want] and min(map(len, want)) > 20


def test_no_sample_meets_a_call_as_a_row(spark):
    """Samples come to the calls of a run in groups of arrays; no join makes a row of every sample in a call."""
    p = plan(ALL["call_sample_windows"](spark, SF))
    assert "CoGroup" in p and "Generate explode(sequence" not in p


def test_totals_of_ranges_equal_brute_force(spark):
    rng = random.Random(17)
    points = [(rng.choice([0, 1, 2, None]), rng.randrange(-500, 3000) if rng.random() > 0.05 else None, rng.randrange(9), rng.randrange(-99, 99)) for _ in range(400)]
    spans = [(i, rng.choice([0, 1, 3, None]), s := rng.randrange(-600, 3100), rng.choice([s - 5, s, s + 7, s + 90, s + 250, s + 2500, None])) for i in range(300)] + [(300, 0, None, 9)]
    p, s = spark.createDataFrame(points, "k long, at long, v long, m long"), spark.createDataFrame(spans, "i long, k long, start long, end long")
    got = {r["i"]: (r["v"], r["m"]) for r in range_totals(p, s, key="k", id="i", sums=["v"], peaks=["m"], width=100).collect()}
    want = {}
    for i, k, a, z in spans:
        hit = [x for x in points if None not in (k, a, z, x[1]) and x[0] == k and a <= x[1] <= z]
        want[i] = (sum(x[2] for x in hit), max((x[3] for x in hit), default=-(1 << 63)))
    assert got == want


def tasks(df) -> set[int]:
    """Numbers of tasks that a plan deals rows over by keys."""
    return {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (?:REPARTITION|ENSURE)", plan(df))}


def test_assets_meet_in_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_BYTES", 1 << 12)
    assert min(tasks(ALL["asset_integrity"](spark, SF))) > 20


def test_requests_and_answers_are_counted_without_a_join(spark):
    df = lambda rows: spark.createDataFrame(rows, "batch long, item long")
    got = contracts.bound(df([(1, 1), (1, 2), (2, 1), (3, 1), (3, 1), (4, None), (None, 1), (6, 1)]), df([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, None), (None, 1), (5, 1)]))
    assert {r["batch"]: r["bound"] for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, None: False}
    assert "Join" not in plan(ALL["response_binding"](spark, SF))


def test_assets_of_a_document_move_once(spark, monkeypatch):
    for name in ("final_assets", "asset_counts"):
        assert plan(ALL[name](spark, SF)).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(joins, "TASK_BYTES", 1 << 12)
    assert min(tasks(ALL["final_assets"](spark, SF))) > 20


def test_jobs_of_a_task_are_counted_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_BYTES", 1 << 12)
    df = ALL["task_jobs"](spark, SF)
    assert "Expand" not in plan(df) and max(tasks(df)) > 20


def test_tables_come_in_tasks_by_size_and_odd_digits_are_no_spans(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_BYTES", 1 << 12)
    assert min(tasks(ALL["html_grids"](spark, SF))) > 20
    html = ["<table><tr><td colspan='²'>a</td></tr></table>", None, "<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c<br/>d</td></tr></table>"]
    df = spark.createDataFrame(list(enumerate(html)), "i int, h string").select("i", packages.table_grid(F.col("h")).alias("g"))
    got = {r["i"]: ([tuple(c) for c in r["g"]["cells"]], *r["g"][1:]) for r in df.collect()}
    assert got == {
        0: ([], None, None, "TABLE_STRUCTURE_INVALID"), 1: ([], None, None, "EMPTY_TABLE_OUTPUT"),
        2: ([(0, 0, 2, 1, False, "a"), (0, 1, 1, 1, False, "b"), (1, 1, 1, 1, False, "cd")], 2, 2, None),
    }


def test_few_cells_of_figures_meet(spark, monkeypatch):
    """Strips meet boxes as they are: fewer rows than boxes grown on all sides would make."""
    seen = []
    kept = regions.touching
    monkeypatch.setattr(regions, "touching", lambda a, b, slack=0: seen.append((a, slack)) or kept(a, b, slack))
    ALL["figure_edges_free"](spark, SF)
    (strips, slack), = seen
    assert slack == 0 and strips.where("y1 - y0 not between 3 and 40").count() == 0


def test_blocks_of_a_document_move_once_to_be_joined(spark):
    p = plan(ALL["visual_documents"](spark, SF))
    assert 0 < p.index("Window [") < p.index("Exchange hashpartitioning")
