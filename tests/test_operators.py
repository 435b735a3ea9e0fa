"""Every query against its SQL, and the operators that SQL cannot express against stated behaviour."""

from __future__ import annotations

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quireframe.functions.eq import to_latex
from quireframe.operators import REGISTRIES, regions, text
from quireframe.plans.joins import epoch, interval_join, once_per_key

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {n: (q, r.sql.get(n)) for r in REGISTRIES for n, q in r.queries.items()}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    fixed = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(str(tuple(map(fixed, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_query_equals_its_sql(spark, db, name):
    query, sql = ALL[name]
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    want = answer.fetchall()
    got = query(spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*[f"`{n}`" for n in names]).collect()) == plain(want)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and {n for r in REGISTRIES for n in r.queries} <= set(e.queries())


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    points = [(i, rng.randrange(3), day + datetime.timedelta(seconds=rng.randrange(9000))) for i in range(200)]
    spans = [(i, rng.randrange(3), day + datetime.timedelta(seconds=(s := rng.randrange(9000))), day + datetime.timedelta(seconds=s + rng.choice([0, 5, 4000]))) for i in range(60)]
    p, s = spark.createDataFrame(points, "p long, k long, t timestamp"), spark.createDataFrame(spans, "s long, k long, a timestamp, b timestamp")
    got = interval_join(p, s, keys=["k"], at=epoch(F.col("t")), start=epoch(F.col("a")), end=epoch(F.col("b")), width=600.0)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((x[0], y[0]) for x in points for y in spans if x[1] == y[1] and y[2] <= x[2] <= y[3])


def test_every_call_has_its_sample_window(spark, db):
    events = db.execute("SELECT event_id, user_id, ts, event_type, value FROM events").fetchall()
    samples = [e for e in events if e[3] in ("view", "click")]
    last = {r: max(e[2] for e in events if e[1] % 8 == r) for r in range(8)}
    now = {r: max(e[2] for e in samples if e[1] % 8 == r) for r in range(8)}
    got = {r["call"]: r for r in ALL["call_sample_windows"][0](spark, SF).collect()}
    calls = [e for e in events if e[3] in ("purchase", "error")]
    assert set(got) == {e[0] for e in calls} and sum(e[0] % 7 == 0 and e[0] % 49 != 0 for e in calls) > 30
    for call, user, start, _, _ in calls:
        run = user % 8
        until = start + datetime.timedelta(hours=1) if call % 7 else last[run] if run % 3 else now[run]
        hit = [s for s in samples if s[1] % 8 == run and start <= s[2] <= until]
        gpu = [s[0] % 101 for s in hit if s[0] % 5]
        r = got[call]
        assert (r["samples"], r["ram_peak"], r["gpu_peak"]) == (len(hit), max((s[0] * 1000 + s[1] for s in hit), default=None), max(gpu, default=None))
        for mean, values in ((r["cpu_avg"], [s[4] for s in hit]), (r["gpu_avg"], gpu)):
            assert mean == (pytest.approx(sum(values) / len(values), abs=1e-4) if values else None)


def test_expensive_calls_are_paid_once_per_key(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def call(x):
        seen.add(1)
        return str(x)

    df = spark.createDataFrame([(i, f"k{i % 3}" if i % 5 else None) for i in range(40)], "i long, k string")
    assert once_per_key(df, ["k"], lambda d: d.select("k", call("k").alias("v"))).count() == 40
    got = once_per_key(df, ["k"], lambda d: d.select("k", call("k").alias("v"))).collect()
    assert all(r["v"] == str(r["k"]) for r in got) and seen.value <= 8


def test_guards_reach_every_branch(spark):
    got = {r["value"]: (r["t"], r["f"]) for r in text.samples(spark).select("value", text.output_problem(F.col("value")).alias("t"), text.output_problem(F.col("value"), formula=True).alias("f")).collect()}
    assert got["x=1"] == (None, None) and got["−"] == (None, None) and got["plain words"] == (None, None)
    assert got["  "][0] == got[""][0] == "EMPTY_OCR"
    assert got["# $$"][0] == "EMPTY_MARKUP_OUTPUT" and got[r"\[ x"][0] == "UNPAIRED_MATH_DELIMITER"
    assert got[r"\frac{}{2}"] == (None, "EMPTY_FORMULA_OPERAND")
    assert got["{a"] == got["a}b{"] == (None, "UNBALANCED_FORMULA_BRACES")
    assert got["***"][0] == "SYMBOL_ONLY_REVIEW" and got["a $$b$$ c"] == (None, None)


def test_region_order_does_not_matter(spark):
    from quireframe.sources import projections as P

    r = P.regions(spark, SF)
    once, again = regions.plan_roles(r), regions.plan_roles(r.orderBy(F.rand(1)))
    assert once.exceptAll(again).count() == 0 and once.count() == again.count() == r.count()


def test_eq_fields():
    cases = {
        r"EQ \f(1,2)": r"\frac{1}{2}", r"\r(3,x)": r"\sqrt[3]{x}", r"\r(x)": r"\sqrt{x}", r"eq f(a,b)\f(g(1,2);3)": r"f(a,b)\frac{g(1,2)}{3}",
        r"\i\su(1,n,k)": r"\sum_{1}^{n} k", r"\i(,,x)": r"\int x", r"x\s\up3(2)": "x^{2}", r"x\s\do3(2)": "x_{2}",
        r"\b\bc(x)": r"\left\{x\right\}", r"\b\bc\{(x)": r"\left\{\right\}\{(x)", r"\a(1,2)": r"\begin{array}{c}1 \\ 2\end{array}", r"\l(a;b)": "ab",
    }
    for source, want in cases.items():
        assert to_latex(source)[0] == want
    assert to_latex(r"\zz(a,b)") == (r"\operatorname{EQ_zz}\left(a,b\right)", True, [r"unknown switch zz: \zz(a,b)"], None)
    assert to_latex(r"\f(1,2")[3] == "unclosed switch f" and to_latex(" ")[3] == "empty output" and to_latex(None) == (None, False, [], None)


def test_boxes_meet_as_all_pairs_do(spark):
    rng = random.Random(13)
    rows = [(i % 4, f"r{i}", x := rng.randrange(-100, 400), y := rng.randrange(400), x + rng.randrange(200), y + rng.randrange(1, 150)) for i in range(160)]
    df = spark.createDataFrame(rows, "page long, region string, x0 long, y0 long, x1 long, y1 long")
    for slack in (0, 2, 40):
        c = F.col
        meet = (F.greatest(c("a_x0"), c("b_x0") - slack) <= F.least(c("a_x1"), c("b_x1") + slack)) & (F.greatest(c("a_y0"), c("b_y0") - slack) <= F.least(c("a_y1"), c("b_y1") + slack))
        want = sorted((r["a_region"], r["b_region"]) for r in regions.pairs(df, df).where(meet).collect())
        assert want and sorted((r["a_region"], r["b_region"]) for r in regions.touching(df, df, slack).collect()) == want
