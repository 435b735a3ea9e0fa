"""Queries over packages, metafiles and HTML tables made from the test tables."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.vectorized import vectorized
from ..plans.joins import spread
from ..registry import Registry
from ..sources import binary
from ..sources import packages as K
from ..sources import projections as P

R = Registry()
_CLEAN = r"[\x00-\x20]+"


@R.add(rf"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, t) - 1 AS INTEGER) AS block, role AS style, t AS text
    FROM (SELECT conv_id, turn, role, regexp_replace(text, '{_CLEAN}', ' ', 'g') AS t FROM conversations)""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per conversation, written and read again."""
    c = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_replace("text", _CLEAN, " ").alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    made = c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", K.built(F.transform("turns", lambda t: F.struct(t["role"].alias("style"), t["text"].alias("text")))).alias("content"))
    return K.rows(made.select("conv_id", K.package("content").alias("package")), "blocks", "conv_id").select("conv_id", "block", "style", "text")


@vectorized("binary")
def metafiles(key: pd.Series, lines: pd.Series) -> pd.Series:
    """A metafile per key: lines, texts, sometimes an unknown record, sometimes no end."""

    def one(k: int, n: int) -> bytes:
        words = struct.pack("<IHhhhhHI", binary.PLACEABLE, 0, 0, 0, 100, 50, 96, 0)
        check = 0
        for w in struct.unpack("<10H", words):
            check ^= w
        records = struct.pack("<IHHH", 5, 0x0213, 1, 1) * (n % 4) + struct.pack("<IHH", 4, 0x0521, 0) * (k % 3) + struct.pack("<IH", 3, 0x0999) * (k % 5 == 0) + struct.pack("<IH", 3, 0) * (k % 7 != 0)
        return words + struct.pack("<H", check) + struct.pack("<HHHIHIH", 1, 9, 0x0300, 0, 0, 0, 0) + records

    return pd.Series([one(int(k), int(n)) for k, n in zip(key, lines, strict=True)])


@R.add("""SELECT p_partkey, d + t + u + CASE WHEN ended THEN 1 ELSE 0 END AS n_records, d AS drawing, t AS text, CAST(u AS BIGINT) AS unknown, ended AS valid, CASE WHEN d + t > 0 THEN 'visible' WHEN ended AND u = 0 THEN 'empty' ELSE 'uncertain' END AS visual_state
    FROM (SELECT p_partkey, CAST(p_size % 4 AS BIGINT) AS d, p_partkey % 3 AS t, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS u, p_partkey % 7 <> 0 AS ended FROM part)""")
def metafile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select("p_partkey", binary.metafile_records(metafiles("p_partkey", "p_size")).alias("m"))
    return p.select("p_partkey", F.col("m.error").isNull().alias("valid"), *[c.alias(n) for n, c in binary.metafile_summary(F.col("m")).items()])


# Elements that a table may have, parents of rows, and hints that are dropped.
ELEMENTS = {"table", "thead", "tbody", "tfoot", "tr", "th", "td", "br", "sup", "sub"}
ROW_PARENTS = {"table", "thead", "tbody", "tfoot"}
HINTS = ("border", "cellspacing", "cellpadding")
GRID = "cells array<struct<row:int,col:int,rowspan:int,colspan:int,header:boolean,text:string>>, n_rows int, n_cols int, error string"
_INVALID = ([], None, None, "TABLE_STRUCTURE_INVALID")


def grid(html: str | None) -> tuple:
    """(cells, n_rows, n_cols, error): one strict table whose cells tile a full rectangle.

    ``free`` holds, per column, the first row that no cell above has taken; a
    cell goes to the first free column of its row.
    """
    text = (html or "").strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("html").strip().removesuffix("```").strip()
    if not text:
        return [], None, None, "EMPTY_TABLE_OUTPUT"
    if "<!" in text:
        return _INVALID
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return _INVALID
    for hint in HINTS:
        value = root.attrib.pop(hint, "0")
        if not (value.isascii() and value.isdigit() and len(value) <= 2):
            return _INVALID
    if not _allowed(root):
        return _INVALID
    rows = list(root.iter("tr"))
    if not rows or not any(t.strip() for t in root.itertext()):
        return _INVALID
    cells, free = [], []
    for y, row in enumerate(rows):
        x = 0
        for c in row:
            if c.tag not in ("td", "th"):
                return _INVALID
            spans = c.attrib
            height, width = (int(spans.get("rowspan", 1)), int(spans.get("colspan", 1))) if spans else (1, 1)
            while x < len(free) and free[x] > y:
                x += 1
            if y + height > len(rows) or x + width > 1000 or (width > 1 and any(f > y for f in free[x : x + width])):
                return _INVALID
            if x + width > len(free):
                free.extend([0] * (x + width - len(free)))
            free[x : x + width] = [y + height] * width
            cells.append((y, x, height, width, c.tag == "th", ("".join(c.itertext()) if len(c) else c.text or "").strip()))
            x += width
        if not len(row) or min(free) <= y or (y and len(free) != columns):
            return _INVALID
        columns = len(free)
    return cells, len(rows), columns, None


def _allowed(root: ET.Element) -> bool:
    """Every element is one that a table may have, in its place, with no attributes but a cell's spans of 1 to 1000."""
    if root.tag != "table" or root.attrib:
        return False
    for p in root.iter():
        for e in p:
            if e.tag in ("td", "th"):
                if p.tag != "tr" or (e.attrib and not all(k in ("rowspan", "colspan") and v.isdecimal() and 1 <= int(v) <= 1000 for k, v in e.attrib.items())):
                    return False
            elif e.attrib or e.tag == "table" or e.tag not in ELEMENTS or (e.tag == "tr" and p.tag not in ROW_PARENTS):
                return False
    return True


def table_grid(html: Column) -> Column:
    """The grid of a text's one table, as GRID, a batch at a time."""

    def grids(texts: pa.Array) -> pa.Array:
        columns = zip(*[grid(h) for h in texts.to_pylist()], strict=True) if len(texts) else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    fields = list(to_arrow_type(_parse_datatype_string(GRID)))
    return F.arrow_udf(grids, GRID)(html)


@R.add("""SELECT l_orderkey AS page, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 2 * count(*) + 1 END AS n_cells, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(sum(l_partkey) AS BIGINT) END AS total,
    CASE WHEN l_orderkey % 5 = 0 THEN 'TABLE_STRUCTURE_INVALID' END AS error FROM lineitem GROUP BY l_orderkey""")
def html_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per order; every fifth lacks a cell."""
    row = F.concat(F.lit("<tr><td>"), "l_partkey", F.lit("</td><td>"), F.col("l_quantity").cast("long"), F.lit("</td></tr>"))
    lines = spread(P.table(spark, sf_dir, "lineitem"), "l_orderkey")
    t = lines.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("body"))
    head = F.concat(F.lit("<tr><th colspan='2'>lines</th></tr>"), F.when(F.col("page") % 5 == 0, "<tr><td>x</td></tr>").otherwise(""))
    g = t.select("page", table_grid(F.concat(F.lit("<table border='1'>"), head, "body", F.lit("</table>"))).alias("g"))
    keys = F.transform(F.filter("g.cells", lambda c: (c["col"] == 0) & ~c["header"]), lambda c: c["text"].cast("long"))
    total = F.when(F.col("g.error").isNull(), F.aggregate(keys, F.lit(0).cast("long"), lambda a, v: a + v))
    return g.select("page", F.size("g.cells").cast("long").alias("n_cells"), total.alias("total"), F.col("g.error").alias("error"))
