"""Word-processing packages: members, content types, relationships, and the body as rows.

A package is one row of bytes. It is opened once, in an Arrow batch, and gives
arrays of structs that explode into the tables `members`, `relationships` and
`blocks`; whatever is wrong with it is data.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eq import to_latex
from ..functions.omml import latex, name
from ..functions.vectorized import vectorized

MIB = 1 << 20
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
SCHEMA = """members array<struct<name:string,kind:string,size:bigint,packed:bigint,content_type:string>>,
    relationships array<struct<owner:string,id:string,type:string,target:string,external:boolean,part:string>>,
    blocks array<struct<block:int,kind:string,style:string,num_id:string,level:int,row:int,col:int,colspan:int,merge:string,text:string,images:array<string>,formulas:array<string>>>,
    problems array<string>"""


@dataclass(frozen=True)
class Limits:
    """What a package may hold."""

    archive: int = 512 * MIB
    members: int = 10_000
    total: int = 512 * MIB
    xml: int = 32 * MIB
    media: int = 128 * MIB
    ole: int = 64 * MIB
    other: int = 128 * MIB
    ratio: float = 200.0


def member_kind(path: str) -> str:
    if path.endswith((".xml", ".rels")):
        return "xml"
    return "media" if path.startswith("word/media/") else "ole" if path.startswith("word/embeddings/") else "other"


def unsafe(path: str) -> bool:
    return not path or path.startswith("/") or "\\" in path or bool(re.match(r"[A-Za-z]:|.*\0", path)) or ".." in path.split("/")


def preflight(archive: zipfile.ZipFile, size: int, limits: Limits) -> list[str]:
    infos = archive.infolist()
    found = [f"DUPLICATE_MEMBER:{n}" for n, k in Counter(i.filename for i in infos).items() if k > 1]
    found += [f"UNSAFE_MEMBER:{i.filename}" for i in infos if unsafe(i.filename)]
    found += [f"MISSING_PART:{r}" for r in REQUIRED if r not in archive.NameToInfo]
    found += [f"MEMBER_TOO_LARGE:{i.filename}" for i in infos if i.file_size > getattr(limits, member_kind(i.filename))]
    found += [f"RATIO_TOO_HIGH:{i.filename}" for i in infos if i.file_size > limits.ratio * max(1, i.compress_size)]
    totals = (("ARCHIVE", size, limits.archive), ("MEMBERS", len(infos), limits.members), ("TOTAL", sum(i.file_size for i in infos), limits.total))
    return found + [f"{what}_TOO_LARGE" for what, n, limit in totals if n > limit]


# What the main part's type says, and what its relationship's type ends with.
MAIN_TYPE, MAIN_RELATION = "wordprocessingml.document.main+xml", "/officeDocument"


def main_part_problems(own: dict[str, str], related: list[tuple]) -> list[str]:
    """The main part needs a type of its own and an internal relationship of the package."""
    declared = MAIN_TYPE in (own.get(REQUIRED[2]) or "")
    reached = any(owner in ("", ".") and (kind or "").endswith(MAIN_RELATION) and part == REQUIRED[2] for owner, _, kind, _, _, part in related)
    return ["MAIN_PART_NOT_DECLARED"] * (not declared) + ["MAIN_PART_NOT_RELATED"] * (not reached)


def content_types(archive: zipfile.ZipFile) -> tuple[dict[str, str], dict[str, str]]:
    """By part, and by extension where a part has none of its own."""
    root = ET.fromstring(archive.read(REQUIRED[0]))
    own = {e.get("PartName", "").lstrip("/"): e.get("ContentType") for e in root if name(e) == "Override"}
    return own, {e.get("Extension", "").lower(): e.get("ContentType") for e in root if name(e) == "Default"}


def relationships(archive: zipfile.ZipFile) -> list[tuple]:
    """Targets are resolved against their owner's folder; what leaves the package resolves to nothing."""
    out = []
    for path in archive.NameToInfo:
        folder, file = posixpath.split(path)
        if not file.endswith(".rels") or posixpath.basename(folder) != "_rels":
            continue
        base = posixpath.dirname(folder)
        owner = posixpath.join(base, file[:-5])
        for e in ET.fromstring(archive.read(path)):
            target, external = e.get("Target", ""), e.get("TargetMode") == "External"
            part = None if external else posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
            out.append((owner, e.get("Id"), e.get("Type"), target, external, None if part is None or unsafe(part) else part))
    return out


class Inlines:
    """Text, pictures and formulas of one paragraph."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.images: list[str] = []
        self.formulas: list[str] = []
        #: Open fields, innermost last: the instruction's parts, and whether the result has begun.
        self.fields: list[list] = []

    def hidden(self) -> bool:
        return any(not begun or self.is_equation(parts) for parts, begun in self.fields)

    @staticmethod
    def is_equation(parts: list[str]) -> bool:
        return "".join(parts).split()[:1] in (["EQ"], ["eq"])

    def formula(self, value: str) -> None:
        self.formulas.append(value)
        self.text.append(f"${value}$")

    def take(self, e: ET.Element) -> None:
        kind = name(e)
        if kind in ("del", "moveFrom", "rPr", "pPr"):
            return
        if kind in ("oMath", "oMathPara"):
            self.formula(latex(e))
        elif kind == "AlternateContent":
            chosen = e.find("{*}Choice")
            self.children(chosen if chosen is not None else e.find("{*}Fallback"))
        elif kind == "fldChar":
            self.field({v.rpartition("}")[2]: w for v, w in e.attrib.items()}.get("fldCharType"))
        elif kind == "instrText" and self.fields:
            self.fields[-1][0].append(e.text or "")
        elif kind in ("t", "tab", "br", "cr"):
            if not self.hidden():
                self.text.append((e.text or "") if kind == "t" else "\t" if kind == "tab" else "\n")
        elif kind == "blip":
            self.images += [v for k, v in e.attrib.items() if k.endswith("}embed")]
        else:
            self.children(e)

    def children(self, e: ET.Element | None) -> None:
        for c in () if e is None else e:
            self.take(c)

    def field(self, what: str | None) -> None:
        if what == "begin":
            self.fields.append([[], False])
        elif what == "separate" and self.fields:
            self.fields[-1][1] = True
        elif what == "end" and self.fields:
            parts, _ = self.fields.pop()
            if self.is_equation(parts) and not self.hidden():
                self.formula(to_latex("".join(parts).strip())[0] or "")


def value_of(e: ET.Element | None, path: str) -> str | None:
    found = None if e is None else e.find(path)
    return None if found is None else next((v for k, v in found.attrib.items() if k.endswith("}val")), "")


def paragraph(e: ET.Element) -> tuple[str | None, str | None, int | None, Inlines]:
    props, inlines = e.find("{*}pPr"), Inlines()
    inlines.children(e)
    level = value_of(props, "{*}numPr/{*}ilvl")
    return value_of(props, "{*}pStyle"), value_of(props, "{*}numPr/{*}numId"), int(level) if level and level.isdigit() else None, inlines


def body_blocks(body: ET.Element) -> list[tuple]:
    """A row per paragraph, and per cell of a table with its place; content controls and insertions are transparent."""
    out: list[tuple] = []
    n = -1

    def visit(parent: ET.Element) -> None:
        nonlocal n
        for e in parent:
            kind = name(e)
            if kind in ("sdt", "sdtContent", "ins", "customXml", "smartTag"):
                visit(e)
            elif kind == "p":
                n += 1
                style, num, level, i = paragraph(e)
                out.append((n, "paragraph", style, num, level, None, None, None, None, "".join(i.text), i.images, i.formulas))
            elif kind == "tbl":
                n += 1
                for r, row in enumerate(e.findall("{*}tr")):
                    col = 0
                    for cell in row.findall("{*}tc"):
                        props = cell.find("{*}tcPr")
                        span = max(1, int(value_of(props, "{*}gridSpan") or 1))
                        merge = value_of(props, "{*}vMerge")
                        parts = [paragraph(p)[3] for p in cell.iter() if name(p) == "p"]
                        text = "\n".join("".join(p.text) for p in parts)
                        out.append((n, "cell", None, None, None, r, col, span, "continue" if merge == "" else merge, text, sum((p.images for p in parts), []), sum((p.formulas for p in parts), [])))
                        col += span

    visit(body)
    return out


def opened(data: bytes | None, limits: Limits = Limits()) -> tuple:
    """(members, relationships, blocks, problems) of one package; nothing is unpacked before it passes its limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data or b""))
        problems = preflight(archive, len(data), limits)
        if problems:
            return [], [], [], problems
        own, default = content_types(archive)
        related = relationships(archive)
        if problems := main_part_problems(own, related):
            return [], [], [], problems
        members = [(i.filename, member_kind(i.filename), i.file_size, i.compress_size, own.get(i.filename, default.get(i.filename.rpartition(".")[2].lower()))) for i in archive.infolist()]
        body = ET.fromstring(archive.read(REQUIRED[2])).find("{*}body")
        return members, related, [] if body is None else body_blocks(body), [] if body is not None else ["MISSING_BODY"]
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, NotImplementedError, EOFError, OSError, RuntimeError) as e:
        return [], [], [], [f"INVALID_PACKAGE:{type(e).__name__}"]


@vectorized(SCHEMA)
def package(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([opened(d) for d in data], columns=["members", "relationships", "blocks", "problems"])


def read_packages(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """(path, package) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", package("content").alias("package"))


def rows(packages: DataFrame, what: str, *keys: str) -> DataFrame:
    """`members`, `relationships` or `blocks` as a table under the packages' keys."""
    return packages.select(*keys, F.inline(f"package.{what}"))


def row_spans(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells that start a span, with the rows that continue it below: islands per column."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "block", "col").orderBy("row")
    starts = F.sum((~F.col("merge").eqNullSafe("continue")).cast("int")).over(w)
    g = cells.where("kind = 'cell'").withColumn("span", starts)
    whole = W.partitionBy(*keys, "block", "col", "span")
    return g.withColumn("rowspan", F.count("*").over(whole)).where(~F.col("merge").eqNullSafe("continue")).drop("span")


def list_ordinals(blocks: DataFrame, *keys: str) -> DataFrame:
    """Numbered paragraphs counted per list and level, never from the start again."""
    from pyspark.sql import Window as W

    numbered = blocks.where("num_id is not null")
    return numbered.withColumn("ordinal", F.row_number().over(W.partitionBy(*keys, "num_id", F.coalesce("level", F.lit(0))).orderBy("block")))


def build(paragraphs: list[tuple[str, str]]) -> bytes:
    """A small package of (style, text) paragraphs."""
    from xml.sax.saxutils import escape, quoteattr

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val={quoteattr(s)}/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    parts = {
        REQUIRED[0]: '<Types xmlns="t"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="rels"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        REQUIRED[1]: '<Relationships xmlns="r"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        REQUIRED[2]: f"<w:document {w}><w:body>{body}</w:body></w:document>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in parts.items():
            z.writestr(path, text)
    return out.getvalue()


@vectorized("binary")
def built(paragraphs: pd.Series) -> pd.Series:
    """Packages of arrays of struct(style, text)."""
    return pd.Series([build([(p["style"], p["text"]) for p in ps]) for ps in paragraphs])
