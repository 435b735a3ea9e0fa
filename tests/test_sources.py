"""Packages, binary evidence, tables and books against small hand-made cases."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import xml.etree.ElementTree as ET
import zipfile

import pytest

from quireframe.functions.omml import latex
from quireframe.operators import stats, textbook
from quireframe.operators.packages import grid
from quireframe.sources import binary
from quireframe.sources import packages as K

W = 'xmlns:w="w" xmlns:m="m" xmlns:mc="mc" xmlns:a="a" xmlns:r="r"'


def zipped(body: str, **more: str) -> bytes:
    parts = {
        "[Content_Types].xml": '<Types><Default Extension="PNG" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="x/wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships><Relationship Id="r1" Type="x/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        **more,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def test_main_part_has_to_be_declared_and_related():
    types = '<Types><Override PartName="/word/document.xml" ContentType="main"/></Types>'
    assert K.opened(zipped("", **{"[Content_Types].xml": types}))[3] == ["MAIN_PART_NOT_DECLARED"]
    outside = '<Relationships><Relationship Id="r1" Type="x/officeDocument" Target="word/document.xml" TargetMode="External"/></Relationships>'
    assert K.opened(zipped("", **{"_rels/.rels": outside}))[3] == ["MAIN_PART_NOT_RELATED"]


def test_blocks_of_a_package():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r><w:del><w:r><w:t>no</w:t></w:r></w:del><w:ins><w:r><w:t>c</w:t></w:r></w:ins></w:p>'
        '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText>EQ \\f(1,2)</w:instrText><w:fldChar w:fldCharType="separate"/><w:t>shown</w:t><w:fldChar w:fldCharType="end"/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
        '<w:sdt><w:sdtContent><w:p><mc:AlternateContent><mc:Choice><a:blip r:embed="rId5" xmlns:r="rel"/></mc:Choice><mc:Fallback><w:t>old</w:t></mc:Fallback></mc:AlternateContent><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:p></w:sdtContent></w:sdt>'
        '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr>'
        '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    _, _, blocks, problems = K.opened(zipped(body))
    assert problems == []
    assert blocks[0] == (0, "paragraph", "H1", "7", 1, None, None, None, None, "a\tbc", [], [])
    assert blocks[1][9] == r"$\frac{1}{2}$link" and blocks[1][11] == [r"\frac{1}{2}"]
    assert blocks[2][9] == "$x$" and blocks[2][10] == ["rId5"]
    assert [(b[5], b[6], b[7], b[8], b[9]) for b in blocks[3:]] == [(0, 0, 2, "restart", "A"), (0, 2, 1, None, ""), (1, 0, 2, "continue", ""), (1, 2, 1, None, "B")]


def test_members_and_relationships():
    rels = '<Relationships><Relationship Id="a" Type="t" Target="media/i.png"/><Relationship Id="b" Type="t" Target="../../x"/><Relationship Id="c" Type="t" Target="http://x" TargetMode="External"/></Relationships>'
    members, found, _, _ = K.opened(zipped("", **{"word/_rels/document.xml.rels": rels, "word/media/i.png": "xx"}))
    assert ("word/media/i.png", "media", 2, 2, "image/png") in members and any(m[0] == "word/document.xml" and m[4].endswith("main+xml") for m in members)
    assert {(r[0], r[1], r[4], r[5]) for r in found} == {("", "r1", False, "word/document.xml"), ("word/document.xml", "a", False, "word/media/i.png"), ("word/document.xml", "b", False, None), ("word/document.xml", "c", True, None)}


@pytest.mark.parametrize("data, problem", [(None, "INVALID_PACKAGE"), (b"", "INVALID_PACKAGE"), (b"PK\3\4 cut", "INVALID_PACKAGE"), (zipped("<w:p>"), "INVALID_PACKAGE"), (zipped("", **{"../up": "x"}), "UNSAFE_MEMBER")])
def test_broken_packages_are_data(data, problem):
    assert K.opened(data)[3][0].startswith(problem)


def test_limits_and_missing_parts():
    assert any(p.startswith("MEMBER_TOO_LARGE:word/document.xml") for p in K.opened(zipped("x" * 100), K.Limits(xml=90))[3])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    assert [p for p in K.opened(out.getvalue())[3] if p.startswith("MISSING")] == [f"MISSING_PART:{p}" for p in K.REQUIRED]


def test_files_row_spans_and_ordinals(spark, tmp_path):
    cell = lambda t, v: f'<w:tc><w:tcPr><w:vMerge{v}/></w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>'
    item = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr></w:p>'
    table = f"<w:tbl><w:tr>{cell('a', ' w:val=\"restart\"')}</w:tr><w:tr>{cell('', '')}</w:tr><w:tr>{cell('b', ' w:val=\"restart\"')}</w:tr></w:tbl>"
    (tmp_path / "x.docx").write_bytes(zipped(item + table + item))
    (tmp_path / "y.txt").write_text("no")
    blocks = K.rows(K.read_packages(spark, str(tmp_path)), "blocks", "path").cache()
    assert [(r["text"], r["rowspan"]) for r in K.row_spans(blocks, "path").orderBy("row").collect()] == [("a", 2), ("b", 1)]
    assert [(r["block"], r["ordinal"]) for r in K.list_ordinals(blocks, "path").orderBy("block").collect()] == [(0, 1), (2, 2)]


@pytest.mark.parametrize(
    "xml, want",
    [
        ("<f><fPr/><num><r><t>a</t></r></num><den><r><t>b</t></r></den></f>", r"\frac{a}{b}"),
        ("<rad><deg/><e><r><t>x</t></r></e></rad>", r"\sqrt{x}"),
        ("<rad><deg><r><t>3</t></r></deg><e><r><t>x</t></r></e></rad>", r"\sqrt[3]{x}"),
        ("<sSubSup><e><r><t>a</t></r></e><sub><r><t>i</t></r></sub><sup><r><t>2</t></r></sup></sSubSup>", "{a}".replace("{a}", "a_{i}^{2}")),
        ("<nary><naryPr><chr val='∑'/></naryPr><sub><r><t>i</t></r></sub><sup/><e><r><t>x</t></r></e></nary>", r"\sum_{i}^{}x"),
        ("<nary><sub/><sup/><e/></nary>", r"\int_{}^{}"),
        ("<d><e><r><t>y</t></r></e></d>", r"\left(y\right)"),
        ("<m><mr><e><r><t>1</t></r></e><e><r><t>2</t></r></e></mr><mr><e/><e/></mr></m>", r"\begin{matrix}1 & 2 \\  & \end{matrix}"),
        ("<eqArr><e><r><t>1</t></r></e><e><r><t>2</t></r></e></eqArr>", r"\begin{aligned}1 \\ 2\end{aligned}"),
    ],
)
def test_office_math(xml, want):
    assert latex(ET.fromstring(f"<oMath>{xml}</oMath>")) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td>a</td><td>b</td></tr></table>", (2, 1, 2, None)),
        ("```html\n<table border='1'><tr><th rowspan='2'>a</th><td>b</td></tr><tr><td>c</td></tr></table>\n```", (3, 2, 2, None)),
        ("<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        ("<table><tr><td rowspan='3'>a</td></tr></table>", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        ("<table><tr><td>a</td></tr><tr><td colspan='2'>b</td></tr></table>", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        ("<table><tr><td onclick='x'>a</td></tr></table>", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        ("<table><tr><td>a", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        ("<table><tr><td> </td></tr></table>", (0, None, None, "TABLE_STRUCTURE_INVALID")),
        (" ", (0, None, None, "EMPTY_TABLE_OUTPUT")),
        (None, (0, None, None, "EMPTY_TABLE_OUTPUT")),
    ],
)
def test_table_grids(html, want):
    cells, *rest = grid(html)
    assert (len(cells), *rest) == want


def compound(name: str, stream: bytes) -> bytes:
    """A compound file of one small stream: FAT, directory, mini FAT and mini stream in sectors 0 to 3."""
    entry = lambda n, kind, start, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)
    minis = -(-len(stream) // 64)
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0, 0)
    fat = struct.pack("<4I", 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFE).ljust(512, b"\xff")
    directory = (entry("Root Entry", 5, 3, 64 * minis) + entry(name, 2, 0, len(stream))).ljust(512, b"\0")
    mini = struct.pack(f"<{minis}I", *[*range(1, minis), 0xFFFFFFFE]).ljust(512, b"\xff")
    return head.ljust(512, b"\xff") + fat + directory + mini + stream.ljust(512, b"\0")


def test_equation_streams():
    payload = b"\x03\x01" + b"m" * 100
    native = struct.pack("<HIHIIIII", 28, 0, 0, len(payload), 0, 0, 0, 0) + payload
    assert binary.equation(compound("Equation Native", native + b"tail")) == (payload, "present", None)
    assert binary.equation(compound("Other", native))[1] == "unknown"
    assert binary.equation(compound("Equation", b"short"))[1] == "corrupted"
    assert binary.equation(None)[1] == binary.equation(b"x" * 600)[1] == binary.equation(compound("Equation", native)[:900])[1] == "corrupted"


def test_raster_headers():
    assert binary.raster(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 7, 9)) == ("png", 7, 9)
    assert binary.raster(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4)
    assert binary.raster(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == ("bmp", 5, 6)
    assert binary.raster(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 8, 12)) == ("jpeg", 12, 8)
    assert binary.raster(b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 3, 1, 30, 257, 4, 1, 20)) == ("tiff", 30, 20)
    assert binary.raster(b"") == binary.raster(None) == binary.raster(b"\x89PNG\r\n\x1a\n") == (None, None, None)


def test_headings():
    assert textbook.nest("## A\n#### B\n## C\n```\n# code\n```\n# D\n### E") == "## A\n### B\n## C\n```\n# code\n```\n## D\n### E"
    assert textbook.nest("####### x\n#nothing\n# t") == "####### x\n#nothing\n## t" and textbook.nest("") == "" and textbook.nest(None) is None


@pytest.mark.parametrize(
    "text, want, bad",
    [
        ("a $x$ b", r"a \(x\) b", []),
        ("$$x$$", r"\[x\]", []),
        ("$$\nx\n$$", "\\[\nx\n\\]", []),
        ("$$\n\n$$", "$$\n\n$$", [1, 3]),
        ("cost $5", "cost $5", [1]),
        (r"\$5 and $x$", r"\$5 and \(x\)", []),
        ("`$a` $b$", r"`$a` \(b\)", []),
        ("```\n$\n```\n$y$", "```\n$\n```\n\\(y\\)", []),
        ("$a$$b$", "$a$$b$", [1]),
    ],
)
def test_math_delimiters(text, want, bad):
    assert textbook.delimited(text) == (want, bad)


def test_outline_rules(spark):
    pages = {1: ["# 封面", "目录", "第一章 力 .... 2", "附录 .... 9"], 2: ["![](a.png)", "# 第一章", "x"], 3: ["第一章", "附录", "见第二章", "# 第二章", "", "## 能量", "# 第三节 热"], 4: ["# 第一章 再"], 5: ["# 后记"]}
    rows = [("b", p, i + 1, t) for p, ls in pages.items() for i, t in enumerate(ls)]
    got = textbook.outline(spark.createDataFrame(rows, "book string, page int, line int, text string")).orderBy("page", "line").collect()
    assert [(r["page"], r["line"], r["title"], r["kind"]) for r in got] == [
        (1, 1, "封面与目录", "FRONT_MATTER"), (2, 1, "第一章 力", "CHAPTER"), (3, 2, "附录", "APPENDIX"), (3, 4, "第二章 能量", "CHAPTER"), (5, 1, "后记", "POSTSCRIPT"),
    ]


def test_representative_rows_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice([None, "x", "y"]), rng.sample(["p", "q", "r"], rng.randrange(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string, t array<string>")
    got = [r["id"] for r in stats.representative(df, key="id", dims=["a", "b", "t"], count=25).orderBy("position").collect()]
    dims = {i: {f"a={a}", f"b={b or 'UNKNOWN'}", *(f"t={x}" for x in t)} for i, a, b, t in rows}
    want, covered, left = [], set(), set(dims)
    while len(want) < 25:
        best = min(left, key=lambda i: (-len(dims[i] - covered), hashlib.sha256(str(i).encode()).hexdigest()))
        want.append(best)
        left.remove(best)
        covered |= dims[best]
    assert got == want
    assert stats.representative(df.limit(0), key="id", dims=["a"], count=3).count() == 0


def test_metafile_errors():
    assert binary.metafile(b"")[3] == "truncated METAHEADER"
    head = struct.pack("<HHHIHIH", 1, 9, 0x0300, 0, 0, 0, 0)
    assert binary.metafile(head + struct.pack("<IH", 99, 0))[3] == "truncated or invalid WMF record table"
    comment = struct.pack("<IHHH", 7, 0x0626, 15, 3) + b"abcd"
    assert binary.metafile(head + comment + struct.pack("<IH", 3, 0)) == (False, [(18, 14, 0x0626, b"abc"), (32, 6, 0, None)], [], None)
