"""Structure of presentation math and of the LaTeX made from it: what is empty, incomplete, unbalanced or no formula."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd

from .latex import PUNCTUATION, Scan, empty, scan
from .mathspan import spans
from .vectorized import vectorized

#: Operands by element: the issue if each is empty; where all the children are one operand, as in a root, none has a number.
OPERANDS: dict[str, tuple[str, ...]] = {
    "mfrac": ("EMPTY_NUMERATOR", "EMPTY_DENOMINATOR"),
    "mroot": ("EMPTY_RADICAND", "EMPTY_ROOT_INDEX"),
    **dict.fromkeys(("msub", "msup", "munder", "mover"), ("EMPTY_BASE", "EMPTY_SCRIPT_OPERAND")),
    **dict.fromkeys(("msubsup", "munderover"), ("EMPTY_BASE", "EMPTY_SCRIPT_OPERAND", "EMPTY_SCRIPT_OPERAND")),
}
# Elements with text of their own, those that give structure, and those that mean something when empty.
TOKENS = frozenset({"mi", "mn", "mo", "mtext", "ms"})
STRUCTURE = frozenset({*OPERANDS, "msqrt", "mtable", "mtr", "mtd", "mfenced", "menclose"})
CONTENT = TOKENS | {"mglyph", "mspace", "annotation", "annotation-xml"}
INVALID = frozenset({"MALFORMED_MATHML", "EMPTY_MATHML_CONTAINER", "UNMATCHED_DELIMITER", "UNMATCHED_ENVIRONMENT", "NO_STRUCTURAL_RESULT"})
NO_FORMULA = frozenset({"PUNCTUATION_FRAGMENT", "NON_FORMULA_TEXT_FRAGMENT"})
_HOLDERS = {"{": "}", "[": "]", "(": ")"}


def tag(e: ET.Element) -> str:
    return re.split(r"[}:]", e.tag)[-1]


def meaningful(e: ET.Element) -> bool:
    return any(tag(x) == "mglyph" or (tag(x) in TOKENS and "".join(x.itertext()).strip()) for x in e.iter())


def semantically_empty(mathml: str | None) -> bool:
    """Whether a tree has no content at all; what does not parse is not called empty."""
    try:
        root = ET.fromstring(mathml or "")
    except ET.ParseError:
        return False
    return not any(tag(e) in CONTENT and (tag(e) in ("mglyph", "mspace") or (e.text or "").strip()) for e in root.iter())


def tree_issues(mathml: str, referenced: bool = True) -> list[str]:
    try:
        root = ET.fromstring(mathml)
    except ET.ParseError:
        return ["MALFORMED_MATHML"]
    nodes = list(root.iter())
    structure = [e for e in nodes if tag(e) in STRUCTURE]
    if not structure and not meaningful(root):
        return ["EMPTY_MATHML_CONTAINER"]
    out: list[str] = []
    for e in structure:
        codes, children = OPERANDS.get(tag(e)), list(e)
        if codes:
            gone = [c for i, c in enumerate(codes) if i >= len(children) or not meaningful(children[i])]
            out += [x for c in gone for x in (c, "EMPTY_REQUIRED_OPERAND", "INCOMPLETE_STRUCTURE")]
            out += ["INCOMPLETE_STRUCTURE"] * (len(children) != len(codes))
        elif tag(e) == "msqrt" and not any(map(meaningful, children)):
            out += ["EMPTY_RADICAND", "EMPTY_REQUIRED_OPERAND", "INCOMPLETE_STRUCTURE"]
        elif tag(e) in ("mtr", "mtd") and not any(map(meaningful, children)):
            out.append("INCOMPLETE_STRUCTURE")
    text = "".join("".join(e.itertext()).strip() for e in nodes if tag(e) in TOKENS).strip()
    if not structure and text:
        if all(c in PUNCTUATION for c in text):
            out.append("PUNCTUATION_FRAGMENT")
        elif len(text) == 1 and "CJK" in unicodedata.name(text, ""):
            out.append("TEXT_ONLY_FRAGMENT" if referenced else "NON_FORMULA_TEXT_FRAGMENT")
    return out


def paired(s: Scan) -> bool:
    """Whether braces, brackets and parentheses close in the order of their opening; escaped ones count for nothing."""
    opened: list[str] = []
    for t in s.tokens:
        if t in _HOLDERS:
            opened.append(_HOLDERS[t])
        elif t in ("}", "]", ")") and (not opened or opened.pop() != t):
            return False
    return not opened


def latex_issues(latex: str, source: str | None = None) -> list[str]:
    whole = spans(latex.strip())
    text = (whole[0].body if len(whole) == 1 and (whole[0].start, whole[0].end) == (0, len(latex.strip())) else latex).strip()
    if not text:
        return ["EMPTY_LATEX"]
    s = scan(text)
    out = ["PUNCTUATION_FRAGMENT"] * all(c in PUNCTUATION for c in text)
    out += ["UNMATCHED_DELIMITER"] * (not paired(s) and not (source == "omml" and text in "()[]"))
    groups = {name: ["".join(g[0]) for i, t in enumerate(s.tokens) if t == name and (g := s.group(i + 1))] for name in (r"\begin", r"\end")}
    out += ["UNMATCHED_ENVIRONMENT"] * (groups[r"\begin"] != groups[r"\end"])
    gone: list[str] = []
    for i, t in enumerate(s.tokens):
        if t in (r"\frac", r"\dfrac", r"\tfrac") and (a := s.group(i + 1)) and (b := s.group(a[1])):
            gone += ["EMPTY_NUMERATOR"] * empty(a[0]) + ["EMPTY_DENOMINATOR"] * empty(b[0])
        elif t == r"\sqrt":
            at = i + 1
            while at < len(s.tokens) and s.tokens[at].isspace():
                at += 1
            at = s.tokens.index("]", at) + 1 if at < len(s.tokens) and s.tokens[at] == "[" and "]" in s.tokens[at:] else at
            gone += ["EMPTY_RADICAND"] * bool((g := s.group(at)) and empty(g[0]))
        elif t in ("_", "^"):
            gone += ["EMPTY_SCRIPT_OPERAND"] * bool((g := s.group(i + 1)) and empty(g[0]))
    return out + [x for c in gone for x in (c, "EMPTY_REQUIRED_OPERAND", "INCOMPLETE_STRUCTURE")]


def verdict(mathml: str | None, latex: str | None, source: str | None = None, referenced: bool = True) -> tuple[str, list[str]]:
    """(verdict, issue codes, each once in order) of a conversion's tree and LaTeX, either of which may be missing."""
    found = (tree_issues(mathml, referenced) if mathml else []) + (latex_issues(latex, source) if latex is not None else [] if mathml else ["NO_STRUCTURAL_RESULT"])
    codes = list(dict.fromkeys(found))
    return "INVALID" if INVALID & set(codes) else "NON_FORMULA_CONTENT" if NO_FORMULA & set(codes) else "SUSPICIOUS" if codes else "VALID", codes


@vectorized("verdict string, issues array<string>, blank boolean")
def structural_verdicts(mathml: pd.Series, latex: pd.Series) -> pd.DataFrame:
    rows = [(*verdict(m, x), semantically_empty(m)) for m, x in zip(mathml, latex, strict=True)]
    return pd.DataFrame(rows, columns=["verdict", "issues", "blank"])
