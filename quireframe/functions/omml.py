"""Office math to LaTeX, by a table of templates per element."""

from __future__ import annotations

import xml.etree.ElementTree as ET

# LaTeX of each structure, in terms of its operands; the n-ary operators.
TEMPLATES = {
    "f": r"\frac{{{num}}}{{{den}}}",
    "sSup": "{e}^{{{sup}}}",
    "sSub": "{e}_{{{sub}}}",
    "sSubSup": "{e}_{{{sub}}}^{{{sup}}}",
    "nary": "{op}_{{{sub}}}^{{{sup}}}{e}",
    "d": r"\left({e}\right)",
}
NARY = {"∫": r"\int", "∑": r"\sum", "∏": r"\prod", "∮": r"\oint"}
HIDDEN = ("rPr", "ctrlPr", "naryPr", "fPr", "dPr", "radPr", "mPr", "eqArrPr", "sSupPr", "sSubPr", "sSubSupPr")


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


class Operands(dict):
    """LaTeX of an element's first child of each name, made when asked for; a missing one is empty."""

    def __init__(self, e: ET.Element) -> None:
        super().__init__()
        self.e = e

    def __missing__(self, key: str) -> str:
        if key == "op":
            sign = self.e.find("{*}naryPr/{*}chr")
            sign = "∫" if sign is None else next(iter(sign.attrib.values()), "∫")
            return NARY.get(sign, sign)
        child = self.e.find(f"{{*}}{key}")
        return "" if child is None else latex(child)


def latex(e: ET.Element) -> str:
    kind = name(e)
    if kind == "t":
        return e.text or ""
    if kind in TEMPLATES:
        return TEMPLATES[kind].format_map(Operands(e))
    if kind == "rad":
        o = Operands(e)
        return rf"\sqrt[{o['deg']}]{{{o['e']}}}" if o["deg"] else rf"\sqrt{{{o['e']}}}"
    if kind in ("m", "eqArr"):
        environment, rows = ("matrix", [" & ".join(map(latex, r.findall("{*}e"))) for r in e.findall("{*}mr")]) if kind == "m" else ("aligned", [latex(r) for r in e.findall("{*}e")])
        return rf"\begin{{{environment}}}" + r" \\ ".join(rows) + rf"\end{{{environment}}}"
    return "".join(latex(c) for c in e if name(c) not in HIDDEN)
