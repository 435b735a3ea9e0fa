r"""Delimited math in Markdown text: display between $$ or \[ \], inline between \( \) or single dollar signs.

A scan goes from one opening mark to the next. A display or escaped form ends at its
first closing mark, wherever that is. A single dollar sign opens only if no backslash or
dollar sign stands before it and no dollar sign after it, and what it opens ends at the
next dollar sign, on the same line, not empty, not escaped and not doubled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd

from .vectorized import vectorized

_PAIRS = {"$$": "$$", r"\[": r"\]", r"\(": r"\)"}
_OPENS = re.compile(r"\$\$|\\\[|\\\(|\$")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    body: str


def spans(text: str) -> list[Span]:
    out: list[Span] = []
    at = 0
    while mark := _OPENS.search(text, at):
        i, opening = mark.start(), mark[0]
        at = i + 1
        if closing := _PAIRS.get(opening):
            end = text.find(closing, i + 2)
            if end >= 0:
                out.append(Span(i, end + 2, text[i + 2 : end]))
                at = end + 2
            continue
        if text[max(0, i - 1) : i] in ("\\", "$") or text[i + 1 : i + 2] == "$":
            continue
        end = text.find("$", i + 1)
        body = text[i + 1 : end] if end > 0 else ""
        if body and "\n" not in body and body[-1] != "\\" and text[end + 1 : end + 2] != "$":
            out.append(Span(i, end + 1, body))
            at = end + 1
    return out


def replaced(text: str, by) -> str:
    """``text`` with each span replaced by what ``by`` gives for it."""
    out, at = [], 0
    for s in spans(text):
        out += [text[at : s.start], by(s)]
        at = s.end
    return "".join([*out, text[at:]])


@vectorized("blank boolean, rest string, n int")
def math_parts(values: pd.Series) -> pd.DataFrame:
    """Whether a span has nothing in it, the text with MATH for every span, and how many there are."""
    rows = []
    for v in values:
        found = spans(v or "")
        rows.append((any(not s.body.strip() for s in found), replaced(v or "", lambda s: "MATH"), len(found)))
    return pd.DataFrame(rows, columns=["blank", "rest", "n"])
