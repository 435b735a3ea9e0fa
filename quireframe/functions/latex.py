"""What a scan of LaTeX tells: whether its groups pair up, and what its commands and scripts are given."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .vectorized import vectorized

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\\\Z|\s+|.", re.DOTALL)
_HAN = re.compile("[\u3400-\u9fff]")
# Commands whose operands are looked at, and marks that alone are no content.
FRACTIONS = (r"\frac", r"\dfrac", r"\tfrac")
PUNCTUATION = frozenset("()[]{}.,;:!?。，；？！·•●○")
LIST_MARKS = (r"\bullet", r"\cdot", r"\vdots", r"\ldots", r"\dots")


@dataclass
class Scan:
    """Tokens, and for each opening brace the place of the one that closes it."""

    tokens: list[str]
    closes: dict[int, int]
    balanced: bool

    def group(self, at: int) -> tuple[list[str], int] | None:
        """(tokens, place after) of the group that begins at or after blanks from ``at``."""
        while at < len(self.tokens) and self.tokens[at].isspace():
            at += 1
        end = self.closes.get(at)
        return None if end is None else (self.tokens[at + 1 : end], end + 1)


def scan(text: str) -> Scan:
    tokens = _TOKEN.findall(text)
    closes: dict[int, int] = {}
    opened: list[int] = []
    balanced, sized = True, False
    for i, t in enumerate(tokens):
        if sized and not t.isspace():
            # What \left and \right take groups nothing.
            sized = False
            if t in "()[]{}|." or t.startswith("\\"):
                continue
        if t in (r"\left", r"\right"):
            sized = True
        elif t == "{":
            opened.append(i)
        elif t == "}":
            if opened:
                closes[opened.pop()] = i
            else:
                balanced = False
    return Scan(tokens, closes, balanced and not opened)


def empty(tokens: list[str]) -> bool:
    return all(t.isspace() for t in tokens)


def flat(tokens: list[str]) -> bool:
    return "{" not in tokens and "}" not in tokens


def faults(text: str) -> dict[str, bool]:
    """By issue code, whether the text has it."""
    s = scan(text)
    names: dict[str, list[str]] = {r"\begin": [], r"\end": []}
    fraction = radicand = script = han = False
    for i, t in enumerate(s.tokens):
        if t in names and (got := s.group(i + 1)) and got[0] and flat(got[0]):
            names[t].append("".join(got[0]))
        elif t in FRACTIONS and (first := s.group(i + 1)):
            second = s.group(first[1]) if flat(first[0]) else None
            fraction |= empty(first[0]) or (second is not None and empty(second[0]))
        elif t == r"\sqrt":
            at = i + 1
            while at < len(s.tokens) and s.tokens[at].isspace():
                at += 1
            if at < len(s.tokens) and s.tokens[at] == "[" and "]" in s.tokens[at:]:
                at = s.tokens.index("]", at) + 1
            got = s.group(at)
            radicand |= got is not None and empty(got[0])
        elif t in "_^" and (got := s.group(i + 1)):
            script |= empty(got[0])
            lead = next((x for x in got[0] if not x.isspace()), "")
            han |= flat(got[0]) and lead not in (r"\text", r"\mathrm") and bool(_HAN.search("".join(got[0])))
    return {
        "CONTROL_CHARACTER": any(c < " " and c not in "\t\r\n" for c in text),
        "UNMATCHED_DELIMITER": not s.balanced,
        "UNMATCHED_ENVIRONMENT": names[r"\begin"] != names[r"\end"],
        "EMPTY_FRACTION_OPERAND": fraction,
        "EMPTY_RADICAND": radicand,
        "EMPTY_SCRIPT_OPERAND": script,
        "UNICODE_TEXT_IN_SCRIPT": han,
    }


def marks_only(text: str) -> bool:
    """Nothing but punctuation, one degree sign, or list marks with quads between them."""
    tokens = _TOKEN.findall(text.strip())
    if not tokens:
        return False
    if all(t.isspace() or t in PUNCTUATION for t in tokens):
        return True
    degree = tokens[1:] if tokens[0] == "^" else tokens
    return degree == [r"\circ"] or (all(t in LIST_MARKS for t in tokens[::2]) and all(t == r"\quad" for t in tokens[1::2]) and len(tokens) % 2 == 1)


def repeats(text: str, least: int = 8, most: int = 64, times: int = 5) -> bool:
    """Whether a part of ``least`` to ``most`` characters stands ``times`` times in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for size in range(least, min(most, len(codes) // times) + 1):
        differ = np.flatnonzero(codes[:-size] != codes[size:])
        runs = np.diff(np.concatenate([[-1], differ, [len(codes) - size]])) - 1
        if runs.max(initial=0) >= size * (times - 1):
            return True
    return False


@vectorized("broken string, doubtful string, style string, marks boolean, repeated boolean, commands int, fractions int")
def latex_faults(values: pd.Series) -> pd.DataFrame:
    """Issue codes by severity, comma-joined, and what the gate looks at."""
    out = []
    for v in values:
        text = v or ""
        found = faults(text)
        codes = [",".join(c for c in group if found[c]) for group in (list(found)[:3], list(found)[3:6], list(found)[6:])]
        commands = [t for t in _TOKEN.findall(text) if len(t) > 1 and t[0] == "\\" and t[1].isascii() and t[1].isalpha()]
        out.append((*codes, marks_only(text), len(text) >= 128 and repeats(text), len(commands), sum(t in FRACTIONS for t in commands)))
    return pd.DataFrame(out, columns=["broken", "doubtful", "style", "marks", "repeated", "commands", "fractions"])
