"""Text grammars that need a scan: wrappers around model output, Markdown parts, file identities, canonical JSON."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd

from .mathspan import replaced, spans
from .vectorized import vectorized

# Words and signs that make a dollar-delimited text math, and marks around whole outputs.
MATH_WORDS = ("frac", "times", "div", "sqrt", "pi", "sin", "cos", "tan")
MATH_SIGNS = "\\[{}_^="
OUTER = ((r"\[", r"\]"), (r"\(", r"\)"), ("$$", "$$"), ("$", "$"))
RESERVED = frozenset({"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))})
_WORD = re.compile(r"\b[A-Za-z]+\b")


def without_math(text: str | None) -> tuple[str | None, int]:
    """Text without its delimited math, and how many spans went."""
    return (None, 0) if text is None else (replaced(text, lambda s: ""), len(spans(text)))


def unwrapped(text: str | None) -> tuple[str | None, int]:
    """Text without marks around its math; a lone dollar sign in prose is no mark."""
    if text is None:
        return None, 0
    removed = 0

    def body(s) -> str:
        nonlocal removed
        single = text[s.start] == "$" and text[s.start : s.start + 2] != "$$"
        if single and not any(c in MATH_SIGNS for c in s.body) and not set(_WORD.findall(s.body)) & set(MATH_WORDS):
            return text[s.start : s.end]
        removed += 1
        return s.body

    out = replaced(text, body)
    return out.strip(), removed


def bare_formula(text: str | None) -> str | None:
    """A formula without a code fence and marks around all of it; inner marks and unpaired ones stay."""
    if text is None:
        return None
    text = text.strip()
    lines = text.splitlines()
    if text.startswith("```") and text.endswith("```") and len(lines) > 1:
        text = "\n".join(lines[1:-1]).strip()
    while True:
        found = spans(text)
        if found and (len(found) > 1 or (found[0].start, found[0].end) != (0, len(text))):
            return text
        pair = next(((a, b) for a, b in OUTER if text.startswith(a) and text.endswith(b) and len(text) >= len(a) + len(b)), None)
        if pair is None:
            return text
        text = text[len(pair[0]) : len(text) - len(pair[1])].strip()


def is_markdown(text: str | None) -> bool:
    """Whether a formula's output is prose: math between marks, ideographs, or two words outside groups."""
    if not text:
        return False
    if spans(text):
        return True
    outside, depth = [], 0
    for piece in re.findall(r"\\[A-Za-z]+|\\.|[{}]|[^\\{}]+", text):
        depth += {"{": 1, "}": -1}.get(piece, 0)
        outside.append(piece if depth == 0 and piece[0] not in "\\{}" else "\0")
    return bool(re.search(r"[㐀-鿿]|\b[A-Za-z]{2,}[^\S\0]+[A-Za-z]{2,}\b", "\0".join(outside)))


def document_id(stem: str, sha: str) -> str:
    """A file name without what file systems refuse, at most 80 characters, and twelve digits of the digest."""
    name = re.sub(r"\s+", "_", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", unicodedata.normalize("NFC", stem))).strip(" ._") or "document"
    name = f"document_{name}" if name.upper() in RESERVED else name
    return f"{name[:80].rstrip(' ._') or 'document'}__{sha[:12]}"


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no escapes of what UTF-8 can hold."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@vectorized("without string, removed int, bare string, peeled string, wrappers int, markdown boolean")
def cleaned(values: pd.Series) -> pd.DataFrame:
    """What the functions above make of each text."""
    rows = []
    for v in values:
        (a, n), (b, m) = without_math(v), unwrapped(v)
        rows.append((a, n, b, bare_formula(v), m, is_markdown(v)))
    return pd.DataFrame(rows, columns=["without", "removed", "bare", "peeled", "wrappers", "markdown"])


@vectorized("string")
def document_ids(stems: pd.Series, shas: pd.Series) -> pd.Series:
    return pd.Series([document_id(a or "", b) for a, b in zip(stems, shas, strict=True)])


@vectorized("string")
def canonical_sha(texts: pd.Series) -> pd.Series:
    """Digest of a JSON text's canonical form; null if it is no JSON."""

    def one(t):
        try:
            return hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)
