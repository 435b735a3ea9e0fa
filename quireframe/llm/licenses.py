"""License scans by ordered signature rules.

A text is reduced to its lower-case words with single blanks between them. One
pass of a keyword automaton finds which keywords occur; a rule's regex runs only
if one of its keywords does. Rules are ordered: a detection whose interval lies
within that of a kept detection of an earlier rule, or of a longer one of the
same rule, is suppressed. Base rules, the plain phrases, are counted in full
before suppression and their labels always stay. Kept intervals that no other holds
are held in order of their starts, so that suppression takes a search a detection.

Rules come from lists of fixed values: phrases written one by one, names of families
crossed with their versions, and identifiers of the package data exchange form.

Defined results: null and empty texts have no words, no labels and score 0. Of equal
intervals the one of the earlier rule is kept, and of one rule's the earlier. Rows
equal in id and text are separate rows of the result. Texts of any length are scanned
whole. Other columns are never read, whatever their names. No documents give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, col


@dataclass(frozen=True)
class Signature:
    """label, pattern over normalised words, keywords of which one must occur, confidence, base."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    confidence: float
    base: bool = False


# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Families of licence names. name pattern, keyword, label stem, versions ("" for none).
FAMILIES = (
    (r"gnu lesser general public licen[cs]e|lgpl", ("lesser general public", "lgpl"), "lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    (r"gnu affero general public licen[cs]e|agpl", ("affero", "agpl"), "agpl", ("1 0", "3 0", "3")),
    (r"gnu library general public licen[cs]e", ("library general public",), "lgpl", ("2 0", "2")),
    (r"gnu general public licen[cs]e|gnu gpl|gpl", ("general public", "gpl"), "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    (r"gnu free documentation licen[cs]e|gfdl", ("free documentation", "gfdl"), "gfdl", ("1 1", "1 2", "1 3")),
    (r"apache software licen[cs]e|apache licen[cs]e|apache", ("apache",), "apache", ("1 0", "1 1", "2 0", "2")),
    (r"mozilla public licen[cs]e|mpl", ("mozilla public", "mpl"), "mpl", ("1 0", "1 1", "2 0")),
    (r"eclipse public licen[cs]e|epl", ("eclipse public", "epl"), "epl", ("1 0", "2 0")),
    (r"common public licen[cs]e", ("common public",), "cpl", ("1 0",)),
    (r"common development and distribution licen[cs]e|cddl", ("development and distribution", "cddl"), "cddl", ("1 0", "1 1")),
    (r"european union public licen[cs]e|eupl", ("european union public", "eupl"), "eupl", ("1 0", "1 1", "1 2")),
    (r"artistic licen[cs]e", ("artistic",), "artistic", ("1 0", "2 0")),
    (r"academic free licen[cs]e|afl", ("academic free", "afl"), "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    (r"open software licen[cs]e|osl", ("open software licen", "osl"), "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    (r"zope public licen[cs]e", ("zope public",), "zpl", ("1 1", "2 0", "2 1")),
    (r"boost software licen[cs]e", ("boost software",), "bsl", ("1 0",)),
    (r"business source licen[cs]e", ("business source",), "busl", ("1 0", "1 1")),
    (r"python software foundation licen[cs]e|psf licen[cs]e", ("python software", "psf licen"), "psf", ("2", "2 0")),
    (r"php licen[cs]e", ("php licen",), "php", ("3 0", "3 01")),
    (r"lucent public licen[cs]e", ("lucent public",), "lpl", ("1 0", "1 02")),
    (r"ibm public licen[cs]e", ("ibm public",), "ipl", ("1 0",)),
    (r"sil open font licen[cs]e|open font licen[cs]e", ("open font",), "ofl", ("1 0", "1 1")),
    (r"server side public licen[cs]e|sspl", ("server side public", "sspl"), "sspl", ("1", "1 0")),
    (r"microsoft public licen[cs]e", ("microsoft public",), "ms-pl", ("",)),
    (r"microsoft reciprocal licen[cs]e", ("microsoft reciprocal",), "ms-rl", ("",)),
    (r"open database licen[cs]e|odbl", ("open database", "odbl"), "odbl", ("1 0",)),
    (r"cecill", ("cecill",), "cecill", ("1 0", "1 1", "2 0", "2 1")),
    (r"latex project public licen[cs]e|lppl", ("latex project", "lppl"), "lppl", ("1 0", "1 1", "1 2", "1 3c")),
    (r"mulan permissive software licen[cs]e|mulan psl", ("mulan",), "mulanpsl", ("1", "2")),
    (r"reciprocal public licen[cs]e", ("reciprocal public",), "rpl", ("1 1", "1 5")),
    (r"q public licen[cs]e", ("q public",), "qpl", ("1 0",)),
    (r"sun public licen[cs]e", ("sun public",), "spl", ("1 0",)),
    (r"netscape public licen[cs]e", ("netscape public",), "npl", ("1 0", "1 1")),
    (r"apple public source licen[cs]e", ("apple public",), "apsl", ("1 0", "1 1", "1 2", "2 0")),
)

# Hand-written signatures without versions. label, pattern, keywords, confidence.
PHRASES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",), 1.0),
    ("mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit(?: x11)? licen[cs]e", ("mit licen", "mit x11"), 0.95),
    ("mit", r"mit licen[cs]e", ("mit licen",), 0.8),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", ("neither the name of",), 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", ("advertising materials",), 1.0),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions in binary",), 0.9),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[cs]e", ("bsd",), 0.9),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd(?: style)? licen[cs]e", ("bsd",), 0.9),
    ("bsd", r"bsd(?: style| type)? licen[cs]e", ("bsd",), 0.75),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission to use copy",), 1.0),
    ("isc", r"isc licen[cs]e", ("isc licen",), 0.85),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", ("provided as is",), 0.9),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", ("zlib",), 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 1.0),
    ("unlicense", r"the unlicen[cs]e", ("unlicen",), 0.85),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", ("public domain",), 0.85),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", ("wtfpl", "you want to public"), 0.95),
    ("beerware", r"beer ?ware licen[cs]e", ("beer",), 0.9),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", ("cc0", "creative commons zero"), 0.9),
    ("proprietary", r"all rights reserved", ("all rights reserved",), 0.5),
    ("proprietary", r"proprietary and confidential|unauthori[sz]ed copying of this", ("proprietary", "copying of this"), 0.8),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", ("copyright",), 0.4),
    ("gpl", r"this program is free software you can redistribute it and or modify", ("free software you can",), 0.95),
    ("apache-2.0", r"you may obtain a copy of the licen[cs]e at https? www apache org licenses license 2 0", ("www apache org",), 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", ("unless required by applicable law",), 0.95),
    ("gpl", r"gnu general public licen[cs]e for more details", ("general public",), 0.9),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", ("general public",), 0.95),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e", ("lesser general public",), 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify", ("this library is free software",), 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", ("affero",), 0.95),
    ("agpl", r"remote network interaction use with the gnu general public licen[cs]e", ("remote network interaction",), 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", ("this permission notice shall",), 0.95),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to", ("provided as is without warranty",), 0.85),
    ("mit", r"expat licen[cs]e", ("expat",), 0.85),
    ("mit-0", r"mit no attribution", ("mit no attribution",), 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source",), 0.95),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|authors?) (?:and contributors )?as is", ("this software is provided by the",), 0.9),
    ("bsd-2-clause", r"bsd 2 clause(?: simplified)?(?: licen[cs]e)?", ("bsd 2 clause",), 0.9),
    ("bsd-3-clause", r"bsd 3 clause(?: new or revised)?(?: licen[cs]e)?", ("bsd 3 clause",), 0.9),
    ("bsd-4-clause", r"bsd 4 clause(?: original)?(?: licen[cs]e)?", ("bsd 4 clause",), 0.9),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", ("zero clause", "0bsd"), 0.9),
    ("isc", r"isc style licen[cs]e", ("isc style",), 0.8),
    ("zlib", r"altered source versions must be plainly marked as such", ("altered source versions",), 1.0),
    ("libpng", r"libpng licen[cs]e", ("libpng licen",), 0.85),
    ("ncsa", r"university of illinois ncsa open source licen[cs]e", ("ncsa open source",), 0.95),
    ("postgresql", r"postgresql licen[cs]e", ("postgresql licen",), 0.9),
    ("openssl", r"openssl licen[cs]e|this product includes software developed by the openssl project", ("openssl",), 0.9),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", ("w3c software",), 0.9),
    ("vim", r"vim licen[cs]e", ("vim licen",), 0.8),
    ("ruby", r"ruby licen[cs]e", ("ruby licen",), 0.8),
    ("perl", r"same terms as perl itself", ("same terms as perl",), 0.9),
    ("json", r"the software shall be used for good not evil", ("used for good not evil",), 1.0),
    ("icu", r"icu licen[cs]e", ("icu licen",), 0.8),
    ("hpnd", r"historical permission notice and disclaimer", ("historical permission notice",), 0.95),
    ("upl-1.0", r"universal permissive licen[cs]e", ("universal permissive",), 0.9),
    ("blueoak", r"blue oak model licen[cs]e", ("blue oak model",), 0.9),
    ("elastic", r"elastic licen[cs]e(?: 2 0)?", ("elastic licen",), 0.9),
    ("commons-clause", r"commons clause(?: licen[cs]e)?(?: condition)?", ("commons clause",), 0.85),
    ("hippocratic", r"hippocratic licen[cs]e", ("hippocratic",), 0.9),
    ("openrail", r"(?:creative ml )?open ?rail(?: m| ?\+\+ ?m)?(?: licen[cs]e)?", ("openrail", "open rail"), 0.8),
    ("odc-by", r"open data commons attribution licen[cs]e|odc by", ("open data commons attribution", "odc by"), 0.9),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", ("public domain dedication", "pddl"), 0.9),
    ("ogl", r"open government licen[cs]e", ("open government licen",), 0.9),
    ("ogl", r"open gaming licen[cs]e", ("open gaming licen",), 0.8),
    ("fal", r"free art licen[cs]e|licence art libre", ("free art licen", "art libre"), 0.9),
    ("gpl-classpath", r"classpath exception", ("classpath exception",), 0.8),
    ("gpl-linking", r"(?:gcc runtime library|linking|font) exception", ("runtime library exception", "linking exception", "font exception"), 0.7),
    ("proprietary", r"may not be (?:reproduced|copied|distributed|used) (?:in any form )?without (?:the )?(?:express |prior )?(?:written )?permission", ("may not be",), 0.7),
    ("proprietary", r"for internal use only", ("internal use only",), 0.5),
    ("proprietary", r"no part of this (?:publication|work|document|book) may be reproduced", ("no part of this",), 0.8),
    ("proprietary", r"end user licen[cs]e agreement|eula", ("end user licen", "eula"), 0.7),
    ("non-commercial", r"for (?:non commercial|noncommercial) (?:use|purposes) only|(?:non commercial|noncommercial) use only", ("commercial",), 0.7),
    ("research-only", r"for (?:academic|research|educational) (?:use|purposes) only", ("use only", "purposes only"), 0.6),
    ("public-domain", r"this work is in the public domain|no known copyright restrictions", ("public domain", "no known copyright"), 0.85),
)
# Identifiers of the package data exchange form, as normalised words, whose label is the words joined by dashes.
SPDX = (
    "mit", "mit 0", "isc", "zlib", "0bsd", "unlicense", "wtfpl", "beerware", "postgresql", "ncsa", "x11", "curl", "ntp", "json", "vim", "libpng",
    "bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 3 clause", "bsd 3 clause clear", "bsd 4 clause", "bsl 1.0", "apache 1.0", "apache 1.1", "apache 2.0",
    "artistic 1.0", "artistic 2.0", "cc0 1.0", "cc by 4.0", "cc by sa 4.0", "cc by nc 4.0", "cc by nd 4.0", "cc by nc sa 4.0", "cc by nc nd 4.0", "ofl 1.1", "odbl 1.0", "upl 1.0",
    "ms pl", "ms rl", "mulanpsl 2.0", "eupl 1.1", "eupl 1.2", "epl 1.0", "epl 2.0", "mpl 1.1", "mpl 2.0", "cddl 1.0", "cddl 1.1", "sspl 1.0", "busl 1.1", "elastic 2.0", "blueoak 1.0.0", "hpnd", "icu", "openssl", "ruby", "php 3.01", "python 2.0", "psf 2.0", "w3c", "zpl 2.1",
)
CC_PARTS = (("by", "attribution"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
GRANTS = r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of the )?(?:{name})"


def _dashed(words: str) -> str:
    return words.replace(" ", "-")


def signatures() -> tuple[Signature, ...]:
    """All rules, strongest first: whole texts, versioned names, grants, bare names, then the base phrases."""
    out = [Signature(label, p, k, c) for label, p, k, c in PHRASES if c >= 0.95]
    for name, keys, stem, versions in FAMILIES:
        for v in (v for v in versions if v):
            label = f"{stem}-{v.replace(' ', '.')}" + ".0" * (" " not in v)
            said = rf"(?:{name}) (?:version |v)?{v}(?! ?[0-9])"
            out.append(Signature(f"{label}-or-later", rf"(?:{said}) or (?:\(?at your option\)? )?(?:any )?later(?: version)?", keys, 0.98))
            out.append(Signature(label, GRANTS.format(name=said), keys, 0.97))
            out.append(Signature(label, said, keys, 0.95))
            out.append(Signature(label, rf"{stem}v{v.replace(' ', ' ?')}(?! ?[0-9])", (f"{stem}v",), 0.95))
            out.append(Signature(label, rf"spdx license identifier {stem} {v}(?: only| or later)?", ("spdx",), 1.0))
    out += [Signature(_dashed(x), rf"spdx license identifier {x.replace('.', ' ')}(?! [0-9])", ("spdx license identifier",), 1.0) for x in SPDX]
    for short, long in CC_PARTS:
        for v in CC_VERSIONS:
            label = f"cc-{_dashed(short)}-{v.replace(' ', '.')}"
            out.append(Signature(label, rf"cc {short} {v}(?! ?[0-9])", (f"cc {short}",), 0.95))
            out.append(Signature(label, rf"creative commons {long}(?: international| unported)? (?:licen[cs]e )?{v}", ("creative commons",), 0.97))
        out.append(Signature(f"cc-{_dashed(short)}", rf"creative commons {long}(?: licen[cs]e)?", ("creative commons",), 0.85))
        if short != "by":
            out.append(Signature(f"cc-{_dashed(short)}", rf"cc {short}(?! (?:nc|nd|sa)(?: |$))", (f"cc {short}",), 0.8))
    out += [Signature(label, p, k, c) for label, p, k, c in PHRASES if c < 0.95]
    for name, keys, stem, _ in FAMILIES:
        grant = r"(?:{0})".format("|".join(x for x in name.split("|") if " " in x) or name)
        out.append(Signature(stem, GRANTS.format(name=grant), keys, 0.85))
        out.append(Signature(stem, grant, keys, 0.75))
    out += [Signature(label, phrase, (phrase,), 0.8, base=True) for phrase, label in BASE]
    return tuple(dict.fromkeys(out))


@cache
def _compiled() -> tuple[ahocorasick.Automaton, list[tuple[int, Signature, re.Pattern[bytes]]]]:
    rules = signatures()
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r.keywords:
            by_key.setdefault(k, []).append(i)
    automaton = ahocorasick.Automaton()
    for k, ids in by_key.items():
        automaton.add_word(k, ids)
    automaton.make_automaton()
    # Whole words only: a match begins and ends at a blank or an end of the text.
    return automaton, [(i, r, re.compile(rb"(?<![^ ])(?:" + r.pattern.encode() + rb")(?![^ ])")) for i, r in enumerate(rules)]


def detect(words: list[bytes]) -> list[tuple[int, int, int, bool]]:
    """(rule, first word, end word, kept) of every detection in normalised words, in order of rules, then of places."""
    automaton, rules = _compiled()
    text = b" ".join(words)
    wanted = sorted({i for _, ids in automaton.iter(text.decode("utf-8", "replace")) for i in ids})
    found = []
    for i in wanted:
        _, rule, pattern = rules[i]
        # A place of a base phrase may begin inside another, hence a search from each next word.
        at, word, place = 0, 0, 0
        while m := pattern.search(text, at):
            word += text.count(b" ", place, m.start())
            place = m.start()
            found.append((i, word, word + m[0].count(b" ") + 1, rule.base))
            at = m.end() if not rule.base else m.start() + 1
    # Starts and ends, both rising, of the kept intervals that no other holds.
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for i, start, end, base in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        before = bisect_right(starts, start)
        inside = before > 0 and ends[before - 1] >= end
        if not inside:
            a, b = bisect_left(starts, start), bisect_right(ends, end)
            starts[a:b], ends[a:b] = [start], [end]
        if base or not inside:
            out.append((i, start, end, not inside))
    return out


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<rule:int,label:string,first_word:long,end_word:long,kept:boolean>>"
)


def _scan(texts: list[str | None]) -> dict[str, list]:
    rules = _compiled()[1]
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
    for text in texts:
        words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
        found = detect(words)
        base = [(s, rules[i][1].label) for i, s, _, _ in found if rules[i][1].base]
        out["n_words"].append(len(words))
        out["n_base"].append(len(base))
        out["first_word"].append(min((s for s, _ in base), default=None))
        out["last_word"].append(max((s for s, _ in base), default=None))
        out["base_labels"].append(",".join(sorted({x for _, x in base})))
        out["labels"].append(",".join(sorted({rules[i][1].label for i, _, _, _ in found})))
        out["score"].append(max((rules[i][1].confidence for i, _, _, _ in found), default=0.0))
        out["detections"].append([{"rule": i, "label": rules[i][1].label, "first_word": s, "end_word": e, "kept": k} for i, s, e, k in found])
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, then SCHEMA."""
    picked = docs.select(col(id_col).alias(id_col), col(text_col).alias("__text"))
    schema = f"`{id_col}` {picked.schema[0].dataType.simpleString()}, {SCHEMA}"
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("kept", pa.bool_())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _scan(b.column(1).to_pylist())
            arrays = [pa.array(v, type=t) for v, t in zip(found.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[id_col, *found])

    return picked.mapInArrow(run, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(F.col(f"`{id_col}`"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
