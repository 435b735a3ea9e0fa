from __future__ import annotations

import re

from quireframe.llm import licenses


def scan(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict() for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_hundreds_of_rules():
    rules = licenses.signatures()
    assert len(rules) >= 300 and len({(r.label, r.pattern) for r in rules}) == len(rules)


def test_base_counts_places_and_keeps_labels(spark):
    a, b, c = scan(spark, "Apache-License; apache\nlicense MIT  License, cc.by by", "submit license mitlicense", None)
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"]) == (9, 4, 0, 6)
    assert a["base_labels"] == "apache,cc-by,mit"
    assert (b["n_base"], b["first_word"], b["base_labels"]) == (0, None, "")
    assert (c["n_words"], c["labels"], c["score"]) == (0, "", 0.0)


def test_versioned_rule_suppresses_bare_name_but_not_base(spark):
    (a,) = scan(spark, "This work is licensed under the GNU General Public License, version 3.")
    assert a["base_labels"] == "gpl" and "gpl-3.0" in a["labels"].split(",")
    kept = [d for d in a["detections"] if d["kept"]]
    assert [d["label"] for d in kept] == ["gpl-3.0"]


def test_labels_of_the_corpus_lines(spark):
    a, b, c = scan(spark, "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Neither the name of X nor the names of its contributors")
    assert {"cc-by", "cc-by-nc-4.0"} <= set(a["labels"].split(","))
    assert {"apache", "apache-2.0"} <= set(b["labels"].split(","))
    assert c["labels"] == "bsd-3-clause" and c["n_base"] == 0


def test_identifiers_and_short_forms(spark):
    a, b, c, d = scan(spark, "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD-3-Clause", "released under GPLv3 or LGPLv2.1", "# SPDX-License-Identifier: Apache-2.0")
    assert "mit" in a["labels"].split(",") and "bsd-3-clause" in b["labels"].split(",") and "apache-2.0" in d["labels"].split(",")
    assert {"gpl-3.0", "lgpl-2.1"} <= set(c["labels"].split(","))


def slow_suppressed(found):
    """Kept flags by comparing with every kept interval."""
    kept, out = [], []
    for i, s, e in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
        inside = any(a <= s and e <= b for a, b in kept)
        kept += [] if inside else [(s, e)]
        out.append((i, s, e, not inside))
    return out


def test_suppression_equals_comparing_all(spark):
    import random

    rng = random.Random(3)
    stock = ["licensed under the", "gnu general public license", "version 3", "or any later version", "mit license", "apache license version 2 0", "cc by nc sa 4 0", "creative commons attribution sharealike 3 0", "x", "bsd style license", "all rights reserved", "gnu gpl v2"]
    rules = licenses.signatures()
    for n in (5, 60, 400):
        words = " ".join(rng.choice(stock) for _ in range(n)).encode().split()
        got = licenses.detect(words)
        # Detections before suppression: kept ones and base ones are returned, others found again by their rules alone.
        every = []
        text = b" ".join(words).decode()
        for i, r in enumerate(rules):
            if any(k in text for k in r.keywords):
                at = 0
                pattern = re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")
                while m := pattern.search(text, at):
                    first = text.count(" ", 0, m.start())
                    every.append((i, first, first + m[0].count(" ") + 1))
                    at = m.start() + 1 if r.base else m.end()
        assert got == [x for x in slow_suppressed(every) if x[3] or rules[x[0]].base]


def test_many_detections_take_little_more_than_linear_time():
    import time

    words = b"mit license x gnu general public license version 3".split() * 8000
    began = time.perf_counter()
    assert sum(kept for *_, kept in licenses.detect(words)) >= 16_000
    assert time.perf_counter() - began < 20


def test_query_base_columns_equal_brute_force(spark):
    """The contract's base columns, from the query itself, over all of the smallest table."""
    from quireframe.llm.queries import op2_licenses

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_licenses(spark, "/root/testdata/sf0.001")
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = got.collect()
    assert len(rows) == len(docs) and any(r["n_base"] for r in rows)
    lower = {c: c + 32 for c in range(65, 91)}
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[r["doc_id"]].translate(lower))
        places = []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        labels = sorted({x for _, x in places})
        want = (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(labels))
        assert tuple(r)[1:6] == want and set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_odd_rows(spark, odd_docs, no_docs):
    got = licenses.scan(odd_docs)
    assert got.count() == odd_docs.count()
    empty = [tuple(r)[1:8] for r in got.where("doc_id in (2, 3, 4)").collect()]
    assert empty == [(0, 0, None, None, "", "", 0.0)] * 3
    clash = spark.createDataFrame([(1, "MIT License", "x"), (1, "MIT License", "y"), (None, "cc by", "z")], "doc_id long, text string, labels string")
    assert sorted(tuple(r)[1:6] for r in licenses.scan(clash).collect()) == [(2, 1, 0, 0, "cc-by"), (2, 1, 0, 0, "mit"), (2, 1, 0, 0, "mit")]
    assert licenses.scan(no_docs).count() == 0
