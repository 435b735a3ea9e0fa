from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from quireframe.llm import decontaminate

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= {x for x in grams[g] if x is not None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 7, 10, 11, 40]))) for i in range(30)] + [(30, ""), (31, None), (None, prose(rng, 12))]
    docs = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(5)):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            parts += [" ".join(w[at : at + rng.choice([9, 10, 15, 60])]).upper(), prose(rng, rng.randrange(20))]
        docs.append((i, " ".join(parts)))
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_equals_brute_force_with_and_without_broadcast(spark):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(x[5] for x in want) > 20
    assert rows(decontaminate.decontaminate(d, b)) == want
    assert rows(decontaminate.decontaminate(d, b, broadcast_bytes=0)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 5").first()["text"]
    items = [(1, " ".join(text.split()[20_000:20_030])), (2, "12 34")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows(decontaminate.decontaminate(odd_docs, b)) == brute(docs, items)
    clean = decontaminate.clean_documents(odd_docs, b)
    assert clean.columns == odd_docs.columns and clean.count() == len(docs) - 2
    assert decontaminate.decontaminate(no_docs, b).count() == 0
    none = decontaminate.decontaminate(odd_docs, b.limit(0))
    assert none.where(F.col("contaminated") | (F.col("n_items") > 0)).count() == 0 and none.count() == len(docs)
