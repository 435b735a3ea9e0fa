from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quireframe.llm import langid, toxicity
from quireframe.llm.common import HELD_OUT, fold_of

from .conftest import DOC_SCHEMA, prose

STOCK = {"xx": "bar zim lor tuk fen gal".split(), "yy": "ostra velin madu kepo siri nul".split(), "zz": "qua xeb wip jot yaf huz".split()}


def corpus(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(STOCK))
        text = prose(rng, rng.randrange(20, 120), STOCK[lang])
        toxic = i % 7 == 0
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilewordo", "vileworda", "grossomat"]))
            text = " ".join(w)
        rows.append((i, text, lang if i % 10 else None, "s", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_folds(spark):
    df = spark.createDataFrame([(1,), (25,), (None,)], "doc_id long").select("doc_id", fold_of(F.col("doc_id")).alias("f"))
    assert [r["f"] for r in df.collect()] == [zlib.crc32(b"1") % 4, zlib.crc32(b"25") % 4, -1]


def test_language_accuracy_on_the_held_out_fold(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    model = langid.fit(docs)
    assert model.langs == ["xx", "yy", "zz"]
    got = langid.predict(docs, model).join(docs.select(F.col("doc_id").alias("doc"), "lang"), "doc").where(fold_of(F.col("doc")) == HELD_OUT)
    assert got.where("lang is not null and lang_pred <> lang").count() == 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_backoff_to_shorter_ngrams(spark):
    rows, _ = corpus()
    model = langid.fit(spark.createDataFrame(rows, DOC_SCHEMA))
    words = langid.Words(pa.array(["velinmadukepo lor"]))
    known = dict(zip(["velinmadukepo", "lor"], np.isin(words.hashes(), model.keys[0]), strict=True))
    scores = model.score(words)
    assert known == {"velinmadukepo": False, "lor": True} and [model.langs[i] for i in scores.argmax(axis=1)] == ["yy", "xx"]


def slow_model(rows):
    """The same model word by word, in plain Python."""
    import collections
    import math
    import unicodedata

    def words_of(text):
        letter = lambda c: unicodedata.category(c)[0] in "LM"
        found = "".join(c if letter(c) else " " for c in text.lower()).split()
        return [w for w in found if any(unicodedata.category(c)[0] == "L" for c in w)]

    def grams(w, n):
        w = f" {w} " if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for w in words_of(text):
            counts[lang, 0][w] += 1
            for n in langid.LENGTHS:
                counts[lang, n].update(grams(w, n))
    langs = sorted({lang for lang, _ in rows})
    score = lambda lang, n, x: math.log10(counts[lang, n][x] / counts[lang, n].total()) if x in counts[lang, n] else math.log10(min(counts[lang, n].values()) / counts[lang, n].total()) - langid.PENALTY
    known = lambda n, x: any(x in counts[lang, n] for lang in langs)

    def word(w):
        if known(0, w):
            return [score(lang, 0, w) for lang in langs]
        for n in langid.LENGTHS:
            if some := [g for g in grams(w, n) if known(n, g)]:
                return [sum(score(lang, n, g) for g in some) / len(some) for lang in langs]
        return [0.0] * len(langs)

    def judge(text):
        w = words_of(text or "")
        if not w:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(word, w), strict=True)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        return langs[best], 1 / sum(10 ** ((t - total[best]) / len(w)) for t in total)

    return judge


def test_language_query_equals_brute_force(spark):
    from quireframe.llm.queries import op6_langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    judge = slow_model([(r["lang"], r["text"] or "") for r in docs if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != HELD_OUT])
    got = {r["doc_id"]: r for r in op6_langid(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = judge(r["text"])
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == HELD_OUT)
        # The slow model keeps all items, so that rare n-grams may tip a close text.
        assert abs(g["score"] - score) < 0.08 and (g["lang_pred"] == lang or score < 0.5)
    known = [r for r in docs if r["lang"] is not None and got[r["doc_id"]]["held_out"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in known) >= 0.95 * len(known)


def test_words_are_letters_and_marks():
    words = langid.Words(pa.array(["² ½ 12 _ !", "हिन्दी भाषा", "Straße’s x\u0301", "\u0301 \u0301", None]))
    assert words.text.tolist() == [1, 1, 2, 2, 2] and words.size[words.which].tolist() == [6, 4, 6, 1, 2]


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(0, "bar zim", "xx"), (1, "² ½", None), (4, "\u0301", None), (6, "हिन्दी भाषा", "hi"), (8, "हिन्दी", None)], "doc_id long, text string, lang string")
    got = {r["doc"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {0: "xx", 1: "und", 4: "und", 6: "hi", 8: "hi"}


def test_many_languages_stay_bounded_and_rare_ones_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORDS_IN_ALL", 2_000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"{chr(0x4E00 + i % 200)}{chr(97 + rng.randrange(26))}" for _ in range(30)), f"l{i % 200:03}") for i in range(1200)]
    rows += [(i, "common words here", "zz") for i in range(1200, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=40)
    assert len(model.langs) == 201 and len(model.lang[0]) <= 201 * 10
    got = langid.predict(docs, model).join(docs.select(F.col("doc_id").alias("doc"), "lang"), "doc")
    assert got.where("lang_pred <> lang").count() == 0
    picked = langid.sampled(docs, id_col="doc_id", text_col="text", lang_col="lang", sample=40).groupBy("lang").count().collect()
    assert max(r["count"] for r in picked) == 40 and len(picked) == 201


def test_samples_do_not_vanish_in_large_tables(spark):
    """Shares below 1e-6: a thousand rows that stand for the least of a far larger table still give a sample."""
    docs = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.lit("bar zim").alias("text"), F.lit("xx").alias("lang"))
    assert langid.sampled(docs, id_col="doc_id", text_col="text", lang_col="lang", sample=2).count() == 2
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, positives=2, unlabelled=2)
    assert np.isfinite(model.bias)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    got = langid.predict(odd_docs, langid.fit(odd_docs))
    assert got.count() == odd_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in got.where("doc in (2, 3, 4, 6)").collect()} == {("und", 0.0)}
    assert langid.predict(odd_docs, langid.fit(no_docs)).where("lang_pred <> 'und'").count() == 0
    assert langid.identified(odd_docs).columns == odd_docs.columns


def test_toxicity_on_the_held_out_fold(spark):
    rows, labels = corpus(1200)
    docs, lab = spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, lab)).where("held_out").collect()
    assert got and all(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in got)


def test_unlabelled_text_is_a_mixture_and_evidence_goes_both_ways():
    """With all rows labelled, the score of a text without evidence is about its share of positives, at any prior."""
    rng = np.random.default_rng(5)
    for prior in (0.1, 0.4):
        toxic = rng.random(4000) < prior
        shows, kind = toxic & (rng.random(4000) < 0.9), rng.random(4000) < np.where(toxic, 0.02, 0.6)
        rows = [np.array([0] * int(a) + [1] * int(b), np.int64) for a, b in zip(shows, kind, strict=True)]
        p = np.flatnonzero(toxic)
        w, bias = toxicity.nnpu([rows[i] for i in p] + rows, np.array([True] * len(p) + [False] * len(rows)), 2, prior)
        none = sum(t for t, r in zip(toxic, rows, strict=True) if not len(r)) / sum(not len(r) for r in rows)
        assert w[0] > 1 and w[1] < 0 and abs(1 / (1 + np.exp(-bias)) - none) < 0.12
    both = toxicity.choose(np.array([90, 5, 50]), np.array([10, 60, 50]), 100, 100)
    assert both.tolist() == [0, 1]


def test_toxicity_query_on_the_whole_table(spark):
    from quireframe.llm.queries import op4_toxicity

    got = op4_toxicity(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    rows = got.collect()
    assert len(rows) == docs and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    judged = got.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in judged}
    assert share[1] >= 0.6 and share[0] <= 0.1


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, none)
    assert toxicity.score(odd_docs, model).where("score <> 0 or predicted <> 0").count() == 0
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd_docs, toxicity.fit(odd_docs, some))
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
