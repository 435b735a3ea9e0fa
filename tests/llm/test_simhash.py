from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quireframe.llm import simhash

from .conftest import prose


def slow_fingerprint(text):
    # Words between ASCII white space, A-Z lower-cased, by the contract's letter.
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int]) -> list[int]:
    """Least index reachable."""
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_fingerprint():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 200):
        text = prose(rng, n)
        assert simhash.fingerprint(text, 4) == slow_fingerprint(text)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


def test_fingerprint_lowers_ascii_letters_only(spark):
    rng = random.Random(12)
    text = prose(rng, 60)
    mixed = "".join(rng.choice([c.upper(), c]) for c in text)
    to_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in (mixed, text.upper(), text.title(), "One", "ÀB Éa İSTANBUL ẞtraße ΣΊΣ " + mixed):
        assert simhash.fingerprint(t, 4) == slow_fingerprint(t.translate(to_lower))
    assert simhash.fingerprint("ÀÉ ΣΊΣ", 4) != simhash.fingerprint("àé σίσ", 4)
    docs = spark.createDataFrame([(3, text), (5, text.upper()), (8, mixed), (9, prose(rng, 60))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {3: 3, 5: 3, 8: 3, 9: 9}
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == [3, 9]


@pytest.mark.parametrize("spread", [0, 2, 64])
def test_index_links_what_brute_force_links(spread):
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = centre[rng.integers(0, 40, 900)]
    for _ in range(min(spread, 12)):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    fps = np.unique(fps)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    assert (np.diff(simhash.gray_rank(fps).astype(object)) > 0).all()
    assert simhash.GrayIndex(fps).links(4).tolist() == brute_components(fps.tolist())


@pytest.mark.parametrize(("group", "large"), [(64, 100_000), (0.0001, 100_000), (64, 7)])
def test_links_over_blocks(spark, group, large):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, 500)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    fps = np.unique(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, group=group, large=large)).collect()}
    signed = fps.view(np.int64).tolist()
    groups: dict[int, set] = {}
    for x, c in zip(signed, brute_components(fps.tolist()), strict=True):
        groups.setdefault(c, set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(y for y in signed if found.get(y, y) == r) for r in {found.get(y, y) for y in signed}}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50] + [(500, 600), (600, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[50] == 1 and got[100] == 51 and got[200] == 151 and got[600] == 500


def test_query_equals_brute_force(spark):
    """The contract's columns, from the query itself, over all of the smallest table."""
    from quireframe.llm.queries import op3_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs.sort(key=lambda r: r["doc_id"])
    fps = [slow_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{f:016x}", docs[c]["doc_id"]) for r, f, c in zip(docs, fps, brute_components(fps), strict=True)}
    got = op3_simhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == want


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a, "x", "s"), (1, b, "x", "s"), (2, b.upper(), "y", "s"), (None, a, "z", "s"), (None, c, "p", "s"), (None, c, "q", "s"), (None, c + " ", "r", "s"), (9, "", "e", "s"), (8, None, "e", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, row string")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), (r["text"] or "").lower().strip()) for r in kept.collect())
    assert got == sorted([("1", a.lower()), ("1", b.lower()), ("None", c.lower()), ("8", "")])


def test_odd_rows_and_dedup(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    empty = got.where(F.col("fingerprint") == "0" * 16)
    assert {r["component_id"] for r in empty.collect()} == {2} and empty.count() == 4
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    # Both texts of id 1 stay, as they are no near copies, and so does the one of null id.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "5", "6", "7", "None"]
    assert simhash.near_duplicates(no_docs).count() == simhash.deduplicated(no_docs).count() == 0
