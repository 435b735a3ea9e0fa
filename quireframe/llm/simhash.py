"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word
shingles, A-Z lower-cased and other letters as they are. Two fingerprints link if they differ in at most ``distance`` bits, and
documents of linked fingerprints share a component.

Equal fingerprints meet first, so that groups of exact copies are one entry from
then on. Distinct fingerprints are cut into blocks of bits; two that differ in
at most d bits agree in all but d blocks, so it is enough to search among those
that share some choice of ``blocks - d`` of them. Within such a group the
fingerprints are sorted by Gray rank, neighbours are gathered into nodes, level
by level, and every node holds the bits that all below it share and that its
parent does not. A search goes down from the root, adds up the differences in
shared bits and drops a node, with all below it, once they exceed d. A node
whose members are all in the searcher's component already is dropped as well:
only connectivity is asked for, and dense groups of near copies cost little more
than their size. Every group gives a tree of links, no more than it has members. A
group of more than ``LARGE`` fingerprints is dealt into parts and searched by pairs
of parts, each a task of its own, so that no task holds more than two parts.

Links at 4 bits are the contract's: near copies whose fingerprints lie further apart
are not linked (at the driver's count, 0.59 of those planted are).

Defined results: a text without words has fingerprint zero and is linked like
any other; null is such a text. Rows of null id form components like others, but
the component's id is the least non-null id in it (null if there is none). Equal
rows share a component. Of a component one row stays after dedup: that of its least
id, and of the least text hash among rows of that id, whichever of the rows equal in
both. Texts of any length are worked whole. Other columns are kept as they are,
whatever their names. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, col

SEED = 42
FANOUT = 16
#: Distinct fingerprints a group should hold on average; with more fingerprints, more blocks are shared.
GROUP = 64
BLOCKS = (5, 6, 7, 8)
#: Fingerprints of a group that are searched in one task; larger groups are dealt out.
LARGE = 100_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SHIFT = (np.arange(8) * 256).astype(np.int64)
_ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hash_of = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    h = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    # How often each value of each byte occurs, times the bits of that value.
    seen = np.bincount((h.astype("<u8").view(np.uint8).reshape(n, 8) + _SHIFT).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc, thash, fp): Spark's hash of the text, and its fingerprint as a signed long."""
    picked = docs.select(col(id_col).alias("doc"), F.xxhash64(col(text_col)).alias("thash"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc", "thash", "fp"])

    return picked.mapInArrow(run, f"doc {picked.schema[0].dataType.simpleString()}, thash long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Nodes over distinct fingerprints in Gray order; level 0 has the fingerprints, the last level one root."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT) -> None:
        self.fps, self.fanout = fps, fanout
        full = np.full(len(fps), ~np.uint64(0))
        masks, values = [full], [fps]
        while len(values[-1]) > 1:
            at = np.arange(0, len(values[-1]), fanout)
            ones, zeros = np.bitwise_and.reduceat(values[-1] & masks[-1], at), np.bitwise_and.reduceat(~values[-1] & masks[-1], at)
            masks.append(ones | zeros)
            values.append(ones)
        # What a node shares beyond its parent.
        self.own = [m & ~np.repeat(up, fanout)[: len(m)] for m, up in zip(masks, [*masks[1:], np.zeros(1, np.uint64)], strict=True)]
        self.values = values

    def links(self, distance: int) -> np.ndarray:
        """Label of each fingerprint: the least index reachable over links of at most ``distance`` bits."""
        n = len(self.fps)
        label = np.arange(n)
        done, step = 0, 32
        while done < n:
            who = np.arange(done, min(n, done + step))
            done, step = done + step, min(step * 2, 2048)
            one = self._uniform(label)
            node, q, differ = np.zeros(len(who), np.int64), who, np.zeros(len(who), np.int64)
            for level in range(len(self.values) - 1, -1, -1):
                differ = differ + np.bitwise_count((self.fps[q] ^ self.values[level][node]) & self.own[level][node])
                keep = (differ <= distance) & (one[level][node] != label[q])
                node, q, differ = node[keep], q[keep], differ[keep]
                if level:
                    width = len(self.values[level - 1])
                    child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    inside = child < width
                    node, q, differ = child[inside], np.repeat(q, self.fanout)[inside], np.repeat(differ, self.fanout)[inside]
            label = _join(label, q, node)
        return label

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all below a node have, or -1."""
        out = [label]
        while len(out) < len(self.values):
            at = np.arange(0, len(out[-1]), self.fanout)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each set's least label."""
    a, b = label[a], label[b]
    root = np.arange(len(label))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root[label]


def plan_blocks(n: int, distance: int, group: int = GROUP) -> tuple[int, list[tuple[int, ...]]]:
    """(number of blocks, the choices of blocks to agree in) for n distinct fingerprints."""
    for blocks in (b for b in BLOCKS if b > distance):
        if n / 2.0 ** (64 * (blocks - distance) // blocks) <= group:
            break
    return blocks, list(combinations(range(blocks), blocks - distance))


def links(distinct: DataFrame, *, distance: int = 4, n: int | None = None, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect just what links of at most ``distance`` bits do."""
    if not 0 < distance < max(BLOCKS):
        raise ValueError("distance must be from 1 to 7")
    blocks, choices = plan_blocks(distinct.count() if n is None else n, distance, group)
    assert comb(blocks, blocks - distance) == len(choices)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for choice in choices:
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in choice)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = distinct.select(
        "fp",
        F.inline(F.array(*[F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])),
    )

    def of_group(t: pa.Table) -> pa.Table:
        fps = t.column("fp").to_numpy().view(np.uint64)
        if len(fps) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        label = GrayIndex(fps).links(distance)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": fps[label[own]].view(np.int64), "b": fps[own].view(np.int64)})

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of one sorted partition, one after another."""
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in ("choice", "key", "parts")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                now = tuple(k[s] for k in keys)
                if held and now != at:
                    yield from of_group(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(b.slice(s, e - s))
                at = now
        if held:
            yield from of_group(pa.Table.from_batches(held)).to_batches()

    parted = _dealt(keyed, large).repartition("choice", "key", "parts").sortWithinPartitions("choice", "key", "parts")
    return parted.mapInArrow(of_part, "a long, b long").distinct()


def _dealt(keyed: DataFrame, large: int) -> DataFrame:
    """``keyed`` with ``parts``, 0 but in groups of more than ``large`` rows.

    Those fall into parts by hash, and every row goes to each pair of parts that has its own, so that any two
    rows of a group meet in a task of two parts.
    """
    sizes = keyed.groupBy(F.col("choice").alias("l_choice"), F.col("key").alias("l_key")).agg(F.count("*").alias("size")).where(F.col("size") > large)
    sizes = checkpoint(sizes)
    if sizes.isEmpty():
        return keyed.withColumn("parts", F.lit(0).cast("long"))
    joined = keyed.join(sizes, (F.col("choice") == F.col("l_choice")) & (F.col("key") == F.col("l_key")), "left")
    count = F.ceil(F.col("size") / large)
    own = F.pmod(F.xxhash64("fp"), count)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda j: F.greatest(own, j) * (1 << 31) + F.least(own, j) + 1)
    return joined.select("fp", "choice", "key", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("parts"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Each round, every node points its neighbours at the least it knows (large star), then gathers what points
    at it from below (small star); chains halve with each round.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        around = both(e)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = checkpoint(small.select("e.*").where("a != b").distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per row of ``docs``: doc (its id), thash (of its text), fp, root (least fingerprint reachable), component_id (least id reachable)."""
    fps = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc").alias("least")))
    linked = components(links(distinct.select("fp"), distance=distance))
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpoint(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("c_fp"), "root", "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("c_fp")).drop("c_fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: id, fp (signed), fingerprint (16 hexadecimal digits), component_id (least id reachable)."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped(docs, id_col=id_col, **options).select(F.col("doc").alias(id_col), "fp", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    found = grouped(docs, id_col=id_col, text_col=text_col, **options)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), F.col("doc").alias("doc"), F.col("thash").alias("thash"))).alias("b")).select("b.doc", "b.thash")

    def keys(doc: Column, thash: Column) -> list[Column]:
        """Without nulls, so that the join deals rows out as the window wants them."""
        return [F.coalesce(doc.cast("string"), F.lit("")).alias("k_doc"), doc.isNull().alias("k_null"), thash.alias("k_hash")]

    names = ["k_doc", "k_null", "k_hash"]
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *keys(col(id_col), F.xxhash64(col(text_col))))
    rows = rows.join(best.select(*keys(F.col("doc"), F.col("thash"))), names, "left_semi")
    repeat = F.row_number().over(W.partitionBy(*names).orderBy("k_hash"))
    return rows.withColumn("n", repeat).where("n = 1").select("row.*")
