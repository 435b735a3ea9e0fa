"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of all kinds, labelled or
not, positive or not, are the unlabelled text, which is thus a mixture with the
prior's share of positives. A linear classifier over hashed words and word prefixes
is trained with numpy by the class-prior-corrected risk: with prior p, positives
P and unlabelled U, it minimises

    p * R_P(toxic) + max(0, R_U(clean) - p * R_P(clean))

where R is the mean logistic loss of calling a set by a class. When the second
part falls below zero, that is, when U is fitted better than a mixture with a
share p of positives can be, a step goes against it instead. The prior is the share
of toxic rows among the labelled ones, up to a half, unless it is given.

Features are presences of words and prefixes, in either direction: those whose
frequencies in P and U differ by a log likelihood ratio that chance would give any
of the candidates once in a hundred times. Settings were compared by cross-validation
among the folds 0, 1 and 3; no setting was tried on the held-out fold 2. Training uses at
most ``POSITIVES`` and ``UNLABELLED`` documents, exactly those of least id hash.
Every document is scored, over its whole text.

Defined results: null and empty texts have no features and get the score of the
bias. Rows of null id are never held out and never learned from. An id with more
than one label is toxic if any says so; of documents that share an id, the one of
least text is learned from; equal texts are scored alike, each row on its own. Null
labels are none. Without positives every score is 0. Other columns are never read,
whatever their names. No documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, col, fold_of, stored

POSITIVES = 6_000
UNLABELLED = 18_000
DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)
FEATURES = 4_096
#: A feature has to occur in so many of the documents used.
LEAST = 4
#: Chance of any feature without meaning, over all candidates.
CHANCE = 0.01
CACHE = 300_000
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed: the word, and each of its prefixes that is shorter than it."""
    forms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in forms)


class Extractor:
    """Feature ids of a text, each once; of ``chosen`` only, renumbered, if given."""

    def __init__(self, chosen: np.ndarray | None = None) -> None:
        self.new = None if chosen is None else {int(f): i for i, f in enumerate(chosen)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        if not text:
            return set()
        if len(self.cache) > CACHE:
            self.cache.clear()
        out: set[int] = set()
        cache = self.cache
        for w in set(_WORDS.findall(text.lower())):
            ids = cache.get(w)
            if ids is None:
                ids = features_of(w)
                if self.new is not None:
                    ids = tuple(self.new[i] for i in ids if i in self.new)
                cache[w] = ids
            if ids:
                out.update(ids)
        return out


@dataclass
class Model:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n: int, prior: float, *, epochs: int = 25, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier over presences, by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    batches = max(1, min(len(p), len(u)) // 64)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def margin(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(rows[i]) for i in ids])
        flat = np.concatenate([rows[i] for i in ids]) if lengths.sum() else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        return np.bincount(owner, w[flat], len(ids)) + w[n], flat, owner

    for _ in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(p), batches), np.array_split(rng.permutation(u), batches), strict=True):
            zp, fp, op = margin(a)
            zu, fu, ou = margin(b)
            # Logistic loss: of calling toxic, log(1 + exp(-z)); of calling clean, log(1 + exp(z)).
            clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_toxic, gp_clean, gu_clean = -sigmoid(-zp) / len(a), sigmoid(zp) / len(a), sigmoid(zu) / len(b)
            if clean >= 0:
                gp, gu = prior * gp_toxic - prior * gp_clean, gu_clean
            else:
                gp, gu = prior * gp_clean, -gu_clean
            g = np.bincount(fp, gp[op], n + 1) + np.bincount(fu, gu[ou], n + 1) + decay * w
            g[n] = gp.sum() + gu.sum()
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def choose(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The features whose document frequencies differ more than chance, by log likelihood ratio."""
    a, b = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    pooled = (in_p + in_u + 1) / (n_p + n_u + 2)
    gain = n_p * (a * np.log(a / pooled) + (1 - a) * np.log((1 - a) / (1 - pooled))) + n_u * (b * np.log(b / pooled) + (1 - b) * np.log((1 - b) / (1 - pooled)))
    ok = np.flatnonzero((in_p + in_u >= LEAST) & (gain > np.log(max(1, len(gain)) / CHANCE)))
    return np.sort(ok[np.argsort(-gain[ok], kind="stable")][:FEATURES])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Train on rows outside the held-out fold."""
    train = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull() & (fold_of(col(id_col)) != HELD_OUT))
    train = train.groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).alias("y"))
    got = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0)).alias("p")).first()
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    if not got["p"]:
        return nothing
    prior = min(0.5, got["p"] / got["n"]) if prior is None else prior
    place = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    least = lambda df, n: df.select("id").distinct().orderBy(place, "id").limit(n)
    rows = docs.where(col(id_col).isNotNull() & (fold_of(col(id_col)) != HELD_OUT)).select(col(id_col).alias("id"), col(text_col).alias("text"))
    used = least(train.where(F.col("y") == 1), positives).withColumn("p", F.lit(True)).union(least(rows, unlabelled).withColumn("p", F.lit(False)))
    # Ids of at most ``positives + unlabelled`` rows are broadcast, and as many texts are written out.
    sample = stored(rows.join(F.broadcast(used), "id").groupBy("p", "id").agg(F.min("text").alias("text")).select("p", "text"), "toxicity-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, sums = Extractor(), np.zeros((2, DIMENSIONS), np.int64)
        sizes = np.zeros(2, np.int64)
        for b in batches:
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[int(p), list(extract(text))] += 1
                sizes[int(p)] += 1
        f = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *f]), pa.array([sizes[1], *sums[1, f]]), pa.array([sizes[0], *sums[0, f]])], names=["f", "p", "u"])

    table = sample.mapInArrow(counts, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
    sizes, table = table[table.f == -1], table[table.f >= 0].sort_values("f")
    n_p, n_u = int(sizes.p.sum()), int(sizes.u.sum())
    if not n_p or not n_u:
        return nothing
    ids = table.f.to_numpy()
    chosen = ids[choose(table.p.to_numpy(), table.u.to_numpy(), n_p, n_u)]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(chosen)
        for b in batches:
            found = [sorted(extract(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["p", "ids"])

    got_rows = sorted(((r["p"], r["ids"]) for r in sample.mapInArrow(picked, "p boolean, ids array<int>").toLocalIterator()), key=lambda x: (x[0], x[1]))
    ids_of = [np.array(x, np.int64) for _, x in got_rows]
    weights, bias = nnpu(ids_of, np.array([p for p, _ in got_rows]), len(chosen), prior)
    return Model(chosen, weights, bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted."""
    picked = docs.select(col(id_col).alias("doc"), (fold_of(col(id_col)) == HELD_OUT).alias("held_out"), col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        extract, w = Extractor(model.chosen), model.weights.tolist()
        for b in batches:
            z = np.array([model.bias + sum(w[i] for i in sorted(extract(t))) for t in b.column(2).to_pylist()], np.float64)
            s = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc", "held_out", "score", "predicted"])

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"doc {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc", id_col)
