"""Language identification, words first.

A word is a run of letters and combining marks, lower-cased, with a letter in it. One
that the model knows is scored by its relative log frequency in each language. An
unseen word falls back to its character n-grams: the longest length of which any
n-gram is known, averaged over the word's known n-grams of it; one below, if none is.
The text's language has the largest sum over its words.

The model is fitted on a bounded sample of labelled rows: of every language the
``SAMPLE`` rows of least id hash, whatever the table's size. It keeps the most
frequent words and n-grams of each language, ``WORDS_KEPT`` and ``NGRAMS_KEPT`` at
most, and fewer where many languages share ``WORDS_IN_ALL`` and ``NGRAMS_IN_ALL``,
as 64-bit hashes with a score per language that has shown them; what a language has
not shown costs it a floor. More than ``LANGUAGES`` languages are an error.
Counting is distributed, and both counting and scoring work on batches of texts.

Defined results: texts that are null or have no letter are ``und`` with score 0.
With nothing to learn from, every text is ``und``. The score is the winner's
share of the languages' likelihoods per word, from 1 / languages to 1. Ties go
to the first language by code point. Rows without a language are never learned
from; rows equal in text are predicted alike, and each row has its own result.
Texts of any length are read whole. Other columns are kept as they are, whatever
their names. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HELD_OUT, col, fold_of, slices, stored

UNDETERMINED = "und"
#: Rows learned from, of each language.
SAMPLE = 3_000
LENGTHS = (5, 4, 3, 2, 1)
WORDS_KEPT, WORDS_IN_ALL = 20_000, 400_000
NGRAMS_KEPT, NGRAMS_IN_ALL = 8_000, 160_000
LANGUAGES = 1_000
#: Cost, in log10, of what a language has never shown, below its rarest kept item.
PENALTY = 1.5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The distinct words of several texts, and where they occur: word ``which[i]`` in text ``text[i]``."""

    def __init__(self, texts: pa.Array) -> None:
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
        lists = pc.ascii_split_whitespace(spaced)
        coded = lists.flatten().dictionary_encode()
        lettered = pc.match_substring_regex(coded.dictionary, r"\pL").to_numpy(zero_copy_only=False)
        number = np.cumsum(lettered) - 1
        which, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        kept = lettered[which] if len(which) else np.zeros(0, bool)
        self.which, self.text, self.texts = number[which[kept]], text[kept], len(texts)
        words = coded.dictionary.filter(pa.array(lettered))
        self.size = pc.utf8_length(words).to_numpy().astype(np.int64)
        #: The words' characters, each word between two blanks; ``start`` is the first blank's place.
        joined = " " + "  ".join(words.to_pylist()) + " " if len(words) else ""
        self.codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.start = np.cumsum(self.size + 2) - self.size - 2

    def hashes(self) -> np.ndarray:
        """Of every word as a whole."""
        n = len(self.codes)
        power, undo = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        power[:1] = undo[:1] = 1
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes * np.cumprod(power), out=upto[1:])
        return _mix((upto[self.start + self.size + 1] - upto[self.start + 1]) * np.cumprod(undo)[self.start + 1] if n else upto[:0])

    def ngrams(self, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, hash) of the n-grams of these words, their ends marked by a blank if n is over 1."""
        margin = 1 if n > 1 else 0
        count = np.maximum(self.size[words] + 2 * margin - n + 1, 0)
        ends = np.cumsum(count)
        at = np.repeat(self.start[words] + 1 - margin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + self.codes[at + j] + np.uint64(1)
        return np.repeat(np.arange(len(words)), count), _mix(h)


@dataclass
class Model:
    """By length (0: whole words): sorted hashes, and in compressed rows the languages that have each and their score above the floor."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]
    lang: dict[int, np.ndarray]
    above: dict[int, np.ndarray]
    floor: dict[int, np.ndarray]

    def _add(self, n: int, hashes: np.ndarray, owner: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds the scores of known hashes to the owners' rows of ``out``; returns how many each owner has."""
        keys = self.keys[n]
        at = np.searchsorted(keys, hashes)
        known = at < len(keys)
        known[known] = keys[at[known]] == hashes[known]
        at, owner = at[known], owner[known]
        count = self.rows[n][at + 1] - self.rows[n][at]
        ends = np.cumsum(count)
        entry = np.repeat(self.rows[n][at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        cell = np.repeat(owner, count) * len(self.langs) + self.lang[n][entry]
        out += np.bincount(cell, self.above[n][entry], out.size).reshape(out.shape)
        return np.bincount(owner, minlength=len(out))

    def score(self, words: Words) -> np.ndarray:
        """A row for each distinct word, a column for each language."""
        out = np.zeros((len(words.size), len(self.langs)))
        found = self._add(0, words.hashes(), np.arange(len(out)), out)
        out[found > 0] += self.floor[0]
        left = np.flatnonzero(found == 0)
        for n in LENGTHS:
            owner, hashes = words.ngrams(n, left)
            part = np.zeros((len(left), len(self.langs)))
            count = self._add(n, hashes, owner, part)
            got = count > 0
            out[left[got]] = part[got] / count[got, None] + self.floor[n]
            left = left[~got]
        return out


def count_items(docs: DataFrame, *, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, item, times) over whole texts; item is a hash, n is 0 for words."""
    picked = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (s for b in batches for s in slices(b)):
            words, langs = Words(s.column(1)), s.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()[words.text]
            pair, times = np.unique(lang.astype(np.int64) * (len(words.size) or 1) + words.which, return_counts=True)
            of_lang, word = np.divmod(pair, len(words.size) or 1)
            for n in (0, *LENGTHS):
                owner, hashes = (np.arange(len(word)), words.hashes()[word]) if not n else words.ngrams(n, word)
                order = np.lexsort((hashes, of_lang[owner]))
                h, a = hashes[order], of_lang[owner][order]
                new = np.append(True, (h[1:] != h[:-1]) | (a[1:] != a[:-1])) if len(h) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                total = np.add.reduceat(times[owner][order], first) if len(first) else np.zeros(0, np.int64)
                arrays = [langs.dictionary.take(pa.array(a[first])), pa.array(np.full(len(first), n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "item", "times"])

    return picked.mapInArrow(run, "lang string, n int, item long, times long").groupBy("lang", "n", "item").agg(F.sum("times").alias("times"))


def sampled(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, text): of every language the ``sample`` rows of least id hash, outside the held-out fold.

    A language's rows below twice its share of the hashes, some 2 x ``sample``, are ranked; so no language's rows meet
    in one task. The comparison is between doubles, which no size of table rounds to nothing.
    """
    place = F.xxhash64(col(id_col).cast("string"), F.lit("langid"))
    rows = docs.where(col(lang_col).isNotNull() & (fold_of(col(id_col)) != HELD_OUT))
    rows = rows.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"), place.alias("place"))
    sizes = stored(rows.groupBy(F.col("lang").alias("s_lang")).agg(F.count("*").alias("size")), "language-sizes")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # At most LANGUAGES rows are broadcast.
    near = rows.join(F.broadcast(sizes), F.col("lang") == F.col("s_lang")).where((F.col("place").cast("double") / 2.0**64 + 0.5) * F.col("size") <= 2.0 * sample)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", F.xxhash64("text")))
    return near.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` that have a language and are not held out."""
    learned = sampled(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample)
    counts = stored(count_items(learned, text_col="text", lang_col="lang"), "language-counts")
    totals = {(r["lang"], r["n"]): r["total"] for r in counts.groupBy("lang", "n").agg(F.sum("times").alias("total")).collect()}
    langs = sorted({lang for lang, _ in totals})
    share = max(1, len(langs))
    kept = F.when(F.col("n") == 0, min(WORDS_KEPT, WORDS_IN_ALL // share)).otherwise(min(NGRAMS_KEPT, NGRAMS_IN_ALL // share))
    rank = F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("times"), "item"))
    found = counts.withColumn("rank", rank).where(F.col("rank") <= kept).select("lang", "n", "item", "times").toPandas()
    place = {lang: i for i, lang in enumerate(langs)}
    model = Model(langs, {}, {}, {}, {}, {})
    for n in (0, *LENGTHS):
        part = found[found.n == n]
        lang = part.lang.map(place).to_numpy(np.int64)
        item = part["item"].to_numpy(np.int64).view(np.uint64)
        value = np.log10(part.times.to_numpy(np.float64) / np.array([totals[x, n] for x in part.lang], np.float64)) if len(part) else np.zeros(0)
        floor = _floors(lang, value, len(langs))
        order = np.lexsort((lang, item))
        keys, counts_of = np.unique(item, return_counts=True)
        model.keys[n], model.rows[n] = keys, np.append(0, np.cumsum(counts_of))
        model.lang[n], model.above[n], model.floor[n] = lang[order], (value - floor[lang])[order], floor
    return model


def _floors(lang: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """By language, what an item that it has not shown costs; a language without any item has the least of all."""
    least = np.zeros(n)
    np.minimum.at(least, lang, value)
    return np.where(least < 0, least, least.min() if n else 0.0) - PENALTY


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: id (or the columns ``keep`` in a struct ``doc``), lang_pred, score."""
    head = col(id_col).alias("doc") if keep is None else F.struct(*[col(c) for c in keep]).alias("doc")
    picked = docs.select(head, col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.langs)
        names = pa.array([*model.langs, UNDETERMINED])
        for s in (s for b in batches for s in slices(b)):
            words = Words(s.column(1))
            count = np.bincount(words.text, minlength=s.num_rows)
            lang, score = np.full(s.num_rows, n), np.zeros(s.num_rows)
            if n and len(words.which):
                scores = model.score(words)
                total = np.stack([np.bincount(words.text, scores[words.which, i], s.num_rows) for i in range(n)], axis=1)
                some = count > 0
                each = (total - total.max(axis=1, keepdims=True))[some] / count[some, None]
                lang[some], score[some] = total[some].argmax(axis=1), 1.0 / (10.0**each).sum(axis=1)
            yield pa.RecordBatch.from_arrays([s.column(0), names.take(pa.array(lang)), pa.array(score)], names=["doc", "lang_pred", "score"])

    return picked.mapInArrow(run, f"doc {picked.schema[0].dataType.simpleString()}, lang_pred string, score double")


def identified(docs: DataFrame, *, least: float = 0.3, **columns) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least this score, with all their columns."""
    found = predict(docs, fit(docs, **columns), keep=docs.columns, **{k: v for k, v in columns.items() if k != "lang_col"})
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc.*")
