"""Quality rules with adaptive thresholds.

Every document is measured; each measure is a rate in millionths (symbols and
capitals by characters, repeated lines by lines, repeated words by words). Per
language and source, a sketch of each measure is a histogram over cells that keep a
rate's first ``DIGITS`` binary digits: sketches merge by adding counts, in any order
and exactly, hold some 500 cells at most, and give quantiles within a sixteenth of
their value. A group's threshold is its ninth decile plus ``spread`` times what that
lies above the median, so that nothing but what is usual in the group decides. Groups
of fewer than ``least`` documents take the merged sketch of their language, and small
languages that of the corpus, merged from the languages'. A document is rejected if a
measure exceeds its group's threshold by more than ``allow`` occurrences, so that a
single line or symbol in a short text is not held against it.

Defined results: null text has no words and fails. Null language and source are
groups of their own. Equal rows are judged alike, each on its own. A rate equal to
its threshold is kept. Texts of any length are measured whole. Other columns are
never read, whatever their names. No documents give no rows.

``n_repeat_words`` compares three-word windows by 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, col, let, space_words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPREAD = 3
LEAST = 200
ALLOW = 3
#: Binary digits of a rate that a cell of the sketch keeps.
DIGITS = 5
MILLION = 1_000_000
#: Measure: what it counts, and by what.
MEASURES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"].cast("long"))

    def twice(pairs: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"])
        return covered(F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))

    def of_windows(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, twice))

    def of_hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return let(F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), of_windows)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc, lang, source, thash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)."""
    text = F.coalesce(col(text_col), F.lit(""))
    base = docs.select(
        col(id_col).alias("doc"),
        col(lang_col).alias("lang"),
        col(source_col).alias("source"),
        text.alias("t"),
        space_words(col(text_col)).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"),
    )
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return base.select(
        "doc",
        "lang",
        "source",
        F.xxhash64("t").alias("thash"),
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - count(r"[\x20\x09-\x0D]")).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_capitals"),
    )


def rates(measured: DataFrame) -> DataFrame:
    """``measured`` with its rates in millionths, 0 where there is nothing to divide by."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{MILLION} * {a} div {b}")).otherwise(F.lit(0)).cast("long")
    return measured.select("*", *[rate(a, b).alias(m) for m, (a, b) in MEASURES.items()])


def cell(rate: str) -> Column:
    """The sketch's cell of a rate: how many binary digits are dropped, and those kept."""
    dropped = f"greatest(length(bin({rate})) - {DIGITS}, 0)"
    return F.expr(f"{dropped} * {1 << DIGITS} + shiftright({rate}, {dropped})").cast("int")


def floor_of(cell: str) -> Column:
    """The least rate of a cell."""
    return F.expr(f"shiftleft(cast({cell} % {1 << DIGITS} as bigint), cast({cell} div {1 << DIGITS} as int))")


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of every group, as the counts of its cells."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), cell(m).alias("bucket")) for m in MEASURES])
    return rated.select("lang", "source", F.inline(cells)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged down to ``keys``."""
    return cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(cells: DataFrame, keys: list[str], spread: int = SPREAD) -> DataFrame:
    """(keys, measure, size, fence): the median and the ninth decile of merged sketches make the fence."""
    group = W.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = cells.select(*keys, "measure", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("size"))
    at = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("size"), F.col("bucket")))
    out = run.groupBy(*keys, "measure").agg(F.max("size").alias("size"), at(5).alias("mid"), at(9).alias("high"))
    return out.select(*keys, "measure", "size", (floor_of("high") + spread * (floor_of("high") - floor_of("mid"))).alias("fence"))


def thresholds(rated: DataFrame, *, spread: int = SPREAD, least: int = LEAST) -> DataFrame:
    """(lang, source, t_<measure> for every measure): a row per language and source that occurs."""
    cells = checkpoint(sketches(rated))
    by_lang = checkpoint(merged(cells, ["lang"]))
    a, b = fences(cells, ["lang", "source"], spread).alias("a"), fences(by_lang, ["lang"], spread).alias("b")
    c = fences(merged(by_lang, []), [], spread).alias("c")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure")))
    both = both.join(F.broadcast(c), F.col("a.measure") == F.col("c.measure"))  # one row per measure
    pick = F.when(F.col("a.size") >= least, F.col("a.fence")).when(F.col("b.size") >= least, F.col("b.fence")).otherwise(F.col("c.fence"))
    one = both.select("a.lang", "a.source", F.col("a.measure").alias("measure"), pick.alias("fence"))
    return one.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"t_{m}") for m in MEASURES])


def judge(docs: DataFrame, *, id_col: str = "doc_id", spread: int = SPREAD, least: int = LEAST, allow: int = ALLOW, **columns) -> DataFrame:
    """Per row of ``docs``: id, the measures, rates and thresholds, base_failed, kept."""
    rated = checkpoint(rates(measure(docs, id_col=id_col, **columns)))
    t = thresholds(rated, spread=spread, least=least).alias("t")
    s = rated.alias("s")
    on = F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source"))
    joined = s.join(t, on, "left").select("s.*", *[f"t_{m}" for m in MEASURES])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    usual = F.lit(True)
    for m, (count, by) in MEASURES.items():
        usual = usual & (MILLION * (F.col(count) - allow) <= F.col(f"t_{m}") * F.col(by))
    return joined.select(
        F.col("doc").alias(id_col), *joined.columns[1:], failed.alias("base_failed"), (~failed & usual).alias("kept")
    )
