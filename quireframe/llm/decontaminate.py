"""Benchmark decontamination by winnowing.

A document and a benchmark item share a window when ``window`` consecutive words
agree; an item of fewer words is one window of its own length. Every window of
``window`` words holds ``window - k + 1`` k-grams, and its fingerprint is the
smallest of their hashes, the leftmost on a tie. Both sides pick the same k-gram
of equal windows, so a join of the picked fingerprints finds every shared window;
each hit is then extended by comparing the words themselves, so that a hash
collision never becomes a hit.

Defined results: null and empty texts have no words. Rows equal in id and text
count once per row of the input. Items of null id mark words but are not listed; of
equal items each is listed. Ties between hashes go to the leftmost k-gram. Texts of
any length are read whole. An empty benchmark leaves every document clean, and no
documents give no rows. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, col, let, plain_words, stored

#: Low bits of a fingerprint hold the position of its k-gram, so the least of a window is also its leftmost.
POSITION_BITS = 31
POSITION_MASK = (1 << POSITION_BITS) - 1
#: The benchmark's fingerprints are broadcast up to this many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 48 << 20
#: What a document's key takes in a broadcast table, at most (ids longer than this allows for are text).
CANDIDATE_BYTES = 256


def _packed(hashes: Column, at: Column, k: int, salt: int = 0) -> Column:
    """Hash of the k word hashes from ``at``, with ``at`` in its low bits."""
    gram = F.xxhash64(F.lit(salt), *[F.get(hashes, at + j) for j in range(k)])
    return gram.bitwiseAND(F.lit(~POSITION_MASK)).bitwiseOR(at.cast("long"))


def _picked(words: Column, k: int, window: int) -> Column:
    """Packed fingerprints of all windows of ``window`` words, each picked k-gram once."""
    steps = window - k + 1

    def of_grams(grams: Column) -> Column:
        windows = F.sequence(F.lit(0), F.size(grams) - steps)
        least = F.least if steps > 1 else lambda x: x
        return F.array_distinct(F.transform(windows, lambda i: least(*[F.get(grams, i + j) for j in range(steps)])))

    def of_hashes(hashes: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: _packed(hashes, i, k)), of_grams)

    return F.when(F.size(words) >= window, let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes)).otherwise(
        F.array().cast("array<bigint>")
    )


def _whole(words: Column, length: int) -> Column:
    """Packed hashes of every run of ``length`` words, for items of just that length."""
    return F.when(
        F.size(words) >= length,
        let(
            F.transform(words, lambda x: F.xxhash64(x)),
            lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - length), lambda i: _packed(h, i, length, length)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, gram): the windows of every item, ``gram`` being an array of words."""
    words = benchmark.select(col(id_col).alias("item"), plain_words(col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.where(F.size("w") > 0).select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("gram")
    )


def window_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): per document a row with null ``gram`` and one per shared window; windows as item_windows().

    Columns of hits: doc, thash (of the text), n_words, start, gram.
    """
    windows = item_windows(benchmark, item_id_col, item_text_col, window)
    short = F.size("gram") < window
    grams = windows.select("gram").distinct()
    fingerprint = F.when(short, F.lit(None).cast("bigint")).otherwise(F.get(_picked(F.col("gram"), k, window), F.lit(0)))
    size = grams.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.size("gram") * 16 + F.octet_length(F.concat_ws("", "gram"))), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set(F.when(short, F.size("gram")))).alias("short"),
    ).first()
    for n in size["short"]:
        fingerprint = F.when(F.size("gram") == n, F.get(_whole(F.col("gram"), n), F.lit(0))).otherwise(fingerprint)
    index = grams.select("gram", fingerprint.alias("packed")).select(
        "gram",
        F.col("packed").bitwiseAND(F.lit(~POSITION_MASK)).alias("fp"),
        F.col("packed").bitwiseAND(F.lit(POSITION_MASK)).cast("int").alias("off"),
    )
    picked = [_picked(F.col("w"), k, window), *[_whole(F.col("w"), n) for n in size["short"]]]
    # One more entry stands for the document itself; its key is spread so that no join key gathers them.
    own = F.xxhash64("doc", "thash").bitwiseOR(F.lit(POSITION_MASK))
    base = docs.select(
        col(id_col).alias("doc"), F.xxhash64(col(text_col)).alias("thash"), plain_words(col(text_col)).alias("w")
    )
    spread = base.select("*", F.concat(*picked, F.array(own)).alias("marks")).select(
        "doc", "thash", "w", F.size("w").cast("long").alias("n_words"), F.explode("marks").alias("m")
    )
    mark = F.col("m").bitwiseAND(F.lit(POSITION_MASK)).cast("int")
    fits = F.slice("w", F.col("start") + 1, F.size("gram")) == F.col("gram")
    kept = F.when(F.col("start") >= 0, fits).otherwise(F.lit(False))
    fp = F.col("m").bitwiseAND(F.lit(~POSITION_MASK))
    is_doc = F.col("p") == POSITION_MASK
    if size["bytes"] <= broadcast_bytes:
        joined = spread.select("*", mark.alias("p"), fp.alias("fp")).join(F.broadcast(index), "fp", "left")
        joined = joined.withColumn("start", F.col("p") - F.col("off"))
        hits = joined.where(is_doc | kept)
    else:
        slim = spread.select("doc", "thash", "n_words", mark.alias("p"), fp.alias("fp"))
        near = slim.where(~is_doc).join(index, "fp").withColumn("start", F.col("p") - F.col("off"))
        # Words are needed of documents with a candidate alone. Where these are few, texts of others are never sent.
        near = stored(near, "decontamination-candidates")
        wanted = stored(near.select("doc", "thash").distinct(), "decontamination-documents").select(F.col("doc").alias("c_doc"), F.col("thash").alias("c_hash"))
        few = wanted.count() * CANDIDATE_BYTES <= broadcast_bytes
        some = base.join(F.broadcast(wanted) if few else wanted, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("thash") == F.col("c_hash")), "left_semi")
        some = some.dropDuplicates(["doc", "thash"]).alias("s")
        on = near["doc"].eqNullSafe(F.col("s.doc")) & (near["thash"] == F.col("s.thash"))
        found = near.join(some, on).where(kept)
        found = found.select(near["doc"], near["thash"], "n_words", "p", "start", "gram")
        hits = found.unionByName(slim.where(is_doc).drop("fp"), allowMissingColumns=True)
    gram = F.when(~is_doc, F.col("gram"))
    return checkpoint(hits.select("doc", "thash", "n_words", "start", gram.alias("gram"))), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, thash (xxhash64 of the text), items."""
    hits, windows = window_hits(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    key = ["doc", "thash"]
    spans = hits.groupBy(*key, "n_words").agg(
        F.collect_set(
            F.when(F.col("gram").isNotNull(), F.struct("start", (F.col("start") + F.size("gram")).alias("end")))
        ).alias("spans"),
        F.count(F.when(F.col("gram").isNull(), 1)).alias("copies"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array("spans"),
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    items = (
        hits.where(F.col("gram").isNotNull())
        .select(*key, "gram")
        .distinct()
        .join(windows.where(F.col("item").isNotNull()).distinct(), "gram")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    a, b = spans.alias("a"), items.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    joined = a.join(b, on, "left").select("a.*", F.coalesce("b.items", F.array().cast("array<string>")).alias("items"))
    return joined.select(
        F.col("doc").alias(id_col),
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        "thash",
        "items",
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))).alias("__copy"),
    ).drop("__copy")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    hits, _ = window_hits(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = hits.where(F.col("gram").isNotNull()).select(F.col("doc").alias("b_doc"), F.col("thash").alias("b_hash")).distinct()
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("k_doc"), F.xxhash64(col(text_col)).alias("k_hash"))
    return rows.join(bad, F.col("k_doc").eqNullSafe(F.col("b_doc")) & (F.col("k_hash") == F.col("b_hash")), "left_anti").select("row.*")
