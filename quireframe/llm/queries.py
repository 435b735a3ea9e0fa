"""The queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, mixing, quality, secrets, simhash, substring_dedup, token_store, toxicity
from .common import HELD_OUT, fold_of, stored, table, tokenizer_path


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return drawn.select("doc.doc_id", "size", "source_size", "target", taken)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs)).withColumnRenamed("doc", "doc_id")
    held_out = (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    first = F.array_join(F.transform("first_docs", lambda x: x.cast("string")), ",")
    return out.withColumn("first_docs", F.coalesce(first, F.lit("")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two scans: the first fills the ledger, and the ledger answers the second, which scans nothing again."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan(docs)
    found, _ = secrets.scan(docs, stored(ledger, "ledger"))
    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in secrets.BASE_KINDS],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("findings")).alias("spans"),
    )


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.index(spark, path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_mix": op5_mix,
    "op6_langid": op6_langid,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secrets": op8_secrets,
    "op9_tokens": op9_tokens,
    "op10_quality": op10_quality,
}
