"""The corpus pipeline: documents in, token segments out.

Language ID drops what is in no learned language, SimHash near-dedup keeps one
document of each component, decontamination drops documents that share ten
consecutive words with a benchmark item, mixing draws documents to the sources'
target weights (a document drawn twice is there twice), and the last stage
writes token segments and returns what their files hold, document by document.

Every stage works on all rows that the one before has kept and has written, and
``run`` removes a stage's table once the next one is written.

Defined results: null and empty texts have no language and go at the first stage, as
do texts without a letter. Rows equal in id and text, and near copies, leave one row
of their component. Null ids, langs and sources stay null: a null source is a source
of its own, null ids come first in the tokens. Ties are decided within the operators,
the same way in every run. Texts of any length go through whole. Extra columns stay
until the last stage, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireframe.llm import decontaminate, langid, mixing, simhash, token_store
from quireframe.llm.common import removed, shared_dir, table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.index(spark, token_store.write(docs, tokenizer_path()))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("token_output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole result of the one before, which is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, before)
    return out


#: SQL can express neither language models nor SimHash nor a tokenizer.
ORACLE_SQL = None
