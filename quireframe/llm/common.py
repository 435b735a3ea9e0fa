"""What the training-data operators share.

Two word rules occur throughout: ``SPACE_SEP`` splits at ASCII white space and
``WORD_SEP`` at every ASCII character that is neither a digit nor a letter
(letters are lower-cased first, A-Z only).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"
SPACE_SEP = r"[\x20\x09-\x0D]+"
WORD_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For ``bytes.translate``: UTF-8 text to lower-case words between single-byte separators.
#: Bytes of 0x80 and above belong to non-ASCII characters, all of which are word characters.
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_SEP))


def plain_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits and all non-ASCII characters; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_SEP), "")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; -1 for a null id, which is thus never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one that the session checkpoints to.

    Where neither is set, a session on the local machine gets a temporary folder of its own; any other is an error,
    as executors would not see each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quireframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh name in the shared folder for a written table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later reads survive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table, which takes less room than a checkpoint.

    Nothing but the cluster's own cleaning of the shared folder removes it: results that are not computed yet read it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(b: pa.RecordBatch, text: int = 1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some ``size`` bytes in the column ``text``, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy())
    at = 0
    while at < b.num_rows:
        done = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, done - at)
        at = done


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a vocabulary; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
