"""Helpers shared by the corpus operators: scratch tables, tokenising columns, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the licence, secret and benchmark contracts: runs of anything but ASCII that is neither letter nor digit.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The single characters of ``WORD_BREAK``.
WORD_BREAKS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
#: The six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, where that is unset and the driver is the only machine (tests), one of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/corvane-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, fixes row numbers and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cv_path = path
    return out


def discard(*tables: DataFrame, sweep: bool = False) -> None:
    """Remove tables of ``materialize`` that nothing will read again; with ``sweep`` let the driver drop the shuffle files of plans that are gone, too."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cv_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if sweep and tables:
        tables[0].sparkSession._jvm.System.gc()  # Spark's cleaner acts on what the collector finds; by itself that is every half hour


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is used where no other capital can be changed by it, ``translate`` elsewhere."""
    others = F.regexp_like(text, F.lit(r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]"))
    return F.when(others, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """The array of words of a text that has been lower-cased; breaks at either end give no empty word. Time is linear, whatever runs of breaks there are."""
    trimmed = F.btrim(text, F.lit(WORD_BREAKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_BREAK)).otherwise(F.array().cast("array<string>"))


def n_blank_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")
