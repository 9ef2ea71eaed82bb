"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import materialize

#: Bytes of the first digit; each later one is eight times as wide, up to the widest.
FIRST_DIGIT, WIDEST_DIGIT = 64, 1 << 20


def _split(active: DataFrame, by: list[str], width: int, tag: str) -> DataFrame:
    """One level: rows (_cv_rid, _cv_id, _cv_ncp, _cv_sha, _cv_rest and the columns ``by``) with what is known of their group.

    A group is told by its parent's number, the next ``width`` bytes and whether the text ends within them. Groups are
    counted with a map-side combine and those of two or more rows written. Rows and groups then come to the join from
    exchanges of their own, so that adaptive execution can split the rows of a hot group, and meet by sorting, which
    spills where digits do not fit into memory. A row without such a group is alone.
    """
    rest = F.col("_cv_rest")
    keyed = active.withColumn("_cv_digit", F.substring(rest, 1, width)).withColumn("_cv_end", F.octet_length(rest) <= width)
    key = [*by, "_cv_digit", "_cv_end"]
    best = F.min(F.struct((-F.col("_cv_ncp")).alias("n"), F.col("_cv_id").isNull().alias("no_id"), F.col("_cv_id").alias("id"), F.col("_cv_rid").alias("rid")))
    groups = keyed.groupBy(*key).agg(F.count("*").alias("_cv_size"), best.alias("_cv_best"), F.min("_cv_rid").alias("_cv_next")).where("_cv_size > 1")
    groups = materialize(groups, f"{tag}-groups")
    joined = keyed.join(groups.hint("merge"), key, "left")
    on = F.col("_cv_size").isNotNull() & ~F.col("_cv_end")
    out = joined.select(
        "_cv_rid", "_cv_id", "_cv_ncp", "_cv_sha", on.alias("_cv_on"), F.col("_cv_next").alias("_cv_gid"),
        F.when(on, F.substring(rest, width + 1, 2**31 - 1 - width)).alias("_cv_rest"),
        F.coalesce(F.col("_cv_size"), F.lit(1)).cast("long").alias("_cv_size"),
        F.when(F.col("_cv_size").isNull(), F.col("_cv_id")).otherwise(F.col("_cv_best.id")).alias("_cv_keep"),
        F.coalesce(F.col("_cv_best.rid") == F.col("_cv_rid"), F.lit(True)).alias("_cv_kept"),
    )
    return materialize(out, tag)


def normalized(text: Column) -> Column:
    """The text without ASCII blanks, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are the same but for ASCII blanks.

    Texts are split by successive digits of bytes, 64 first and then ever wider, until a group is one row or its texts
    have ended; equality is that of all bytes, no digest is compared. A level moves only the rest of the texts that still
    have company, through the shared folder.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256 (of the bare text) and row (the
    row's number here). Of equal texts that with the most code points before stripping stays, then the smallest id, null
    ids last, then the first row. Null counts as an empty text; null or repeated ids are rows of their own; an empty table
    gives no rows; other columns are not read.
    """
    bare = normalized(F.col(text_col))
    rows = df.select(F.monotonically_increasing_id().alias("_cv_rid"), F.col(id_col).alias("_cv_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("_cv_ncp"), bare.alias("_cv_bare"))
    rows = materialize(rows.select("_cv_rid", "_cv_id", "_cv_ncp", F.unhex(F.sha2("_cv_bare", 256)).alias("_cv_sha"), F.col("_cv_bare").cast("binary").alias("_cv_rest")), "exact-texts")
    return _refine(rows, id_col)


def _refine(rows: DataFrame, id_col: str) -> DataFrame:
    done, by, width = [], [], FIRST_DIGIT
    while True:
        level = _split(rows, by, width, f"exact-level{len(done)}")
        done.append(level.where(~F.col("_cv_on")))
        rows = level.where("_cv_on").select("_cv_rid", "_cv_id", "_cv_ncp", "_cv_sha", "_cv_gid", "_cv_rest")
        if rows.isEmpty():
            break
        by, width = ["_cv_gid"], min(width * 8, WIDEST_DIGIT)
    return reduce(DataFrame.unionByName, done).select(
        F.col("_cv_id").alias(id_col),
        F.col("_cv_keep").alias("keep_id"),
        F.col("_cv_size").alias("group_size"),
        F.col("_cv_kept").alias("kept"),
        F.lower(F.hex("_cv_sha")).alias("text_sha256"),
        F.col("_cv_rid").alias("row"),
    )


def drop_exact_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of ``exact_groups``, all columns as they were. Same cases."""
    bare = normalized(F.col(text_col))
    numbered = materialize(df.withColumn("_cv_rid", F.monotonically_increasing_id()), "exact-rows")
    rows = numbered.select("_cv_rid", F.col(id_col).alias("_cv_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("_cv_ncp"), F.unhex(F.sha2(bare, 256)).alias("_cv_sha"), bare.cast("binary").alias("_cv_rest"))
    gone = materialize(_refine(rows, id_col).where(~F.col("kept")).select(F.col("row").alias("_cv_rid")), "exact-gone")
    return numbered.join(gone, "_cv_rid", "left_anti").drop("_cv_rid")
