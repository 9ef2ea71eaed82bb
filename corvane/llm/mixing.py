"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import materialize, n_blank_words


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets by source from rows (_cv_key, _cv_size): one row for each source, with its key, size and target.

    Sources stand by code point with null last and weigh ``weights`` in turn. The mix is as large as all sizes together.
    A target stops at ``most`` times its source's size and the excess is shared by weight among the others until none is
    above, which is min(cap, level * weight) for one level of all sources: the level is read off where sources, by
    cap/weight, would first stay below their caps. The windows run over one row a source.
    """
    totals = sized.groupBy("_cv_key").agg(F.sum("_cv_size").alias("source_size"))
    ranked = totals.withColumn("_cv_i", F.row_number().over(Window.orderBy(F.col("_cv_key").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_cv_i") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("_cv_w"), "_cv_i").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_cv_w", weight)
        .withColumn("_cv_left", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(by_cap), F.lit(0)))
        .withColumn("_cv_wleft", F.sum("_cv_w").over(whole) - F.coalesce(F.sum("_cv_w").over(by_cap), F.lit(0)))
        .withColumn("_cv_level", F.col("_cv_left").cast("double") / F.col("_cv_wleft").cast("double"))
    )
    # The first source, by cap over weight, whose cap its share does not pass sets the level of it and all after it.
    fits = F.col("_cv_level") * F.col("_cv_w") <= F.col("source_size") * most
    level = F.min_by(F.when(fits, F.col("_cv_level")), F.when(fits, F.struct(F.col("source_size") / F.col("_cv_w"), F.col("_cv_i")))).over(whole)
    cap = (F.col("source_size") * most).cast("double")
    return levels.withColumn("_cv_lv", level).select("_cv_key", "source_size", F.least(cap, F.coalesce(F.col("_cv_lv") * F.col("_cv_w"), cap)).alias("target"))


def mix_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, emit: bool = False, carry: bool = True) -> DataFrame:
    """Mix sources by repeating documents.

    A source's rate is its target over its size. Each document is taken floor(rate) times, and once more if a coin seeded
    by (seed, id, text) falls below the rate's fraction, so reruns agree and no document passes ceil(rate) copies.
    Returns the input's columns (only ``id_col`` without ``carry``) with size, source_size, target, copies and taken; with
    ``emit`` the input's columns alone, each document as often as it is taken.

    A null text has size 0; null is a source of its own; a source without words has target 0 and is not taken; rows that
    repeat in id and text share their coin; an empty table gives no rows; columns of the input with one of the new names
    are replaced.
    """
    new = [] if emit else ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (df.columns if carry or emit else [id_col]) if c not in new]
    source, text = F.col(source_col), F.col(text_col)
    sized = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.concat(F.lit("s"), source).alias("_cv_key"),
        n_blank_words(text).alias("_cv_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))).alias("_cv_coin"),
    )
    if not (carry or emit):
        sized = materialize(sized, "mix-sizes")
    targets = materialize(source_targets(sized, weights=weights, most=most), "mix-targets")  # its size in files decides how it is joined
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    coin = F.conv(F.substring("_cv_coin", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")
    same = F.coalesce(F.col("_cv_key"), F.lit("n"))
    mixed = sized.withColumn("_cv_join", same).join(targets.select(same.alias("_cv_join"), "source_size", "target"), "_cv_join").withColumn("copies", copies)
    if emit:
        return _repeat(mixed, kept)
    return mixed.select(*[F.col(f"`{c}`") for c in kept], F.col("_cv_size").alias("size"), "source_size", "target", "copies", (F.col("_cv_size") * F.col("copies")).alias("taken"))


def _repeat(mixed: DataFrame, kept: list[str]) -> DataFrame:
    return mixed.where("copies > 0").withColumn("_cv_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in kept])
