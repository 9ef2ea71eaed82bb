"""Size-balanced shards by sampled splitters."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import materialize

_MIN, _MAX = -(2**63), 2**63 - 1


def _longs(values: list[int]) -> Column:
    """A constant array of longs, folded to one literal."""
    return F.expr(f"array({','.join('(-9223372036854775807L - 1L)' if v == _MIN else f'{v}L' for v in values)})")


def _range_of(h: Column, t: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (h, t): a binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    levels = len(splitters).bit_length()
    padded = splitters + [(_MAX, _MAX)] * (2**levels - 1 - len(splitters))
    hs, ts = _longs([x[0] for x in padded]), _longs([x[1] for x in padded])

    def step(acc: Column, width: Column) -> Column:
        at = acc + width
        sh, st = F.get(hs, at - 1), F.get(ts, at - 1)
        return F.when((sh < h) | ((sh == h) & (st <= t) & (at <= len(splitters))), at).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(2**b) for b in reversed(range(levels))]), F.lit(0), step)


def _draw(rows: DataFrame, step: float, seed: int) -> list[tuple[int, int, int]]:
    """Keys drawn in proportion to size: about one for each ``step`` bytes."""
    coin = F.pmod(F.xxhash64("_cv_rid", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.select("_cv_h", "_cv_t", F.floor(F.col("_cv_size") / F.lit(step) + coin).alias("k")).where("k > 0")
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(drawn: list[tuple[int, int, int]], ranges: int) -> list[tuple[int, int]]:
    """Boundaries of ``ranges`` ranges of equal drawn weight. A text's first boundary stands before the whole text, so that only a text that fills several ranges is cut."""
    weight, out, seen = sum(k for _, _, k in drawn), [], 0
    for h, t, k in drawn:
        before, seen = seen, seen + k
        if before * ranges // weight != seen * ranges // weight:
            out.append((h, t) if out and out[-1][0] == h else (h, _MIN))
    return sorted(set(out))


def assign_shards(df: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, samples: int = 16384, ranges: int = 1024, overfull: float = 2.0, seed: int = 7) -> DataFrame:
    """Spread rows over ``shards`` shards of near equal bytes.

    Keys are (hash of the text, hash of the row's number). A size-weighted sample of about ``samples`` keys (the
    documented bound of what reaches the driver) gives the splitters of ``ranges`` ranges; the true bytes of each range
    are counted over all rows, ranges above ``overfull`` times their share are drawn again and subdivided until none is or
    no draw parts it, and runs of ranges make the shards. Equal texts stand side by side and are cut only where they fill
    several ranges or meet a shard's edge: the law is that of near equal bytes, so a group of copies larger than its
    share of bytes goes to more than one shard.

    Returns the input's columns (only ``id_col`` without ``carry``) and size, text_crc32, law, shard, slot and
    grown_shard. A null text counts as empty, a null or repeated id is just another row, an empty table gives no rows;
    columns of the input with one of the new names are replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in (df.columns if carry else [id_col]) if c not in new]
    rows = materialize(
        df.select(
            *[F.col(f"`{c}`") for c in kept],
            (F.octet_length(text) + 1).cast("long").alias("_cv_size"),
            F.crc32(text).alias("_cv_crc"),
            F.xxhash64(text).alias("_cv_h"),
            F.monotonically_increasing_id().alias("_cv_rid"),
        ),
        "shard",
    ).withColumn("_cv_t", F.xxhash64("_cv_rid"))

    total = rows.agg(F.sum("_cv_size")).first()[0] or 0
    splitters: list[tuple[int, int]] = []
    shard_of = [0]
    if total:
        splitters = _quantiles(_draw(rows, total / samples, seed), ranges)
        again = 0
        while True:
            ranged = rows.withColumn("_cv_range", _range_of(F.col("_cv_h"), F.col("_cv_t"), splitters))
            full = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_cv_range").agg(F.sum("_cv_size"), F.count("*")).collect()}
            over = [r for r, (size, n) in full.items() if n > 1 and size > overfull * total / ranges]
            if not over:
                break
            inside = ranged.where(F.array_contains(_longs(sorted(over)), F.col("_cv_range").cast("long")))
            more = [(h, t) for h, t, _ in _draw(inside, total / ranges / 2, seed + 1 + again)]
            if set(more) <= set(splitters):
                break
            splitters, again = sorted({*splitters, *more}), again + 1
        shard_of, before = [], 0
        for r in range(len(splitters) + 1):
            size = full.get(r, (0, 0))[0]
            shard_of.append(min(shards - 1, int((before + size / 2) * shards / total)))
            before += size

    ranged = rows.withColumn("_cv_range", _range_of(F.col("_cv_h"), F.col("_cv_t"), splitters))
    placed = ranged.withColumn("_cv_shard", F.get(_longs(shard_of), F.col("_cv_range")).cast("int")).withColumn("_cv_pid", F.shiftright("_cv_rid", 33))
    # Slots: a row's place among its task's rows of the shard, after those of earlier tasks. A task's rows are bounded by its split.
    counts = placed.groupBy("_cv_shard", "_cv_pid").agg(F.count("*").alias("_cv_n"))
    earlier = Window.partitionBy("_cv_shard").orderBy("_cv_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("_cv_shard", "_cv_pid", F.coalesce(F.sum("_cv_n").over(earlier), F.lit(0)).alias("_cv_off")), "shard-offsets")
    within = Window.partitionBy("_cv_shard", "_cv_pid").orderBy("_cv_rid")
    slot = F.row_number().over(within).cast("long") - 1
    return (
        placed.withColumn("_cv_row", slot)
        .join(offsets, ["_cv_shard", "_cv_pid"])
        .select(
            *[F.col(f"`{c}`") for c in kept],
            F.col("_cv_size").alias("size"),
            F.col("_cv_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("_cv_shard").alias("shard"),
            (F.col("_cv_row") + F.col("_cv_off")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as one Parquet folder each, rows in slot order within each file. The files of a shard are as many as its bytes need."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_of_key(splitters: list[tuple[int, int]], key: tuple[int, int]) -> int:
    """What the column of splitters computes, for tests."""
    return bisect.bisect_right(splitters, key)
