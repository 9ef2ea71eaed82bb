"""SimHash near-deduplication with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import discard, materialize

#: For each byte value, which of its bits are set, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is set where it is set in over half of the shingles' XXH64. Without words: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    return print_of(hashes)


def print_of(hashes: np.ndarray) -> int:
    """The 64 bits of which each is set where it is set in over half of the hashes."""
    n = len(hashes)
    lanes = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    set_in = np.concatenate([np.bincount(lanes[:, b], minlength=256) @ _BITS for b in range(8)])
    return int.from_bytes(np.packbits(set_in * 2 > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, *, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``df`` with the column _cv_fp for ``text_col``, which is read as UTF-8 bytes and dropped."""
    rest = [c for c in df.columns if c != text_col]
    slim = df.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("binary").alias("_cv_bytes"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(found)], [*rest, "_cv_fp"])

    schema = slim.drop("_cv_bytes").schema.add("_cv_fp", "long")
    return slim.mapInArrow(of, schema)


def _variants(fp: Column, low: int, width: int, tag: int) -> Column:
    """Keys of a segment of ``width`` bits from bit ``low``: for each of its bits, the segment with that bit cleared, below the bit's number and the segment's."""
    segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct((F.lit(tag * 64) + j).cast("int").alias("s"), segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))).alias("v")))


def _pieces(bits: int, distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of so many pieces of ``bits`` bits that of ``distance`` differing bits at most one lies in one of them; two at least."""
    n = max(2, distance // 2 + 1)
    cuts = [bits * k // n for k in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False)]


def _by_piece(tag: Column, values: list[Column]) -> Column:
    """The value of the piece that a key belongs to."""
    out = values[-1]
    for k in reversed(range(len(values) - 1)):
        out = F.when(tag == k, values[k]).otherwise(out)
    return out


def near_links(prints: DataFrame, distance: int = 3, hot: int = 4096) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp at most ``distance`` bits apart.

    The 64 bits are cut into segments, two for up to three differing bits: at most one of these lies in one of them. Each
    segment is indexed once for each of its bits with that bit cleared, so such pairs share a key; equal keys are joined
    and the pairs verified. Keys of over ``hot`` fingerprints are joined by a second key as well: the rest of the bits,
    which differ in ``distance`` or fewer, is cut in the same way, again one-wildcard variants, so that no link is lost.
    Prints are few bytes in few files: they are dealt to as many tasks as a shuffle has before their keys are made.
    """
    prints = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    segments = _pieces(64, distance)
    variants = F.concat(*[_variants(F.col("fp"), low, width, k) for k, (low, width) in enumerate(segments)])
    keyed = prints.select("fp", F.explode(variants).alias("k")).select("fp", F.col("k.s").alias("s"), F.col("k.v").alias("v"))
    counts = keyed.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    large = materialize(counts.select("s", "v"), "simhash-hot")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    tag = F.shiftright("s", 6)
    crossed = F.col("a").bitwiseXOR(F.col("b"))
    segment = _by_piece(tag, [F.shiftrightunsigned(crossed, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in segments])
    # A pair that shares a whole segment shares all its keys: it counts under the first alone.
    first = ((segment == 0) & (F.col("s") % 64 == 0)) | (segment == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s") % 64))

    def met(left: DataFrame, on: list[str]) -> DataFrame:
        # Spark sizes what an explode makes by its input: without the hint it would broadcast all keys of a few MB of prints.
        both = left.withColumnRenamed("fp", "a").hint("merge").join(left.withColumnRenamed("fp", "b"), on)
        return both.where((F.col("a") < F.col("b")) & (apart <= distance) & first).select("a", "b")

    def without(low: int, width: int) -> Column:
        """The other bits, moved together."""
        below = F.col("fp").bitwiseAND(F.lit((1 << low) - 1))
        return below if low + width == 64 else below.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low + width), low))

    if large.isEmpty():
        return met(keyed, ["s", "v"]).distinct()
    usual = met(keyed.join(large, ["s", "v"], "left_anti"), ["s", "v"])
    finer = keyed.join(large, ["s", "v"]).withColumn("o", _by_piece(tag, [without(*x) for x in segments]))
    parts = _pieces(64 - min(width for _, width in segments), distance)
    finer = finer.select("fp", "s", "v", F.explode(F.concat(*[_variants(F.col("o"), low, width, k) for k, (low, width) in enumerate(parts)])).alias("k2"))
    return usual.unionByName(met(finer, ["s", "v", "k2"])).distinct()


def components(links: DataFrame) -> DataFrame:
    """The connected components of ``links`` (a, b): node and the smallest node reachable, by hooking and pointer jumping, each round written to the shared folder."""
    links = materialize(links, "links")
    # Where every node is its own label, the links alone tell the first hooking.
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
    labels = materialize(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "labels")
    if labels.isEmpty():
        discard(links)
        return labels
    while True:
        jumped = labels
        for _ in range(2):
            jumped = jumped.join(jumped.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label"))
        old, labels = labels, materialize(jumped, "labels")
        discard(old)
        told = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        least = F.least("la", "lb").alias("to")
        told = told.where("la <> lb").select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), least) for c in ("a", "b", "la", "lb")])).alias("x"))
        hooked = told.select("x.node", "x.to").where("node <> to").groupBy("node").agg(F.min("to").alias("to"))
        moved = materialize(labels.join(hooked, "node", "left").select("node", F.least("label", "to").alias("label"), F.coalesce(F.col("to") < F.col("label"), F.lit(False)).alias("moved")), "labels")
        if moved.where("moved").isEmpty():
            discard(links, moved)
            return labels
        discard(labels)
        labels = moved.select("node", "label")
        labels._cv_path = moved._cv_path


def _grouped(rows: DataFrame, shingle: int, seed: int, distance: int, hot: int) -> DataFrame:
    """From rows (_cv_rank, _cv_text): _cv_rank, _cv_fp and _cv_first, the least rank of the row's component."""
    rows = materialize(with_fingerprints(rows, text_col="_cv_text", shingle=shingle, seed=seed), "simhash")
    prints = materialize(rows.groupBy(F.col("_cv_fp").alias("fp")).agg(F.min("_cv_rank").alias("lo")), "simhash-prints")
    found = components(near_links(prints.select("fp"), distance, hot))
    labelled = materialize(prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lo", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    firsts = labelled.groupBy("label").agg(F.min("lo").alias("_cv_first"))
    by_print = materialize(labelled.join(firsts, "label").select(F.col("fp").alias("_cv_fp"), "_cv_first"), "simhash-firsts")
    return rows.join(by_print, "_cv_fp")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3, hot: int = 4096) -> DataFrame:
    """Near-duplicate groups: documents linked, directly or through others, by SimHash fingerprints at most ``distance`` bits apart.

    Fingerprints are of whole texts; links are sought between distinct fingerprints, so copies cost nothing. Returns one
    row per document: ``id_col``, fingerprint (16 hexadecimal digits) and component_id (the smallest id reachable, null
    only if all are null). A null text or one without words has fingerprint zero, linked like any other; null or repeated
    ids are rows of their own; an empty table gives no rows; other columns are not read.
    """
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    grouped = _grouped(df.select(rank.alias("_cv_rank"), F.col(text_col).alias("_cv_text")), shingle, seed, distance, hot)
    return grouped.select(F.col("_cv_rank.id").alias(id_col), F.lower(F.lpad(F.hex("_cv_fp"), 16, "0")).alias("fingerprint"), F.col("_cv_first.id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3, hot: int = 4096) -> DataFrame:
    """``df`` with one row of each group of ``near_duplicates``: that of the smallest id (null last), then the first row. Columns and cases as there."""
    numbered = materialize(df.withColumn("_cv_row", F.monotonically_increasing_id()), "simhash-rows")
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_cv_row").alias("row"))
    grouped = _grouped(numbered.select(rank.alias("_cv_rank"), F.col(text_col).alias("_cv_text")), shingle, seed, distance, hot)
    gone = materialize(grouped.where(F.col("_cv_rank.row") != F.col("_cv_first.row")).select(F.col("_cv_rank.row").alias("_cv_row")), "simhash-gone")
    return numbered.join(gone, "_cv_row", "left_anti").drop("_cv_row")
