"""Near-deduplication by true similarity: Jaccard over word shingles, candidates by prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import discard, materialize
from corvane.llm.simhash import components, near_links, print_of

#: Documents of the sample that tells common shingles, and how many of these are put last in the order.
SAMPLE, COMMON = 10_000, 1 << 17
#: How often sets are held against one other of their shingles before all pairs of a shingle are.
ROUNDS = 1
#: Of how many shingles before it a shingle tells when pairs are put forward by the first one they share.
BEFORE = 4
#: Bits of a set's parity map.
BITS = 512


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's distinct shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=len(words) - shingle + 1))


def _common(texts: DataFrame, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that meet again in a sample of documents, ascending, and in how many: a bounded number reaches the driver.

    They only order the shingles; what is missing here costs candidates, never links.
    """
    n = max(1, texts.count())
    sample = texts.where(F.pmod(F.xxhash64("_cv_row"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, SAMPLE / n)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle, seed).view(np.int64))], ["h"])

    met = sample.select("_cv_bytes").mapInArrow(of, "h long").groupBy("h").count().where("count > 1")
    found = met.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()  # collect() would merge every task's rows on the driver
    h, c = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    return h[np.argsort(h)], c[np.argsort(h)]


def prefix_of(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: sets of that similarity share one of them."""
    if not len(found):
        return found
    length = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    h, c = common
    if not len(h):
        return found[:length]
    at = np.minimum(np.searchsorted(h, found), len(h) - 1)
    return found[np.argsort(np.where(h[at] == found, c[at], 0), kind="stable")[:length]]


def parity_map(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each telling whether an odd number of the set's shingles fall on it: those of two sets differ in no more bits than the sets do in shingles."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _with_prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, seed: int, similarity: float) -> DataFrame:
    """_cv_row, the digest, the size, the parity map and the SimHash of the row's shingle set, and its prefix."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle, seed) for t in batch.column(1)]
            prefixes = pa.array([prefix_of(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            digests, sizes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())
            maps = pa.array([parity_map(s) for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.fromiter((print_of(s) if len(s) else 0 for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, sizes, maps, prints, prefixes], ["_cv_row", "digest", "n", "bits", "fp", "prefix"])

    return texts.mapInArrow(of, "_cv_row long, digest binary, n int, bits array<long>, fp long, prefix array<long>")


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether sets that share the shingle at place ``i`` of one prefix and of the other can be so similar, by their sizes and these places."""
    na, nb, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.i"), F.col(f"{b}.i")
    shared = F.least(i, j) + 1 + F.least(na - i - 1, nb - j - 1)
    return (F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-9) & (shared >= (na + nb) * (similarity / (1 + similarity)) - 1e-9)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets are that similar, counted over the whole sets."""
    asked = pairs.select(F.col("a").alias("_cv_row")).union(pairs.select("b")).distinct()
    wanted = materialize(texts.join(asked, "_cv_row", "left_semi"), "near-texts")
    left = wanted.select(F.col("_cv_row").alias("a"), F.col("_cv_bytes").alias("ta"))
    right = wanted.select(F.col("_cv_row").alias("b"), F.col("_cv_bytes").alias("tb"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingle_set(ta.as_py(), shingle, seed), shingle_set(tb.as_py(), shingle, seed)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(of, "a long, b long"), "near-links")
    discard(wanted, sweep=True)
    return links


def _first_shared(a: str, b: str, similarity: float) -> Column:
    """Whether sets can be so similar if what they share begins with the shingle at place ``i`` of one and of the other: it and what comes after it in either is all they share.

    A shingle before which both have one of the last few in common is not the first. For the first shingle that such sets
    share all this holds, so that no pair is lost; others put a pair forward hardly ever.
    """
    na, nb, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.i"), F.col(f"{b}.i")
    later = F.arrays_overlap(F.col(f"{a}.before"), F.col(f"{b}.before"))
    return ~later & (F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-9) & (1 + F.least(na - i - 1, nb - j - 1) >= (na + nb) * (similarity / (1 + similarity)) - 1e-9)


def _maps_allow(a: Column, b: Column, na: Column, nb: Column, similarity: float) -> Column:
    """Whether sets of these parity maps can be so similar: such sets differ in so few shingles that their maps differ in no more bits.

    Sets that share a passage and little else fail it, however many documents hold the passage, before a row is made of the
    pair. It never fails a similar pair; where sets are much larger than the maps it fails hardly any other either.
    """
    apart = reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(BITS // 64)])
    return apart <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _can_reach(c: Column, na: Column, nb: Column, similarity: float) -> Column:
    """Whether sets whose prefixes share ``c`` shingles can be so similar.

    Of two sets, that whose prefix ends first in the order shares what comes up to there, and beyond it at most the rest of
    its own shingles.
    """
    rest = lambda n: F.ceil(n * similarity - 1e-9) - 1
    return c + F.greatest(rest(na), rest(nb)) >= (na + nb) * (similarity / (1 + similarity)) - 1e-9


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs a < b by SimHash, of rows of ``sets`` (_cv_row, fp): each row and the first of its fingerprint, and the first row of each fingerprint and that of the smallest other within 3 bits, which equal deletion variants find.

    One a row, so that a large group costs its size; what 3 bits do not tell the prefixes do.
    """
    firsts = materialize(sets.groupBy("fp").agg(F.min("_cv_row").alias("id")), "near-prints")
    ends = near_links(firsts.select("fp")).select(F.inline(F.array(*[F.struct(F.col(x).alias("fp"), F.col(y).alias("to")) for x, y in ("ab", "ba")])))
    nearest = ends.groupBy("fp").agg(F.min("to").alias("to"))
    near = nearest.join(firsts, "fp").join(firsts.select(F.col("fp").alias("to"), F.col("id").alias("other")), "to").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return near.unionByName(sets.join(firsts, "fp").where(F.col("_cv_row") != F.col("id")).select(F.col("id").alias("a"), F.col("_cv_row").alias("b")))


def _proposed(shared: DataFrame, lists: DataFrame, labels: DataFrame | None, similarity: float, again: int) -> DataFrame:
    """For each set at most one other to be compared with (a, b): each shingle puts forward one of its sets, first the one that shares the most itself and then another each time, and that with which most shingles are shared is taken, of those not joined yet and similar enough for all that the prefixes tell."""
    row = F.struct("id", "n", "i", "label")
    seen = _labelled(shared, labels)
    middle = -F.col("s") if again == 0 else F.lit(0)  # what others were made of shares the most shingles
    lead = F.min_by(row, F.struct(middle.alias("m"), F.xxhash64("id", F.lit(again)).alias("r"), "id"))
    leads = seen.groupBy("h").agg(lead.alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "lead")
    # Here and below: Spark sizes rows made of arrays by the array's file, and would broadcast many times that.
    met = seen.select("h", row.alias("x")).hint("merge").join(leads, "h").where((F.col("x.label") != F.col("lead.label")) & _may_link("lead", "x", similarity))
    counted = met.groupBy(F.col("x.id").alias("x"), F.col("lead.id").alias("lead")).agg(F.count("*").alias("c"))
    best = counted.groupBy("x").agg(F.max_by("lead", F.struct("c", F.col("lead"))).alias("lead"))
    return _enough(best.select(F.least("x", "lead").alias("a"), F.greatest("x", "lead").alias("b")).distinct(), lists, similarity)


def _enough(pairs: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can be so similar by all that their prefixes share, and by their parity maps."""
    own, other = (lists.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"), F.col("hs.h").alias(f"h{c}")) for c in "ab")
    both = pairs.join(own, "a").join(other, "b").where(_maps_allow(F.col("bits_a"), F.col("bits_b"), F.col("na"), F.col("nb"), similarity))
    return both.where(_can_reach(F.size(F.array_intersect("ha", "hb")), F.col("na"), F.col("nb"), similarity)).select("a", "b")


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    return shared.withColumn("label", F.col("id")) if labels is None else shared.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, label) of components once ``links`` (a, b) join them, ids that had none included: only labels that a link joins are looked at again."""
    told = links
    for c in "ab":
        told = told.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    up = components(told.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    again = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return again.unionByName(up.withColumnRenamed("node", "id").join(labels.select("id"), "id", "left_anti"))


def similar_groups(sets: DataFrame, texts: DataFrame, *, shingle: int, seed: int, similarity: float) -> DataFrame:
    """The components of all links of that similarity between rows of ``sets`` (_cv_row, n, bits, fp, prefix; no two sets equal): id and the smallest id reachable, for rows that have a link.

    Sets of that similarity share a shingle of their prefixes. First each set is compared with the one that its SimHash puts
    forward and with one other of its shingles,
    which joins most of a group of near copies at the cost of its size; then all pairs of a shingle are, but for those
    already joined or compared and those that the parity maps rule out, so that a large group does not cost its square.
    """
    rows = sets.select(F.col("_cv_row").alias("id"), "n", F.posexplode("prefix").alias("i", "h"))
    shared = rows.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")
    # A set's shingles that any other has: fewer than its prefix.
    grouped = shared.groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("hs"))
    lists = materialize(grouped.join(sets.select(F.col("_cv_row").alias("id"), "bits"), "id"), "near-lists")
    shared = lists.select("id", "n", F.size("hs").alias("s"), F.inline("hs"))
    links, tried, labels = [], [], None
    for again in range(ROUNDS):
        pairs = _proposed(shared, lists, labels, similarity, again)
        if again == 0:
            pairs = pairs.unionByName(_enough(by_fingerprint(sets.where("n > 0")), lists, similarity)).distinct()
        for earlier in tried:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        tried.append(materialize(pairs, "near-tried"))
        links.append(_verified(tried[-1], texts, shingle, seed, similarity))
        labels = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "id")
    told = F.transform("hs", lambda x, k: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.slice("hs.h", F.greatest(k - BEFORE + 1, F.lit(1)), F.least(k, F.lit(BEFORE))).alias("before")))
    labelled = _labelled(lists.select("id", "n", "bits", F.inline(told)), labels).select("h", F.struct("id", "n", "i", "before", "bits").alias("x"), "label")
    p, q = labelled.select("h", F.col("x").alias("p"), F.col("label").alias("lp")), labelled.select("h", F.col("x").alias("q"), F.col("label").alias("lq"))
    rest = p.hint("merge").join(q, "h").where((F.col("p.id") < F.col("q.id")) & (F.col("lp") != F.col("lq")) & _first_shared("p", "q", similarity) & _maps_allow(F.col("p.bits"), F.col("q.bits"), F.col("p.n"), F.col("q.n"), similarity))
    rest = materialize(rest.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct(), "near-met")
    met = rest
    for earlier in tried:
        rest = rest.join(earlier, ["a", "b"], "left_anti")
    rest = materialize(_enough(rest, lists, similarity), "near-pairs")
    discard(lists, met, *tried, sweep=True)
    last = _verified(rest, texts, shingle, seed, similarity)
    discard(rest)
    return _joined(labels, last)


def drop_similar(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of documents linked, directly or through others, by a Jaccard similarity of their word shingles of at least ``similarity``.

    That of the smallest id stays (null last), then the first row. No link is missed: candidates share a shingle of their
    prefixes, and the similarity of each is counted over the whole sets. Words are as in ``near_duplicates``; a text of
    fewer words than a shingle is one shingle, null texts and those without words are one group, equal sets are one group,
    null or repeated ids are rows of their own; an empty table gives no rows; other columns are carried.
    """
    numbered = materialize(df.withColumn("_cv_row", F.monotonically_increasing_id()), "near-rows")
    texts = numbered.select("_cv_row", F.col(text_col).cast("binary").alias("_cv_bytes"))
    found = materialize(_with_prefixes(texts, _common(texts, shingle, seed), shingle, seed, similarity), "near-prefixes")
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_cv_row").alias("row"))
    ranked = materialize(found.select("_cv_row", "digest").join(numbered.select("_cv_row", rank.alias("rank")), "_cv_row"), "near-ranks")
    firsts = materialize(ranked.groupBy("digest").agg(F.min("rank").alias("lo")), "near-firsts")
    copies = ranked.join(firsts, "digest").where(F.col("rank.row") != F.col("lo.row")).select(F.col("rank.row").alias("_cv_row"))
    copies = materialize(copies, "near-copies")
    sets = found.join(copies, "_cv_row", "left_anti")
    labels = materialize(similar_groups(sets, texts, shingle=shingle, seed=seed, similarity=similarity), "near-groups")
    discard(found, copies)
    labelled = firsts.join(labels.withColumnRenamed("id", "at"), F.col("lo.row") == F.col("at"), "left").select("digest", "lo", F.coalesce("label", F.col("lo.row")).alias("label"))
    labelled = materialize(labelled, "near-labels")
    kept = labelled.join(labelled.groupBy("label").agg(F.min("lo").alias("first")), "label").select("digest", F.col("first.row").alias("kept"))
    gone = ranked.join(kept, "digest").where(F.col("rank.row") != F.col("kept")).select(F.col("rank.row").alias("_cv_row"))
    gone = materialize(gone, "near-gone")
    discard(ranked, firsts, labelled, sweep=True)
    return numbered.join(gone, "_cv_row", "left_anti").drop("_cv_row")
