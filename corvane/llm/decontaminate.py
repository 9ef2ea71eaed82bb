"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import ascii_lower, materialize, split_words

_POS_BITS = 30  # a fingerprint is the top 34 bits of a hash, above the word's position (below 2**30)
_HASH_MASK = -(1 << _POS_BITS)


def _gram_marks(words: Column, k: int) -> Column:
    """For each start of ``k`` words: their hash, cut to 34 bits, above the position."""
    grams = F.transform(words, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(words, i + j) for j in range(1, k)]).bitwiseAND(F.lit(_HASH_MASK)).bitwiseOR(i.cast("long")))
    return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def _shifted_least(marks: Column, by: int) -> Column:
    """The lesser of each mark and the one ``by`` places on; places without one keep their own."""
    return F.zip_with(marks, F.slice(marks, F.lit(1 + by), F.size(marks)), lambda a, b: F.least(a, b))


def _with_fingerprints(df: DataFrame, k: int, window: int, short: list[int]) -> DataFrame:
    """From _cv_words: _cv_marks, the least mark of each ``window`` k-grams in a row (fewer at the end), and all marks of the lengths ``short``."""
    df = df.withColumn("_cv_m", _gram_marks(F.col("_cv_words"), k))
    have = 1
    while have < window:
        by = min(have, window - have)
        df = df.withColumn("_cv_m", _shifted_least(F.col("_cv_m"), by))
        have += by
    marks = [F.array_distinct("_cv_m"), *[_gram_marks(F.col("_cv_words"), m) for m in short]]
    return df.withColumn("_cv_marks", F.concat(*marks) if short else marks[0]).drop("_cv_m")


def _worded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_cv_words", split_words(ascii_lower(F.col("_cv_text")))).drop("_cv_text")


def _coded(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, _POS_BITS)


def _first_pass(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """One row for each document (_cv_id, _cv_h, _cv_n words, _cv_hit false) and one for each of its fingerprints that the benchmark has (_cv_h, _cv_hit true).

    A document's own row goes with its fingerprints, as a mark of -1, so that one read of the texts gives both. Its code
    is below those of all fingerprints, and spread. Marks are dealt out by the outer form, here and below, as the other
    puts a filter on the array's size into the plan, which would make the array again.
    """
    own = F.col("_cv_mark") == -1
    docs = docs.select("_cv_id", "_cv_h", F.size("_cv_words").cast("long").alias("_cv_n"), F.concat(F.array(F.lit(-1).cast("long")), "_cv_marks").alias("_cv_marks"))
    marks = docs.select("_cv_id", "_cv_h", "_cv_n", F.explode_outer("_cv_marks").alias("_cv_mark"))
    marks = marks.withColumn("_cv_code", F.when(own, -1 - F.shiftrightunsigned("_cv_h", 1)).otherwise(_coded(F.col("_cv_mark"))))
    met = marks.join(prints.select("_cv_code", F.lit(True).alias("_cv_met")).distinct(), "_cv_code", "left").where(own | F.col("_cv_met"))
    return met.select(F.when(own, F.col("_cv_id")).alias("_cv_id"), "_cv_h", F.when(own, F.col("_cv_n")).alias("_cv_n"), (~own).alias("_cv_hit"))


def _verified(docs: DataFrame, prints: DataFrame, spans: DataFrame, span: int, k: int, window: int, short: list[int]) -> DataFrame:
    """For rows (_cv_rid, _cv_words) with any span of the benchmark: _cv_rid, its items in order and the places (start, words) of its spans in order."""
    n = F.size("_cv_words")
    marks = _with_fingerprints(docs, k, window, short).select("_cv_rid", n.alias("_cv_n"), F.explode_outer("_cv_marks").alias("_cv_mark"))
    hits = marks.withColumn("_cv_code", _coded(F.col("_cv_mark"))).join(prints, "_cv_code")
    at = F.col("_cv_mark").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int")
    low, high = F.greatest(at - (span - k), F.lit(0)), F.least(at, F.col("_cv_n") - span)
    starts = F.when(F.col("_cv_m") > 0, F.array(at)).when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    tried = hits.select("_cv_rid", F.when(F.col("_cv_m") > 0, F.col("_cv_m")).otherwise(span).alias("_cv_len"), F.explode(starts).alias("_cv_s"))
    # The places of a document are fewer than its words.
    tried = tried.groupBy("_cv_rid").agg(F.collect_set(F.struct("_cv_s", "_cv_len")).alias("_cv_tried"))
    tried = docs.select("_cv_rid", "_cv_words").join(tried, "_cv_rid").select("_cv_rid", "_cv_words", F.inline("_cv_tried"))
    tried = tried.select("_cv_rid", "_cv_s", "_cv_len", F.array_join(F.slice("_cv_words", F.col("_cv_s") + 1, F.col("_cv_len")), " ").alias("_cv_span"))
    found = tried.join(spans, "_cv_span").groupBy("_cv_rid")
    return found.agg(F.sort_array(F.collect_set("_cv_item")).alias("_cv_items"), F.sort_array(F.collect_set(F.struct(F.col("_cv_s").alias("s"), F.col("_cv_len").alias("n")))).alias("_cv_places"))


def find_contamination(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """Words of documents that lie in a span of ``span`` words shared with a benchmark item.

    Both sides keep the least hash of each ``span - k + 1`` k-grams in a row, so that every shared span of ``span`` words
    shares a fingerprint. The documents' fingerprints meet those of the benchmark, each hit is extended to all spans of
    ``span`` words around it, and these are compared word by word, as text, with the items' spans. Items of fewer words are
    one span of their own length; for each such length (at most ``span - 1``) documents keep every hash.

    A first pass sends the documents' fingerprints, without their words, to those of the benchmark; only texts that meet
    any are read again, and their words join once a document.

    Returns one row per document: ``id_col``, text_hash (xxhash64 of the text, null as empty), n_words, n_hit, n_items,
    items_sha256, contaminated. A null text has no words; null or repeated ids are rows of their own; items of equal id
    count once, a null item id counts as an empty one; an item without words is never found; an empty benchmark hits
    nothing, an empty table gives no rows. Other columns are not read.
    """
    spark, window = df.sparkSession, span - k + 1
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_cv_item"), split_words(ascii_lower(F.coalesce(F.col(item_text_col), F.lit("")))).alias("_cv_words")
    ).where(F.size("_cv_words") > 0)
    items = materialize(items, "bench-items")
    size = F.size("_cv_words")
    short = sorted(r[0] for r in items.where(size < span).select(size.alias("n")).distinct().collect())  # at most span - 1 numbers
    length = F.least(size, F.lit(span))
    spans = items.select("_cv_item", "_cv_words", length.alias("_cv_len"), F.explode(F.sequence(F.lit(0), size - length)).alias("_cv_s")).select(
        "_cv_item", F.array_join(F.slice("_cv_words", F.col("_cv_s") + 1, F.col("_cv_len")), " ").alias("_cv_span")
    )
    spans = materialize(spans.distinct(), "bench-spans")
    code = _coded(F.col("_cv_mark")).alias("_cv_code")
    of_long = _with_fingerprints(items.where(size >= span), k, window, []).select(F.explode_outer("_cv_marks").alias("_cv_mark")).select(code, F.lit(0).alias("_cv_m"))
    of_short = [items.where(size == m).select(F.explode(_gram_marks(F.col("_cv_words"), m)).alias("_cv_mark")).select(code, F.lit(m).alias("_cv_m")) for m in short]
    prints = materialize(reduce(DataFrame.unionByName, of_short, of_long).distinct(), "bench-prints")

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_cv_id"), F.xxhash64(text).alias("_cv_h"), text.alias("_cv_text"))
    first = materialize(_first_pass(_with_fingerprints(_worded(docs), k, window, short), prints), "bench-first")
    candidates = materialize(first.where("_cv_hit").select("_cv_h").distinct(), "bench-candidates")  # its size in files decides how it is joined
    nothing = F.array().cast("array<string>"), F.array().cast("array<struct<s:int,n:int>>")
    clean = first.where(~F.col("_cv_hit")).join(candidates, "_cv_h", "left_anti").select("_cv_id", "_cv_h", "_cv_n", nothing[0].alias("_cv_items"), nothing[1].alias("_cv_places"))
    again = materialize(_worded(docs.join(candidates, "_cv_h", "left_semi")).withColumn("_cv_rid", F.monotonically_increasing_id()), "bench-again")
    found = _verified(again, prints, spans, span, k, window, short)
    hit = again.select("_cv_rid", "_cv_id", "_cv_h", size.cast("long").alias("_cv_n")).join(found, "_cv_rid", "left")
    hit = hit.select("_cv_id", "_cv_h", "_cv_n", F.coalesce("_cv_items", nothing[0]).alias("_cv_items"), F.coalesce("_cv_places", nothing[1]).alias("_cv_places"))
    per_doc = clean.unionByName(hit)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    n_hit = F.aggregate(
        "_cv_places",
        zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(a["to"], x["s"]))).cast("long").alias("n"), F.greatest(a["to"], x["s"] + x["n"]).alias("to")),
        lambda a: a["n"],
    )
    return per_doc.select(
        F.col("_cv_id").alias(id_col),
        F.col("_cv_h").alias("text_hash"),
        F.col("_cv_n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_cv_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_cv_items", ","), 256).alias("items_sha256"),
        (F.size("_cv_places") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``df`` without documents that share a span with the benchmark. Same cases as ``find_contamination``; clean rows stay as they are, repeated ones as often as they come."""
    found = find_contamination(df, benchmark, id_col=id_col, text_col=text_col, **how)
    bad = found.where("contaminated").select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_cv_k"), F.col("text_hash").alias("_cv_h")).distinct()
    bad = materialize(bad, "contaminated")  # its size in files decides how it is joined
    keyed = df.withColumn("_cv_k", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("_cv_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(bad, ["_cv_k", "_cv_h"], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
