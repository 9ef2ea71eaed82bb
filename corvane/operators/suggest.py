"""Suggesters: term, phrase and completion."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.positions import osa
from corvane.plans.search import Engine, Index

def _dictionary(ix: Index, field: str) -> DataFrame:
    """Terms of a field with the documents they stand in."""
    tokens = ix.mapping.tokens(ix.mapping.get(field))
    return ix.df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def _near(ix: Index, field: str, words: list[str], how: dict) -> DataFrame:
    """Terms within ``max_edits`` of each of a request's words, with score 1 - distance / shorter length: the dictionary is made once, cut by prefix, length and a loose built-in distance, then measured."""
    edits, prefix = int(how.get("max_edits", 2)), int(how.get("prefix_length", 1))
    word = F.col("text")
    pairs = _dictionary(ix, field).where(F.length("term") >= int(how.get("min_word_length", 4))).withColumn("text", F.explode(F.array(*[F.lit(w) for w in words]).cast("array<string>")))
    close = pairs.where((F.col("term") != word) & (F.substring("term", 1, prefix) == F.substring(word, 1, prefix)) & (F.abs(F.length("term") - F.length(word)) <= edits) & (F.levenshtein("term", word) <= 2 * edits))

    @F.pandas_udf("int")
    def distance(terms: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([osa(t, w, edits) for t, w in zip(terms, texts, strict=True)], dtype="int32")

    score = 1.0 - F.col("d") / F.least(F.length("term"), F.length(word))
    found = close.withColumn("d", distance("term", word)).where(F.col("d") <= edits)
    return found.select("text", F.col("term").alias("suggestion"), score.alias("score"), "freq").where(F.col("score") >= float(how.get("accuracy", 0.5)))


def _best(found: DataFrame, by_frequency: bool, size: int) -> DataFrame:
    """The first ``size`` suggestions of each word."""
    order = [F.desc("freq"), F.desc("score")] if by_frequency else [F.desc("score"), F.desc("freq")]
    ranked = found.withColumn("_cv_r", F.row_number().over(Window.partitionBy("text").orderBy(*order, "suggestion")))
    return ranked.where(F.col("_cv_r") <= size)


def term_suggest(ix: Index, text: str, how: dict) -> DataFrame:
    """Corrections of each word: ``missing`` only for words not in the index, ``popular`` only more frequent ones, ``always``; by score, then frequency, then term."""
    field, mode = how["field"], how.get("suggest_mode", "missing")
    words = list(dict.fromkeys(ix.df.sparkSession.range(1).select(ix.mapping.analyzed(ix.mapping.get(field), text).alias("t")).first()["t"]))
    known = {r["term"]: r["freq"] for r in _dictionary(ix, field).where(F.col("term").isin(words or [""])).collect()}
    asked = [w for w in words if len(w) >= int(how.get("min_word_length", 4)) and not (mode == "missing" and w in known)]
    if not asked:
        return ix.df.sparkSession.createDataFrame([], "text string, suggestion string, score double, freq long")
    found = _near(ix, field, asked, how)
    if mode == "popular":
        often = F.create_map(*[F.lit(x) for w in words for x in (w, known.get(w, 0))])
        found = found.where(F.col("freq") > F.try_element_at(often, F.col("text")))
    order = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)])
    return _best(found, how.get("sort") == "frequency", int(how.get("size", 5))).orderBy(F.try_element_at(order, F.col("text")), "_cv_r").select("text", "suggestion", "score", "freq")


def phrase_suggest(ix: Index, text: str, how: dict) -> list[tuple[str, float]]:
    """Corrections of a whole phrase: candidates of each word, scored by an n-gram model with stupid backoff (0.4) over a Laplace unigram. Only counts of grams of candidates reach the driver."""
    field, errors = how["field"], float(how.get("max_errors", 1.0))
    tokens = ix.mapping.tokens(ix.mapping.get(field))
    words = list(ix.df.sparkSession.range(1).select(ix.mapping.analyzed(ix.mapping.get(field), text).alias("t")).first()["t"])
    generator = (how.get("direct_generator") or [{"suggest_mode": "always"}])[0]
    near: dict[str, list[str]] = defaultdict(list)
    for r in _best(_near(ix, field, list(dict.fromkeys(words)), {"min_word_length": 3, **generator}), False, int(generator.get("size", 5))).orderBy("_cv_r").collect():
        near[r["text"]].append(r["suggestion"])
    options = [[w, *near[w]] for w in words]
    vocabulary = sorted({w for o in options for w in o})
    inside = ix.df.select(F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("a"), F.get(tokens, i + 1).alias("b"))), lambda p: p["a"].isin(vocabulary)).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b")
    one: dict[str, int] = defaultdict(int)
    two: dict[tuple[str, str], int] = defaultdict(int)
    for r in inside.withColumn("b", F.when(F.col("b").isin(vocabulary), F.col("b"))).groupBy("a", "b").count().collect():
        one[r["a"]] += r["count"]
        if r["b"] is not None:
            two[(r["a"], r["b"])] += r["count"]
    total, kinds = ix.df.select(F.explode(tokens).alias("t")).agg(F.count("*"), F.count_distinct("t")).first()
    limit = max(1, round(errors * len(words)) if errors < 1 else int(errors))
    beam: list[tuple[float, list[str], int]] = [(0.0, [], 0)]
    for n, o in enumerate(options):
        grown = []
        for s, path, wrong in beam:
            for w in o:
                bad = wrong + (w != words[n])
                if bad > limit:
                    continue
                uni = (one[w] + 1) / (total + kinds)
                p = two[(path[-1], w)] / one[path[-1]] if path and two[(path[-1], w)] else 0.4 * uni if path else uni
                grown.append((s + math.log(p), [*path, w], bad))
        beam = sorted(grown, key=lambda x: (-x[0], x[1]))[:20_000]
    base = next((s for s, p, _ in beam if p == words), -math.inf)
    confidence = float(how.get("confidence", 1.0))
    kept = [(" ".join(p), math.exp(s)) for s, p, _ in beam if p != words and math.exp(s) > confidence * math.exp(base)]
    return kept[: int(how.get("size", 5))]


def completion_suggest(df: DataFrame, prefix: str, how: dict) -> DataFrame:
    """Inputs of a completion column (struct or array of struct<input, weight, contexts>) that begin with the prefix, by weight; ``fuzzy`` allows edits in it, ``contexts`` filter categories."""
    field = how["field"]
    kind = dict(df.dtypes)[field]
    entries = df.select("_id", (F.explode(field) if kind.startswith("array") else F.col(field)).alias("c")) if kind.startswith(("array", "struct")) else df.select("_id", F.struct(F.array(field).alias("input"), F.lit(1).alias("weight")).alias("c"))
    for name, values in how.get("contexts", {}).items():
        wanted = [v["context"] if isinstance(v, dict) else v for v in (values if isinstance(values, list) else [values])]
        entries = entries.where(F.arrays_overlap(F.try_element_at(F.col("c.contexts"), F.lit(name)), F.array(*[F.lit(w) for w in wanted])))
    rows = entries.select("_id", F.explode("c.input").alias("text"), F.col("c.weight").cast("long").alias("weight"))
    low = prefix.lower()
    hit: Column = F.startswith(F.lower("text"), F.lit(low))
    if fuzzy := how.get("fuzzy"):
        edits = int(fuzzy.get("fuzziness", 1 if len(prefix) < 6 else 2)) if isinstance(fuzzy, dict) else 1
        keep = int(fuzzy.get("prefix_length", 1)) if isinstance(fuzzy, dict) else 1
        near = [F.levenshtein(F.substring(F.lower("text"), 1, len(low) + d), F.lit(low)) <= edits for d in range(-edits, edits + 1) if len(low) + d > 0]
        anyway = near[0]
        for x in near[1:]:
            anyway = anyway | x
        hit = hit | (F.startswith(F.lower("text"), F.lit(low[:keep])) & anyway)
    rows = rows.where(hit)
    if how.get("skip_duplicates"):
        rows = rows.groupBy("text").agg(F.max("weight").alias("weight"), F.min("_id").alias("_id"))
    return rows.select("_id", "text", "weight").orderBy(F.desc("weight"), "text", "_id").limit(int(how.get("size", 5)))


def suggest(engine: Engine, expression: str, body: dict) -> dict:
    """The suggest section of a response: each named suggester's options for its text or prefix."""
    out: dict = {}
    ix = engine.resolve(expression)[0][0]
    for name, how in body.items():
        if name == "text":
            continue
        text = how.get("text", how.get("prefix", body.get("text", "")))
        if "completion" in how:
            rows = completion_suggest(ix.df.withColumn("_id", F.col(ix.id_col)), how.get("prefix", text), how["completion"]).collect()
            options = [{"text": r["text"], "_id": str(r["_id"]), "_score": float(r["weight"])} for r in rows]
            out[name] = [{"text": text, "offset": 0, "length": len(text), "options": options}]
        elif "phrase" in how:
            out[name] = [{"text": text, "offset": 0, "length": len(text), "options": [{"text": t, "score": s} for t, s in phrase_suggest(ix, text, how["phrase"])]}]
        else:
            found: dict[str, list] = defaultdict(list)
            for r in term_suggest(ix, text, how["term"]).collect():
                found[r["text"]].append({"text": r["suggestion"], "score": r["score"], "freq": r["freq"]})
            words = list(ix.df.sparkSession.range(1).select(ix.mapping.analyzed(ix.mapping.get(how["term"]["field"]), text).alias("t")).first()["t"])
            at, entries = 0, []
            for w in words:
                start = text.lower().find(w.lower(), at)
                at = max(start, 0) + len(w)
                entries.append({"text": w, "offset": max(start, 0), "length": len(w), "options": found.get(w, [])})
            out[name] = entries
    return out
