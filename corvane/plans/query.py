"""The query DSL compiled to columns: for each node whether a row matches, and its score."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import datemath, geo, hashing, patterns, positions
from corvane.functions.scripts import Script
from corvane.plans.mapping import NUMERIC, RANGES, TEXT, Field, Mapping, id_in

if TYPE_CHECKING:
    from corvane.plans.search import Engine

MAX_CLAUSES, MAX_EXPANSIONS = 1024, 50
REJECTED = {"knn", "neural", "neural_sparse", "percolate", "xy_shape", "hybrid", "template", "span_or", "span_first", "span_not", "span_containing", "span_within", "field_masking_span", "span_field_masking"}


class Match(NamedTuple):
    """Whether a row matches, where null stands for no, and its score where it does. Left nullable so that the scan can take over the comparisons."""

    hit: Column
    score: Column


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def _sum(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs) if cs else F.lit(0.0)


def _equals(value: object) -> Callable[[Column], Column]:
    return lambda x: x == value


def _one(body: dict) -> tuple[str, object]:
    if len(body) != 1:
        raise ValueError(f"expected a single field or query, got {sorted(body)}")
    return next(iter(body.items()))


class Compiler:
    """Compiles queries over one index. Joins that a query needs are added to ``df``; without ``scoring`` text statistics are not gathered."""

    def __init__(self, df: DataFrame, mapping: Mapping, engine: Engine | None = None, scoring: bool = False, id_col: str = "_id", index: str = "") -> None:
        self.df, self.mapping, self.engine, self.scoring, self.id_col, self.index = df, mapping, engine, scoring, id_col, index
        self.named: dict[str, Column] = {}
        self.inner: dict[str, Column] = {}
        self._stats: dict[str, object] = {}
        self._n = 0

    # -- entry

    def compile(self, node: dict | None) -> Match:
        if not node:
            return Match(F.lit(True), F.lit(1.0))
        kind, body = _one(node)
        if kind in REJECTED:
            raise ValueError(f"[{kind}] query is not supported")
        f = getattr(self, f"q_{kind}", None)
        if f is None:
            raise ValueError(f"unknown query [{kind}]")
        options = body if isinstance(body, dict) else {}
        inner = next(iter(options.values())) if len(options) == 1 and isinstance(next(iter(options.values())), dict) and kind not in ("bool", "constant_score", "nested", "function_score", "boosting", "dis_max") else {}
        m = f(body)
        boost = float(inner.get("boost", options.get("boost", 1.0)) if kind not in ("constant_score",) else 1.0)
        m = Match(m.hit, m.score * boost if boost != 1.0 else m.score)
        name = options.get("_name") or inner.get("_name")
        if name:
            self.named[name] = m.hit
        return m

    def _const(self, hit: Column) -> Match:
        return Match(hit, F.lit(1.0))

    def _field(self, name: str) -> Field | None:
        return self.mapping.get(name)

    def _on(self, f: Field, test: Callable[[Column], Column]) -> Column:
        """The test on a field's value, any of its values, or any of a text's tokens."""
        if f.type in TEXT:
            return F.exists(self.mapping.tokens(f), test)
        c = self.mapping.column(f)
        return F.exists(c, test) if f.multi else test(c)

    # -- leaves

    def q_match_all(self, body: dict) -> Match:
        return self._const(F.lit(True))

    def q_match_none(self, body: dict) -> Match:
        return self._const(F.lit(False))

    def _value(self, f: Field, v: object) -> Column | None:
        """The literal of a query's value in the field's type, None if no value of it can be equal."""
        if f.type in NUMERIC:
            number = float(v)
            if f.type in ("long", "integer", "short", "byte", "unsigned_long", "token_count"):
                return F.lit(int(v) if isinstance(v, (int, str)) and str(v).lstrip("-").isdigit() else int(number)) if number == int(number) else None
            return F.lit(number)
        if f.type == "boolean":
            return F.lit(v if isinstance(v, bool) else {"true": True, "false": False, "": False}[str(v)])
        if f.type in ("date", "date_nanos"):
            return F.lit(datemath.resolve(v)).cast("timestamp_ntz")
        return F.lit(str(v))

    def q_term(self, body: dict) -> Match:
        name, how = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        v, fold = (how["value"], how.get("case_insensitive", False)) if isinstance(how, dict) else (how, False)
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        if f.type in RANGES:
            c = self.mapping.column(f)
            v = self._value(Field("", f.type.removesuffix("_range"), ""), v)
            return self._const((c["gte"] <= v) & (c["lte"] >= v))
        if f.type == "flat_object":
            return self._const(F.array_contains(F.map_values(self.mapping.column(f)), str(v)))
        if f.type == "ip":
            lo, hi = geo.ip_bounds(str(v))
            return self._const(self._on(f, lambda x: geo.ip_key(x).between(lo, hi)))
        value = self._value(f, v)
        if value is None:
            return self._const(F.lit(False))
        hit = self._on(f, (lambda x: F.lower(x) == F.lower(value)) if fold else lambda x: x == value)
        if self.scoring and f.type in TEXT:
            return Match(hit, self._bm25(f, [str(v)]))
        return self._const(hit)

    def q_terms(self, body: dict) -> Match:
        name, values = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        if isinstance(values, dict):
            return self._const(self._terms_lookup(f, values))
        if f.type == "ip":
            return self._const(_any([self.q_term({name: v}).hit for v in values]))
        known = [x for x in (self._value(f, v) for v in values) if x is not None]
        return self._const(self._on(f, lambda x: x.isin(known)) if known else F.lit(False))

    def _terms_lookup(self, f: Field, how: dict) -> Column:
        """Values of another index's field, by id or query: a join on distinct values."""
        other = self.engine.index(how["index"])
        rows = other.df.where(id_in(other.df, other.id_col, [how["id"]])) if "id" in how else other.filtered(how.get("query"))
        at = other.mapping.get(how["path"])
        c = other.mapping.column(at)
        found = rows.select((F.explode(c) if at.multi else c).alias("v")).where("v is not null").distinct()
        return self._flag(found, lambda x: x, f)

    def _flag(self, found: DataFrame, key: Callable[[Column], Column], f: Field) -> Column:
        """A column that tells whether the field's value is among the distinct values v of ``found``."""
        flag = self._name()
        if f.multi or f.type in TEXT:
            ids = self.df.select(F.col(self.id_col).alias("i"), F.explode(self.mapping.tokens(f) if f.type in TEXT else self.mapping.column(f)).alias("v")).join(found, "v", "left_semi").select(F.col("i").alias(f"{flag}_k")).distinct()
            own = F.col(self.id_col)
        else:
            ids, own = found.select(F.col("v").alias(f"{flag}_k")), self.mapping.column(f)
        self.df = self.df.join(ids.withColumn(flag, F.lit(True)), own == F.col(f"{flag}_k"), "left").drop(f"{flag}_k")
        return F.col(flag).isNotNull()

    def _name(self) -> str:
        self._n += 1
        return f"_cv_j{self._n}"

    def q_terms_set(self, body: dict) -> Match:
        name, how = _one(body)
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        values = F.array(*[F.lit(str(t)) for t in how["terms"]])
        need = self.mapping.column(self._field(how["minimum_should_match_field"]))
        return self._const(F.size(F.array_intersect(self.mapping.tokens(f), values)) >= F.when(need.isNotNull(), F.greatest(F.lit(1), need)))

    def _bound(self, f: Field, v: object, op: str, how: dict) -> Column:
        if f.type in ("date", "date_nanos", "date_range"):
            return F.lit(datemath.resolve(v, round_up=op in ("gt", "lte"), time_zone=how.get("time_zone"), fmt=how.get("format"))).cast("timestamp_ntz")
        if f.type in NUMERIC or f.type in RANGES:
            n = float(v)
            if f.type in ("long", "integer", "short", "byte"):
                return F.lit(math.ceil(n) if op in ("gte", "lt") else math.floor(n))
            return F.lit(n)
        return F.lit(v if isinstance(v, bool) else str(v))

    def q_range(self, body: dict) -> Match:
        name, how = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        how = dict(how)
        for old, a, b in (("from", "gte", "gt"), ("to", "lte", "lt")):
            if old in how:
                how[a if how.pop("include_lower" if old == "from" else "include_upper", True) else b] = how.pop(old)
        ops = {"gt": lambda x, v: x > v, "gte": lambda x, v: x >= v, "lt": lambda x, v: x < v, "lte": lambda x, v: x <= v}
        bounds = {k: self._bound(f, how[k], k, how) for k in ops if how.get(k) is not None}
        if f.type in RANGES:
            c, relation = self.mapping.column(f), how.get("relation", "INTERSECTS").upper()
            lo = ("gte", "gt")
            tests = []
            for k, v in bounds.items():
                if relation == "INTERSECTS":
                    tests.append(ops[k](c["lte"] if k in lo else c["gte"], v))
                elif relation == "WITHIN":
                    tests.append(ops[k](c["gte"] if k in lo else c["lte"], v))
                else:
                    tests.append(c["gte"] <= v if k in lo else c["lte"] >= v)
            return self._const(c.isNotNull() & _all(tests))
        if f.type == "ip":
            bounds = {k: F.lit(geo.ip_bounds(str(how[k]))[k in ("lte", "gt")]) for k in bounds}
            return self._const(self._on(f, lambda x: _all([ops[k](geo.ip_key(x), v) for k, v in bounds.items()])))
        return self._const(self._on(f, lambda x: _all([x.isNotNull(), *[ops[k](x, v) for k, v in bounds.items()]])))

    def _exists(self, name: str) -> Column:
        f = self._field(name)
        if f is None:
            return F.lit(False)
        if f.type == "object":
            return _any([self._exists(n) for n in self.mapping.match(f"{name}.*")])
        c = self.mapping.column(f)
        return _sure(F.size(F.filter(c, lambda x: x.isNotNull())) > 0) if f.multi and f.type != "nested" else _sure(F.size(c) > 0) if f.multi else c.isNotNull()

    def q_exists(self, body: dict) -> Match:
        return self._const(self._exists(body["field"]))

    def _multi_term(self, body: dict, test: Callable[[Column, str, bool], Column]) -> Match:
        name, how = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        v, fold = (how.get("value", how.get("wildcard")), how.get("case_insensitive", False)) if isinstance(how, dict) else (how, False)
        return self._const(self._on(f, lambda x: test(F.lower(x) if fold else x, str(v).lower() if fold else str(v), fold)))

    def q_prefix(self, body: dict) -> Match:
        return self._multi_term(body, lambda x, v, _: F.startswith(x, F.lit(v)))

    def q_wildcard(self, body: dict) -> Match:
        return self._multi_term(body, lambda x, v, _: F.regexp_like(x, F.lit(patterns.wildcard(v))))

    def q_regexp(self, body: dict) -> Match:
        return self._multi_term(body, lambda x, v, _: F.regexp_like(x, F.lit(patterns.lucene(v))))

    def q_fuzzy(self, body: dict) -> Match:
        name, how = _one(body)
        how = how if isinstance(how, dict) else {"value": how}
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        if int(how.get("max_expansions", 50)) <= 0:
            raise ValueError("maxExpansions must be positive.")
        return self._const(self._fuzzy(f, str(how["value"]), how))

    def _expanded(self, f: Field, what: tuple, of: Callable[[DataFrame], DataFrame]) -> list[str]:
        """What ``of`` takes of the field's distinct terms (column t), asked once a request; it bounds how many reach the driver."""
        key = (f.name, "terms", *what)
        if key not in self._stats:
            found = of(self.df.select(F.explode(self.mapping.tokens(f)).alias("t")).distinct())
            self._stats[key] = [r["t"] for r in found.collect()]
        return self._stats[key]

    def _fuzzy(self, f: Field, term: str, how: dict) -> Column:
        """Whether a document has one of the ``max_expansions`` terms of the field that are most like the term, by edits over the shorter length, ties by term."""
        edits, prefix = positions.fuzziness(how.get("fuzziness", "AUTO"), term), int(how.get("prefix_length", 0))
        swaps, most = bool(how.get("transpositions", how.get("fuzzy_transpositions", True))), int(how.get("max_expansions", 50))
        tokens = self.mapping.tokens(f)
        if not edits or prefix >= len(term):
            return F.array_contains(tokens, term)
        if self.df.isStreaming:  # which has no terms to count: all of those near enough
            return positions.fuzzy_any(tokens, term, edits, prefix) if swaps else F.exists(tokens, lambda x: (F.levenshtein(x, F.lit(term)) <= edits) & (F.substring(x, 1, prefix) == term[:prefix]))

        def nearest(words: DataFrame) -> DataFrame:
            near = words.where((F.abs(F.length("t") - len(term)) <= edits) & (F.substring("t", 1, prefix) == term[:prefix]) & (F.levenshtein("t", F.lit(term)) <= edits * (2 if swaps else 1)))
            near = near.withColumn("d", positions.edits(F.substring("t", prefix + 1, 2**31 - 1), term[prefix:], edits) if swaps else F.levenshtein("t", F.lit(term))).where(F.col("d") <= edits)
            return near.orderBy(F.desc(1 - F.col("d") / F.least(F.length("t"), F.lit(len(term)))), "t").select("t").limit(most)

        found = self._expanded(f, ("fuzzy", term, edits, prefix, swaps, most), nearest)
        return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in found])) if found else F.lit(False)

    def _begun(self, f: Field, start: str, how: dict) -> list[str]:
        """The first ``max_expansions`` terms of the field, in order, that begin so."""
        most = max(1, int(how.get("max_expansions", 50)))
        return self._expanded(f, ("prefix", start, most), lambda words: words.where(F.startswith("t", F.lit(start))).orderBy("t").limit(most))

    def q_ids(self, body: dict) -> Match:
        return self._const(id_in(self.df, self.id_col, body["values"]))

    def script(self, how: dict | str, score: Column | None = None) -> Column:
        how = {"source": how} if isinstance(how, str) else how
        if how.get("lang", "painless") not in ("painless", "expression"):
            raise ValueError(f"script_lang not supported [{how['lang']}]")

        def value(name: str) -> Column:
            f = self._field(name)
            if f is None:
                raise ValueError(f"No field found for [{name}] in mapping")
            c = self.mapping.column(f)
            return F.array_min(c) if f.multi else c

        whole = lambda n: (f := self._field(n)) is not None and f.type in ("long", "integer", "short", "byte")
        return Script(how["source"], value, how.get("params"), score, whole).compile()

    def q_script(self, body: dict) -> Match:
        return self._const(self.script(body["script"]))

    def q_wrapper(self, body: dict) -> Match:
        return self.compile(json.loads(base64.b64decode(body["query"])))

    # -- full text

    def _terms_of(self, f: Field, text: object, analyzer: str | dict | None = None) -> list[str]:
        """A query's tokens: one row evaluated on the driver."""
        key = (f.name, str(text), str(analyzer))
        if key not in self._stats:
            self._stats[key] = list(self.df.sparkSession.range(1).select(self.mapping.analyzed(f, str(text), analyzer).alias("t")).first()["t"])
        return self._stats[key]

    def _text_stats(self, f: Field, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """Documents with the field, mean length and document frequency of the terms: one aggregate row."""
        key = (f.name, *sorted(set(terms)))
        if key not in self._stats:
            t = F.col("t")
            row = self.df.select(self.mapping.tokens(f).alias("t")).where(F.size("t") > 0).agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("l"), *[F.sum(F.array_contains(t, x).cast("long")).alias(f"d{i}") for i, x in enumerate(dict.fromkeys(terms))]).first()
            self._stats[key] = (row["n"], float(row["l"] or 1.0), {x: row[f"d{i}"] or 0 for i, x in enumerate(dict.fromkeys(terms))})
        return self._stats[key]

    def _bm25(self, f: Field, terms: list[str], k1: float = 1.2, b: float = 0.75) -> Column:
        if f.params.get("similarity") == "boolean" or not terms:
            return F.lit(float(len(terms)))
        n, mean, freq = self._text_stats(f, terms)
        tokens = self.mapping.tokens(f)
        length = F.size(tokens)
        out = []
        for t in terms:
            idf = math.log(1 + (n - freq[t] + 0.5) / (freq[t] + 0.5))
            tf = F.size(F.filter(tokens, _equals(t))).cast("double")
            out.append(F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))
        return F.coalesce(_sum(out), F.lit(0.0))

    def _match(self, f: Field, text: object, how: dict) -> Match:
        terms = self._terms_of(f, text, how.get("analyzer"))
        if f.type not in TEXT and f.type != "keyword":
            return self.q_term({f.name: text})
        if not terms:
            return self._const(F.lit(how.get("zero_terms_query", "none") == "all"))
        tokens = self.mapping.tokens(f)
        hits = [self._fuzzy(f, t, how) if "fuzziness" in how else F.array_contains(tokens, t) for t in terms]
        need = len(terms) if str(how.get("operator", "or")).lower() == "and" else patterns.minimum_should_match(how.get("minimum_should_match", 1), len(terms))
        hit = _all(hits) if need >= len(terms) else _any(hits) if need <= 1 else _sum([_sure(h).cast("int") for h in hits]) >= need
        return Match(_sure(hit), self._bm25(f, terms) if self.scoring else F.lit(1.0))

    def _text_query(self, body: dict, f: Callable[[Field, object, dict], Match]) -> Match:
        name, how = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        how = how if isinstance(how, dict) else {"query": how}
        field = self._field(name)
        return f(field, how["query"], how) if field else self._const(F.lit(False))

    def q_match(self, body: dict) -> Match:
        return self._text_query(body, self._match)

    def _phrase(self, f: Field, text: object, how: dict, prefix: bool = False) -> Match:
        terms = self._terms_of(f, text, how.get("analyzer"))
        if not terms:
            return self._const(F.lit(how.get("zero_terms_query", "none") == "all"))
        hit = positions.phrase(self.mapping.tokens(f), terms, int(how.get("slop", 0)), prefix, self._begun(f, terms[-1], how) if prefix and not self.df.isStreaming else None)
        return Match(_sure(hit), self._bm25(f, terms[:-1] if prefix else terms) if self.scoring else F.lit(1.0))

    def q_match_phrase(self, body: dict) -> Match:
        return self._text_query(body, self._phrase)

    def q_match_phrase_prefix(self, body: dict) -> Match:
        return self._text_query(body, lambda f, q, how: self._phrase(f, q, how, True))

    def _bool_prefix(self, f: Field, text: object, how: dict) -> Match:
        terms = self._terms_of(f, text, how.get("analyzer"))
        if not terms:
            return self._const(F.lit(False))
        tokens = self.mapping.tokens(f)
        hits = [F.array_contains(tokens, t) for t in terms[:-1]] + [F.exists(tokens, lambda x: F.startswith(x, F.lit(terms[-1])))]
        need = len(terms) if str(how.get("operator", "or")).lower() == "and" else patterns.minimum_should_match(how.get("minimum_should_match", 1), len(terms))
        return Match(_sure(_sum([_sure(h).cast("int") for h in hits]) >= max(1, need)), self._bm25(f, terms[:-1]) + hits[-1].cast("double") if self.scoring else F.lit(1.0))

    def q_match_bool_prefix(self, body: dict) -> Match:
        return self._text_query(body, self._bool_prefix)

    def _fields(self, names: list[str] | None) -> list[tuple[Field, float]]:
        out = []
        for n in names or ["*"]:
            name, _, boost = n.partition("^")
            for m in self.mapping.match(name) if "*" in name else [name]:
                f = self._field(m)
                if f and (f.type in TEXT or f.type == "keyword" or "*" not in name):
                    out.append((f, float(boost or 1)))
        return out

    def _best(self, ms: list[Match], tie: float) -> Match:
        if not ms:
            return self._const(F.lit(False))
        scores = [F.when(m.hit, m.score).otherwise(0.0) for m in ms]
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return Match(_any([m.hit for m in ms]), top + (_sum(scores) - top) * tie if tie else top)

    def q_multi_match(self, body: dict) -> Match:
        kind, how = body.get("type", "best_fields"), {k: v for k, v in body.items() if k not in ("fields", "type", "boost", "_name")}
        fields = self._fields(body.get("fields"))
        if kind == "cross_fields":
            return self._per_term(fields, body, sum_scores=False)
        one = {"phrase": self._phrase, "phrase_prefix": lambda f, q, h: self._phrase(f, q, h, True), "bool_prefix": self._bool_prefix}.get(kind, self._match)
        ms = [one(f, body["query"], how) for f, _ in fields]
        ms = [Match(m.hit, m.score * b) for m, (_, b) in zip(ms, fields, strict=True)]
        return self._best(ms, float(body.get("tie_breaker", {"most_fields": 1.0, "bool_prefix": 1.0}.get(kind, 0.0))))

    def _per_term(self, fields: list[tuple[Field, float]], body: dict, sum_scores: bool) -> Match:
        """Each term in any of the fields, then operator or minimum over terms."""
        if not fields:
            return self._const(F.lit(False))
        terms = self._terms_of(fields[0][0], body["query"], body.get("analyzer"))
        hits, scores = [], []
        for t in terms:
            each = [F.array_contains(self.mapping.tokens(f), t) for f, _ in fields]
            hits.append(_sure(_any(each)))
            if self.scoring:
                own = [self._bm25(f, [t]) * b for f, b in fields]
                scores.append(_sum(own) if sum_scores or len(own) == 1 else F.greatest(*own))
        need = len(terms) if str(body.get("operator", "or")).lower() == "and" else patterns.minimum_should_match(body.get("minimum_should_match", 1), len(terms))
        return Match(_sum([h.cast("int") for h in hits]) >= max(1, need), _sum(scores) if self.scoring else F.lit(1.0))

    def q_combined_fields(self, body: dict) -> Match:
        return self._per_term([(f, b) for f, b in self._fields(body["fields"]) if f.type in TEXT], body, sum_scores=True)

    def q_common(self, body: dict) -> Match:
        name, how = _one(body)
        f = self._field(name)
        if f is None:
            return self._const(F.lit(False))
        terms = self._terms_of(f, how["query"], how.get("analyzer"))
        n, _, freq = self._text_stats(f, terms)
        cut = float(how.get("cutoff_frequency", 0.01))
        often = [t for t in terms if freq[t] > (cut if cut >= 1 else cut * n)]
        rare = [t for t in terms if t not in often]
        tokens = self.mapping.tokens(f)
        chosen, op = (rare, how.get("low_freq_operator", "or")) if rare else (often, how.get("high_freq_operator", "or"))
        hits = [F.array_contains(tokens, t) for t in chosen]
        spec = how.get("minimum_should_match", 1)
        spec = spec.get("low_freq" if rare else "high_freq", 1) if isinstance(spec, dict) else spec
        need = len(hits) if op.lower() == "and" else patterns.minimum_should_match(spec, len(hits))
        return Match(_sum([_sure(h).cast("int") for h in hits]) >= max(1, need), self._bm25(f, terms) if self.scoring else F.lit(1.0))

    def q_query_string(self, body: dict) -> Match:
        from corvane.plans.qstring import parse_query_string

        return self.compile(parse_query_string(body["query"], body, self.mapping))

    def q_simple_query_string(self, body: dict) -> Match:
        from corvane.plans.qstring import parse_simple

        return self.compile(parse_simple(body["query"], body, self.mapping))

    def _rule(self, f: Field, rule: dict) -> dict:
        kind, how = _one(rule)
        mode = how.get("mode") or ("ordered" if how.get("ordered") else "unordered")
        if kind == "match":
            out = {"kind": "match", "terms": self._terms_of(f, how["query"], how.get("analyzer")), "mode": mode, "max_gaps": how.get("max_gaps", -1)}
        elif kind in ("prefix", "wildcard", "regexp"):
            text = how.get("prefix") or how.get("pattern")
            out = {"kind": "regex", "pattern": {"prefix": lambda p: "(?s)" + "".join("\\" + c if not c.isalnum() else c for c in p) + ".*", "wildcard": patterns.wildcard, "regexp": patterns.lucene}[kind](text)}
        elif kind == "fuzzy":
            out = {"kind": "fuzzy", "term": how["term"], "edits": positions.fuzziness(how.get("fuzziness", "AUTO"), how["term"])}
        else:
            out = {"kind": kind, "rules": [self._rule(f, r) for r in how["intervals"]], "mode": mode, "max_gaps": how.get("max_gaps", -1)}
        if "filter" in how:
            name, inner = _one(how["filter"])
            out["filter"] = (name, self._rule(f, inner))
        return out

    def q_intervals(self, body: dict) -> Match:
        name, rule = _one({k: v for k, v in body.items() if k not in ("boost", "_name")})
        f = self._field(name)
        return self._const(positions.intervals(self.mapping.tokens(f), self._rule(f, {k: v for k, v in rule.items() if k != "boost"}))) if f else self._const(F.lit(False))

    def _span(self, node: dict) -> tuple[str, dict]:
        kind, body = _one(node)
        if kind == "span_term":
            name, how = _one(body)
            return name, {"kind": "match", "terms": [str(how.get("value", how.get("term")) if isinstance(how, dict) else how)], "mode": "ordered", "max_gaps": -1}
        if kind == "span_multi":
            inner, how = _one(body["match"])
            name, v = _one(how)
            text = str(v.get("value") if isinstance(v, dict) else v)
            if inner == "fuzzy":
                return name, {"kind": "fuzzy", "term": text, "edits": positions.fuzziness("AUTO", text)}
            return name, {"kind": "regex", "pattern": patterns.wildcard(text + "*") if inner == "prefix" else patterns.wildcard(text) if inner == "wildcard" else patterns.lucene(text)}
        if kind != "span_near":
            raise ValueError(f"[{kind}] query is not supported")
        parts = [self._span(c) for c in body["clauses"]]
        return parts[0][0], {"kind": "all_of", "rules": [r for _, r in parts], "mode": "ordered" if body.get("in_order", True) else "unordered_no_overlap", "max_gaps": int(body.get("slop", 0))}

    def _span_match(self, node: dict) -> Match:
        name, rule = self._span(node)
        f = self._field(name)
        return self._const(positions.intervals(self.mapping.tokens(f), rule)) if f else self._const(F.lit(False))

    def q_span_term(self, body: dict) -> Match:
        return self._span_match({"span_term": body})

    def q_span_near(self, body: dict) -> Match:
        return self._span_match({"span_near": body})

    def q_span_multi(self, body: dict) -> Match:
        return self._span_match({"span_multi": body})

    def q_more_like_this(self, body: dict) -> Match:
        fields = [f for f, _ in self._fields(body.get("fields"))]
        likes = body["like"] if isinstance(body["like"], list) else [body["like"]]
        ids = [str(x["_id"]) for x in likes if isinstance(x, dict)]
        hits, n_terms = [], 0
        for f in fields:
            tokens = self.mapping.tokens(f)
            counts: dict[str, int] = {}
            for text in (x for x in likes if isinstance(x, str)):
                for t in self._terms_of(f, text):
                    counts[t] = counts.get(t, 0) + 1
            if ids:
                for r in self.df.where(id_in(self.df, self.id_col, ids)).select(F.explode(tokens).alias("t")).groupBy("t").count().collect():
                    counts[r["t"]] = counts.get(r["t"], 0) + r["count"]
            counts = {t: c for t, c in counts.items() if c >= body.get("min_term_freq", 2) and len(t) >= body.get("min_word_length", 0) and t not in body.get("stop_words", ())}
            if not counts:
                continue
            spark = self.df.sparkSession
            asked = F.broadcast(spark.createDataFrame(sorted(counts.items()), "t string, tf long"))  # the words of the texts asked about
            freq = {r["t"]: r["count"] for r in self.df.select(F.explode(F.array_distinct(tokens)).alias("t")).join(asked, "t").groupBy("t").count().collect()}
            n = self.df.count()
            kept = {t: counts[t] * (math.log((n + 1) / (d + 1)) + 1) for t, d in freq.items() if body.get("min_doc_freq", 5) <= d <= body.get("max_doc_freq", n)}
            terms = sorted(kept, key=lambda t: (-kept[t], t))[: body.get("max_query_terms", 25)]
            n_terms += len(terms)
            hits += [F.array_contains(tokens, t) for t in terms]
        if not hits:
            return self._const(F.lit(False))
        hit = _sum([_sure(h).cast("int") for h in hits]) >= max(1, patterns.minimum_should_match(body.get("minimum_should_match", "30%"), n_terms))
        if ids and not body.get("include", False):
            hit = hit & ~id_in(self.df, self.id_col, ids)
        return self._const(hit)

    # -- compound

    def q_bool(self, body: dict) -> Match:
        parts = {k: [self.compile(q) for q in (v if isinstance(v, list) else [v])] for k in ("must", "filter", "should", "must_not") if (v := body.get(k))}
        must, keep, should, never = (parts.get(k, []) for k in ("must", "filter", "should", "must_not"))
        if sum(map(len, (must, keep, should, never))) > MAX_CLAUSES:
            raise ValueError("too_many_clauses")
        tests = [m.hit for m in must + keep] + [~_sure(m.hit) for m in never]
        required = bool(must or keep)
        need = patterns.minimum_should_match(body["minimum_should_match"], len(should)) if "minimum_should_match" in body else 0 if required else 1
        need = max(need, 0 if required else 1)
        if should and need:
            tests.append(_any([m.hit for m in should]) if need == 1 else _sum([_sure(m.hit).cast("int") for m in should]) >= need)
        score = _sum([m.score for m in must] + [F.when(m.hit, m.score).otherwise(0.0) for m in should]) if must or should else F.lit(0.0 if keep else 1.0)
        return Match(_all(tests), score)

    def q_constant_score(self, body: dict) -> Match:
        return Match(self.compile(body["filter"]).hit, F.lit(float(body.get("boost", 1.0))))

    def q_dis_max(self, body: dict) -> Match:
        return self._best([self.compile(q) for q in body["queries"]], float(body.get("tie_breaker", 0.0)))

    def q_boosting(self, body: dict) -> Match:
        yes, no = self.compile(body["positive"]), self.compile(body["negative"])
        return Match(yes.hit, F.when(no.hit, yes.score * float(body["negative_boost"])).otherwise(yes.score))

    def _decay(self, kind: str, spec: dict) -> Column:
        mode = spec.get("multi_value_mode", "min")
        name, how = _one({k: v for k, v in spec.items() if k != "multi_value_mode"})
        f, decay = self._field(name), float(how.get("decay", 0.5))
        c = self.mapping.column(f)
        if f.type == "geo_point":
            lat, lon = geo.point(how["origin"])
            scale, offset = geo.metres(how["scale"]), geo.metres(how.get("offset", 0))
            gap = lambda x: geo.haversine(x, lat, lon)
        elif f.type == "date":
            at = datemath.resolve(how.get("origin", "now"))
            scale, offset = datemath.parse_duration_ms(how["scale"]), datemath.parse_duration_ms(how.get("offset", "0ms"))
            gap = lambda x: F.abs(F.timestamp_diff("MICROSECOND", F.lit(at).cast("timestamp_ntz"), x)) / 1000.0
        else:
            at, scale, offset = float(how["origin"]), float(how["scale"]), float(how.get("offset", 0))
            gap = lambda x: F.abs(x - at)
        if f.multi:
            all_gaps = F.transform(c, gap)
            gap_of = {"min": F.array_min, "max": F.array_max, "sum": lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x), "avg": lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g)}[mode](all_gaps)
        else:
            gap_of = gap(c)
        d = F.greatest(F.lit(0.0), gap_of - offset)
        if kind == "gauss":
            out = F.exp(0.5 * d * d / (0.5 * scale**2 / math.log(decay)))
        elif kind == "exp":
            out = F.exp(math.log(decay) / scale * d)
        else:
            s = scale / (1 - decay)
            out = F.greatest(F.lit(0.0), (s - d) / s)
        return F.coalesce(out, F.lit(1.0))

    def _function(self, fn: dict, score: Column) -> Column:
        w = float(fn.get("weight", 1.0))
        for kind in ("gauss", "exp", "linear"):
            if kind in fn:
                return self._decay(kind, fn[kind]) * w
        if "field_value_factor" in fn:
            how = fn["field_value_factor"]
            f = self._field(how["field"])
            c = self.mapping.column(f)
            c = (F.array_min(c) if f.multi else c).cast("double")
            v = F.coalesce(c, F.lit(float(how["missing"])) if "missing" in how else F.lit(None).cast("double")) * float(how.get("factor", 1))
            m = {"none": lambda x: x, "log": F.log10, "log1p": lambda x: F.log10(x + 1), "log2p": lambda x: F.log10(x + 2), "ln": F.log, "ln1p": F.log1p, "ln2p": lambda x: F.log(x + 2), "square": lambda x: x * x, "sqrt": F.sqrt, "reciprocal": lambda x: 1 / x}
            return m[how.get("modifier", "none")](v) * w
        if "random_score" in fn:
            how = fn["random_score"]
            by = self.mapping.column(self._field(how["field"])) if how.get("field", "_id") != "_id" else F.col(self.id_col)
            seed = str(how.get("seed", 0))
            number = re.fullmatch(r"[+-]?\d+(\.\d*)?", seed)
            salted = hashing.mix32(int(seed.split(".")[0]) if number else hashing.string_hash(seed), hashing.string_hash(self.index) << 10)
            h = F.coalesce(hashing.murmur3(F.encode(by.cast("string"), "UTF-8"), salted), F.lit(salted).cast("long"))
            return h.bitwiseAND(0xFFFFFF) / float(1 << 24) * w
        if "script_score" in fn:
            return self.script(fn["script_score"]["script"], score).cast("double") * w
        return F.lit(w)

    def q_function_score(self, body: dict) -> Match:
        base = self.compile(body.get("query"))
        fns = body.get("functions") or [{k: v for k, v in body.items() if k in ("gauss", "exp", "linear", "field_value_factor", "random_score", "script_score", "weight")}]
        fns = [fn for fn in fns if fn]
        told = [(self.compile(fn["filter"]).hit if "filter" in fn else F.lit(True), self._function(fn, base.score), float(fn.get("weight", 1.0))) for fn in fns]
        mode = body.get("score_mode", "multiply")
        some = _any([h for h, _, _ in told])
        if mode == "multiply":
            v = reduce(lambda a, b: a * b, [F.when(h, x).otherwise(1.0) for h, x, _ in told], F.lit(1.0))
        elif mode in ("sum", "avg"):
            v = _sum([F.when(h, x).otherwise(0.0) for h, x, _ in told])
            v = v / _sum([F.when(h, F.lit(w)).otherwise(0.0) for h, _, w in told]) if mode == "avg" else v
        elif mode == "first":
            v = F.coalesce(*[F.when(h, x) for h, x, _ in told], F.lit(1.0))
        else:
            each = [F.when(h, x) for h, x, _ in told]
            v = (F.greatest if mode == "max" else F.least)(*each) if len(each) > 1 else each[0]
        v = F.when(some, v).otherwise(1.0) if told else F.lit(1.0)
        if "max_boost" in body:
            v = F.least(v, F.lit(float(body["max_boost"])))
        s = base.score
        out = {"multiply": s * v, "replace": v, "sum": s + v, "avg": (s + v) / 2, "max": F.greatest(s, v), "min": F.least(s, v)}[body.get("boost_mode", "multiply")]
        out = F.when(some, out).otherwise(s) if told else s
        return Match(base.hit & (out >= float(body["min_score"])) if "min_score" in body else base.hit, out)

    def q_script_score(self, body: dict) -> Match:
        base = self.compile(body.get("query"))
        out = self.script(body["script"], base.score).cast("double")
        return Match(base.hit & (out >= float(body["min_score"])) if "min_score" in body else base.hit, out)

    def q_distance_feature(self, body: dict) -> Match:
        f = self._field(body["field"])
        if f is None:
            return self._const(F.lit(False))
        c = self.mapping.column(f)
        if f.type == "geo_point":
            pivot, lat_lon = geo.metres(body["pivot"]), geo.point(body["origin"])
            d = geo.haversine(c, *lat_lon)
        else:
            pivot = float(datemath.parse_duration_ms(body["pivot"]))
            d = F.abs(F.timestamp_diff("MICROSECOND", F.lit(datemath.resolve(body["origin"])).cast("timestamp_ntz"), c)) / 1000.0
        return Match(c.isNotNull(), pivot / (pivot + d))

    def q_rank_feature(self, body: dict) -> Match:
        f = self._field(body["field"])
        if f is None:
            return self._const(F.lit(False))
        v = self.mapping.column(f).cast("double")
        if "log" in body:
            s = F.log(float(body["log"]["scaling_factor"]) + v)
        elif "sigmoid" in body:
            p, e = float(body["sigmoid"]["pivot"]), float(body["sigmoid"]["exponent"])
            s = F.pow(v, e) / (F.pow(v, e) + p**e)
        elif "linear" in body:
            s = v
        else:
            p = body.get("saturation", {}).get("pivot")
            p = float(p) if p is not None else float(self.df.agg(F.avg(v)).first()[0] or 1.0)
            s = v / (v + p)
        return Match(v.isNotNull(), s)

    # -- nested and joins

    def q_nested(self, body: dict) -> Match:
        f = self._field(body["path"])
        if f is None:
            return self._const(F.lit(False))
        c = self.mapping.column(f)
        inner = Nested(self, body["path"])
        if "inner_hits" in body:
            self.inner[body["inner_hits"].get("name", body["path"])] = self._inner_hits(c, inner, body)
        if body.get("score_mode", "avg") == "none" or not self.scoring:
            return self._const(F.exists(c, lambda x: inner.at(x, body["query"]).hit))
        pairs = F.filter(F.transform(c, lambda x: F.struct(inner.at(x, body["query"]).hit.alias("h"), inner.at(x, body["query"]).score.cast("double").alias("s"))), lambda p: p["h"])
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["s"])
        scores = F.transform(pairs, lambda p: p["s"])
        s = {"avg": total / F.size(pairs), "sum": total, "min": F.array_min(scores), "max": F.array_max(scores)}[body.get("score_mode", "avg")]
        return Match(_sure(F.size(pairs) > 0), s)

    def _inner_hits(self, elements: Column, inner: Nested, body: dict) -> Column:
        """The elements that match, with their place in the array: sorted by one field or in place order, a slice of them."""
        how, path = body["inner_hits"], body["path"]
        sort = how.get("sort", [])
        name, spec = next(iter(s.items())) if (s := (sort[0] if isinstance(sort, list) and sort else sort)) and isinstance(s, dict) else (s or None, "asc")
        down = (spec if isinstance(spec, str) else spec.get("order", "asc")) == "desc"

        def told(x: Column, i: Column) -> Column:
            key = x[name.removeprefix(path + ".")] if name else F.lit(0)
            return F.struct(key.alias("key"), (-i if down else i).alias("place"), i.alias("offset"), x.alias("source"))

        found = F.sort_array(F.filter(F.transform(elements, told), lambda t: inner.at(t["source"], body["query"]).hit), not down)
        return F.transform(F.slice(found, int(how.get("from", 0)) + 1, int(how.get("size", 3))), lambda t: F.struct(t["offset"].alias("offset"), t["source"].alias("source")))

    def q_has_child(self, body: dict) -> Match:
        """Parents with enough matching children: the children are counted by parent, then joined."""
        rel = self.engine.relation(body["type"])
        rows, score = self.engine.index(rel.child).scored(body["query"], scoring=body.get("score_mode", "none") != "none")
        rows = rel.of_child(rows)
        n, s = self._name(), self._name()
        per = rows.groupBy(F.col(rel.parent_key).alias(f"{n}_k")).agg(F.count("*").alias(n), {"sum": F.sum, "min": F.min, "max": F.max}.get(body.get("score_mode"), F.avg)(score).alias(s))
        self.df = self.df.join(per, F.col(self.id_col) == F.col(f"{n}_k"), "left").drop(f"{n}_k")
        hit = rel.is_parent() & (F.col(n) >= max(1, int(body.get("min_children", 1)))) & (F.col(n) <= int(body.get("max_children", 2**31 - 1)))
        return Match(hit, F.col(s) if body.get("score_mode", "none") != "none" else F.lit(1.0))

    def q_has_parent(self, body: dict) -> Match:
        rel = self.engine.relation(body.get("child_type") or next(r.name for r in self.engine.relations.values() if (r.parent_kind or r.parent) == body["parent_type"]))
        parent = self.engine.index(rel.parent)
        rows, score = parent.scored(body["query"], scoring=bool(body.get("score")))
        rows = rows.where(rel.is_parent())
        s = self._name()
        per = rows.select(F.col(parent.id_col).alias(f"{s}_k"), score.alias(s))
        self.df = self.df.join(per, F.col(rel.parent_key) == F.col(f"{s}_k"), "left").drop(f"{s}_k")
        return Match(F.col(s).isNotNull(), F.col(s) if body.get("score") else F.lit(1.0))

    def q_parent_id(self, body: dict) -> Match:
        rel = self.engine.relation(body["type"])
        return self._const(rel.is_child() & (F.col(rel.parent_key).cast("string") == str(body["id"])))

    # -- geo

    def _geo(self, body: dict, known: set[str]) -> tuple[Field | None, object]:
        name, how = _one({k: v for k, v in body.items() if k not in known})
        return self._field(name), how

    def q_geo_distance(self, body: dict) -> Match:
        f, at = self._geo(body, {"distance", "distance_type", "validation_method", "ignore_unmapped", "boost", "_name", "unit"})
        if f is None:
            return self._const(F.lit(False))
        lat, lon = geo.point(at)
        far = geo.plane if body.get("distance_type") == "plane" else geo.haversine
        limit = geo.metres(body["distance"])
        reach = math.degrees(limit / geo.EARTH_M) * 1.01
        return self._const(self._on(f, lambda p: p["lat"].between(lat - reach, lat + reach) & (far(p, lat, lon) <= limit)))

    def q_geo_bounding_box(self, body: dict) -> Match:
        f, how = self._geo(body, {"validation_method", "type", "ignore_unmapped", "boost", "_name"})
        if f is None:
            return self._const(F.lit(False))
        if "wkt" in how:
            top, left, bottom, right, _ = geo.shape_bounds(how["wkt"])
        elif "top_left" in how:
            (top, left), (bottom, right) = geo.point(how["top_left"]), geo.point(how["bottom_right"])
        elif "top_right" in how:
            (top, right), (bottom, left) = geo.point(how["top_right"]), geo.point(how["bottom_left"])
        else:
            top, left, bottom, right = (float(how[k]) for k in ("top", "left", "bottom", "right"))
        return self._const(self._on(f, lambda p: geo.in_box(p, top, left, bottom, right)))

    def q_geo_polygon(self, body: dict) -> Match:
        f, how = self._geo(body, {"validation_method", "ignore_unmapped", "boost", "_name"})
        if f is None:
            return self._const(F.lit(False))
        ring = [geo.point(p) for p in how["points"]]
        if len(set(ring)) < 3:
            raise ValueError("too few points defined for geo_polygon query")
        return self._const(self._on(f, lambda p: geo.in_polygon(p, ring)))

    def q_geo_shape(self, body: dict) -> Match:
        f, how = self._geo(body, {"ignore_unmapped", "boost", "_name"})
        if f is None:
            if body.get("ignore_unmapped"):
                return self._const(F.lit(False))
            raise ValueError("failed to find type for field in geo_shape query")
        shape, relation = how["shape"], how.get("relation", "INTERSECTS").upper()
        if isinstance(shape, dict) and shape["type"].lower() == "circle":
            lat, lon = geo.point(shape["coordinates"])
            return self._const(self._on(f, lambda p: geo.haversine(p, lat, lon) <= geo.metres(shape["radius"])))
        top, left, bottom, right, rings = geo.shape_bounds(shape)
        if f.type == "geo_point":
            return self._const(self._on(f, lambda p: _any([geo.in_polygon(p, r) for r in rings]) if rings else geo.in_box(p, top, left, bottom, right)))
        c = self.mapping.column(f)
        apart = (c["left"] > right) | (c["right"] < left) | (c["bottom"] > top) | (c["top"] < bottom)
        return self._const({"INTERSECTS": ~apart, "DISJOINT": apart, "WITHIN": (c["left"] >= left) & (c["right"] <= right) & (c["bottom"] >= bottom) & (c["top"] <= top), "CONTAINS": (c["left"] <= left) & (c["right"] >= right) & (c["bottom"] <= bottom) & (c["top"] >= top)}[relation])


class Nested:
    """Compiles a query about the elements of a nested path, for one element."""

    def __init__(self, outer: Compiler, path: str) -> None:
        self.outer, self.path = outer, path

    def at(self, x: Column, query: dict) -> Match:
        outer, path = self.outer, self.path

        class Inside(Mapping):
            def __init__(self) -> None:
                self.settings, self.fields = outer.mapping.settings, {k: v for k, v in outer.mapping.fields.items() if k.startswith(path + ".")}

            def column(self, f: Field) -> Column:
                c = x
                for part in f.column.removeprefix(path + ".").split("."):
                    c = c[part]
                return c

        inner = Compiler(outer.df, Inside(), outer.engine, outer.scoring, outer.id_col)
        return inner.compile(query)
