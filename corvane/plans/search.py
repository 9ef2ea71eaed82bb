"""Indices, the engine that holds them, and the search request compiled into one lazy plan of hits and aggregations."""

from __future__ import annotations

import copy
import fnmatch
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import datemath, geo, hashing
from corvane.operators.aggregations import Aggregator
from corvane.operators.highlight import highlighted
from corvane.plans.mapping import TEXT, Field, Mapping, id_in
from corvane.plans.query import Compiler

MAX_WINDOW = 10_000
#: Columns of a row that are not of its source.
META = {"_index", "_id", "_score", "matched_queries", "_version", "_seq_no", "_ignored"}


@dataclass
class Index:
    """A DataFrame with a mapping. Indices are immutable: a write gives a new one."""

    name: str
    df: DataFrame
    mapping: Mapping
    engine: Engine
    id_col: str = "_id"

    def filtered(self, query: dict | None) -> DataFrame:
        c = Compiler(self.df, self.mapping, self.engine, False, self.id_col)
        m = c.compile(query)
        return c.df.where(m.hit)

    def scored(self, query: dict | None, scoring: bool = True) -> tuple[DataFrame, Column]:
        c = Compiler(self.df, self.mapping, self.engine, scoring, self.id_col, self.name)
        m = c.compile(query)
        return c.df.where(m.hit).withColumn("_cv_child_score", m.score), F.col("_cv_child_score")


@dataclass(frozen=True)
class Relation:
    """A parent and child relation: the child index's column that holds the parent's id. Where both live in one index, ``kind_col`` tells parents (``parent_kind``) from children (``name``)."""

    name: str
    parent: str
    child: str
    parent_key: str
    kind_col: str | None = None
    parent_kind: str | None = None

    def is_parent(self) -> Column:
        return F.col(self.kind_col) == self.parent_kind if self.kind_col else F.lit(True)

    def is_child(self) -> Column:
        return F.col(self.kind_col) == self.name if self.kind_col else F.lit(True)

    def of_child(self, df: DataFrame) -> DataFrame:
        return df.where(self.is_child()) if self.kind_col else df


@dataclass
class Engine:
    """A catalog of indices, aliases and relations over a session."""

    spark: SparkSession
    indices: dict[str, Index] = field(default_factory=dict)
    aliases: dict[str, dict[str, dict | None]] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    points: dict[str, tuple[Engine, str]] = field(default_factory=dict)
    scrolls: dict[str, Scroll] = field(default_factory=dict)
    templates: dict[str, dict] = field(default_factory=dict)
    components: dict[str, dict] = field(default_factory=dict)

    def template_for(self, name: str) -> dict:
        """Settings, mappings and aliases for a new index: of the templates whose patterns its name fits, that of the highest priority, over the components it is composed of."""
        fits = [t for t in self.templates.values() if any(fnmatch.fnmatchcase(name, p) for p in _listed(t.get("index_patterns")))]
        if not fits:
            return {}
        best = max(fits, key=lambda t: t.get("priority", 0))
        out: dict = {}
        for part in [*[self.components[c].get("template", {}) for c in best.get("composed_of", [])], best.get("template", {})]:
            out = merged(out, part)
        return out

    def create(self, name: str, df: DataFrame, properties: dict | None = None, settings: dict | None = None, id_col: str = "_id") -> Index:
        if id_col not in df.columns:
            raise ValueError(f"index [{name}] has no id column [{id_col}]")
        self.indices[name] = Index(name, df, Mapping(df, properties, settings), self, id_col)
        for field_name, how in (properties or {}).items():
            if how.get("type") == "join":
                for parent, children in how["relations"].items():
                    for child in _listed(children):
                        self.relations[child] = Relation(child, name, name, f"{field_name}.parent", f"{field_name}.name", parent)
        return self.indices[name]

    def drop(self, name: str) -> None:
        """Remove an index, and it from its aliases."""
        del self.indices[name]
        self.aliases = {a: t for a, t in ((a, {i: q for i, q in t.items() if i != name}) for a, t in self.aliases.items()) if t}

    def clone(self) -> Engine:
        """A copy that shares all data; writes to either do not show in the other."""
        out = Engine(self.spark, {}, {k: dict(v) for k, v in self.aliases.items()}, dict(self.relations), templates=dict(self.templates), components=dict(self.components))
        out.indices = {k: replace(v, engine=out) for k, v in self.indices.items()}
        return out

    def index(self, name: str) -> Index:
        found = self.resolve(name)
        if len(found) != 1 or found[0][1] is not None:
            raise ValueError(f"[{name}] is not one index")
        return found[0][0]

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise ValueError(f"no join relation [{name}]")
        return self.relations[name]

    def resolve(self, expression: str) -> list[tuple[Index, dict | None]]:
        """``a,b*,-c``, ``_all`` and aliases: indices with the alias's filter."""
        out: dict[str, dict | None] = {}
        for part in expression.split(","):
            minus, part = part.startswith("-"), part.removeprefix("-")
            part = "*" if part == "_all" else part
            names = fnmatch.filter([*self.indices, *self.aliases], part) if "*" in part else [part]
            for n in names:
                if minus:
                    out.pop(n, None)
                elif n in self.indices:
                    out[n] = None
                elif n in self.aliases:
                    for i, query in self.aliases[n].items():
                        out.setdefault(i, query)
                else:
                    raise ValueError(f"no such index [{n}]")
        return [(self.indices[n], q) for n, q in out.items()]

    def search(self, expression: str, body: dict | None = None) -> SearchResult:
        body = body or {}
        if "pit" in body:
            engine, expression = self.points[body["pit"]["id"]]
            return Search(engine, expression, body).run()
        return Search(self, expression, body).run()

    def open_point(self, expression: str) -> str:
        """A point in time: the indices as they are now, kept under an id until it is closed."""
        self.resolve(expression)
        key = uuid.uuid4().hex
        self.points[key] = (self.clone(), expression)
        return key

    def close_point(self, key: str) -> bool:
        return self.points.pop(key, None) is not None

    def scroll(self, expression: str, body: dict | None = None) -> str:
        key = uuid.uuid4().hex
        self.scrolls[key] = Scroll(self, expression, body or {})
        return key

    def count(self, expression: str, query: dict | None = None) -> int:
        return Search(self, expression, {"query": query}).base.count()

    def msearch(self, requests: list[tuple[str, dict]]) -> list[SearchResult]:
        return [self.search(e, b) for e, b in requests]

    def explain(self, name: str, doc_id: object, query: dict) -> DataFrame:
        """One row: whether the document matches and its score, clause by clause for a bool query."""
        ix = self.index(name)
        c = Compiler(ix.df, ix.mapping, self, True, ix.id_col, ix.name)
        m = c.compile(query)
        clauses = [(f"{k}[{i}]", c.compile(q)) for k in ("must", "filter", "should", "must_not") for i, q in enumerate(_listed(query.get("bool", {}).get(k)))]
        parts = F.array(*[F.struct(F.lit(n).alias("clause"), F.coalesce(x.hit, F.lit(False)).alias("matched"), x.score.cast("double").alias("value")) for n, x in clauses]) if clauses else F.array().cast("array<struct<clause:string,matched:boolean,value:double>>")
        return c.df.where(id_in(ix.df, ix.id_col, [doc_id])).select(F.col(ix.id_col), F.coalesce(m.hit, F.lit(False)).alias("matched"), F.when(m.hit, m.score).otherwise(0.0).alias("value"), parts.alias("details"))

    def field_caps(self, expression: str, fields: str = "*") -> DataFrame:
        """Type, searchable and aggregatable by field and index."""
        rows = [(n, ix.name, f.type, f.type not in ("binary", "object", "nested"), f.type not in TEXT | {"binary", "object", "nested"} or bool(f.params.get("fielddata"))) for ix, _ in self.resolve(expression) for n, f in ix.mapping.fields.items() if any(fnmatch.fnmatchcase(n, p) for p in fields.split(","))]
        return self.spark.createDataFrame(rows, "field string, index string, type string, searchable boolean, aggregatable boolean")

    def validate(self, expression: str, query: dict) -> tuple[bool, str | None]:
        try:
            for ix, _ in self.resolve(expression):
                Compiler(ix.df, ix.mapping, self, False, ix.id_col).compile(query)
        except (ValueError, KeyError, TypeError) as e:
            return False, str(e)
        return True, None

    def termvectors(self, name: str, doc_id: object, fields: list[str], statistics: bool = False) -> DataFrame:
        """Terms of a document with frequency and positions; with ``statistics`` the documents and times each stands in all."""
        ix = self.index(name)
        out = []
        for n in fields:
            tokens = ix.mapping.tokens(ix.mapping.get(n))
            own = ix.df.where(id_in(ix.df, ix.id_col, [doc_id])).select(F.posexplode(tokens).alias("pos", "term")).groupBy("term").agg(F.count("*").alias("term_freq"), F.sort_array(F.collect_list("pos")).alias("positions"))
            if statistics:
                all_of = ix.df.select(F.col(ix.id_col).alias("i"), F.explode(tokens).alias("term")).groupBy("term").agg(F.count_distinct("i").alias("doc_freq"), F.count("*").alias("ttf"))
                own = own.join(all_of, "term")
            out.append(own.withColumn("field", F.lit(n)))
        return reduce(DataFrame.unionByName, out)


def merged(a: dict, b: dict) -> dict:
    """``b`` over ``a``, objects within objects."""
    return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def _listed(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


@dataclass
class SearchResult:
    """Lazy parts of a response."""

    hits: DataFrame
    aggregations: dict[str, DataFrame]
    matched: DataFrame
    search: Search | None = None
    totals: dict[str, DataFrame] = field(default_factory=dict)

    def total(self) -> int:
        return self.matched.count()


class Scroll:
    """All hits of a request, page by page. Each page is a bounded top-k past the last row of the one before, over the indices as they were at the start."""

    def __init__(self, engine: Engine, expression: str, body: dict) -> None:
        if body.get("from"):
            raise ValueError("`from` parameter must be set to 0 when `scroll` is used")
        self.size = int(body.get("size", 10))
        self.search = Search(engine.clone(), expression, {k: v for k, v in body.items() if k not in ("aggs", "aggregations")})
        self.search.run()
        self.last: list | None = None

    def next(self) -> list:
        """The next page's rows; empty at the end."""
        order = self.search.order
        keyed = self.search.hits if self.last is None else self.search.hits.where(Search._beyond(order, self.last))
        keys = [f"_cv_s{i}" for i in range(len(order))]
        page = keyed.withColumns({k: c for k, (c, _) in zip(keys, order, strict=True)}).orderBy(*Search._sorted(order)).limit(self.size)
        rows = page.select(F.struct(*[F.col(k) for k in keys]).alias("_cv_keys"), F.struct(*self.search._columns(page)).alias("_cv_hit")).collect()
        if rows:
            self.last = list(rows[-1]["_cv_keys"])
        return [r["_cv_hit"] for r in rows]


class Search:
    """One request, in the order: match, min_score, slice (these count for aggregations), post_filter, rescore, collapse, search_after, page, fetch."""

    KNOWN = {"query", "from", "size", "sort", "_source", "fields", "docvalue_fields", "stored_fields", "script_fields", "aggs", "aggregations", "post_filter", "min_score", "rescore", "collapse", "search_after", "slice", "highlight", "indices_boost", "track_total_hits", "track_scores", "version", "seq_no_primary_term", "explain", "timeout", "terminate_after", "profile", "suggest", "stats", "pit", "ext", "include_named_queries_score", "search_pipeline", "verbose_pipeline", "derived"}

    def __init__(self, engine: Engine, expression: str, body: dict) -> None:
        if unknown := set(body) - self.KNOWN:
            raise ValueError(f"unknown key {sorted(unknown)}")
        self.engine, self.body, self.expression = engine, body, expression
        targets = engine.resolve(expression)
        if not targets:
            raise ValueError(f"no such index [{expression}]")
        self.mapping = targets[0][0].mapping
        sort = _listed(body.get("sort"))
        by_score = not sort or any("_score" in (s if isinstance(s, dict) else {s: 1}) for s in sort)
        self.scoring = bool(body.get("track_scores") or by_score and body.get("size", 10) or "rescore" in body or "min_score" in body or "sampler" in str(body.get("aggs", "")))
        parts = [self._matched(ix, alias) for ix, alias in targets]
        self.base = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        self.whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._own(ix, ix.filtered(alias) if alias else ix.df) for ix, alias in targets])
        if len(targets) > 1:
            self.mapping = copy.copy(self.mapping)  # the first index keeps its own
            self.mapping.fields = reduce(lambda a, b: b | a, [ix.mapping.fields for ix, _ in targets])

    def _own(self, ix: Index, df: DataFrame) -> DataFrame:
        out = df.withColumn("_index", F.lit(ix.name))
        return out if ix.id_col == "_id" else out.withColumn("_id", F.col(ix.id_col))

    def _matched(self, ix: Index, alias: dict | None) -> DataFrame:
        c = Compiler(ix.df, ix.mapping, self.engine, self.scoring, ix.id_col, ix.name)
        m = c.compile(self.body.get("query"))
        guard = c.compile(alias).hit if alias else F.lit(True)
        boost = next((float(b) for entry in _listed(self.body.get("indices_boost")) for n, b in entry.items() if fnmatch.fnmatchcase(ix.name, n)), 1.0)
        out = c.df.where(m.hit & guard).withColumn("_score", (m.score * boost).cast("double"))
        if c.named:
            out = out.withColumn("matched_queries", F.array_compact(F.array(*[F.when(F.coalesce(h, F.lit(False)), F.lit(n)) for n, h in c.named.items()])))
        if c.inner:
            out = out.withColumns({f"inner_hits.{n}": v for n, v in c.inner.items()})
        out = out.drop(*[x for x in out.columns if x.startswith("_cv_j")])
        if "min_score" in self.body:
            out = out.where(F.col("_score") >= float(self.body["min_score"]))
        if "slice" in self.body:
            s = self.body["slice"]
            out = out.where(F.pmod(self._slice_hash(ix, out, s.get("field", "_id")), F.lit(int(s["max"]))) == int(s["id"]))
        if int(self.body.get("terminate_after", 0)) > 0:
            out = out.limit(int(self.body["terminate_after"]))
        return self._own(ix, out)

    @staticmethod
    def _slice_hash(ix: Index, df: DataFrame, name: str) -> Column:
        """The number that tells an id's or a value's slice; a missing value's is 0. Values that are no whole numbers take Spark's hash."""
        if name == "_id":
            return hashing.murmur3(hashing.encoded_id(F.col(ix.id_col)), 7919)
        value = hashing.as_long(F.col(name), dict(df.dtypes).get(name, ""))
        if value is None:
            return F.hash(name)
        low = hashing.mix64(value).bitwiseAND(0xFFFFFFFF)
        return F.coalesce(F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low), F.lit(0).cast("long"))

    # -- sort

    def _key(self, spec: object) -> list[tuple[Column, bool, object]]:
        """Sort columns with direction and where missing values stand."""
        name, how = (spec, {}) if isinstance(spec, str) else next(iter(spec.items()))
        how = {"order": how} if isinstance(how, str) else how
        if name == "_score":
            return [(F.col("_score"), how.get("order", "desc") == "asc", "_last")]
        asc = how.get("order", "asc") == "asc"
        missing, mode = how.get("missing", "_last"), how.get("mode", "min" if asc else "max")
        if name in ("_doc", "_shard_doc"):
            return [(F.col("_id"), asc, "_last")]
        if name == "_geo_distance":
            rest = {k: v for k, v in how.items() if k not in ("order", "unit", "mode", "distance_type", "ignore_unmapped")}
            at, where = next(iter(rest.items()))
            lat, lon = geo.point(where)
            f, far = self.mapping.get(at), geo.plane if how.get("distance_type") == "plane" else geo.haversine
            unit = geo.UNITS[how.get("unit", "m")]
            c = self.mapping.column(f)
            return [(self._reduce(F.transform(c, lambda p: far(p, lat, lon) / unit), mode, "double") if f.multi else far(c, lat, lon) / unit, asc, "_last")]
        if name == "_script":
            c = Compiler(self.base, self.mapping, self.engine).script(how["script"], F.col("_score"))
            return [(c.cast("string") if how.get("type") == "string" else c.cast("double"), asc, "_last")]
        if name in ("_id", "_index"):
            return [(F.col(name), asc, "_last")]
        f = self.mapping.get(name)
        if f is None:
            if "unmapped_type" not in how:
                raise ValueError(f"No mapping found for [{name}] in order to sort on")
            return [(F.lit(None).cast("string"), asc, missing)]
        if "nested" in how or "." in name and (p := self.mapping.get(name.split(".")[0])) and p.type == "nested":
            path = how.get("nested", {}).get("path", name.split(".")[0])
            from corvane.plans.query import Nested

            arr = self.mapping.column(self.mapping.get(path))
            if flt := how.get("nested", {}).get("filter"):
                inner = Nested(Compiler(self.base, self.mapping, self.engine), path)
                arr = F.filter(arr, lambda x: inner.at(x, flt).hit)
            return [(self._reduce(F.transform(arr, lambda x: x[name.removeprefix(path + ".")]), mode, "double"), asc, missing)]
        if f.type in TEXT:
            if not f.params.get("fielddata"):
                raise ValueError(f"Text fields are not optimised for sorting; use a keyword field instead of [{name}]")
            return [(F.array_min(self.mapping.tokens(f)) if asc else F.array_max(self.mapping.tokens(f)), asc, missing)]
        c = self.mapping.column(f)
        return [(self._reduce(c, mode, "double") if f.multi else c, asc, missing)]

    def _reduce(self, c: Column, mode: str, kind: str) -> Column:
        c = F.array_compact(c)
        total = lambda: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast(kind))
        if mode == "median":
            s, n = F.sort_array(c), F.size(c)
            return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
        return {"min": lambda: F.array_min(c), "max": lambda: F.array_max(c), "sum": lambda: F.when(F.size(c) > 0, total()), "avg": lambda: F.when(F.size(c) > 0, total() / F.size(c))}[mode]()

    def _order(self) -> list[tuple[Column, bool]]:
        """Every key made total: a missing value's place goes before it, and index and id break ties."""
        out: list[tuple[Column, bool]] = []
        for spec in _listed(self.body.get("sort")) or ["_score"]:
            for c, asc, missing in self._key(spec):
                if missing in ("_last", "_first"):
                    out.append((c.isNull(), missing == "_last"))
                else:
                    c = F.coalesce(c, F.lit(missing))
                out.append((c, asc))
        return [*out, (F.col("_index"), True), (F.col("_id"), True)]

    @staticmethod
    def _sorted(order: list[tuple[Column, bool]]) -> list[Column]:
        return [c.asc() if asc else c.desc() for c, asc in order]

    def _after(self, df: DataFrame, order: list[tuple[Column, bool]], values: list) -> DataFrame:
        """Rows past the given keys: any earlier keys equal and the next one beyond. Missing keys come last and so are beyond any value."""
        specs = [k for s in _listed(self.body.get("sort")) or ["_score"] for k in self._key(s)]
        tests, equal = [], F.lit(True)
        for (c, asc, _), v in zip(specs, values, strict=True):
            v = F.lit(datemath.resolve(v)).cast("timestamp_ntz") if isinstance(v, str) and "timestamp" in str(df.select(c).dtypes[0][1]) else F.lit(v)
            beyond = (c > v) if asc else (c < v)
            tests.append(equal & F.coalesce(beyond, c.isNull()))
            equal = equal & (c == v)
        return df.where(reduce(lambda a, b: a | b, tests))

    @staticmethod
    def _beyond(order: list[tuple[Column, bool]], values: list) -> Column:
        """Rows past a row's values of the whole order. Missing values' places come before the keys, so among rows of equal places a null key is equal to another."""
        tests, equal = [], F.lit(True)
        for (c, asc), v in zip(order, values, strict=True):
            if v is not None:
                tests.append(equal & F.coalesce(c > F.lit(v) if asc else c < F.lit(v), F.lit(False)))
            equal = equal & c.eqNullSafe(F.lit(v))
        return reduce(lambda a, b: a | b, tests)

    # -- run

    def run(self) -> SearchResult:
        body, hits = self.body, self.base
        order = self._order()
        if "post_filter" in body:
            c = Compiler(hits, self.mapping, self.engine, False, "_id")
            m = c.compile(body["post_filter"])
            hits = c.df.where(m.hit)
        for r in _listed(body.get("rescore")):
            hits = self._rescore(hits, r)
        if "collapse" in body:
            hits = self._collapse(hits, order)
        if "search_after" in body:
            hits = self._after(hits, order, body["search_after"])
        size, start = int(body.get("size", 10)), int(body.get("from", 0))
        if size + start > MAX_WINDOW:
            raise ValueError(f"Result window is too large, from + size must be less than or equal to: [{MAX_WINDOW}] but was [{size + start}]")
        self.hits, self.order = hits, order
        page = hits.orderBy(*self._sorted(order)).offset(start).limit(size)
        aggs = body.get("aggs") or body.get("aggregations") or {}
        aggregator = Aggregator(self.base, self.whole, self.mapping, self.engine)
        made = aggregator.run(aggs) if aggs else {}
        return SearchResult(self._fetch(page), made, self.base, self, aggregator.totals)

    def _rescore(self, hits: DataFrame, r: dict) -> DataFrame:
        """The best ``window_size`` rows by score get a combined score; the window is a bounded top-k, joined by id."""
        q = r["query"]
        window = int(r.get("window_size", 10))
        top = hits.orderBy(F.desc("_score"), "_index", "_id").limit(window)
        c = Compiler(top, self.mapping, self.engine, True, "_id")
        m = c.compile(q["rescore_query"])
        a, b = F.col("_score") * float(q.get("query_weight", 1)), m.score * float(q.get("rescore_query_weight", 1))
        both = {"total": a + b, "multiply": a * b, "avg": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[q.get("score_mode", "total")]
        new = c.df.select("_index", "_id", F.when(m.hit, both).otherwise(a).alias("_cv_rescored"))
        return hits.join(F.broadcast(new), ["_index", "_id"], "left").withColumn("_score", F.coalesce("_cv_rescored", "_score")).drop("_cv_rescored")  # a window of at most 10,000 rows

    def _collapse(self, hits: DataFrame, order: list[tuple[Column, bool]]) -> DataFrame:
        f = self.mapping.get(self.body["collapse"]["field"])
        if f.multi:
            raise ValueError("cannot collapse on a multi-valued field")
        w = Window.partitionBy(self.mapping.column(f)).orderBy(*self._sorted(order))
        inners = _listed(self.body["collapse"].get("inner_hits"))
        most = max([1, *(int(i.get("size", 3)) for i in inners)])
        out = hits.withColumn("_cv_rank", F.row_number().over(w)).where(F.col("_cv_rank") <= most)  # cut before groups meet, so that a large one stays spread
        for inner in inners:
            k = int(inner.get("size", 3))
            kept = F.when(F.col("_cv_rank") <= k, F.struct(F.col("_cv_rank").alias("rank"), F.col("_id").alias("_id")))
            out = out.withColumn(inner.get("name", f.name), F.collect_list(kept).over(Window.partitionBy(self.mapping.column(f))))
        return out.where("_cv_rank = 1").drop("_cv_rank")

    def _fetch(self, page: DataFrame) -> DataFrame:
        return page.select(*self._columns(page))

    def _columns(self, page: DataFrame) -> list[Column]:
        """Metadata, the filtered source, and what else was asked for of each hit."""
        body, own = self.body, [c for c in page.columns if not c.startswith(("_cv_", "_j")) and not c.startswith("inner_hits.") and c not in META]
        kept = self._source(own, False if body.get("stored_fields") in ("_none_", ["_none_"]) else body.get("_source", True))
        out = [F.col("_index"), F.col("_id"), *([F.col("_score")] if self.scoring else []), *[F.col(f"`{c}`") for c in kept]]
        asked = [("matched_queries", True), ("_version", body.get("version")), ("_seq_no", body.get("seq_no_primary_term")), ("_ignored", True)]
        out += [F.col(n) for n, wanted in asked if wanted and n in page.columns]
        out += [F.col(f"`{c}`") for c in page.columns if c.startswith("inner_hits.")]
        for spec in [*_listed(body.get("fields")), *_listed(body.get("docvalue_fields"))]:
            name, fmt = (spec, None) if isinstance(spec, str) else (spec["field"], spec.get("format"))
            for n in self.mapping.match(name) if "*" in name else [name]:
                if f := self.mapping.get(n):
                    out.append(self._formatted(f, fmt).alias(f"fields.{n}"))
        for name, how in body.get("script_fields", {}).items():
            out.append(Compiler(page, self.mapping, self.engine).script(how["script"], F.col("_score")).alias(name))
        if "highlight" in body:
            out += self._highlight(body["highlight"])
        seen: set[str] = set()
        names = [c for c in page.select(*out).columns]
        keep = [i for i, n in enumerate(names) if not (n in seen or seen.add(n))]
        return [out[i] for i in keep]

    @staticmethod
    def _source(columns: list[str], spec: object) -> list[str]:
        if spec is True or spec is None:
            return columns
        if spec is False:
            return []
        spec = spec if isinstance(spec, dict) else {"includes": spec}
        inc, exc = _listed(spec.get("includes", spec.get("include"))), _listed(spec.get("excludes", spec.get("exclude")))
        return [c for c in columns if (not inc or any(fnmatch.fnmatchcase(c, p) or p.startswith(c + ".") for p in inc)) and not any(fnmatch.fnmatchcase(c, p) for p in exc)]

    def _formatted(self, f: Field, fmt: str | None) -> Column:
        c = self.mapping.column(f)
        c = c if f.multi else F.array(c)
        if fmt and f.type == "date":
            return F.transform(c, lambda x: (F.unix_millis(x.cast("timestamp")).cast("string") if fmt == "epoch_millis" else F.date_format(x, fmt)))
        if fmt:
            return F.transform(c, lambda x: F.format_number(x, fmt))
        return c

    def _highlight(self, how: dict) -> list[Column]:
        out = []
        for name, own in (how["fields"].items() if isinstance(how["fields"], dict) else [next(iter(x.items())) for x in how["fields"]]):
            f = self.mapping.get(name)
            if f is not None:
                query = own.get("highlight_query") or how.get("highlight_query") or self.body.get("query") or {}
                c = Compiler(self.base, self.mapping, self.engine)
                terms = _query_terms(c, query, name if {**how, **own}.get("require_field_match", True) else None)
                out.append(highlighted(self.mapping.column(f), terms, {**how, **own}).alias(f"highlight.{name}"))
        return out


def _query_terms(c: Compiler, node: object, only: str | None) -> list[str]:
    """The terms that a query looks for in a field, prefixes and wildcards with a star."""
    out: list[str] = []
    if isinstance(node, list):
        return [t for n in node for t in _query_terms(c, n, only)]
    if not isinstance(node, dict):
        return out
    for kind, body in node.items():
        if kind == "must_not":
            continue
        if kind in ("match", "match_phrase", "match_phrase_prefix", "match_bool_prefix", "term", "prefix", "wildcard", "fuzzy", "terms") and isinstance(body, dict):
            for name, how in body.items():
                if (only is None or name == only) and (f := c.mapping.get(name)):
                    v = how.get("query", how.get("value")) if isinstance(how, dict) else how
                    if kind in ("term", "fuzzy"):
                        out.append(str(v))
                    elif kind == "terms":
                        out += [str(x) for x in v] if isinstance(v, list) else []
                    elif kind in ("prefix", "wildcard"):
                        out.append(str(v) + ("*" if kind == "prefix" else ""))
                    else:
                        ts = c._terms_of(f, v)
                        out += [*ts[:-1], ts[-1] + "*"] if kind in ("match_phrase_prefix", "match_bool_prefix") and ts else ts
        elif kind in ("multi_match", "combined_fields", "query_string", "simple_query_string"):
            fields = [x.partition("^")[0] for x in body.get("fields", ["*"])]
            for name in c.mapping.fields:
                if (only is None or name == only) and any(fnmatch.fnmatchcase(name, p) for p in fields):
                    out += c._terms_of(c.mapping.get(name), body["query"])
        else:
            out += _query_terms(c, body, only)
    return list(dict.fromkeys(out))
