"""The aggregation tree compiled to grouped DataFrames: one group-by for each level of buckets, pipelines as windows over bucket rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import datemath, geo, hashing
from corvane.functions.scripts import Script
from corvane.plans.mapping import TEXT, Field, Mapping
from corvane.plans.query import Compiler

if TYPE_CHECKING:
    from corvane.plans.search import Engine

MAX_BUCKETS = 65_535
_TOO_MANY = f"Trying to create too many buckets. Must be less than or equal to: [{MAX_BUCKETS}]"
METRICS = {"avg", "sum", "min", "max", "value_count", "cardinality", "stats", "extended_stats", "weighted_avg", "percentiles", "percentile_ranks", "median_absolute_deviation", "top_hits", "geo_bounds", "geo_centroid"}
SIBLINGS = {"avg_bucket", "sum_bucket", "min_bucket", "max_bucket", "stats_bucket", "extended_stats_bucket", "percentiles_bucket"}
PARENTS = {"cumulative_sum", "derivative", "serial_diff", "moving_avg", "bucket_sort", "bucket_script", "bucket_selector"}
BUCKETS = {"terms", "multi_terms", "rare_terms", "significant_terms", "significant_text", "histogram", "date_histogram", "auto_date_histogram", "variable_width_histogram", "range", "date_range", "ip_range", "geo_distance", "composite", "filter", "filters", "adjacency_matrix", "missing", "global", "nested", "reverse_nested", "sampler", "diversified_sampler", "geohash_grid", "geotile_grid", "children", "parent"}
REJECTED = {"matrix_stats", "scripted_metric", "moving_fn", "geohex_grid"}
#: Tiers of an automatic date histogram, finest first: calendar unit or milliseconds, steps, name.
TIERS = [*[(s * 1000, f"{s}s") for s in (1, 5, 10, 30)], *[(m * 60_000, f"{m}m") for m in (1, 5, 10, 30)], *[(h * 3_600_000, f"{h}h") for h in (1, 3, 12)], (86_400_000, "1d"), (7 * 86_400_000, "7d"), *[(("M", n), f"{n}M") for n in (1, 3)], *[(("y", n), f"{n}y") for n in (1, 5, 10, 20, 50, 100)]]
_CALENDAR = {"second": "second", "1s": "second", "minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}
_STEP = {"second": "interval 1 second", "minute": "interval 1 minute", "hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}

#: Mean seconds of a calendar unit.
_WIDTH = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2629746, "quarter": 7889238, "year": 31556952}


def _seconds(how: dict) -> float:
    """The mean width of the buckets of a date histogram."""
    unit = how.get("calendar_interval") or (how.get("interval") if how.get("interval") in _CALENDAR else None)
    return _WIDTH[_CALENDAR[unit]] if unit else datemath.parse_duration_ms(how.get("fixed_interval") or how["interval"]) / 1000


def _kind(node: dict) -> tuple[str, dict, dict]:
    """Kind, parameters and sub-aggregations of a node."""
    kinds = [k for k in node if k not in ("aggs", "aggregations", "meta")]
    if len(kinds) != 1:
        raise ValueError(f"expected one aggregation type, got {kinds}")
    kind = kinds[0]
    if kind in REJECTED or kind not in METRICS | SIBLINGS | PARENTS | BUCKETS:
        raise ValueError(f"unsupported aggregation [{kind}]")
    return kind, node[kind], node.get("aggs") or node.get("aggregations") or {}


def _between(value: Callable[[Column], Column], lo: Column | None, hi: Column | None) -> Callable[[Column], Column]:
    """Whether a value is at least ``lo`` and below ``hi``, where these are given."""
    return lambda x: x.isNotNull() & (F.lit(True) if lo is None else value(x) >= lo) & (F.lit(True) if hi is None else value(x) < hi)


class Level:
    """Rows that stand for the documents of buckets: the frame, the keys so far, and the nested path that rows are elements of."""

    def __init__(self, df: DataFrame, keys: list[str], mapping: Mapping, path: str | None = None) -> None:
        self.df, self.keys, self.mapping, self.path = df, keys, mapping, path


class _Element(Mapping):
    """Fields of a nested path when each row carries one element in ``_cv_el``."""

    def __init__(self, outer: Mapping, path: str) -> None:
        self.settings = outer.settings
        self.fields = dict(outer.fields)
        for n, f in outer.fields.items():
            if n.startswith(path + "."):
                self.fields[n] = Field(f.name, f.type, "_cv_el." + n.removeprefix(path + "."), f.multi, f.analyzer, f.search_analyzer, f.params)


class Aggregator:
    """Results by path (``a`` or ``a>b``): metrics are columns of their parent's rows, ``doc_count`` counts documents, a bucket's key is a column of its name."""

    def __init__(self, df: DataFrame, whole: DataFrame, mapping: Mapping, engine: Engine | None = None) -> None:
        self.df, self.whole, self.mapping, self.engine = df, whole, mapping, engine
        self.out: dict[str, DataFrame] = {}
        self.totals: dict[str, DataFrame] = {}

    def run(self, aggs: dict) -> dict[str, DataFrame]:
        self._below(Level(self.df, [], self.mapping), aggs, "")
        return self.out

    # -- values

    def _value(self, level: Level, how: dict, name: str = "field") -> tuple[Column, Field]:
        f = level.mapping.get(how[name])
        if f is None:
            c: Column = F.lit(how.get("missing")).cast("double" if isinstance(how.get("missing"), (int, float)) or "missing" not in how else "string")
            return c, Field(how[name], "double")
        if f.type in TEXT and not f.params.get("fielddata"):
            raise ValueError(f"Text fields are not optimised for aggregations: [{f.name}]")
        c = level.mapping.column(f)
        if "missing" in how:
            m = F.lit(datemath.resolve(how["missing"])).cast("timestamp_ntz") if f.type == "date" else F.lit(how["missing"])
            c = F.when(F.coalesce(F.size(F.array_compact(c)), F.lit(0)) > 0, c).otherwise(F.array(m)) if f.multi else F.coalesce(c, m)
        return c, f

    @staticmethod
    def _number(c: Column, f: Field) -> Column:
        if f.type == "date":
            return F.unix_micros(c.cast("timestamp")) / 1000.0
        return c.cast("int").cast("double") if f.type == "boolean" else c.cast("double")

    # -- tree

    def _below(self, level: Level, aggs: dict, path: str) -> DataFrame | None:
        """Metrics of a level as one group-by, its bucket aggregations each a level of their own, sibling pipelines last."""
        kinds = {n: _kind(a) for n, a in aggs.items()}
        for n, (k, how, subs) in kinds.items():
            if k in BUCKETS:
                self._bucket(level, k, how, subs, f"{path}>{n}" if path else n, n)
        metrics = {n: (k, how) for n, (k, how, _) in kinds.items() if k in METRICS}
        mine = None
        if metrics and not level.keys:
            mine = self._metrics(level, metrics, F.count("*").alias("doc_count"))
            for n, (k, _) in metrics.items():
                self.out[n] = mine.select([F.col(f"`{c}`") for c in mine.columns if c == n or c.startswith(n + ".")])
        for n, (k, how, _) in kinds.items():
            if k in SIBLINGS:
                self.out[f"{path}>{n}" if path else n] = self._sibling(level, k, how, path, n)
        return mine

    def _metrics(self, level: Level, metrics: dict, *first: Column) -> DataFrame:
        """All metrics of the rows by the level's keys. Multi-valued fields are reduced within the row; only spreads around a median and top hits need a step of their own."""
        exprs, late, df = list(first), [], level.df
        for n, (k, how) in metrics.items():
            if k == "top_hits":
                late.append((n, k, how))
                continue
            f = level.mapping.get(how["field"]) if k == "cardinality" and "field" in how else None
            if k == "median_absolute_deviation" or f is not None and f.multi:
                late.append((n, k, how))
            else:
                exprs += self._metric(level, n, k, how)
        out = df.groupBy(*level.keys).agg(*exprs) if exprs else df.select(*level.keys).distinct()
        for n, k, how in late:
            extra = self._late(level, n, k, how)
            if level.keys:
                cond = reduce(lambda a, b: a & b, [out[c].eqNullSafe(extra[c]) for c in level.keys])
                out = out.join(extra, cond, "left").drop(*[extra[c] for c in level.keys])
            else:
                out = out.crossJoin(extra)  # one row each
        return out

    def _flat(self, c: Column, f: Field) -> tuple[Column, bool]:
        return (F.array_compact(F.transform(c, lambda x: self._number(x, f))), True) if f.multi else (self._number(c, f), False)

    def _metric(self, level: Level, n: str, k: str, how: dict) -> list[Column]:
        if k == "weighted_avg":
            v, fv = self._value(level, how["value"])
            w, fw = self._value(level, how["weight"])
            v, w = self._number(v, fv), self._number(w, fw)
            return [(F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).alias(n)]
        c, f = self._value(level, how)
        if k == "geo_bounds":
            lat, lon = c["lat"], c["lon"]
            east, west = F.when(lon >= 0, lon), F.when(lon < 0, lon)
            span, wrapped = F.max(lon) - F.min(lon), 360 - F.min(east) + F.max(west)
            wrap = F.coalesce(F.lit(how.get("wrap_longitude", True)) & (wrapped < span), F.lit(False))
            return [F.max(lat).alias(f"{n}.top"), F.when(wrap, F.min(east)).otherwise(F.min(lon)).alias(f"{n}.left"), F.min(lat).alias(f"{n}.bottom"), F.when(wrap, F.max(west)).otherwise(F.max(lon)).alias(f"{n}.right")]
        if k == "geo_centroid":
            return [F.avg(c["lat"]).alias(f"{n}.lat"), F.avg(c["lon"]).alias(f"{n}.lon"), F.count(c).alias(f"{n}.count")]
        if k == "cardinality":
            return [F.count_distinct(c).alias(n)]
        if k == "value_count":
            return [(F.coalesce(F.sum(F.size(F.array_distinct(F.array_compact(c))).cast("long")), F.lit(0)) if f.multi else F.count(c)).alias(n)]
        x, multi = self._flat(c, f)
        sums = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) if multi else x
        count = F.coalesce(F.sum(F.size(x)), F.lit(0)).cast("long") if multi else F.count(x)
        total = F.sum(sums)
        low, high = (F.min(F.array_min(x)), F.max(F.array_max(x))) if multi else (F.min(x), F.max(x))
        mean = total / F.when(count > 0, count)
        if k in ("avg", "sum", "min", "max"):
            return [{"avg": mean, "sum": F.coalesce(total, F.lit(0.0)), "min": low, "max": high}[k].alias(n)]
        if k in ("stats", "extended_stats"):
            out = [count.alias(f"{n}.count"), low.alias(f"{n}.min"), high.alias(f"{n}.max"), mean.alias(f"{n}.avg"), F.coalesce(total, F.lit(0.0)).alias(f"{n}.sum")]
            if k == "extended_stats":
                squares = F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) if multi else x * x)
                pop, samp = (F.greatest(F.lit(0.0), squares / count - mean * mean), F.lit(None).cast("double")) if multi else (F.var_pop(x), F.when(F.count(x) > 1, F.var_samp(x)))
                s = float(how.get("sigma", 2))
                out += [F.coalesce(squares, F.lit(0.0)).alias(f"{n}.sum_of_squares"), pop.alias(f"{n}.variance"), pop.alias(f"{n}.variance_population"), samp.alias(f"{n}.variance_sampling"), F.sqrt(pop).alias(f"{n}.std_deviation"), F.sqrt(samp).alias(f"{n}.std_deviation_sampling"), (mean + s * F.sqrt(pop)).alias(f"{n}.upper"), (mean - s * F.sqrt(pop)).alias(f"{n}.lower")]
            return out
        if multi:
            raise ValueError(f"[{k}] needs a single-valued field")
        if k == "percentiles":
            if "hdr" in how:
                raise ValueError("[percentiles] hdr is not supported")
            ps = how.get("percents", [1, 5, 25, 50, 75, 95, 99])
            if "tdigest" in how:  # a sketch of bounded size was asked for by name; else the percentiles are exact
                accuracy = 100 * int(how["tdigest"].get("compression", 100))
                return [F.percentile_approx(x, F.lit(p / 100.0), accuracy).alias(f"{n}.{float(p)}") for p in ps]
            return [F.percentile(x, F.lit(p / 100.0)).alias(f"{n}.{float(p)}") for p in ps]
        return [(100.0 * F.avg((x <= float(v)).cast("double"))).alias(f"{n}.{float(v)}") for v in how["values"]]

    def _late(self, level: Level, n: str, k: str, how: dict) -> DataFrame:
        if k == "cardinality":
            c, _ = self._value(level, how)
            each = level.df.select(*level.keys, F.explode_outer(c).alias("_cv_v"))  # outer: a bucket without values counts 0
            return each.groupBy(*level.keys).agg(F.count_distinct("_cv_v").alias(n))
        if k == "median_absolute_deviation":
            c, f = self._value(level, how)
            rows = level.df.select(*level.keys, self._number(c, f).alias("_cv_v"))
            mid = rows.groupBy(*level.keys).agg(F.median("_cv_v").alias("_cv_m"))
            if level.keys:
                both = rows.join(mid, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(mid[c]) for c in level.keys])).drop(*[mid[c] for c in level.keys])
            else:
                both = rows.crossJoin(mid)  # one row
            return both.groupBy(*level.keys).agg(F.median(F.abs(F.col("_cv_v") - F.col("_cv_m"))).alias(n))
        size, start = int(how.get("size", 3)), int(how.get("from", 0))
        order = []
        for s in how.get("sort", []) if isinstance(how.get("sort", []), list) else [how["sort"]]:
            name, spec = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
            asc = (spec if isinstance(spec, str) else spec.get("order", "asc")) == "asc"
            c = F.col("_score") if name == "_score" else level.mapping.column(level.mapping.get(name))
            order.append(c.asc_nulls_last() if asc else c.desc_nulls_last())
        order = [*(order or [F.desc("_score")]), F.asc("_id")]
        spec = how.get("_source", True)
        spec = spec.get("includes", True) if isinstance(spec, dict) else spec
        kept = [spec] if isinstance(spec, str) else spec if isinstance(spec, list) else [c for c in level.df.columns if not c.startswith("_") and c not in level.keys]
        ranked = level.df.withColumn("_cv_rank", F.row_number().over(Window.partitionBy(*level.keys).orderBy(*order))).where((F.col("_cv_rank") > start) & (F.col("_cv_rank") <= start + size))
        hit = F.struct(F.col("_cv_rank").alias("rank"), F.col("_id"), *[F.col(f"`{c}`") for c in kept])
        return ranked.groupBy(*level.keys).agg(F.sort_array(F.collect_list(hit)).alias(n))

    # -- buckets

    def _bucket(self, level: Level, kind: str, how: dict, subs: dict, path: str, name: str) -> None:
        made = getattr(self, f"b_{kind}")(level, name, how)
        rows, finish = made if isinstance(made, tuple) else (made, None)
        kinds = {n: _kind(a) for n, a in subs.items()}
        metrics = {n: (k, h) for n, (k, h, _) in kinds.items() if k in METRICS}
        frame = self._metrics(rows, metrics, F.count("*").alias("doc_count"))
        frame = finish(frame, rows) if finish else frame
        self.out[path] = frame
        if any(k in BUCKETS for k, _, _ in kinds.values()):
            kept = rows
            if kind in ("terms", "multi_terms", "rare_terms", "significant_terms", "significant_text", "composite", "geohash_grid", "geotile_grid"):
                keys = frame.select(*rows.keys).distinct()
                cond = reduce(lambda a, b: a & b, [rows.df[c].eqNullSafe(keys[c]) for c in rows.keys])
                kept = Level(rows.df.join(keys, cond, "left_semi"), rows.keys, rows.mapping, rows.path)
            self._below(kept, {n: subs[n] for n in subs if kinds[n][0] in BUCKETS}, path)
        for n, (k, h, _) in kinds.items():
            if k in SIBLINGS:
                self.out[f"{path}>{n}"] = self._sibling(rows, k, h, path, n)
        order = [rows.keys[-1]] if rows.keys else []
        for n, (k, h, _) in kinds.items():
            if k in PARENTS:
                frame = self._parent(frame, rows.keys[:-1], order[0] if order else None, n, k, h)
        self.out[path] = frame

    def _with_key(self, level: Level, name: str, key: Column, many: bool = False) -> Level:
        """The level's rows with one more key; an array gives a row for each distinct element, a null none."""
        df = level.df.withColumn(name, F.explode(F.array_distinct(F.array_compact(key)))) if many else level.df.withColumn(name, key).where(F.col(name).isNotNull())
        return Level(df, [*level.keys, name], level.mapping, level.path)

    def _top(self, frame: DataFrame, parents: list[str], order: list[Column], size: int) -> DataFrame:
        """The first ``size`` buckets of each parent; without parents a bounded top-k. The largest int asks for all."""
        if size >= 2**31 - 1:  # a limit would bring all of them to one task
            return frame if parents else frame.orderBy(*order)
        if not parents:
            return frame.orderBy(*order).limit(size)
        w = Window.partitionBy(*parents).orderBy(*order)
        return frame.withColumn("_cv_rank", F.row_number().over(w)).where(F.col("_cv_rank") <= size).drop("_cv_rank")

    @staticmethod
    def _order(spec: object, key: str, frame: DataFrame, default: list) -> list[Column]:
        out = []
        for s in (spec if isinstance(spec, list) else [spec]) if spec else default:
            n, d = next(iter(s.items()))
            c = {"_count": "doc_count", "_key": key, "_term": key}.get(n, n.replace(">", "."))
            c = c.removesuffix(".value") if c not in frame.columns else c
            out.append(F.col(f"`{c}`").asc_nulls_last() if d == "asc" else F.col(f"`{c}`").desc_nulls_last())
        return [*out, F.asc(f"`{key}`")]

    def _included(self, c: Column, how: dict, kind: str) -> Column:
        def test(spec: object) -> Column:
            return c.isin(spec) if isinstance(spec, list) else F.regexp_like(c.cast("string"), F.lit(f"^(?:{spec})$"))

        ok = F.lit(True)
        inc, exc = how.get("include"), how.get("exclude")
        if isinstance(inc, dict):
            value = hashing.as_long(c, kind)
            h = hashing.mix64(value) if value is not None else hashing.murmur3(F.encode(c, "UTF-8"), 31) if kind == "string" else F.hash(c)
            ok = F.pmod(h, F.lit(int(inc["num_partitions"]))) == int(inc["partition"])
        elif inc is not None:
            ok = test(inc)
        return ok & ~test(exc) if exc is not None else ok

    def b_terms(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        if f.type in TEXT:
            c, f = level.mapping.tokens(f), Field(f.name, "keyword", "", True)
        rows = self._with_key(level, name, c, f.multi)
        if "include" in how or "exclude" in how:
            rows.df = rows.df.where(self._included(F.col(name), how, dict(rows.df.dtypes)[name]))
        size, least = int(how.get("size", 10)), int(how.get("min_doc_count", 1))

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            if least == 0 and not level.keys:
                every = self._with_key(Level(self.whole, [], level.mapping), name, c, f.multi).df.select(name).distinct()
                frame = every.join(frame, name, "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
            kept = frame.where(F.col("doc_count") >= least)
            kept = self._top(kept, level.keys, self._order(how.get("order"), name, frame, [{"_count": "desc"}]), size)
            if level.keys:
                totals = frame.groupBy(*level.keys).agg(F.sum("doc_count").alias("_cv_all"))
                shown = kept.groupBy(*level.keys).agg(F.sum("doc_count").alias("_cv_kept"))
                other = totals.join(shown, level.keys).select(*level.keys, (F.col("_cv_all") - F.col("_cv_kept")).alias("sum_other_doc_count"))
                return kept.join(other, level.keys)
            self.totals[name] = rows.df.agg(F.count("*").alias("n"))  # one row, for sum_other_doc_count
            if how.get("show_other", False):
                shown = kept.agg(F.sum("doc_count").alias("_cv_kept"))
                kept = kept.crossJoin(self.totals[name].crossJoin(shown)).withColumn("sum_other_doc_count", F.col("n") - F.col("_cv_kept")).drop("n", "_cv_kept")  # one row each
            return kept

        return rows, finish

    def b_multi_terms(self, level: Level, name: str, how: dict) -> tuple:
        parts = [self._value(level, t) for t in how["terms"]]
        keys = F.concat_ws("|", *[c.cast("string") for c, _ in parts])
        every = reduce(lambda a, b: a & b, [c.isNotNull() for c, _ in parts])
        named = [f"{name}.{i}" for i in range(len(parts))]
        df = level.df.where(every).withColumns({n: c for n, (c, _) in zip(named, parts, strict=True)})
        df = df.withColumn(name, keys)
        rows = Level(df, [*level.keys, *named, name], level.mapping, level.path)

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            order = [F.asc(f"`{n}`") for n in named]
            given = self._order(how.get("order"), name, frame, [{"_count": "desc"}])[:-1]
            return self._top(frame.where(F.col("doc_count") >= int(how.get("min_doc_count", 1))), level.keys, given + order, int(how.get("size", 10)))

        rows.keys = [*level.keys, *[f"`{n}`" for n in named], name]
        return rows, finish

    def b_rare_terms(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        if f.type in ("double", "float", "half_float", "scaled_float"):
            raise ValueError("rare_terms does not work on floating point fields")
        rows = self._with_key(level, name, c, f.multi)
        if "include" in how or "exclude" in how:
            rows.df = rows.df.where(self._included(F.col(name), how, dict(rows.df.dtypes)[name]))
        return rows, lambda frame, _: frame.where(F.col("doc_count") <= int(how.get("max_doc_count", 1)))

    def _significant(self, level: Level, name: str, how: dict, key: Column, many: bool) -> tuple:
        rows = self._with_key(level, name, key, many)
        back = self.whole
        if "background_filter" in how:
            c = Compiler(back, self.mapping, self.engine, False)
            m = c.compile(how["background_filter"])
            back = c.df.where(m.hit)
        bg = self._with_key(Level(back, [], self.mapping), name, key, many).df.groupBy(name).agg(F.count("*").alias("bg_count"))
        n_bg = back.count()

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            if level.keys:
                sizes = level.df.groupBy(*level.keys).agg(F.count("*").alias("_cv_fg"))
                frame = frame.join(sizes, level.keys)
            else:
                frame = frame.withColumn("_cv_fg", F.lit(level.df.count()))
            frame = frame.join(bg, name)
            fg, n, b, m = F.col("doc_count").cast("double"), F.col("_cv_fg").cast("double"), F.col("bg_count").cast("double"), F.lit(float(n_bg))
            p, q = fg / n, b / m
            if "percentage" in how:
                score = fg / b
            elif "chi_square" in how or "mutual_information" in how:
                n11, n10, n01, total = fg, b - fg, n - fg, m
                n00 = total - n11 - n10 - n01
                if "chi_square" in how:
                    score = total * F.pow(n11 * n00 - n10 * n01, 2.0) / ((n11 + n01) * (n11 + n10) * (n10 + n00) * (n01 + n00))
                else:
                    part = lambda x, a, c: F.when(x > 0, x / total * F.log2(total * x / (a * c))).otherwise(0.0)
                    score = part(n11, n11 + n10, n11 + n01) + part(n10, n11 + n10, n10 + n00) + part(n01, n01 + n00, n11 + n01) + part(n00, n01 + n00, n10 + n00)
            elif "gnd" in how:
                lf, lb, lj, lt = F.log(n), F.log(b), F.log(fg), F.log(m)
                score = F.exp(-((F.greatest(lf, lb) - lj) / (lt - F.least(lf, lb))))
            else:
                score = (p - q) * (p / q)
            frame = frame.withColumn("score", score).where((F.col("doc_count") >= int(how.get("min_doc_count", 3))) & (p > q) & (F.col("score") > 0)).drop("_cv_fg")
            return self._top(frame, level.keys, [F.desc("score"), F.asc(name)], int(how.get("size", 10)))

        return rows, finish

    def b_significant_terms(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        return self._significant(level, name, how, c, f.multi)

    def b_significant_text(self, level: Level, name: str, how: dict) -> tuple:
        f = level.mapping.get(how["field"])
        if how.get("filter_duplicate_text"):
            level = Level(level.df.dropDuplicates([f.column]), level.keys, level.mapping, level.path)
        return self._significant(level, name, how, level.mapping.tokens(f), True)

    def _fill(self, frame: DataFrame, level: Level, name: str, how: dict, steps: object, width: float, default: int = 0) -> DataFrame:
        """Empty buckets between the first and last, or the extended bounds; the sequence is made from one row of bounds per parent.

        ``width`` is a bucket's, in the key's numbers or in seconds: bounds that would take more than MAX_BUCKETS fail before
        any sequence is made.
        """
        least = int(how.get("min_doc_count", default))
        if least > 0:
            return frame.where(F.col("doc_count") >= least)
        lo, hi = F.min(name), F.max(name)
        if "extended_bounds" in how:
            kind = dict(frame.dtypes)[name]
            e = {k: (F.lit(datemath.resolve(v)) if kind.startswith("timestamp") else F.lit(v)).cast(kind) for k, v in how["extended_bounds"].items()}
            lo, hi = F.least(lo, e["min"]) if "min" in e else lo, F.greatest(hi, e["max"]) if "max" in e else hi
        spans = frame.groupBy(*level.keys).agg(lo.alias("_cv_lo"), hi.alias("_cv_hi")).where("_cv_lo is not null")
        number = (lambda c: F.unix_micros(c.cast("timestamp")) / 1e6) if dict(frame.dtypes)[name].startswith("timestamp") else (lambda c: c.cast("double"))
        many = (number(F.col("_cv_hi")) - number(F.col("_cv_lo"))) / width > MAX_BUCKETS
        every = spans.select(*level.keys, F.explode(F.when(many, F.raise_error(F.lit(_TOO_MANY))).otherwise(steps(F.col("_cv_lo"), F.col("_cv_hi")))).alias(name))
        sums = [c for c in frame.columns if c not in level.keys and c not in (name, "doc_count")]
        out = every.join(frame, [*level.keys, name], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)).cast("long"))
        return out.select(*level.keys, name, "doc_count", *[F.col(f"`{c}`") for c in sums])

    def _bounded(self, df: DataFrame, name: str, how: dict) -> DataFrame:
        b = how.get("hard_bounds", {})
        kind = dict(df.dtypes)[name]
        at = lambda v: (F.lit(datemath.resolve(v)) if kind.startswith("timestamp") else F.lit(v)).cast(kind)
        if "min" in b:
            df = df.where(F.col(name) >= at(b["min"]))
        return df.where(F.col(name) <= at(b["max"])) if "max" in b else df

    def b_histogram(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        step, off = float(how["interval"]), float(how.get("offset", 0))
        if step <= 0:
            raise ValueError("[interval] must be >0 for histogram aggregation")
        key = lambda x: F.floor((self._number(x, f) - off) / step) * step + off
        rows = self._with_key(level, name, F.transform(c, key) if f.multi else key(c), f.multi)
        rows.df = self._bounded(rows.df, name, how)
        steps = lambda lo, hi: F.transform(F.sequence(F.round((lo - off) / step).cast("long"), F.round((hi - off) / step).cast("long")), lambda i: i * step + off)
        return rows, lambda frame, _: self._fill(frame, level, name, how, steps, step)

    def _rounded(self, c: Column, how: dict) -> tuple[Column, object]:
        """A time's bucket as a naive UTC time, and the sequence of buckets between two."""
        tz, off = how.get("time_zone", "UTC"), int(datemath.parse_duration_ms(str(how.get("offset", "0ms")).lstrip("+")))
        moved = c.cast("timestamp_ntz") - F.expr(f"interval '{off / 1000:.3f}' second") if off else c.cast("timestamp_ntz")
        unit = how.get("calendar_interval") or (how.get("interval") if how.get("interval") in _CALENDAR else None)
        back = lambda t: t + F.expr(f"interval '{off / 1000:.3f}' second") if off else t
        utc = tz in ("UTC", "Z")
        local = moved if utc else F.convert_timezone(F.lit("UTC"), F.lit(tz), moved)
        home = (lambda t: t) if utc else (lambda t: F.convert_timezone(F.lit(tz), F.lit("UTC"), t))
        if unit:
            unit = _CALENDAR[unit]
            key = back(home(F.date_trunc(unit, local).cast("timestamp_ntz")))
            if not utc and unit in ("second", "minute", "hour"):
                key = back(F.date_trunc(unit, moved).cast("timestamp_ntz"))
                return key, lambda lo, hi: F.sequence(lo, hi, F.expr(_STEP[unit]))
            there = (lambda t: t) if utc else (lambda t: F.convert_timezone(F.lit("UTC"), F.lit(tz), t))
            return key, lambda lo, hi: F.transform(F.sequence(there(lo), there(hi), F.expr(_STEP[unit])), home)
        ms = datemath.parse_duration_ms(how.get("fixed_interval") or how["interval"])
        epoch = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", epoch, local)
        key = back(home(F.timestamp_add("MICROSECOND", F.floor(micros / (ms * 1000)).cast("long") * (ms * 1000), epoch)))
        return key, lambda lo, hi: F.sequence(lo, hi, F.expr(f"interval '{ms / 1000:.3f}' second"))

    def b_date_histogram(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        if f.multi:
            key = F.transform(c, lambda x: self._rounded(x, how)[0])
            steps = self._rounded(F.lit(None).cast("timestamp_ntz"), how)[1]
        else:
            key, steps = self._rounded(c, how)
        rows = self._with_key(level, name, key, f.multi)
        rows.df = self._bounded(rows.df, name, how)
        return rows, lambda frame, _: self._fill(frame, level, name, how, steps, _seconds(how))

    def b_auto_date_histogram(self, level: Level, name: str, how: dict) -> tuple:
        """The finest tier that needs at most ``buckets`` buckets, from the first and last time: one row to the driver."""
        c, f = self._value(level, how)
        lo, hi = level.df.agg(F.min(c), F.max(c)).first()
        want = int(how.get("buckets", 10))
        names = {"second": 0, "minute": 4, "hour": 8, "day": 11, "month": 13, "year": 15}
        start = names[how["minimum_interval"]] if "minimum_interval" in how else 0
        tier, label = TIERS[start]
        for tier, label in TIERS[start:] if lo is not None else []:
            if isinstance(tier, int):
                ms = lambda t: int((t.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1000)
                n = ms(hi) // tier - ms(lo) // tier + 1
            else:
                size = tier[1] * (12 if tier[0] == "y" else 1)
                n = (hi.year * 12 + hi.month - 1) // size - (lo.year * 12 + lo.month - 1) // size + 1
            if n <= want:
                break
        if isinstance(tier, int):
            key, steps = self._rounded(c, {"fixed_interval": f"{tier}ms"})
        else:
            size = tier[1] * (12 if tier[0] == "y" else 1)
            epoch = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
            months = F.floor((F.year(c) * 12 + F.month(c) - 1) / size) * size
            key = F.timestamp_add("MONTH", (months - 1970 * 12).cast("long"), epoch)
            steps = lambda a, b: F.sequence(a, b, F.expr(f"interval {size} months"))
        rows = self._with_key(level, name, key)
        return rows, lambda frame, _: self._fill(frame, level, name, {}, steps, tier / 1000 if isinstance(tier, int) else size * _WIDTH["month"]).withColumn("interval", F.lit(label))

    def b_variable_width_histogram(self, level: Level, name: str, how: dict) -> tuple:
        """Cuts at the largest gaps between distinct values. Gaps are sought within bins that share the values out evenly, and between one bin's last and the next one's first; only the buckets' bounds reach the driver."""
        if level.keys:
            raise ValueError("[variable_width_histogram] must not be under another aggregation that splits documents")
        c, f = self._value(level, how)
        want = int(how.get("buckets", 10))
        x = self._number(c, f)
        values = level.df.select(x.alias("v")).where("v is not null").distinct()
        bounds = sorted(set(values.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000)).first()[0] or []))
        binned = values.withColumn("bin", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("v"))) if bounds else F.lit(0))
        inner = binned.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy("bin").orderBy("v"))).select("v", "gap")
        ends = binned.groupBy("bin").agg(F.min("v").alias("v"), F.max("v").alias("last"))
        outer = ends.select("v", (F.col("v") - F.lag("last").over(Window.orderBy("bin"))).alias("gap"))  # at most 256 bins
        gaps = inner.unionByName(outer).where("gap is not null")
        cuts = sorted(r["v"] for r in gaps.orderBy(F.desc("gap"), "v").limit(want - 1).collect())
        at = reduce(lambda a, b: a + b, [(x >= v).cast("int") for v in cuts], F.lit(0))
        df = level.df.where(x.isNotNull()).withColumn(name, at).withColumn("_cv_x", x)
        rows = Level(df, [name], level.mapping, level.path)

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            stats = rows.df.groupBy(name).agg(F.avg("_cv_x").alias("_cv_key"), F.min("_cv_x").alias("min"), F.max("_cv_x").alias("max"))
            return frame.join(stats, name).withColumn(name, F.col("_cv_key")).drop("_cv_key")

        return rows, finish

    def _ranges(self, level: Level, name: str, tests: list[tuple[str, Column]], extra: dict[str, dict] | None = None) -> tuple:
        """Buckets that may overlap: a document stands once in each that it meets; empty ones are kept."""
        names = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests]))
        rows = self._with_key(level, name, names, True)
        keys = [k for k, _ in tests]

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            told = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit((extra or {}).get(k, {}).get(b)).cast("double").alias(b) for b in ("from", "to")]) for k in keys])
            parents = level.df.select(*level.keys).distinct() if level.keys else frame.sparkSession.range(1)
            every = parents.select(*level.keys, F.explode(told).alias("_cv_r"))  # the request's own ranges, for each parent
            every = every.select(*level.keys, F.col("_cv_r.k").alias(name), *([F.col("_cv_r.from"), F.col("_cv_r.to")] if extra else []))
            return every.join(frame, [*level.keys, name], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)).cast("long"))

        return rows, finish

    @staticmethod
    def _shown(v: object) -> str:
        return "*" if v is None else str(float(v)) if isinstance(v, (int, float)) else str(v)

    def b_range(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        tests, extra = [], {}
        for r in how["ranges"]:
            lo, hi = r.get("from"), r.get("to")
            key = r.get("key") or f"{self._shown(lo)}-{self._shown(hi)}"
            one = _between(lambda x: self._number(x, f), None if lo is None else F.lit(float(lo)), None if hi is None else F.lit(float(hi)))
            tests.append((key, F.exists(c, one) if f.multi else one(c)))
            extra[key] = {"from": None if lo is None else float(lo), "to": None if hi is None else float(hi)}
        return self._ranges(level, name, tests, extra)

    def b_date_range(self, level: Level, name: str, how: dict) -> tuple:
        c, f = self._value(level, how)
        tests = []
        for r in how["ranges"]:
            lo, hi = (None if r.get(k) is None else datemath.resolve(r[k], time_zone=how.get("time_zone")) for k in ("from", "to"))
            told = lambda t: "*" if t is None else t.isoformat(timespec="milliseconds") + "Z"
            one = _between(lambda x: x, *[None if t is None else F.lit(t).cast("timestamp_ntz") for t in (lo, hi)])
            tests.append((r.get("key") or f"{told(lo)}-{told(hi)}", F.exists(c, one) if f.multi else one(c)))
        return self._ranges(level, name, tests)

    def b_ip_range(self, level: Level, name: str, how: dict) -> tuple:
        c, _ = self._value(level, how)
        tests = []
        for r in how["ranges"]:
            if "mask" in r:
                lo, last = geo.ip_bounds(r["mask"])
                tests.append((r.get("key") or r["mask"], geo.ip_key(c).between(lo, last)))
            else:
                ends = [geo.ip_bounds(r[k])[0] if r.get(k) else None for k in ("from", "to")]
                tests.append((r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}", _between(geo.ip_key, *[None if e is None else F.lit(e) for e in ends])(c)))
        return self._ranges(level, name, tests)

    def b_geo_distance(self, level: Level, name: str, how: dict) -> tuple:
        c, _ = self._value(level, how)
        lat, lon = geo.point(how["origin"])
        d = (geo.plane if how.get("distance_type") == "plane" else geo.haversine)(c, lat, lon) / geo.UNITS[how.get("unit", "m")]
        tests, extra = [], {}
        for r in how["ranges"]:
            lo, hi = r.get("from"), r.get("to")
            key = r.get("key") or f"{self._shown(lo)}-{self._shown(hi)}"
            tests.append((key, (F.lit(True) if lo is None else d >= float(lo)) & (F.lit(True) if hi is None else d < float(hi)) & c.isNotNull()))
            extra[key] = {"from": None if lo is None else float(lo), "to": None if hi is None else float(hi)}
        return self._ranges(level, name, tests, extra)

    def _source_key(self, kind: str, how: dict, f: Field) -> Callable[[Column], Column]:
        """The key that a composite source makes of a value."""
        if kind == "histogram":
            step = float(how["interval"])
            return lambda x: F.floor(self._number(x, f) / step) * step
        if kind == "date_histogram":
            return lambda x: self._rounded(x, how)[0]
        if kind == "geotile_grid":
            return lambda x: geo.geotile(x, int(how.get("precision", 7)))
        return lambda x: x

    def b_composite(self, level: Level, name: str, how: dict) -> tuple:
        df, keys, dirs, gone = level.df, [], [], []
        for source in how["sources"]:
            n, spec = next(iter(source.items()))
            kind, s = next(iter(spec.items()))
            c, f = self._value(level, s)
            make = self._source_key(kind, s, f)
            missing = bool(s.get("missing_bucket"))
            df = df.withColumn(n, (F.explode_outer if missing else F.explode)(F.array_distinct(F.transform(c, make)))) if f.multi else df.withColumn(n, make(c))
            df = df if missing else df.where(F.col(n).isNotNull())
            keys.append(n)
            asc, order = s.get("order", "asc") == "asc", s.get("missing_order", "default")
            first = order == "first" or order == "default" and asc
            dirs.append((n, asc, first))
            gone.append(missing)
        rows = Level(df, [*level.keys, *keys], level.mapping, level.path)

        def finish(frame: DataFrame, rows: Level) -> DataFrame:
            if "after" in how:
                tests, equal = [], F.lit(True)
                for n, asc, first in dirs:
                    v = how["after"][n]
                    kind = dict(frame.dtypes)[n]
                    x = F.col(n)
                    if v is None:
                        beyond, same = (x.isNotNull() if first else F.lit(False)), x.isNull()
                    else:
                        w = F.lit(datemath.resolve(v) if kind.startswith("timestamp") else v).cast(kind)
                        beyond, same = F.coalesce(x > w if asc else x < w, F.lit(not first)), F.coalesce(x == w, F.lit(False))
                    tests.append(equal & beyond)
                    equal = equal & same
                frame = frame.where(reduce(lambda a, b: a | b, tests))
            order = [{(True, True): F.asc_nulls_first, (True, False): F.asc_nulls_last, (False, True): F.desc_nulls_first, (False, False): F.desc_nulls_last}[(asc, first)](n) for n, asc, first in dirs]
            return self._top(frame, level.keys, order, int(how.get("size", 10)))

        return rows, finish

    def _hit(self, level: Level, query: dict) -> Column:
        c = Compiler(level.df, level.mapping, self.engine, False)
        m = c.compile(query)
        level.df = c.df
        return m.hit

    def b_filter(self, level: Level, name: str, how: dict) -> Level:
        own = Level(level.df, level.keys, level.mapping, level.path)
        hit = self._hit(own, how)
        return Level(own.df.where(hit), level.keys, level.mapping, level.path)

    def b_filters(self, level: Level, name: str, how: dict) -> tuple:
        given = how["filters"] if isinstance(how["filters"], dict) else {str(i): q for i, q in enumerate(how["filters"])}
        own = Level(level.df, level.keys, level.mapping, level.path)
        tests = [(k, self._hit(own, q)) for k, q in given.items()]
        if how.get("other_bucket") or how.get("other_bucket_key"):
            tests.append((how.get("other_bucket_key", "_other_"), ~reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for _, t in tests])))
        return self._ranges(own, name, tests)

    def b_adjacency_matrix(self, level: Level, name: str, how: dict) -> Level:
        own = Level(level.df, level.keys, level.mapping, level.path)
        tests = [(k, self._hit(own, q)) for k, q in sorted(how["filters"].items())]
        met = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))
        sep = how.get("separator", "&")
        pairs = F.flatten(F.transform(met, lambda a, i: F.transform(F.slice(met, i + 1, F.size(met)), lambda b: F.when(a == b, F.lit(None) if how.get("show_only_intersecting") else a).otherwise(F.concat(a, F.lit(sep), b)))))
        return self._with_key(own, name, pairs, True)

    def b_missing(self, level: Level, name: str, how: dict) -> Level:
        f = level.mapping.get(how["field"])
        if f is None:
            return Level(level.df, level.keys, level.mapping, level.path)
        c = level.mapping.column(f)
        return Level(level.df.where(F.coalesce(F.size(F.array_compact(c)) == 0, F.lit(True)) if f.multi else c.isNull()), level.keys, level.mapping, level.path)

    def b_global(self, level: Level, name: str, how: dict) -> Level:
        if level.keys or level.df is not self.df:
            raise ValueError("[global] aggregations must be defined at the top level")
        return Level(self.whole, [], self.mapping)

    def b_nested(self, level: Level, name: str, how: dict) -> Level:
        path = how["path"]
        f = level.mapping.get(path)
        df = level.df.withColumn("_cv_el", F.explode(level.mapping.column(f)))
        return Level(df, level.keys, _Element(level.mapping, path), path)

    def b_reverse_nested(self, level: Level, name: str, how: dict) -> Level:
        if level.path is None:
            raise ValueError("Reverse nested aggregation can only be used inside a nested aggregation")
        return Level(level.df.dropDuplicates(["_id", *level.keys]), level.keys, self.mapping, None)

    def b_sampler(self, level: Level, name: str, how: dict) -> Level:
        size = int(how.get("shard_size", 100))
        order = [F.desc("_score") if "_score" in level.df.columns else F.lit(1), F.asc("_id")]
        return Level(self._top(level.df, level.keys, order, size), level.keys, level.mapping, level.path)

    def b_diversified_sampler(self, level: Level, name: str, how: dict) -> Level:
        c, _ = self._value(level, how)
        order = [F.desc("_score") if "_score" in level.df.columns else F.lit(1), F.asc("_id")]
        w = Window.partitionBy(*level.keys, c).orderBy(*order)
        kept = level.df.where(c.isNotNull()).withColumn("_cv_n", F.row_number().over(w)).where(F.col("_cv_n") <= int(how.get("max_docs_per_value", 1))).drop("_cv_n")
        kept = kept.unionByName(level.df.where(c.isNull()))
        return Level(self._top(kept, level.keys, order, int(how.get("shard_size", 100))), level.keys, level.mapping, level.path)

    def _grid(self, level: Level, name: str, how: dict, cell: object) -> tuple:
        c, f = self._value(level, how)
        rows = self._with_key(level, name, F.transform(c, cell) if f.multi else F.when(c.isNotNull(), cell(c)), f.multi)
        return rows, lambda frame, _: self._top(frame, level.keys, [F.desc("doc_count"), F.desc(name)], int(how.get("size", 10_000)))

    def b_geohash_grid(self, level: Level, name: str, how: dict) -> tuple:
        return self._grid(level, name, how, lambda p: geo.geohash(p, int(how.get("precision", 5))))

    def b_geotile_grid(self, level: Level, name: str, how: dict) -> tuple:
        return self._grid(level, name, how, lambda p: geo.geotile(p, int(how.get("precision", 7))))

    def _related(self, level: Level, how: dict, up: bool) -> Level:
        rel = self.engine.relation(how["type"])
        other = self.engine.index(rel.parent if up else rel.child)
        source = other.df.where(rel.is_parent()) if up else rel.of_child(other.df)
        if up:
            ids = level.df.select(*level.keys, F.col(rel.parent_key).alias("_cv_p")).distinct()
            df = source.withColumn("_id", F.col(other.id_col)).join(ids, F.col(other.id_col) == F.col("_cv_p")).drop("_cv_p")
        else:
            ids = level.df.select(*level.keys, F.col("_id").alias("_cv_p"))
            df = source.withColumn("_id", F.col(other.id_col)).join(ids, F.col(rel.parent_key) == F.col("_cv_p")).drop("_cv_p")
        return Level(df, level.keys, other.mapping)

    def b_children(self, level: Level, name: str, how: dict) -> Level:
        return self._related(level, how, up=False)

    def b_parent(self, level: Level, name: str, how: dict) -> Level:
        return self._related(level, how, up=True)

    # -- pipelines

    @staticmethod
    def _gap(frame: DataFrame, target: str, policy: str) -> Column:
        """A bucket's value: null where it is a gap, 0 with insert_zeros."""
        name = {"_count": "doc_count"}.get(target, re.sub(r"\['?([^'\]]+)'?\]", r".\1", target).replace(">", "."))
        if name not in frame.columns:
            name = name.removesuffix(".value")
        c = F.col(f"`{name}`").cast("double")
        if name == "doc_count":
            return c
        c = F.when((F.col("doc_count") > 0) & ~F.isnan(c), c)
        return F.coalesce(c, F.lit(0.0)) if policy == "insert_zeros" else c

    def _parent(self, frame: DataFrame, parents: list[str], key: str | None, name: str, kind: str, how: dict) -> DataFrame:
        """Windows over bucket rows, by parent in the order of the key; bucket frames are no larger than the request's buckets."""
        w = Window.partitionBy(*parents).orderBy(key) if parents else Window.orderBy(key)
        path, policy = how.get("buckets_path"), how.get("gap_policy", "skip")
        if kind == "cumulative_sum":
            return frame.withColumn(name, F.sum(self._gap(frame, path, "insert_zeros")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if kind in ("derivative", "serial_diff"):
            v = self._gap(frame, path, policy)
            before = F.lag(v, int(how.get("lag", 1))).over(w)
            frame = frame.withColumn(name, v - before)
            if "unit" in how:
                unit = float(datemath.parse_duration_ms(how["unit"]))
                at = F.unix_micros(F.col(key).cast("timestamp")) / 1000.0
                frame = frame.withColumn(f"{name}.normalized_value", F.col(f"`{name}`") / ((at - F.lag(at).over(w)) / unit))
            return frame
        if kind == "moving_avg":
            v, size, model = self._gap(frame, path, policy), int(how.get("window", 5)), how.get("model", "simple")
            if model not in ("simple", "linear", "ewma"):
                raise ValueError(f"[moving_avg] model [{model}] is not supported")
            frame = frame.withColumn("_cv_v", v)
            full = frame.where("_cv_v is not null")
            f = Window.partitionBy(*parents).orderBy(key).rowsBetween(-size, -1) if parents else Window.orderBy(key).rowsBetween(-size, -1)
            if model == "simple":
                out = F.avg("_cv_v").over(f)
            else:
                xs = F.collect_list("_cv_v").over(f)
                if model == "linear":
                    top = F.aggregate(F.transform(xs, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
                    out = F.when(F.size(xs) > 0, top / (F.size(xs) * (F.size(xs) + 1) / 2))
                else:
                    alpha = float(how.get("settings", {}).get("alpha", 0.3))
                    out = F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha))
            told = full.withColumn(name, out)
            rest = frame.where("_cv_v is null").withColumn(name, F.lit(None).cast("double"))
            return told.unionByName(rest).drop("_cv_v")
        if kind == "bucket_sort":
            order, needed = [], F.lit(True)
            for s in how.get("sort", []):
                n, d = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
                d = d if isinstance(d, str) else d.get("order", "asc")
                c = self._gap(frame, n, how.get("gap_policy", "skip")) if n not in ("_key",) else F.col(key)
                needed = needed & c.isNotNull()
                order.append(c.asc() if d == "asc" else c.desc())
            frame = frame.where(needed)
            start, size = int(how.get("from", 0)), int(how.get("size", 2**31 - 1))
            over = (Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))).orderBy(*(order or [F.asc(key)]), F.asc(key))
            return frame.withColumn("_cv_r", F.row_number().over(over)).where((F.col("_cv_r") > start) & (F.col("_cv_r") <= start + size)).drop("_cv_r")
        paths = path if isinstance(path, dict) else {"_value": path}
        script = how["script"] if isinstance(how["script"], dict) else {"source": how["script"]}
        values = {k: self._gap(frame, p, policy) for k, p in paths.items()}
        source = re.sub(r"params\.(\w+)", lambda m: m[1] if m[1] in values else m[0], script["source"])
        out = Script(source, lambda n: values[n], script.get("params")).compile()
        return frame.withColumn(name, out.cast("double")) if kind == "bucket_script" else frame.where(F.coalesce(out, F.lit(False)))

    def _sibling(self, level: Level, kind: str, how: dict, path: str, name: str) -> DataFrame:
        """A second aggregation, over the bucket rows of a sibling."""
        agg, _, target = how["buckets_path"].partition(">")
        if f"{path}>{agg}" not in self.out and agg not in self.out and "." in agg:
            agg, _, target = how["buckets_path"].partition(".")
        full = f"{path}>{agg}" if path else agg
        while target and f"{full}>{target.split('>')[0]}" in self.out:
            step, _, target = target.partition(">")
            full = f"{full}>{step}"
        frame = self.out[full]
        rows = frame.withColumn("_cv_v", self._gap(frame, target or "_count", how.get("gap_policy", "skip"))).where("_cv_v is not null")
        keys = [k for k in level.keys if k in rows.columns]
        v, g = F.col("_cv_v"), rows.groupBy(*keys)
        if kind in ("avg_bucket", "sum_bucket"):
            return g.agg((F.avg(v) if kind == "avg_bucket" else F.coalesce(F.sum(v), F.lit(0.0))).alias(name))
        if kind in ("min_bucket", "max_bucket"):
            best = F.min(v) if kind == "min_bucket" else F.max(v)
            top = rows.withColumn("_cv_b", best.over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))))
            return top.where("_cv_v = _cv_b").groupBy(*keys).agg(F.first("_cv_v").alias(name), F.sort_array(F.collect_list(F.col(f"`{agg}`").cast("string"))).alias(f"{name}.keys"))
        if kind == "percentiles_bucket":
            s, n = F.sort_array(F.collect_list(v)), F.count(v)
            return g.agg(*[F.get(s, F.round(F.lit(p / 100.0) * (n - 1)).cast("int")).alias(f"{name}.{float(p)}") for p in how.get("percents", [1, 5, 25, 50, 75, 95, 99])])
        out = [F.count(v).alias(f"{name}.count"), F.min(v).alias(f"{name}.min"), F.max(v).alias(f"{name}.max"), F.avg(v).alias(f"{name}.avg"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}.sum")]
        if kind == "extended_stats_bucket":
            s = float(how.get("sigma", 2))
            out += [F.sum(v * v).alias(f"{name}.sum_of_squares"), F.var_pop(v).alias(f"{name}.variance"), F.stddev_pop(v).alias(f"{name}.std_deviation"), (F.avg(v) + s * F.stddev_pop(v)).alias(f"{name}.upper"), (F.avg(v) - s * F.stddev_pop(v)).alias(f"{name}.lower")]
        return g.agg(*out)


def checked_buckets(frame: DataFrame, most: int = MAX_BUCKETS) -> list:
    """Bucket rows for rendering, never more than ``most``."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"Trying to create too many buckets. Must be less than or equal to: [{most}]")
    return rows
