"""Mappings: logical field types over a DataFrame's columns."""

from __future__ import annotations

import copy
import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.analysis import analyze, normalize

NUMERIC = {"long", "integer", "short", "byte", "double", "float", "half_float", "scaled_float", "unsigned_long", "token_count", "rank_feature"}
TEXT = {"text", "match_only_text", "search_as_you_type"}
KEYWORD = {"keyword", "wildcard", "constant_keyword", "version", "ip", "flat_object"}
RANGES = {"integer_range", "long_range", "float_range", "double_range", "date_range", "ip_range"}
TYPES = NUMERIC | TEXT | KEYWORD | RANGES | {"boolean", "date", "date_nanos", "object", "nested", "geo_point", "geo_shape", "xy_point", "xy_shape", "join", "rank_features", "knn_vector", "completion", "binary", "alias", "percolator"}
#: Token filters of the fields that a search_as_you_type field brings with it.
SAYT = {
    "_2gram": ["lowercase", {"type": "shingle", "min_shingle_size": 2, "max_shingle_size": 2, "output_unigrams": False}],
    "_3gram": ["lowercase", {"type": "shingle", "min_shingle_size": 3, "max_shingle_size": 3, "output_unigrams": False}],
    "_index_prefix": ["lowercase", {"type": "shingle", "min_shingle_size": 2, "max_shingle_size": 3}, {"type": "edge_ngram", "min_gram": 1, "max_gram": 20}],
}
_CASTS = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "half_float": "float", "unsigned_long": "decimal(20,0)", "boolean": "boolean"}


@dataclass
class Field:
    """One mapped field: its type, where it lies, and the parameters that change its values."""

    name: str
    type: str
    column: str = ""
    multi: bool = False
    analyzer: str | dict = "standard"
    search_analyzer: str | dict | None = None
    params: dict = field(default_factory=dict)


def _of_spark(name: str, kind: T.DataType) -> tuple[str, bool]:
    multi = isinstance(kind, T.ArrayType)
    inner = kind.elementType if multi else kind
    if isinstance(inner, T.StructType):
        names = {f.name for f in inner.fields}
        if names == {"lat", "lon"}:
            return "geo_point", multi
        if names == {"gte", "lte"}:
            first = inner.fields[0].dataType
            return ("date_range" if isinstance(first, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "double_range" if isinstance(first, (T.DoubleType, T.FloatType)) else "long_range"), multi
        return ("nested" if multi else "object"), multi
    for t, out in ((T.StringType, "keyword"), (T.LongType, "long"), (T.IntegerType, "integer"), (T.ShortType, "short"), (T.ByteType, "byte"), (T.DoubleType, "double"), (T.FloatType, "float"), (T.BooleanType, "boolean"), (T.BinaryType, "binary"), (T.MapType, "flat_object"), (T.DecimalType, "unsigned_long")):
        if isinstance(inner, t):
            return out, multi
    return "date", multi


class Mapping:
    """Fields by dotted name. Columns not told of take the type that their Spark type stands for; strings are keywords."""

    def __init__(self, df: DataFrame, properties: dict | None = None, settings: dict | None = None) -> None:
        self.settings = settings or {}
        self.fields: dict[str, Field] = {}
        self.declared = dict(properties or {})
        self.stored: dict[str, str] = {}  # columns that hold the tokens of a field
        self._infer("", df.schema)
        for name, how in (properties or {}).items():
            self._declare(name, dict(how))

    def _infer(self, prefix: str, schema: T.StructType) -> None:
        for f in schema.fields:
            if f.name in ("_version", "_seq_no") or f.name.startswith("_cv_"):
                continue
            kind, multi = _of_spark(f.name, f.dataType)
            name = prefix + f.name
            self.fields[name] = Field(name, kind, name, multi)
            inner = f.dataType.elementType if multi else f.dataType
            if kind in ("object", "nested"):
                self._infer(name + ".", inner)

    def _declare(self, name: str, how: dict) -> None:
        kind = how.get("type", "object")
        if kind not in TYPES:
            raise ValueError(f"No handler for type [{kind}] declared on field [{name}]")
        if kind == "alias":
            self.fields[name] = self.fields[how["path"]]
            return
        base = self.fields.get(name)
        column = base.column if base else how.get("column", name)
        at = Field(name, kind, column, bool(base and base.multi), how.get("analyzer", "standard"), how.get("search_analyzer"), how)
        self.fields[name] = at
        for sub, more in how.get("fields", {}).items():
            self._declare(f"{name}.{sub}", {**more, "column": column})
            self.fields[f"{name}.{sub}"].multi = at.multi
        if kind == "search_as_you_type":
            for sub, filters in SAYT.items():
                self.fields[f"{name}.{sub}"] = Field(f"{name}.{sub}", "text", column, at.multi, {"tokenizer": "standard", "filter": filters}, params={"derived": True})
        for sub, more in how.get("properties", {}).items():
            self._declare(f"{name}.{sub}", more)

    def get(self, name: str) -> Field | None:
        """A field by name; ``a.b`` is also the entry b of a map a, be it a flat object or features."""
        if name in self.fields or "." not in name:
            return self.fields.get(name)
        at = name.index(".")
        while at > 0:
            base = self.fields.get(name[:at])
            if base and base.type in ("flat_object", "rank_features"):
                return Field(name, "keyword" if base.type == "flat_object" else "rank_feature", base.column, False, params={"entry": name[at + 1 :]})
            at = name.find(".", at + 1)
        return None

    def properties(self) -> dict:
        """The mapping as it is told: what was declared, and the types that columns stand for."""
        return {n: self.declared.get(n, {"type": f.type}) for n, f in self.fields.items() if "." not in n and n != "_id"} | {n: how for n, how in self.declared.items() if n not in self.fields}

    def match(self, pattern: str) -> list[str]:
        return [n for n in self.fields if fnmatch.fnmatchcase(n, pattern)]

    def column(self, f: Field) -> Column:
        """The field's value, with ignore_above, null_value, normalizer and scaling applied."""
        c = F.col(".".join(f"`{p}`" for p in f.column.split(".")))
        p = f.params
        if "entry" in p:
            return F.try_element_at(c, F.lit(p["entry"]))
        if "null_value" in p:
            c = F.coalesce(c, F.lit(p["null_value"]))
        if "ignore_above" in p:
            fits = lambda x: F.length(x) <= p["ignore_above"]
            c = F.filter(c, fits) if f.multi else F.when(fits(c), c)
        if "normalizer" in p:
            filters = self.settings.get("normalizer", {}).get(p["normalizer"], {}).get("filter", [p["normalizer"]])
            c = F.transform(c, lambda x: normalize(x, filters)) if f.multi else normalize(c, filters)
        if f.type == "scaled_float":
            c = F.floor(c * p["scaling_factor"] + 0.5) / p["scaling_factor"]
        if f.type == "token_count":
            c = F.size(analyze(c, f.analyzer, self.settings))
        return c

    def tokens(self, f: Field) -> Column:
        """The tokens of a text field; a keyword's value is its only one."""
        if f.name in self.stored:
            return F.col(f"`{self.stored[f.name]}`")
        c = self.column(f)
        if f.type not in TEXT:
            return F.array_compact(c if f.multi else F.array(c))
        if f.multi:
            return F.flatten(F.transform(c, lambda x: analyze(x, f.analyzer, self.settings)))
        return analyze(c, f.analyzer, self.settings)

    def storing(self, columns: dict[str, str]) -> Mapping:
        """The same fields, with columns that hold tokens by field."""
        out = copy.copy(self)
        out.stored = columns
        return out

    def analyzed(self, f: Field, text: str, analyzer: str | dict | None = None) -> Column:
        """The tokens of a query's text."""
        if f.type not in TEXT:
            return F.array(F.lit(str(text)))
        return analyze(F.lit(str(text)), analyzer or f.search_analyzer or f.analyzer, self.settings)


def spark_type(how: dict) -> str:
    """The Spark type of a declared field."""
    kind = how.get("type", "object")
    if kind in ("object", "nested") and how.get("properties"):
        inner = "struct<" + ",".join(f"`{n}`:{spark_type(h)}" for n, h in how["properties"].items()) + ">"
        return f"array<{inner}>" if kind == "nested" else inner
    if kind in RANGES:
        bound = {"integer_range": "int", "long_range": "bigint", "float_range": "float", "double_range": "double", "date_range": "timestamp_ntz", "ip_range": "string"}[kind]
        return f"struct<gte:{bound},lte:{bound}>"
    return _CASTS.get(kind) or {"date": "timestamp_ntz", "date_nanos": "timestamp_ntz", "scaled_float": "double", "geo_point": "struct<lat:double,lon:double>", "binary": "binary", "rank_feature": "float", "rank_features": "map<string,float>", "flat_object": "map<string,string>", "knn_vector": "array<float>", "join": "struct<name:string,parent:string>", "completion": "array<struct<input:array<string>,weight:bigint,contexts:map<string,array<string>>>>", "xy_point": "struct<x:double,y:double>"}.get(kind, "string")


def id_in(df: DataFrame, id_col: str, values: list) -> Column:
    """Whether a row's id is one of ``values``. These take the id's type, not the other way round, so that the scan can use them; one that cannot is no row's id."""
    kind = dict(df.dtypes)[id_col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        whole = [int(str(v)) for v in values if re.fullmatch(r"-?\d{1,19}", str(v))]
        bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind]
        return F.col(id_col).isin([F.lit(v).cast(kind) for v in whole if -(1 << bits) <= v < 1 << bits])
    c = F.col(id_col) if kind == "string" else F.col(id_col).cast("string")
    return c.isin([str(v) for v in values])


def coerce(df: DataFrame, properties: dict) -> DataFrame:
    """Cast raw columns to their mapped types; a value that does not fit becomes null and its field is told in ``_ignored``. copy_to fields gather their sources."""
    out, bad = {}, []
    copies: dict[str, list[str]] = {}
    for name, how in properties.items():
        for to in [how["copy_to"]] if isinstance(how.get("copy_to"), str) else how.get("copy_to", []):
            copies.setdefault(to, []).append(name)
        kind = _CASTS.get(how.get("type"), "timestamp_ntz" if how.get("type") == "date" else None)
        if name not in df.columns or kind is None or dict(df.dtypes)[name].startswith("array"):
            continue
        raw = F.col(f"`{name}`")
        cast = raw.try_cast(kind)
        if kind in ("bigint", "int", "smallint", "tinyint"):
            cast = F.coalesce(cast, raw.try_cast("double").try_cast(kind))
        out[name] = cast
        bad.append(F.when(raw.isNotNull() & cast.isNull(), F.lit(name)))
    df = df.withColumn("_ignored", F.array_compact(F.array(*bad).cast("array<string>"))) if bad else df
    df = df.withColumns(out)
    return df.withColumns({to: F.array_compact(F.array(*[F.col(f"`{s}`").cast("string") for s in names])) for to, names in copies.items()})


def dynamic_properties(df: DataFrame, date_detection: bool = True) -> dict:
    """Types that a document store would infer: strings that look like dates in every row are dates (one aggregate row to the driver), other strings text with a keyword, whole numbers long, others float."""
    strings = [n for n, t in df.dtypes if t == "string"]
    dated: set[str] = set()
    if date_detection and strings:
        looks = r"^\d{4}[-/]\d{2}[-/]\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
        got = df.select(strings).agg(*[F.min(F.coalesce(F.regexp_like(n, F.lit(looks)), F.lit(True))).alias(n) for n in strings], *[F.count(n).alias(f"n_{n}") for n in strings]).first()
        dated = {n for n in strings if got[n] and got[f"n_{n}"]}
    out: dict = {}
    for name, kind in df.dtypes:
        if kind == "string":
            out[name] = {"type": "date"} if name in dated else {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 256}}}
        else:
            t = {"bigint": "long", "int": "long", "double": "float", "float": "float", "boolean": "boolean"}.get(kind)
            if t:
                out[name] = {"type": t}
    return out
