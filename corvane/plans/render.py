"""Responses: the rows of a search result as the nested JSON of the document-store API. Only a page of hits and bounded bucket rows are collected."""

from __future__ import annotations

import base64
import re
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Row

from corvane.operators.aggregations import METRICS, PARENTS, SIBLINGS, _kind, checked_buckets
from corvane.plans.search import SearchResult

SINGLE = {"filter", "missing", "global", "nested", "reverse_nested", "sampler", "diversified_sampler", "children", "parent"}
ORDERED = {"histogram", "date_histogram", "auto_date_histogram", "variable_width_histogram"}
RANGES = {"range", "date_range", "ip_range", "geo_distance", "filters", "adjacency_matrix"}


def value(v: object) -> object:
    """A cell as JSON."""
    if isinstance(v, Row):
        return {k: value(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, (list, tuple)):
        return [value(x) for x in v]
    if isinstance(v, dict):
        return {str(k): value(x) for k, x in v.items()}
    if isinstance(v, datetime):
        return v.isoformat(timespec="milliseconds") + "Z"
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    return float(v) if isinstance(v, Decimal) else v


def hits(result: SearchResult, track_total: bool | int = True) -> dict:
    """The hits object: total, best score and the page, each hit with its source and what was fetched beside it."""
    out, sources = [], None
    for row in result.hits.collect():
        told = row.asDict()
        hit = {"_index": told.pop("_index"), "_id": str(told.pop("_id")), "_score": told.pop("_score", None)}
        groups: dict[str, dict] = {"fields": {}, "highlight": {}, "inner_hits": {}}
        for name in list(told):
            group, dot, rest = name.partition(".")
            if dot and group in groups:
                v = value(told.pop(name))
                if v:
                    groups[group][rest] = {"hits": {"hits": [{"_nested": {"field": rest, "offset": x["offset"]}, "_source": x.get("source", {})} for x in v]}} if group == "inner_hits" else v
        for name in ("matched_queries", "_version", "_seq_no", "_ignored"):
            if (v := told.pop(name, None)) not in (None, []):
                hit[name] = value(v)
        sources = {k: value(v) for k, v in told.items() if v is not None}
        if result.search is None or result.search.body.get("_source", True) is not False:
            hit["_source"] = sources
        out.append(hit | {k: v for k, v in groups.items() if v})
    best = max((h["_score"] for h in out if h["_score"] is not None), default=None)
    made = {"max_score": best, "hits": out}
    if track_total is False:
        return made
    total = result.total()
    capped = track_total is not True and total > int(track_total)
    return {"total": {"value": int(track_total) if capped else total, "relation": "gte" if capped else "eq"}, **made}


def _key(v: object, fmt: str | None = None) -> dict:
    """A bucket's key, dates as milliseconds and truth values as 1 and 0, with the written form beside these."""
    if isinstance(v, bool):
        return {"key": int(v), "key_as_string": str(v).lower()}
    if isinstance(v, datetime):
        ms = round(v.replace(tzinfo=timezone.utc).timestamp() * 1000)
        return {"key": ms, "key_as_string": written(v, fmt)}
    return {"key": value(v)}


_JAVA = {"yyyy": "%Y", "uuuu": "%Y", "yy": "%y", "MMM": "%b", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSS": "ms", "EEE": "%a", "DDD": "%j"}


def written(v: datetime, fmt: str | None) -> str:
    """A time in the first of a format's patterns."""
    first = (fmt or "").split("||")[0]
    if first == "epoch_millis":
        return str(round(v.replace(tzinfo=timezone.utc).timestamp() * 1000))
    if first == "epoch_second":
        return str(int(v.replace(tzinfo=timezone.utc).timestamp()))
    if not first or first.startswith(("strict_", "date_")):
        return v.isoformat(timespec="milliseconds") + "Z"

    def part(m: re.Match) -> str:
        text = m[0]
        if text.startswith("'"):
            return text[1:-1] or "'"
        strf = _JAVA.get(text)
        return f"{v.microsecond // 1000:03d}" if strf == "ms" else v.strftime(strf) if strf else {"M": str(v.month), "d": str(v.day), "H": str(v.hour), "m": str(v.minute), "s": str(v.second)}.get(text, text)

    return re.sub(r"'[^']*'|([A-Za-z])\1*", part, first)


def _metric(kind: str, how: dict, name: str, row: dict) -> dict:
    parts = {k.removeprefix(name + "."): value(v) for k, v in row.items() if k.startswith(name + ".")}
    if kind == "top_hits":
        return {"hits": {"hits": [{"_id": str(h["_id"]), "_source": {k: value(v) for k, v in h.asDict().items() if k not in ("rank", "_id")}} for h in row.get(name) or []]}}
    if kind in ("percentiles", "percentile_ranks", "percentiles_bucket"):
        return {"values": parts if how.get("keyed", True) else [{"key": float(k), "value": v} for k, v in parts.items()]}
    if kind == "geo_bounds":
        return {"bounds": {"top_left": {"lat": parts["top"], "lon": parts["left"]}, "bottom_right": {"lat": parts["bottom"], "lon": parts["right"]}}} if parts.get("top") is not None else {}
    if kind == "geo_centroid":
        return {"location": {"lat": parts["lat"], "lon": parts["lon"]}, "count": parts["count"]} if parts.get("count") else {"count": 0}
    if kind in ("min_bucket", "max_bucket"):
        return {"value": value(row.get(name)), "keys": parts.get("keys", [])}
    if "upper" in parts:
        parts["std_deviation_bounds"] = {"upper": parts.pop("upper"), "lower": parts.pop("lower")}
    if name in row:
        return {"value": value(row[name]), **parts}
    return parts


class _Tree:
    def __init__(self, result: SearchResult) -> None:
        self.result, self.rows = result, {}

    def frame(self, path: str) -> list[dict]:
        if path not in self.rows:
            self.rows[path] = [r.asDict() for r in checked_buckets(self.result.aggregations[path])]
        return self.rows[path]

    def level(self, nodes: dict, path: str, at: dict, row: dict | None) -> dict:
        """The results of a level's nodes under the bucket with the keys ``at``, whose own columns are ``row``."""
        out: dict = {}
        for name, node in nodes.items():
            kind, how, subs = _kind(node)
            full = f"{path}>{name}" if path else name
            if kind in METRICS:
                source = row if row is not None else (self.frame(name) or [{}])[0]
                out[name] = _metric(kind, how, name, source)
            elif kind in SIBLINGS:
                mine = [r for r in self.frame(full) if all(r.get(k) == v for k, v in at.items() if k in r)]
                out[name] = _metric(kind, how, name, mine[0] if mine else {name: None})
            elif kind in PARENTS:
                if row is not None and kind not in ("bucket_sort", "bucket_selector") and name in row and row[name] is not None:
                    out[name] = _metric(kind, how, name, row)
            else:
                mine = [r for r in self.frame(full) if all(r.get(k) == v for k, v in at.items())]
                out[name] = self.bucket(kind, how, subs, name, full, at, mine)
            if node.get("meta"):
                out[name]["meta"] = node["meta"]
        return out

    def bucket(self, kind: str, how: dict, subs: dict, name: str, full: str, at: dict, mine: list[dict]) -> dict:
        if kind in SINGLE:
            row = mine[0] if mine else {"doc_count": 0}
            return {"doc_count": row["doc_count"], **self.level(subs, full, at, row)}
        buckets = []
        for r in self._sorted(kind, how, name, mine):
            keys = [next(iter(s)) for s in how["sources"]] if kind == "composite" else [k for k in r if re.fullmatch(re.escape(name) + r"\.\d+", k)] + [name] if kind == "multi_terms" else [name]
            told: dict = {"key": {k: _key(r[k])["key"] for k in keys}} if kind == "composite" else {"key": [value(r[k]) for k in keys[:-1]], "key_as_string": r[name]} if kind == "multi_terms" else _key(r[name], how.get("format"))
            for extra in ("from", "to", "min", "max", "bg_count", "score"):
                if extra in r and r[extra] is not None and extra not in subs:
                    told[extra] = value(r[extra])
            told |= {"doc_count": r["doc_count"], **self.level(subs, full, at | {k: r[k] for k in keys}, r)}
            buckets.append(told)
        out: dict = {}
        if kind == "composite" and buckets:
            out["after_key"] = buckets[-1]["key"]
        if kind in ("terms", "multi_terms") and mine and "sum_other_doc_count" in mine[0]:
            out["sum_other_doc_count"] = mine[0]["sum_other_doc_count"] or 0
        elif kind == "terms" and not at and name in self.result.totals:
            out["sum_other_doc_count"] = self.result.totals[name].first()["n"] - sum(b["doc_count"] for b in buckets)
        if kind == "auto_date_histogram" and mine:
            out["interval"] = mine[0]["interval"]
        keyed = how.get("keyed", kind == "filters" and isinstance(how.get("filters"), dict))
        if kind == "filters" and not keyed:
            for b in buckets:
                b.pop("key")
        out["buckets"] = {str(b.get("key_as_string", b["key"])): {k: v for k, v in b.items() if k not in ("key",)} for b in buckets} if keyed else buckets
        return out

    @staticmethod
    def _sorted(kind: str, how: dict, name: str, rows: list[dict]) -> list[dict]:
        """Bucket rows in the order the request asks for; ties by key."""
        null_last = lambda v: (v is None, v if v is not None else 0)
        if kind == "composite":
            for source in reversed(how["sources"]):
                n, spec = next(iter(source.items()))
                s = next(iter(spec.values()))
                down = s.get("order", "asc") == "desc"
                first = s.get("missing_order", "default") in (("last",) if down else ("first", "default"))
                rows = sorted(rows, key=lambda r, n=n, first=first: ((r[n] is not None) if first else (r[n] is None), r[n] if r[n] is not None else 0), reverse=down)
            return rows
        if kind in RANGES:
            asked = {k: i for i, k in enumerate(how.get("filters", ()))} if kind == "filters" and isinstance(how.get("filters"), dict) else {}
            return sorted(rows, key=lambda r: (asked.get(r[name], len(asked)), r.get("from") is not None, r.get("from") or 0, r.get("to") is None, r.get("to") or 0, str(r[name])))
        spec = how.get("order") or ([] if kind in ORDERED else [{"score": "desc"}] if kind.startswith("significant") else [{"_count": "asc"}] if kind == "rare_terms" else [{"_count": "desc"}])
        rows = sorted(rows, key=lambda r: null_last(r[name]), reverse=kind in ("geohash_grid", "geotile_grid"))
        for one in reversed(spec if isinstance(spec, list) else [spec]):
            n, way = next(iter(one.items()))
            col = {"_count": "doc_count", "_key": name, "_term": name}.get(n, n.replace(">", "."))
            rows = sorted(rows, key=lambda r, col=col: r.get(col, r.get(col.removesuffix(".value"))) or 0, reverse=way == "desc")
        return rows


def aggregations(result: SearchResult, aggs: dict) -> dict:
    """The aggregation results, bucket within bucket, from the flat frames of each level."""
    return _Tree(result).level(aggs, "", {}, None)


def response(result: SearchResult, body: dict | None = None) -> dict:
    """A whole search response."""
    body = body or (result.search.body if result.search else {})
    out: dict = {"timed_out": False, "hits": hits(result, body.get("track_total_hits", True))}
    if aggs := body.get("aggs") or body.get("aggregations"):
        out["aggregations"] = aggregations(result, aggs)
    if result.search is not None and "suggest" in body:
        from corvane.operators.suggest import suggest

        out["suggest"] = suggest(result.search.engine, result.search.expression, body["suggest"])
    return out


def filter_path(body: object, spec: str) -> object:
    """The parts of a response that match dotted patterns (``*`` one name, ``**`` any depth), or all but those after a minus."""
    patterns = [p.strip() for p in spec.split(",") if p.strip()]
    keep, drop = [p.split(".") for p in patterns if p[0] != "-"], [p[1:].split(".") for p in patterns if p[0] == "-"]

    def one(name: str, pattern: str) -> bool:
        return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name) is not None

    def after(ps: list[list[str]], name: str) -> list[list[str]]:
        out = []
        for p in ps:
            if p and p[0] == "**":
                out += [p, *([p[2:]] if len(p) > 1 and one(name, p[1]) else [])]
            elif p and one(name, p[0]):
                out.append(p[1:])
        return out

    def kept(node: object, ps: list[list[str]]) -> object:
        if any(not p for p in ps):
            return node
        if isinstance(node, list):
            return [x for x in (kept(x, ps) for x in node) if x not in (None, {}, [])] or None
        if not isinstance(node, dict):
            return node if any(p == ["**"] for p in ps) else None
        found = {k: kept(v, after(ps, k)) for k, v in node.items() if after(ps, k)}
        return {k: v for k, v in found.items() if v is not None} or None

    def cut(node: object, ps: list[list[str]]) -> object:
        if isinstance(node, list):
            return [cut(x, ps) for x in node]
        if not isinstance(node, dict):
            return node
        return {k: cut(v, after(ps, k)) for k, v in node.items() if not any(not p for p in after(ps, k))}

    out = kept(body, keep) if keep else body
    return cut(out if out is not None else {}, drop) if drop else out if out is not None else {}
