"""The document-store API in process: a method, a path and a JSON body to a status and a JSON response."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.analysis import analyze
from corvane.plans import render
from corvane.plans.mapping import spark_type
from corvane.plans.search import META, Engine, Scroll, Search, merged
from corvane.sources import documents as sources

#: Paths that only make writes visible or tidy up: every write here is visible at once.
_NOTHING_TO_DO = {"_refresh", "_flush", "_forcemerge", "_cache", "_open", "_close"}


class ApiError(Exception):
    def __init__(self, status: int, kind: str, reason: str) -> None:
        super().__init__(reason)
        self.status, self.kind = status, kind


class Client:
    """Requests against an engine of its own (or a given one). A request's own documents are small; tables are opened with ``engine.create`` or ``sources.open_parquet``."""

    def __init__(self, spark: SparkSession, engine: Engine | None = None) -> None:
        self.spark, self.engine = spark, engine or Engine(spark)

    def request(self, method: str, path: str, body: object = None, params: dict | None = None) -> tuple[int, object]:
        params = dict(params or {})
        try:
            status, out = self._dispatch(method.upper(), [p for p in path.split("/") if p], body, params)
        except ApiError as e:
            status, out = e.status, {"error": {"type": e.kind, "reason": str(e)}, "status": e.status}
        except KeyError as e:
            status, out = 404, {"error": {"type": "resource_not_found_exception", "reason": str(e)}, "status": 404}
        except (ValueError, TypeError, PySparkException) as e:
            gone = "no such index" in str(e)
            status = 404 if gone else 400
            out = {"error": {"type": "index_not_found_exception" if gone else "illegal_argument_exception", "reason": str(e)}, "status": status}
        return status, render.filter_path(out, params["filter_path"]) if "filter_path" in params and isinstance(out, dict) else out

    # -- routes

    def _dispatch(self, method: str, parts: list[str], body: object, params: dict) -> tuple[int, object]:
        if not parts:
            return 200, {"version": {"distribution": "corvane"}, "tagline": "search on DataFrames"}
        index = None if parts[0].startswith("_") else parts[0]
        rest = parts if index is None else parts[1:]
        action = rest[0] if rest else ""
        if action in _NOTHING_TO_DO:
            return 200, {"_shards": {"failed": 0}}
        name = {"": "index", "_mappings": "_mapping", "_alias": "_aliases"}.get(action, action).removeprefix("_")
        if name == "search" and len(rest) > 1:
            name = {"scroll": "scroll", "point_in_time": "point"}[rest[1]]
        handler: Callable | None = getattr(self, f"r_{name}", None)
        if handler is None:
            raise ApiError(400, "illegal_argument_exception", f"no handler found for [{method} /{'/'.join(parts)}]")
        return handler(method, index, rest[1:], body if body is not None else {}, params)

    def r_index(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        e = self.engine
        if method == "PUT":
            if index in e.indices:
                raise ApiError(400, "resource_already_exists_exception", f"index [{index}] already exists")
            self._create(index, body)
            return 200, {"acknowledged": True, "index": index}
        if method == "HEAD":
            return (200 if index in e.indices or index in e.aliases else 404), None
        found = [ix for ix, _ in e.resolve(index)]
        if method == "DELETE":
            for ix in found:
                e.drop(ix.name)
            return 200, {"acknowledged": True}
        return 200, {ix.name: {"mappings": {"properties": ix.mapping.properties()}, "aliases": {a: {} for a, t in e.aliases.items() if ix.name in t}} for ix in found}

    def _create(self, index: str, body: dict) -> None:
        """An empty index as its templates and the request say."""
        body = merged(self.engine.template_for(index), body)
        props = body.get("mappings", {}).get("properties", {})
        fields = ", ".join(["_id string", *[f"`{n}` {spark_type(how)}" for n, how in props.items() if how.get("type") != "alias"]])
        self.engine.create(index, self.spark.createDataFrame([], fields), props, body.get("settings", {}).get("analysis"))
        for alias, how in body.get("aliases", {}).items():
            sources.put_alias(self.engine, alias, index, how.get("filter"))

    def r_index_template(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        if rest and rest[0].startswith("_simulate"):
            return 200, {"template": self.engine.template_for(rest[1])}
        return self._stored(self.engine.templates, "index_templates", method, rest, body)

    def r_component_template(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        return self._stored(self.engine.components, "component_templates", method, rest, body)

    @staticmethod
    def _stored(held: dict, kind: str, method: str, rest: list[str], body: dict) -> tuple[int, object]:
        if method in ("PUT", "POST"):
            held[rest[0]] = body
            return 200, {"acknowledged": True}
        if method == "DELETE":
            del held[rest[0]]
            return 200, {"acknowledged": True}
        if method == "HEAD":
            return (200 if rest[0] in held else 404), None
        return 200, {kind: [{"name": n, kind.removesuffix("s"): t} for n, t in held.items() if not rest or n == rest[0]]}

    def r_mapping(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        found = [ix for ix, _ in self.engine.resolve(index or "_all")]
        if method in ("PUT", "POST"):
            for ix in found:
                new = {n: how for n, how in body.get("properties", {}).items() if n not in ix.df.columns and how.get("type") != "alias"}
                df = ix.df.withColumns({n: F.lit(None).cast(spark_type(how)) for n, how in new.items()}) if new else ix.df
                self.engine.create(ix.name, df, ix.mapping.declared | body.get("properties", {}), ix.mapping.settings, ix.id_col)
            return 200, {"acknowledged": True}
        return 200, {ix.name: {"mappings": {"properties": ix.mapping.properties()}} for ix in found}

    def r_aliases(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        for act in body.get("actions", []):
            kind, how = next(iter(act.items()))
            if kind == "remove_index":
                self.engine.drop(how["index"])
                continue
            for name in how.get("indices", [how.get("index")]):
                for alias in how.get("aliases", [how.get("alias")]):
                    sources.put_alias(self.engine, alias, name, how.get("filter")) if kind == "add" else sources.remove_alias(self.engine, alias, name)
        if method in ("POST", "PUT") and body.get("actions"):
            return 200, {"acknowledged": True}
        if method in ("POST", "PUT") and rest:
            sources.put_alias(self.engine, rest[0], index, body.get("filter"))
            return 200, {"acknowledged": True}
        return 200, {n: {"aliases": {a: ({"filter": t[n]} if t[n] else {}) for a, t in self.engine.aliases.items() if n in t}} for n in self.engine.indices}

    # -- documents

    def _write(self, actions: list[tuple[str, str, str | None, str | None]]) -> list[dict]:
        """Bulk actions (op, index, id, source) in order, one new index for each that they touch; a result for each."""
        results: dict[int, dict] = {}
        for name in dict.fromkeys(a[1] for a in actions):
            own = [(i, a) for i, a in enumerate(actions) if a[1] == name]
            if name not in self.engine.indices and self.engine.template_for(name):
                self._create(name, {})
            ids = {i: a[2] or uuid.uuid4().hex[:20] for i, a in own}
            docs = [json.loads(a[3]) for _, a in own if a[3]]
            docs = [d.get("doc", d) if a[0] == "update" else d for d, a in zip(docs, [a for _, a in own if a[3]], strict=True)]
            ix = self.engine.indices.get(name)
            known = {f.name: f.dataType.simpleString() for f in ix.df.schema.fields if f.name not in META and not f.name.startswith("_cv_")} if ix else {}
            schema = ", ".join(f"`{n}` {t}" for n, t in (self._infer(docs, known) if docs else known).items())
            df = self.spark.createDataFrame([(op, name, ids[i], src, i) for i, (op, _, _, src) in own], "op string, _index string, _id string, source string, n long")
            _, told = sources.apply_bulk(self.engine, df.withColumn("file", F.lit("")).withColumn("block", F.lit(0).cast("long")), name, schema or "`_none` string")
            written = told.collect()  # the results, told before the index moves on
            sources.compact(self.engine, name)
            for r in written:
                results[r["n"]] = {r["op"]: {"_index": name, "_id": r["_id"], "status": r["status"], "result": r["result"], **({"_version": r["_version"], "_seq_no": r["_seq_no"], "_primary_term": 1} if r["status"] < 400 else {})}}
        return [results[i] for i in range(len(actions))]

    def _infer(self, docs: list[dict], known: dict[str, str]) -> dict[str, str]:
        kind = self.spark.range(1).select(F.schema_of_json(F.lit(json.dumps(docs))).alias("s")).first()["s"]
        found = self.spark.createDataFrame([], f"d {kind}").schema["d"].dataType.elementType
        return known | {f.name: f.dataType.simpleString() for f in getattr(found, "fields", []) if f.name not in known}

    def r_bulk(self, method: str, index: str | None, rest: list[str], body: object, params: dict) -> tuple[int, object]:
        lines = [x for x in body.split("\n") if x.strip()] if isinstance(body, str) else [json.dumps(x) for x in body]
        actions, i = [], 0
        while i < len(lines):
            op, meta = next(iter(json.loads(lines[i]).items()))
            if op not in ("index", "create", "update", "delete"):
                raise ApiError(400, "illegal_argument_exception", f"Malformed action/metadata line [{i + 1}]")
            takes = op != "delete"
            if takes and i + 1 >= len(lines):
                raise ApiError(400, "illegal_argument_exception", "The bulk request must be terminated by a newline")
            actions.append((op, meta.get("_index", index), meta.get("_id"), lines[i + 1] if takes else None))
            i += 1 + takes
        items = self._write(actions)
        return 200, {"errors": any(next(iter(x.values()))["status"] >= 400 for x in items), "items": items}

    def r_doc(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        key = rest[0] if rest else None
        if "if_seq_no" in params and method != "GET":
            now = sources.get(self.engine, index, key).first()
            if now is None or int(params["if_seq_no"]) != now["_seq_no"]:
                raise ApiError(409, "version_conflict_engine_exception", f"[{key}]: version conflict, required seqNo [{params['if_seq_no']}], but it is [{None if now is None else now['_seq_no']}]")
        if method in ("PUT", "POST"):
            got = next(iter(self._write([(params.get("op_type", "index"), index, key, json.dumps(body))])[0].values()))
            if got["status"] == 409:
                raise ApiError(409, "version_conflict_engine_exception", f"[{key}]: version conflict, document already exists")
            return got["status"], {k: v for k, v in got.items() if k != "status"}
        if method == "DELETE":
            got = next(iter(self._write([("delete", index, key, None)])[0].values()))
            return got["status"], {k: v for k, v in got.items() if k != "status"}
        row = sources.get(self.engine, index, key).first()
        if row is None:
            return 404, {"_index": index, "_id": key, "found": False}
        source = {k: render.value(v) for k, v in row.asDict().items() if k not in META and v is not None}
        return 200, {"_index": index, "_id": key, "found": True, **{k: row[k] for k in ("_version", "_seq_no") if k in row}, "_source": source}

    def r_create(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        return self.r_doc("PUT", index, rest, body, {**params, "op_type": "create"})

    def r_source(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        status, out = self.r_doc("GET", index, rest, body, params)
        return status, out.get("_source") if status == 200 else out

    def r_update(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        there = not sources.get(self.engine, index, rest[0]).isEmpty()
        if there:
            self._write([("update", index, rest[0], json.dumps({"doc": body["doc"]}))])
        else:
            doc = body.get("doc") if body.get("doc_as_upsert") else body.get("upsert")
            if doc is None:
                raise ApiError(404, "document_missing_exception", f"[{rest[0]}]: document missing")
            self._write([("index", index, rest[0], json.dumps(doc))])
        return (200 if there else 201), {"_index": index, "_id": rest[0], "result": "updated" if there else "created"}

    def r_mget(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        asked = [(d.get("_index", index), d["_id"]) for d in body.get("docs", [])] + [(index, i) for i in body.get("ids", [])]
        out = []
        for r in sources.mget(self.engine, asked).collect():
            own = {f.name for f in self.engine.index(r["_index"]).df.schema.fields if not f.name.startswith("_cv_")} - META
            doc = {"_index": r["_index"], "_id": r["_id"], "found": r["found"]}
            out.append(doc | ({"_source": {k: render.value(v) for k, v in r.asDict().items() if k in own and v is not None}} if r["found"] else {}))
        return 200, {"docs": out}

    def r_reindex(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        src, dest = body["source"], body["dest"]
        if "script" in body or "remote" in src:
            raise ValueError("reindex with a script or from a remote cluster is not supported")
        n = self.engine.count(src["index"], src.get("query"))
        fields = src.get("_source")
        sources.reindex(self.engine, src["index"], dest["index"], src.get("query"), [fields] if isinstance(fields, str) else fields, body.get("max_docs"), dest.get("op_type", "index"))
        return 200, {"total": min(n, body.get("max_docs", n)), "failures": []}

    def r_delete_by_query(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        if "query" not in body:
            raise ApiError(400, "action_request_validation_exception", "query is missing")
        n = sources.delete_by_query(self.engine, index, body["query"], body.get("max_docs"))
        return 200, {"deleted": n, "total": n, "failures": []}

    def r_update_by_query(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        if "script" in body:
            raise ValueError("update by query with a script is not supported")
        n = self.engine.count(index, body.get("query"))
        return 200, {"updated": n, "total": n, "failures": []}

    # -- search

    def r_search(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        body = dict(body)
        body |= {k: int(params[k]) for k in ("size", "from") if k in params}
        if "q" in params:
            body["query"] = {"query_string": {"query": params["q"], **({"default_field": params["df"]} if "df" in params else {})}}
        if "sort" in params:
            body["sort"] = [dict([s.split(":")]) if ":" in s else s for s in params["sort"].split(",")]
        if "scroll" in params:
            key = self.engine.scroll(index or "_all", body)
            return 200, self._page(key)
        return 200, render.response(self.engine.search(index or "_all", body), body)

    def _page(self, key: str) -> dict:
        s: Scroll = self.engine.scrolls[key]
        rows = []
        for r in s.next():
            told = r.asDict()
            rows.append({"_index": told.pop("_index"), "_id": str(told.pop("_id")), "_score": told.pop("_score", None), "_source": {k: render.value(v) for k, v in told.items() if v is not None}})
        return {"_scroll_id": key, "hits": {"total": {"value": s.search.base.count(), "relation": "eq"}, "hits": rows}}

    def r_scroll(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        key = body.get("scroll_id") or params.get("scroll_id") or (rest[1] if len(rest) > 1 else None)
        if method == "DELETE":
            keys = key if isinstance(key, list) else [key]
            return 200, {"succeeded": True, "num_freed": sum(self.engine.scrolls.pop(k, None) is not None for k in keys)}
        if key not in self.engine.scrolls:
            raise ApiError(404, "search_context_missing_exception", f"No search context found for id [{key}]")
        return 200, self._page(key)

    def r_point(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        if method == "POST":
            return 200, {"pit_id": self.engine.open_point(index)}
        if method == "GET":
            return 200, {"pits": [{"pit_id": k} for k in self.engine.points]}
        keys = list(self.engine.points) if len(rest) > 1 and rest[1] == "_all" else body.get("pit_id", [])
        return 200, {"pits": [{"pit_id": k, "successful": self.engine.close_point(k)} for k in ([keys] if isinstance(keys, str) else keys)]}

    def r_count(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        return 200, {"count": self.engine.count(index or "_all", body.get("query"))}

    def r_msearch(self, method: str, index: str | None, rest: list[str], body: object, params: dict) -> tuple[int, object]:
        lines = [json.loads(x) for x in body.split("\n") if x.strip()] if isinstance(body, str) else list(body)
        out = []
        for head, query in zip(lines[::2], lines[1::2], strict=True):
            status, got = self.request("POST", f"/{head.get('index', index or '_all')}/_search", query)
            out.append({**got, "status": status})
        return 200, {"responses": out}

    def r_explain(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        row = self.engine.explain(index, rest[0], body["query"]).first()
        if row is None:
            return 404, {"_index": index, "_id": rest[0], "matched": False}
        return 200, {"_index": index, "_id": rest[0], "matched": row["matched"], "explanation": {"value": row["value"], "details": render.value(row["details"])}}

    def r_validate(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        ok, why = self.engine.validate(index or "_all", body.get("query", {"match_all": {}}))
        return 200, {"valid": ok, **({"error": why} if why else {})}

    def r_field_caps(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        asked = body.get("fields", params.get("fields", "*"))
        out: dict = {}
        for r in self.engine.field_caps(index or "_all", ",".join(asked) if isinstance(asked, list) else asked).collect():
            out.setdefault(r["field"], {})[r["type"]] = {"type": r["type"], "searchable": r["searchable"], "aggregatable": r["aggregatable"]}
        return 200, {"indices": [ix.name for ix, _ in self.engine.resolve(index or "_all")], "fields": out}

    def r_termvectors(self, method: str, index: str, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        ix = self.engine.index(index)
        fields = body.get("fields") or [n for n, f in ix.mapping.fields.items() if f.type == "text"]
        stats = bool(body.get("term_statistics"))
        out: dict = {}
        for r in self.engine.termvectors(index, rest[0], fields, stats).collect():
            term = {"term_freq": r["term_freq"], "tokens": [{"position": p} for p in r["positions"]]}
            out.setdefault(r["field"], {"terms": {}})["terms"][r["term"]] = term | ({"doc_freq": r["doc_freq"], "ttf": r["ttf"]} if stats else {})
        return 200, {"_index": index, "_id": rest[0], "found": bool(out), "term_vectors": out}

    def r_mtermvectors(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        return 200, {"docs": [self.r_termvectors("GET", d.get("_index", index), [d["_id"]], d, params)[1] for d in body["docs"]]}

    def r_analyze(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        texts = body["text"] if isinstance(body["text"], list) else [body["text"]]
        ix = self.engine.index(index) if index else None
        f = ix.mapping.get(body["field"]) if ix and "field" in body else None
        if "tokenizer" in body or "filter" in body:
            how: object = {"tokenizer": body.get("tokenizer", "keyword"), "filter": body.get("filter", []), "char_filter": body.get("char_filter", [])}
        else:
            how = body.get("analyzer") or (f.analyzer if f else "standard")
        df: DataFrame = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        rows = df.select("i", F.posexplode(analyze(F.col("t"), how, ix.mapping.settings if ix else None)).alias("position", "token")).orderBy("i", "position").collect()
        return 200, {"tokens": [{"token": r["token"], "position": r["position"]} for r in rows]}

    def r_search_shards(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        return 200, {"indices": {ix.name: {} for ix, _ in self.engine.resolve(index or "_all")}, "shards": [{"index": ix.name, "partitions": ix.df.rdd.getNumPartitions()} for ix, _ in self.engine.resolve(index or "_all")]}

    def r_resolve(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        found = self.engine.resolve(rest[1])
        return 200, {"indices": [{"name": ix.name} for ix, _ in found], "aliases": [{"name": a, "indices": sorted(t)} for a, t in self.engine.aliases.items() if set(t) & {ix.name for ix, _ in found}]}

    def r_cat(self, method: str, index: str | None, rest: list[str], body: dict, params: dict) -> tuple[int, object]:
        if rest and rest[0] == "count":
            return 200, [{"count": str(self.engine.count(rest[1] if len(rest) > 1 else "_all"))}]
        if rest and rest[0] == "aliases":
            return 200, [{"alias": a, "index": i, "filter": "*" if q else "-"} for a, t in self.engine.aliases.items() for i, q in t.items()]
        return 200, [{"index": n, "health": "green", "status": "open", "docs.count": str(Search(self.engine, n, {}).base.count())} for n in self.engine.indices]
