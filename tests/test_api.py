"""Requests end to end, on a handful of documents."""

from __future__ import annotations

import json

import pytest

from corvane.plans.rest import Client

PRODUCTS = [
    {"name": "Red Running Shoes", "sku": "A-1", "price": 59.9, "stock": 12, "tags": ["shoes", "sport"], "created": "2024-01-05", "active": True, "location": {"lat": 35.68, "lon": 139.76}, "vendor": {"name": "acme", "rating": 4.5}, "note": "light shoes for road running"},
    {"name": "Blue Running Shirt", "sku": "B-2", "price": 19.5, "stock": 0, "tags": ["shirt", "sport"], "created": "2024-02-10", "active": True, "location": {"lat": 34.69, "lon": 135.5}, "vendor": {"name": "acme", "rating": 4.5}, "note": "a shirt that runs cool"},
    {"name": "Green Tent", "sku": "C-3", "price": 199.0, "stock": 3, "tags": ["camping"], "created": "2024-02-20", "active": False, "location": {"lat": 43.06, "lon": 141.35}, "vendor": {"name": "peak", "rating": 3.9}, "note": "tent for two people"},
    {"name": "Camping Lamp", "sku": "D-4", "price": 25.0, "stock": 40, "tags": ["camping", "light"], "created": "2024-03-01", "active": True, "vendor": {"name": "peak", "rating": 3.9}, "note": "lamp for the tent"},
    {"name": "Trail Shoes", "sku": "E-5", "price": 89.0, "tags": ["shoes"], "created": "2024-03-15", "active": False, "vendor": {"name": "zeta", "rating": 4.9}, "note": "shoes for the trail, not for the road"},
]
PROPS = {
    "name": {"type": "text", "fields": {"keyword": {"type": "keyword"}}}, "sku": {"type": "keyword"}, "price": {"type": "double"}, "stock": {"type": "integer"}, "created": {"type": "date"},
    "active": {"type": "boolean"}, "location": {"type": "geo_point"}, "note": {"type": "text"}, "tags": {"type": "keyword"},
}


@pytest.fixture(scope="module")
def client(spark):
    c = Client(spark)
    kinds = "_id string, name string, sku string, price double, stock int, tags array<string>, created timestamp_ntz, active boolean, location struct<lat:double,lon:double>, vendor struct<name:string,rating:double>, note string"
    lines = spark.createDataFrame([(json.dumps({"_id": str(i + 1), **p}),) for i, p in enumerate(PRODUCTS)], "v string")
    from pyspark.sql import functions as F

    c.engine.create("products", lines.select(F.from_json("v", kinds).alias("d")).select("d.*"), PROPS)
    return c


def ids(client, query, **more):
    status, out = client.request("POST", "/products/_search", {"query": query, "size": 20, **more})
    assert status == 200, out
    return [h["_id"] for h in out["hits"]["hits"]]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"match_all": {}}, "12345"),
        ({"term": {"sku": "A-1"}}, "1"),
        ({"term": {"tags": "camping"}}, "34"),
        ({"term": {"stock": 12.5}}, ""),
        ({"terms": {"sku": ["A-1", "E-5"]}}, "15"),
        ({"range": {"price": {"gte": 25, "lt": 89}}}, "14"),
        ({"range": {"stock": {"gt": 0.5}}}, "134"),
        ({"range": {"created": {"gte": "2024-02-01", "lte": "2024-02"}}}, "23"),
        ({"range": {"created": {"gt": "2024-02-10||/M"}}}, "45"),
        ({"exists": {"field": "stock"}}, "1234"),
        ({"bool": {"must_not": {"exists": {"field": "location"}}}}, "45"),
        ({"bool": {"must_not": {"range": {"stock": {"gt": 1}}}}}, "25"),
        ({"prefix": {"name": "run"}}, "12"),
        ({"wildcard": {"name.keyword": "*Shoes"}}, "15"),
        ({"regexp": {"sku": "[A-C]-<1-2>"}}, "12"),
        ({"regexp": {"sku": "~(A-1)&.*"}}, "2345"),
        ({"fuzzy": {"name": "shoez"}}, "15"),
        ({"fuzzy": {"name": {"value": "hsoes", "fuzziness": 1}}}, "15"),
        ({"match": {"name": {"query": "running shoes", "operator": "and"}}}, "1"),
        ({"match": {"name": "tent lamp"}}, "34"),
        ({"match_phrase": {"note": "the road"}}, "5"),
        ({"match_phrase": {"note": {"query": "shoes road", "slop": 2}}}, "1"),
        ({"match_phrase_prefix": {"note": "for the t"}}, "45"),
        ({"match_bool_prefix": {"name": "camping la"}}, "4"),
        ({"multi_match": {"query": "tent", "fields": ["name", "note"]}}, "34"),
        ({"query_string": {"query": "name:(shoes OR tent) AND NOT price:>100"}}, "15"),
        ({"query_string": {"query": "note:\"for the\"~1 -trail", "default_field": "note"}}, "4"),
        ({"simple_query_string": {"query": "shoes -trail", "fields": ["name"], "default_operator": "and"}}, "1"),
        ({"intervals": {"note": {"all_of": {"ordered": True, "max_gaps": 1, "intervals": [{"match": {"query": "for"}}, {"match": {"query": "tent"}}]}}}}, "4"),
        ({"intervals": {"note": {"match": {"query": "shoes", "filter": {"before": {"match": {"query": "trail"}}}}}}}, "5"),
        ({"span_near": {"clauses": [{"span_term": {"note": "tent"}}, {"span_term": {"note": "for"}}], "slop": 3, "in_order": False}}, "34"),
        ({"geo_distance": {"distance": "450km", "location": {"lat": 35.0, "lon": 137.0}}}, "12"),
        ({"nested": {"path": "missing", "query": {"match_all": {}}, "ignore_unmapped": True}}, ""),
        ({"script": {"script": {"source": "doc['price'].value / 2 > params.x || doc['stock'].value == 0", "params": {"x": 40}}}}, "235"),
        ({"terms_set": {"tags": {"terms": ["shoes", "sport", "camping"], "minimum_should_match_field": "stock"}}}, "2"),
        ({"term": {"vendor.name": "peak"}}, "34"),
        ({"wrapper": {"query": "eyJ0ZXJtIjogeyJza3UiOiAiQi0yIn19"}}, "2"),
        ({"bool": {"should": [{"term": {"tags": "sport"}}, {"term": {"active": True}}, {"range": {"price": {"gt": 50}}}], "minimum_should_match": 2}}, "12"),
    ],
)
def test_queries(client, query, want):
    assert ids(client, query, sort=["_id"]) == list(want)


def test_page_sort_and_missing(client):
    assert ids(client, None, sort=[{"stock": {"order": "asc"}}]) == ["2", "3", "1", "4", "5"]
    assert ids(client, None, sort=[{"stock": {"order": "asc", "missing": "_first"}}]) == ["5", "2", "3", "1", "4"]
    assert ids(client, None, sort=[{"stock": {"order": "desc", "missing": 7}}]) == ["4", "1", "5", "3", "2"]
    status, out = client.request("POST", "/products/_search", {"sort": [{"price": "desc"}], "from": 1, "size": 2, "_source": ["name", "vendor.*"]})
    assert [h["_id"] for h in out["hits"]["hits"]] == ["5", "1"] and set(out["hits"]["hits"][0]["_source"]) == {"name", "vendor"}
    assert out["hits"]["total"] == {"value": 5, "relation": "eq"}
    assert client.request("POST", "/products/_search", {"from": 9999, "size": 10})[0] == 400


def test_scores(client):
    status, out = client.request("POST", "/products/_search", {"query": {"match": {"note": "tent"}}})
    assert [h["_id"] for h in out["hits"]["hits"]] in (["3", "4"], ["4", "3"]) and out["hits"]["max_score"] > 0
    status, out = client.request("POST", "/products/_search", {"query": {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "stock", "missing": 1}, "boost_mode": "replace"}}, "size": 2})
    assert [(h["_id"], h["_score"]) for h in out["hits"]["hits"]] == [("4", 40.0), ("1", 12.0)]


def test_aggregations_nest(client):
    body = {
        "size": 0,
        "aggs": {
            "tags": {"terms": {"field": "tags", "size": 3}, "aggs": {"p": {"avg": {"field": "price"}}, "by": {"terms": {"field": "vendor.name"}, "aggs": {"m": {"max": {"field": "price"}}}}, "active": {"filter": {"term": {"active": True}}, "aggs": {"n": {"value_count": {"field": "sku"}}}}}},
            "months": {"date_histogram": {"field": "created", "calendar_interval": "month", "format": "yyyy-MM"}, "aggs": {"s": {"sum": {"field": "price"}}, "c": {"cumulative_sum": {"buckets_path": "s"}}}},
            "best": {"max_bucket": {"buckets_path": "months>s"}},
            "all": {"stats": {"field": "price"}},
            "kinds": {"cardinality": {"field": "tags"}},
            "by_vendor": {"terms": {"field": "vendor.name"}, "aggs": {"kinds": {"cardinality": {"field": "tags"}}, "half": {"percentiles": {"field": "price", "percents": [50], "tdigest": {"compression": 200}}}}},
            "r": {"range": {"field": "price", "ranges": [{"to": 50}, {"from": 50}]}},
            "f": {"filters": {"filters": {"cheap": {"range": {"price": {"lt": 30}}}, "none": {"match_none": {}}}}},
            "top": {"terms": {"field": "active"}, "aggs": {"t": {"top_hits": {"size": 1, "sort": [{"price": "desc"}], "_source": ["name"]}}}},
        },
    }
    status, out = client.request("POST", "/products/_search", body)
    assert status == 200, out
    a = out["aggregations"]
    assert [(b["key"], b["doc_count"]) for b in a["tags"]["buckets"]] == [("camping", 2), ("shoes", 2), ("sport", 2)]
    assert [(b["key"], b["m"]["value"]) for b in a["tags"]["buckets"][1]["by"]["buckets"]] == [("acme", 59.9), ("zeta", 89.0)]
    assert a["tags"]["buckets"][0]["active"] == {"doc_count": 1, "n": {"value": 1}}
    assert [(b["key_as_string"], b["doc_count"], round(b["c"]["value"], 2)) for b in a["months"]["buckets"]] == [("2024-01", 1, 59.9), ("2024-02", 2, 278.4), ("2024-03", 2, 392.4)]
    assert a["kinds"] == {"value": 5}
    assert [(b["key"], b["kinds"]["value"], b["half"]["values"]["50.0"]) for b in a["by_vendor"]["buckets"]] == [("acme", 3, 19.5), ("peak", 2, 25.0), ("zeta", 1, 89.0)]
    assert a["best"]["value"] == 218.5 and a["all"]["count"] == 5
    assert [(b["key"], b["doc_count"]) for b in a["r"]["buckets"]] == [("*-50.0", 2), ("50.0-*", 3)]
    assert a["f"]["buckets"] == {"cheap": {"doc_count": 2}, "none": {"doc_count": 0}}
    assert a["top"]["buckets"][0]["key_as_string"] == "true" and a["top"]["buckets"][0]["t"]["hits"]["hits"][0]["_source"] == {"name": "Red Running Shoes"}


def test_writes(spark):
    c = Client(spark)
    assert c.request("PUT", "/books", {"mappings": {"properties": {"title": {"type": "text"}, "year": {"type": "integer"}}}})[0] == 200
    assert c.request("PUT", "/books", {})[0] == 400
    assert c.request("PUT", "/books/_doc/1", {"title": "The Old Sea", "year": 1952})[0] == 201
    assert c.request("PUT", "/books/_create/1", {"title": "x"})[0] == 409
    assert c.request("POST", "/books/_update/1", {"doc": {"year": 1953}})[0] == 200
    assert c.request("GET", "/books/_doc/1")[1]["_source"] == {"title": "The Old Sea", "year": 1953}
    got = c.request("GET", "/books/_doc/1")[1]
    assert got["_version"] == 2
    assert c.request("PUT", "/books/_doc/1", {"title": "x"}, {"if_seq_no": got["_seq_no"] + 1})[0] == 409
    status, out = c.request("PUT", "/books/_doc/1", {"title": "The Old Sea", "year": 1953}, {"if_seq_no": got["_seq_no"]})
    assert (status, out["result"], out["_version"]) == (200, "updated", 3)
    assert c.request("POST", "/books/_search", {"version": True})[1]["hits"]["hits"][0]["_version"] == 3
    assert c.request("GET", "/books/_doc/9")[0] == 404
    lines = [{"index": {"_id": "2"}}, {"title": "A New Sea", "year": 1960, "pages": 90}, {"delete": {"_id": "7"}}, {"create": {"_id": "3"}}, {"title": "Land", "year": 1970}]
    status, out = c.request("POST", "/books/_bulk", "\n".join(json.dumps(x) for x in lines) + "\n")
    assert [next(iter(x.values()))["status"] for x in out["items"]] == [201, 404, 201] and out["errors"]
    assert c.request("POST", "/books/_count", {"query": {"match": {"title": "sea"}}})[1] == {"count": 2}
    assert c.request("POST", "/_reindex", {"source": {"index": "books", "query": {"range": {"year": {"gte": 1960}}}}, "dest": {"index": "late"}})[0] == 200
    assert c.request("GET", "/late/_count")[1] == {"count": 2}
    assert c.request("POST", "/books/_delete_by_query", {"query": {"term": {"year": 1970}}})[1]["deleted"] == 1
    assert c.request("GET", "/books,late/_count")[1] == {"count": 4}
    assert c.request("POST", "/_aliases", {"actions": [{"add": {"index": "late", "alias": "sea", "filter": {"match": {"title": "sea"}}}}]})[0] == 200
    assert c.request("GET", "/sea/_count")[1] == {"count": 1}
    assert [d["found"] for d in c.request("POST", "/_mget", {"docs": [{"_index": "late", "_id": "3"}, {"_index": "books", "_id": "3"}]})[1]["docs"]] == [True, False]
    assert c.request("DELETE", "/late")[0] == 200 and c.request("GET", "/late/_search")[0] == 404


def test_scroll_and_point_in_time(client):
    status, out = client.request("POST", "/products/_search", {"size": 2, "sort": [{"stock": "desc"}]}, {"scroll": "1m"})
    seen = [h["_id"] for h in out["hits"]["hits"]]
    while True:
        status, out = client.request("POST", "/_search/scroll", {"scroll_id": out["_scroll_id"]})
        if not out["hits"]["hits"]:
            break
        seen += [h["_id"] for h in out["hits"]["hits"]]
    assert seen == ["4", "1", "3", "2", "5"]
    pit = client.request("POST", "/products/_search/point_in_time")[1]["pit_id"]
    assert client.request("POST", "/_search", {"pit": {"id": pit}, "query": {"ids": {"values": ["1"]}}})[1]["hits"]["total"]["value"] == 1
    assert client.request("DELETE", "/_search/point_in_time", {"pit_id": [pit]})[1]["pits"][0]["successful"]


def test_other_requests(client):
    assert client.request("GET", "/products/_analyze", {"text": "Old Sea-Shoes", "analyzer": "standard"})[1] == {"tokens": [{"token": "old", "position": 0}, {"token": "sea", "position": 1}, {"token": "shoes", "position": 2}]}
    assert client.request("POST", "/products/_validate/query", {"query": {"nonsense": {}}})[1]["valid"] is False
    assert client.request("POST", "/products/_search", {"query": {"knn": {}}})[0] == 400
    assert client.request("GET", "/products/_explain/1", {"query": {"term": {"sku": "A-1"}}})[1]["matched"] is True
    assert client.request("GET", "/products/_field_caps", None, {"fields": "na*"})[1]["fields"]["name"]["text"]["aggregatable"] is False
    out = client.request("POST", "/products/_search", {"query": {"match": {"name": "shoes"}}, "highlight": {"fields": {"name": {}}}, "sort": ["_id"]}, {"filter_path": "hits.hits.highlight"})[1]
    assert out == {"hits": {"hits": [{"highlight": {"name": ["Red Running <em>Shoes</em>"]}}, {"highlight": {"name": ["Trail <em>Shoes</em>"]}}]}}
    out = client.request("POST", "/products/_search", {"size": 0, "suggest": {"s": {"text": "shooes", "term": {"field": "name"}}}})[1]
    assert out["suggest"]["s"][0]["options"][0]["text"] == "shoes"
    assert client.request("POST", "/_msearch", [{"index": "products"}, {"size": 0}, {"index": "gone"}, {}])[1]["responses"][1]["status"] == 404


def test_templates(spark):
    c = Client(spark)
    assert c.request("PUT", "/_component_template/base", {"template": {"mappings": {"properties": {"at": {"type": "date"}}}}})[0] == 200
    assert c.request("PUT", "/_index_template/logs", {"index_patterns": ["logs-*"], "priority": 5, "composed_of": ["base"], "template": {"mappings": {"properties": {"line": {"type": "text"}}}, "aliases": {"all-logs": {}}}})[0] == 200
    assert c.request("PUT", "/_index_template/any", {"index_patterns": ["*"], "template": {"mappings": {"properties": {"line": {"type": "keyword"}}}}})[0] == 200
    assert c.request("PUT", "/logs-1/_doc/1", {"at": "2024-01-02", "line": "Disk full"})[0] == 201
    assert c.request("GET", "/all-logs/_count")[1] == {"count": 1}
    assert c.request("POST", "/logs-1/_search", {"query": {"bool": {"must": [{"match": {"line": "disk"}}, {"range": {"at": {"gte": "2024-01-01"}}}]}}})[1]["hits"]["total"]["value"] == 1
    assert set(c.request("POST", "/_index_template/_simulate_index/logs-9")[1]["template"]["mappings"]["properties"]) == {"at", "line"}
    assert c.request("DELETE", "/_index_template/logs")[0] == 200 and c.request("HEAD", "/_index_template/logs")[0] == 404
