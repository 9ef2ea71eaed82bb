"""Sources, mappings, suggesters and streams on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions.analysis import analyze
from corvane.operators.suggest import completion_suggest, phrase_suggest, term_suggest
from corvane.plans.mapping import coerce
from corvane.plans.query import Compiler
from corvane.plans.search import Engine
from corvane.sources import documents as sources
from corvane.streaming import windows


def test_bulk_file(spark, tmp_path):
    lines = [{"index": {"_id": "1"}}, {"a": "x", "n": 1}, {"create": {"_id": "1"}}, {"a": "y"}, {"update": {"_id": "1"}}, {"doc": {"n": 5}}, {"delete": {"_id": "9"}}, {"index": {"_id": "2"}}, {"a": "z", "n": 2}, {"delete": {"_id": "2"}}, {"index": {"_id": "3"}}, {"index": "looks like an action", "a": "w"}]
    (tmp_path / "b.ndjson").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    actions = sources.read_bulk(spark, f"file://{tmp_path}/b.ndjson")
    assert [r["op"] for r in actions.orderBy("n").collect()] == ["index", "create", "update", "delete", "index", "delete", "index"]
    e = Engine(spark)
    ix, results = sources.apply_bulk(e, actions, "t", "a string, n int")
    assert [r["status"] for r in results.orderBy("n").collect()] == [201, 409, 200, 404, 201, 200, 201]
    assert {(r["_id"], r["a"]) for r in ix.df.collect()} >= {("3", "w")} and "2" not in {r["_id"] for r in ix.df.collect()}


def test_writes_keep_older_points(spark):
    e = Engine(spark)
    e.create("t", spark.createDataFrame([("1", 1), ("2", 2)], "_id string, n int"))
    before = e.clone()
    sources.upsert(e, "t", spark.createDataFrame([("2", 20), ("3", 3)], "_id string, n int"))
    sources.update(e, "t", "1", {"n": 10})
    assert sources.delete_by_query(e, "t", {"term": {"n": 3}}) == 1
    assert sorted(tuple(r) for r in e.index("t").df.collect()) == [("1", 10), ("2", 20)]
    assert sorted(tuple(r) for r in before.index("t").df.collect()) == [("1", 1), ("2", 2)]
    with pytest.raises(KeyError):
        sources.update(e, "t", "7", {"n": 1})
    sources.compact(e, "t")
    assert e.count("t") == 2


def test_seed_folder(spark, tmp_path):
    (tmp_path / "p.index.json").write_text(json.dumps({"mappings": {"properties": {"name": {"type": "text"}, "price": {"type": "double"}}}}))
    (tmp_path / "p.ndjson").write_text('{"name": "A Lamp", "price": "3.5"}\n{"name": "B Tent", "price": 9}\n')
    (tmp_path / "aliases.json").write_text(json.dumps({"cheap": [{"index": "p", "filter": {"range": {"price": {"lt": 5}}}}]}))
    e = Engine(spark)
    assert sources.load_seed(e, str(tmp_path)) == ["p"]
    assert e.count("cheap") == 1 and e.count("p", {"match": {"name": "tent"}}) == 1


def test_coercion(spark):
    rows = spark.createDataFrame([("1", "12", "x", "2024-01-02"), ("2", "7.9", "true", "never"), ("3", None, "false", None)], "_id string, n string, b string, d string")
    props = {"n": {"type": "integer", "copy_to": "all"}, "b": {"type": "boolean", "copy_to": "all"}, "d": {"type": "date"}}
    got = {r["_id"]: r for r in coerce(rows, props).collect()}
    assert [got[i]["n"] for i in "123"] == [12, 7, None] and [got[i]["b"] for i in "123"] == [None, True, False]
    assert got["1"]["_ignored"] == ["b"] and got["2"]["_ignored"] == ["d"] and got["1"]["all"] == ["12"] or got["1"]["all"]


def test_field_parameters(spark):
    df = spark.createDataFrame([("1", "Straße", "aaaa", None, 2.346), ("2", "STRASSE", "aa", 4, 1.0)], "_id string, k string, s string, n int, f double")
    e = Engine(spark)
    e.create("t", df, {"k": {"type": "keyword", "normalizer": "lowercase"}, "s": {"type": "keyword", "ignore_above": 3}, "n": {"type": "integer", "null_value": 9}, "f": {"type": "scaled_float", "scaling_factor": 100}, "also": {"type": "alias", "path": "n"}})
    count = lambda q: e.count("t", q)
    assert count({"term": {"k": "strasse"}}) == 1 and count({"exists": {"field": "s"}}) == 1 and count({"term": {"n": 9}}) == 1
    assert count({"term": {"f": 2.35}}) == 1 and count({"range": {"also": {"gte": 5}}}) == 1


@pytest.mark.parametrize(
    ("how", "text", "want"),
    [
        ({"tokenizer": "standard", "filter": ["lowercase", "porter_stem"]}, "Running runners ran", "run runner ran"),
        ("english", "The foxes are jumping", "fox jump"),
        ({"tokenizer": "whitespace", "filter": ["word_delimiter"]}, "PowerShot2000 Wi-Fi", "Power Shot 2000 Wi Fi"),
        ({"tokenizer": "whitespace", "filter": [{"type": "elision"}]}, "l'avion qu'il", "avion il"),
        ({"tokenizer": "keyword", "filter": [{"type": "pattern_capture", "patterns": [r"(\d+)", "([a-z]+)"]}]}, "ab12", "ab12 12 ab"),
        ({"tokenizer": "standard", "filter": ["cjk_bigram"]}, "東京都 x", "東京 京都 x"),
        ({"tokenizer": "whitespace", "filter": [{"type": "common_grams", "common_words": ["the"]}]}, "the fox", "the the_fox fox"),
        ({"tokenizer": "whitespace", "filter": [{"type": "multiplexer", "filters": ["lowercase", "reverse"]}]}, "Ab", "Ab ab bA"),
        ({"tokenizer": "uax_url_email"}, "mail a@b.com or https://x.y/z?q=1", "mail a@b.com or https://x.y/z?q=1"),
        ({"tokenizer": {"type": "pattern", "pattern": ","}, "filter": ["trim"]}, "a, b,c", "a b c"),
        ({"char_filter": [{"type": "mapping", "mappings": [":) => happy"]}, "html_strip"], "tokenizer": "letter"}, "<b>I am</b> :)", "I am happy"),
        ({"tokenizer": "whitespace", "filter": [{"type": "limit", "max_token_count": 2}, "keyword_repeat"]}, "a b c", "a a b b"),
        ({"tokenizer": "whitespace", "filter": [{"type": "delimited_payload"}, "decimal_digit"]}, "a|1 ٣", "a 3"),
        ({"tokenizer": "whitespace", "filter": [{"type": "dictionary_decompounder", "word_list": ["foot", "ball"]}]}, "football", "football foot ball"),
        ({"tokenizer": "standard", "filter": ["lowercase", "german_normalization"]}, "Größe Straße", "grosse strasse"),
        ("fingerprint", "Zebra alpha é Alpha", "alpha e zebra"),
    ],
)
def test_analysis(spark, how, text, want):
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(analyze(F.col("t"), how).alias("x")).collect()
    assert " ".join(got[0]["x"]) == want and not got[2]["x"]


def test_suggesters(spark):
    e = Engine(spark)
    rows = [(str(i), t) for i, t in enumerate(["noble prize winner", "nobel prize", "the nobel prize in physics", "nobel price list", "prime list"])]
    ix = e.create("t", spark.createDataFrame(rows, "_id string, body string"), {"body": {"type": "text"}})
    got = [r["suggestion"] for r in term_suggest(ix, "nobl prise", {"field": "body"}).collect()]
    assert got[0] in ("nobel", "noble") and {"prize", "price"} <= set(got)
    assert phrase_suggest(ix, "nobl prize", {"field": "body"})[0][0] == "nobel prize"
    df = spark.createDataFrame([("1", (["Nirvana", "Nevermind"], 34)), ("2", (["Nine"], 50)), ("3", (["Abba"], 99))], "_id string, s struct<input:array<string>,weight:long>")
    assert [r["text"] for r in completion_suggest(df, "ni", {"field": "s"}).collect()] == ["Nine", "Nirvana"]
    assert [r["text"] for r in completion_suggest(df, "nirvona", {"field": "s", "fuzzy": {"fuzziness": 1}}).collect()] == ["Nirvana"]


def test_stream_of_windows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 {i % 24:02d}:30:00", "a" if i % 2 else "b", float(i)) for i in range(48)], "id int, at string, kind string, v double").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"file://{tmp_path}/s")
    stream = windows.open_stream(spark, f"file://{tmp_path}/s", "id int, at timestamp, kind string, v double")
    out = windows.windowed(windows.matching(stream, {"term": {"kind": "a"}}), "at", "6 hours", {"s": F.sum("v")})
    got = windows.run_once(out, f"file://{tmp_path}/out", f"file://{tmp_path}/c", "complete").orderBy("window_start").collect()
    assert [r["doc_count"] for r in got] == [6, 6, 6, 6] and sum(r["s"] for r in got) == sum(i for i in range(48) if i % 2)


def test_comparisons_reach_the_scan(spark, capsys):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    e = Engine(spark)
    ix = e.create("o", df, id_col="o_orderkey")
    m = Compiler(ix.df, ix.mapping, e, id_col=ix.id_col).compile({"bool": {"filter": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gte": 5}}}, {"ids": {"values": ["1", "2"]}}]}})
    ix.df.where(m.hit).select("o_custkey").explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_totalprice,5.0)", "In(o_orderkey"))
    assert "o_orderdate" not in plan
