"""Bounds of requests: buckets of gaps, expansions of terms, types told by all rows, folders of a cluster."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.plans import registry
from corvane.plans.mapping import dynamic_properties
from corvane.plans.search import Engine
from corvane.sources import documents as sources


@pytest.fixture(scope="module")
def words(spark):
    e = Engine(spark)
    rows = [(i, t) for i, t in enumerate(["cart race", "card game", "care home", "case study", "cat nap", "acrt swap", "bat cave", None])]
    e.create("w", spark.createDataFrame(rows, "k int, t string"), {"t": {"type": "text"}}, id_col="k")
    return e


def found(e, query):
    return sorted(r["k"] for r in e.search("w", {"query": query, "size": 0}).matched.select("k").collect())


@pytest.mark.parametrize("aggs", [{"histogram": {"field": "v", "interval": 1}}, {"date_histogram": {"field": "at", "fixed_interval": "1s"}}, {"date_histogram": {"field": "at", "calendar_interval": "minute"}}])
def test_too_many_gaps_are_an_error(spark, aggs):
    e = Engine(spark)
    e.create("n", spark.createDataFrame([(0, 0.0, "1970-01-01"), (1, 1e9, "2001-09-09")], "k int, v double, at string").selectExpr("k", "v", "cast(at as timestamp_ntz) as at"), id_col="k")
    start = time.perf_counter()
    with pytest.raises(Exception, match="Trying to create too many buckets"):
        e.search("n", {"size": 0, "aggs": {"h": aggs}}).aggregations["h"].collect()
    assert time.perf_counter() - start < 30
    wide = e.search("n", {"size": 0, "aggs": {"h": {"histogram": {"field": "v", "interval": 1e5}}}}).aggregations["h"]
    assert wide.count() == 10_001


def test_expansions_are_the_nearest_terms(words):
    assert found(words, {"fuzzy": {"t": {"value": "cart", "fuzziness": 1}}}) == [0, 1, 2, 4, 5]
    assert found(words, {"fuzzy": {"t": {"value": "cart", "fuzziness": 1, "max_expansions": 1}}}) == [0]
    assert found(words, {"fuzzy": {"t": {"value": "cart", "fuzziness": 1, "max_expansions": 3}}}) == [0, 1, 5]
    assert found(words, {"fuzzy": {"t": {"value": "cart", "fuzziness": 1, "transpositions": False}}}) == [0, 1, 2, 4]
    assert found(words, {"match": {"t": {"query": "cart", "fuzziness": 1, "max_expansions": 2}}}) == [0, 5]
    with pytest.raises(ValueError, match="must be positive"):
        found(words, {"fuzzy": {"t": {"value": "cart", "max_expansions": 0}}})


def test_prefixes_take_the_first_terms(words):
    assert found(words, {"match_phrase_prefix": {"t": "ca"}}) == [0, 1, 2, 3, 4, 6]
    assert found(words, {"match_phrase_prefix": {"t": {"query": "ca", "max_expansions": 2}}}) == [1, 2]
    assert found(words, {"match_phrase_prefix": {"t": {"query": "bat ca", "max_expansions": 5}}}) == []
    assert found(words, {"match_phrase_prefix": {"t": {"query": "bat ca", "max_expansions": 6}}}) == [6]
    assert found(words, {"match_phrase_prefix": {"t": {"query": "bat zz"}}}) == []


def test_types_are_told_by_all_rows(spark):
    df = spark.range(5000).selectExpr("id", "case when id = 4999 then 'later' else '2024-01-01' end as a", "'2024-01-01' as b", "cast(null as string) as c").repartition(1)
    got = dynamic_properties(df)
    assert got["a"]["type"] == "text" and got["b"]["type"] == "date" and got["c"]["type"] == "text"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sources.shared_folder(Session())
    assert sources.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_tokens_are_stored_once(spark, capsys):
    e = Engine(spark)
    rows = [(i, t) for i, t in enumerate(["the quick fox", "a slow fox", None, "the end"])]
    e.create("w", spark.createDataFrame(rows, "k int, t string"), {"t": {"type": "text", "fields": {"stem": {"type": "text", "analyzer": "english"}}}}, id_col="k")
    plain = {q: [(r["k"], r["_score"]) for r in e.search("w", {"query": {"match": {q: "the foxes fox"}}}).hits.collect()] for q in ("t", "t.stem")}
    sources.store_tokens(e, "w")
    assert {q: [(r["k"], r["_score"]) for r in e.search("w", {"query": {"match": {q: "the foxes fox"}}}).hits.collect()] for q in plain} == plain
    page = e.search("w", {"query": {"match": {"t": "fox"}}}).hits
    assert set(page.columns) == {"_index", "_id", "_score", "k", "t"}
    e.search("w", {"query": {"match": {"t": "fox"}}, "size": 0}).matched.select("k").explain("formatted")
    assert "ReadSchema: struct<k:int,_cv_tokens_0:array<string>>" in capsys.readouterr().out
    sources.update(e, "w", 3, {"t": "another fox"})
    assert found(e, {"match": {"t": "fox"}}) == [0, 1, 3] and not e.index("w").mapping.stored


def test_partitions_hold_all_terms(spark, tmp_path):
    """More terms in a partition than any size short of the largest int lets through."""
    sf = Path("/root/testdata/sf0.001")
    for p in sf.iterdir():
        if p.name != "orders.parquet":
            (tmp_path / p.name).symlink_to(p)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    shifted = orders.crossJoin(spark.range(1 + 450_000 // orders.count()).withColumnRenamed("id", "k"))
    key = F.row_number().over(Window.orderBy("k", "o_orderkey")).cast("long")
    shifted.withColumn("o_orderkey", key).withColumn("o_custkey", F.col("o_orderkey")).drop("k").write.parquet(f"{tmp_path}/orders.parquet")
    n = spark.read.parquet(f"{tmp_path}/orders.parquet").count()
    parts = registry.QUERIES["b_terms_partition_number"](spark, str(tmp_path))
    assert 100_000 < parts.count() < n / 3 and "Limit" not in parts._jdf.queryExecution().optimizedPlan().toString()
    assert registry.QUERIES["b_terms_partitions"](spark, str(tmp_path)).agg(F.count_distinct("c"), F.sum("doc_count")).first() == (n, n)
