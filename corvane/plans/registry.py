"""Registered queries of the search engine and their SQL: one for each operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import hashing
from corvane.functions.analysis import TOKEN, analyze
from corvane.operators import suggest
from corvane.plans.search import Engine, Relation, SearchResult
from corvane.sources import documents as sources
from corvane.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TEXT = {"text": {"type": "text"}}
_IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}
#: Points made of keys, for the geographic operators.
_POINT = ("cast(c_custkey * 37 % 170 - 85 as double)", "cast(c_custkey * 91 % 340 - 170 as double)")


def _frame(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_OPEN: dict[tuple[str, str], Engine] = {}
#: The size of a terms aggregation that asks for all buckets.
ALL = 2**31 - 1


def engine(spark: SparkSession, sf: str) -> Engine:
    """The engine over a folder of driver tables, opened once in a session; each caller gets a clone to write in."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = _opened(spark, sf)
    return _OPEN[key].clone()


def _opened(spark: SparkSession, sf: str) -> Engine:
    """All driver tables as indices, with orders and their lines as parents and children, points on customers and lines nested under orders."""
    e = Engine(spark)
    for name, key in _IDS.items():
        e.create(name, _frame(spark, sf, name), {"documents": TEXT | {"text.raw": {"type": "keyword", "column": "text"}}, "benchmark": TEXT, "part": {"p_name": {"type": "text", "fields": {"keyword": {"type": "keyword"}}}}}.get(name), id_col=key)
    lines = _frame(spark, sf, "lineitem")
    e.create("lineitem", lines.withColumn("_id", F.concat_ws("-", "l_orderkey", "l_linenumber")))
    customers = _frame(spark, sf, "customer").withColumn("location", F.struct(F.expr(_POINT[0]).alias("lat"), F.expr(_POINT[1]).alias("lon"))).withColumn("ip", F.expr("concat_ws('.', '10', cast(c_custkey % 4 as string), cast(c_custkey % 200 as string), '1')"))
    e.create("shops", customers.withColumn("limits", F.struct(F.col("c_acctbal").alias("gte"), (F.col("c_acctbal") + 500.0).alias("lte"))), {"ip": {"type": "ip"}}, id_col="c_custkey")
    per = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")).alias("lines"))
    e.create("baskets", _frame(spark, sf, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"), id_col="o_orderkey")
    events = _frame(spark, sf, "events")
    features = F.create_map(F.lit("size"), F.col("value").cast("float"), F.lit("user"), F.col("user_id").cast("float"))
    e.create("signals", events.withColumn("flat", F.from_json("props", "map<string,string>")).withColumn("features", features), {"flat": {"type": "flat_object"}, "features": {"type": "rank_features"}}, id_col="event_id")
    e.create("titles", _frame(spark, sf, "part"), {"p_name": {"type": "search_as_you_type"}}, id_col="p_partkey")
    places = _frame(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("_id"), F.col("r_name").alias("name"), F.struct(F.lit("region").alias("name"), F.lit(None).cast("string").alias("parent")).alias("kind"))
    places = places.unionByName(_frame(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.struct(F.lit("nation").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).alias("kind")))
    for name in ("documents", "benchmark"):
        sources.store_tokens(e, name)
    e.create("places", places, {"kind": {"type": "join", "relations": {"region": ["nation"]}}})
    e.relations["line"] = Relation("line", "orders", "lineitem", "l_orderkey")
    e.aliases["urgent"] = {"orders": {"term": {"o_orderpriority": "1-URGENT"}}}
    return e


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Plain names, and floating values rounded as the SQL rounds them."""
    df = df.toDF(*[c.replace(".0", "").replace(".", "_") for c in df.columns])
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def _add(name: str, f: Callable[[Engine], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf, f=f: _rounded(f(engine(spark, sf)))
    if sql is not None:
        ORACLE_SQL[name] = sql


def _rows(name: str, index: str, query: dict, columns: str, sql: str) -> None:
    """All rows that a query matches."""
    _add(name, lambda e: e.search(index, {"query": query, "size": 0}).matched.selectExpr(*columns.split(",")), f"SELECT {columns} FROM {sql}")


def _hits(name: str, index: str, body: dict, columns: str, sql: str | None) -> None:
    """A page of hits."""
    _add(name, lambda e: e.search(index, body).hits.selectExpr(*[c.strip() for c in columns.split(";")]), sql)


def _agg(name: str, index: str, aggs: dict, path: str, sql: str | None, query: dict | None = None, columns: str | None = None, body: dict | None = None) -> None:
    """The rows of one aggregation."""

    def run(e: Engine) -> DataFrame:
        r: SearchResult = e.search(index, {"size": 0, "aggs": aggs, **({"query": query} if query else {}), **(body or {})})
        out = r.aggregations[path]
        return out.selectExpr(*[c.strip() for c in columns.split(";")]) if columns else out

    _add(name, run, sql)


# -- flagship

_agg(
    "flagship_filtered_terms_sum", "lineitem", {"by": {"terms": {"field": "l_linestatus"}, "aggs": {"rev": {"sum": {"field": "l_extendedprice"}}}}}, "by",
    "SELECT l_linestatus AS by, count(*) AS doc_count, round(sum(l_extendedprice), 4) AS rev FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1",
    {"bool": {"filter": [{"term": {"l_returnflag": "R"}}, {"range": {"l_shipdate": {"gte": "1995-01-01", "lt": "1996-01-01"}}}]}},
)

# -- leaf predicates

_rows("q_match_all", "nation", {"match_all": {}}, "n_nationkey,n_name", "nation")
_rows("q_match_none", "nation", {"match_none": {}}, "n_nationkey,n_name", "nation WHERE false")
_rows("q_term", "orders", {"term": {"o_orderstatus": "F"}}, "o_orderkey,o_orderstatus", "orders WHERE o_orderstatus = 'F'")
_rows("q_term_numeric", "part", {"term": {"p_size": {"value": 7}}}, "p_partkey,p_size", "part WHERE p_size = 7")
_rows("q_term_case_insensitive", "customer", {"term": {"c_mktsegment": {"value": "building", "case_insensitive": True}}}, "c_custkey,c_mktsegment", "customer WHERE lower(c_mktsegment) = 'building'")
_rows("q_terms", "orders", {"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, "o_orderkey,o_orderpriority", "orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_rows("q_terms_lookup", "customer", {"terms": {"c_nationkey": {"index": "nation", "query": {"term": {"n_regionkey": 1}}, "path": "n_nationkey"}}}, "c_custkey,c_nationkey", "customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_rows("q_range_numeric", "lineitem", {"range": {"l_quantity": {"gt": 45, "lte": 48}}}, "l_orderkey,l_linenumber,l_quantity", "lineitem WHERE l_quantity > 45 AND l_quantity <= 48")
_rows("q_range_date_math", "orders", {"range": {"o_orderdate": {"gte": "1996-01-15||/M", "lte": "1996-02-10||/M"}}}, "o_orderkey,o_orderdate", "orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
_rows("q_range_keyword", "nation", {"range": {"n_name": {"gte": "F", "lt": "K"}}}, "n_nationkey,n_name", "nation WHERE n_name >= 'F' AND n_name < 'K'")
_rows("q_range_field_relation", "shops", {"range": {"limits": {"gte": 1000, "lte": 1200, "relation": "intersects"}}}, "c_custkey", "customer WHERE c_acctbal <= 1200 AND c_acctbal + 500.0 >= 1000")
_rows("q_range_field_within", "shops", {"range": {"limits": {"gte": 1000, "lte": 2000, "relation": "within"}}}, "c_custkey", "customer WHERE c_acctbal >= 1000 AND c_acctbal + 500.0 <= 2000")
_rows("q_exists", "documents", {"exists": {"field": "lang"}}, "doc_id", "documents WHERE lang IS NOT NULL")
_rows("q_prefix", "part", {"prefix": {"p_type": {"value": "ECON"}}}, "p_partkey,p_type", "part WHERE starts_with(p_type, 'ECON')")
_rows("q_wildcard", "part", {"wildcard": {"p_type": {"value": "*o*N?S?", "case_insensitive": True}}}, "p_partkey,p_type", "part WHERE regexp_full_match(lower(p_type), '.*o.*n.s.')")
_rows("q_regexp", "customer", {"regexp": {"c_name": "Customer#0*<10-19>"}}, "c_custkey,c_name", "customer WHERE regexp_full_match(c_name, 'Customer#0*1[0-9]')")
_rows("q_fuzzy", "nation", {"fuzzy": {"n_name": {"value": "IRAM", "fuzziness": 1}}}, "n_nationkey,n_name", "nation WHERE damerau_levenshtein(n_name, 'IRAM') <= 1")
_rows("q_ids", "orders", {"ids": {"values": ["1", "2", "7"]}}, "o_orderkey", "orders WHERE o_orderkey IN (1, 2, 7)")
_rows("q_script", "lineitem", {"script": {"script": {"source": "doc['l_quantity'].value * params.f > doc['l_extendedprice'].value", "params": {"f": 1500}}}}, "l_orderkey,l_linenumber", "lineitem WHERE l_quantity * 1500 > l_extendedprice")
_rows("q_wrapper", "orders", {"wrapper": {"query": "eyJ0ZXJtIjogeyJvX29yZGVyc3RhdHVzIjogIk8ifX0="}}, "o_orderkey", "orders WHERE o_orderstatus = 'O'")
_rows("q_bool", "lineitem", {"bool": {"must": [{"term": {"l_returnflag": "N"}}], "must_not": [{"term": {"l_linestatus": "O"}}], "should": [{"range": {"l_quantity": {"gt": 40}}}, {"range": {"l_discount": {"gt": 0.08}}}, {"range": {"l_tax": {"gt": 0.06}}}], "minimum_should_match": 2}}, "l_orderkey,l_linenumber", "lineitem WHERE l_returnflag = 'N' AND l_linestatus <> 'O' AND (CAST(l_quantity > 40 AS INT) + CAST(l_discount > 0.08 AS INT) + CAST(l_tax > 0.06 AS INT)) >= 2")
_rows("q_constant_score", "orders", {"constant_score": {"filter": {"range": {"o_totalprice": {"gte": 400000}}}, "boost": 2}}, "o_orderkey", "orders WHERE o_totalprice >= 400000")

# -- full text

_T = f"regexp_extract_all(lower(text), '{TOKEN.replace(chr(39), chr(39) * 2)}')"
_rows("t_match_or", "documents", {"match": {"text": "idiot clown"}}, "doc_id", f"documents WHERE list_has_any({_T}, ['idiot', 'clown'])")
_rows("t_match_and", "documents", {"match": {"text": {"query": "The And WITH", "operator": "and"}}}, "doc_id", f"documents WHERE list_has_all({_T}, ['the', 'and', 'with'])")
_rows("t_match_msm", "documents", {"match": {"text": {"query": "the les der los", "minimum_should_match": "50%"}}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE (CAST(list_contains(t, 'the') AS INT) + CAST(list_contains(t, 'les') AS INT) + CAST(list_contains(t, 'der') AS INT) + CAST(list_contains(t, 'los') AS INT)) >= 2")
_rows("t_match_phrase", "documents", {"match_phrase": {"text": "of the"}}, "doc_id", f"documents WHERE contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')")
_rows("t_match_phrase_prefix", "documents", {"match_phrase_prefix": {"text": "of th"}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents), (SELECT list(w) AS ends FROM (SELECT DISTINCT w FROM (SELECT unnest({_T}) AS w FROM documents) WHERE starts_with(w, 'th') ORDER BY w LIMIT 50)) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND list_contains(ends, t[i + 1]))) > 0")
_rows("t_match_bool_prefix", "documents", {"match_bool_prefix": {"text": {"query": "the wors", "operator": "and"}}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'wors'))) > 0")
_rows("t_multi_match", "part", {"multi_match": {"query": "MAROON", "fields": ["p_name", "p_type"], "operator": "or"}}, "p_partkey", "part WHERE list_contains(regexp_extract_all(lower(p_name), '\\w+'), 'maroon') OR p_type = 'MAROON'")
_rows("t_combined_fields", "documents", {"combined_fields": {"query": "the worthless", "fields": ["text"], "operator": "and"}}, "doc_id", f"documents WHERE list_has_all({_T}, ['the', 'worthless'])")
_rows("t_query_string", "documents", {"query_string": {"query": "+idiot -clown (scum OR trash)", "default_field": "text"}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE list_contains(t, 'idiot') AND NOT list_contains(t, 'clown')")
_rows("t_query_string_fields", "orders", {"query_string": {"query": "o_orderstatus:F AND o_totalprice:[100000 TO 150000}"}}, "o_orderkey", "orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 150000")
_rows("t_simple_query_string", "documents", {"simple_query_string": {"query": "idiot + -clown | \"of the\"", "fields": ["text"]}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE (list_contains(t, 'idiot') AND NOT list_contains(t, 'clown')) OR contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
_rows("t_terms_set", "documents", {"terms_set": {"text": {"terms": ["the", "and", "of"], "minimum_should_match_field": "n_chars"}}}, "doc_id", f"documents WHERE len(list_intersect(list_distinct({_T}), ['the', 'and', 'of'])) >= greatest(1, n_chars)")
_rows("t_span_near", "documents", {"span_near": {"clauses": [{"span_term": {"text": "of"}}, {"span_term": {"text": "the"}}], "slop": 0, "in_order": True}}, "doc_id", f"documents WHERE contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')")
_rows("t_intervals_match", "documents", {"intervals": {"text": {"match": {"query": "of the", "ordered": True, "max_gaps": 0}}}}, "doc_id", f"documents WHERE contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')")
_rows("t_intervals_any_of", "documents", {"intervals": {"text": {"any_of": {"intervals": [{"match": {"query": "idiot"}}, {"prefix": {"prefix": "worthl"}}]}}}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE list_contains(t, 'idiot') OR len(list_filter(t, lambda x: starts_with(x, 'worthl'))) > 0")
_BM25 = f"""
WITH d AS (SELECT doc_id, {_T} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS l FROM d WHERE len(t) > 0),
f AS (SELECT q, (SELECT count(*) FROM d WHERE list_contains(t, q)) AS df FROM (VALUES ('idiot'), ('clown')) v(q)),
x AS (SELECT doc_id, q, len(t) AS len, CAST(len(list_filter(t, lambda y: y = q)) AS DOUBLE) AS tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, l FROM d, s, f),
r AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / l))) AS score FROM x GROUP BY doc_id HAVING sum(tf) > 0)
SELECT doc_id, round(score, 4) AS score FROM r ORDER BY score DESC, doc_id LIMIT 20
"""
_hits("t_bm25_top", "documents", {"query": {"match": {"text": "idiot clown"}}, "size": 20}, "doc_id; _score AS score", _BM25)
_add("t_common_terms", lambda e: e.search("documents", {"query": {"common": {"text": {"query": "the worthless", "cutoff_frequency": 0.5}}}, "size": 0}).matched.select("doc_id"), f"SELECT doc_id FROM documents WHERE list_contains({_T}, 'worthless')")
_add("t_more_like_this", lambda e: e.search("documents", {"query": {"more_like_this": {"fields": ["text"], "like": "idiot idiot clown clown scum scum", "min_doc_freq": 1, "minimum_should_match": "100%"}}, "size": 0}).matched.select("doc_id"), f"SELECT doc_id FROM documents WHERE list_has_all({_T}, ['idiot', 'clown', 'scum'])")
_hits("t_highlight", "documents", {"query": {"match": {"text": "idiot"}}, "sort": ["doc_id"], "size": 5, "_source": False, "highlight": {"fields": {"text": {"number_of_fragments": 0}}}}, "CAST(_id AS BIGINT) AS doc_id; `highlight.text`[0] AS marked", r"SELECT doc_id, trim(regexp_replace(text, '(?i)\b(idiot)\b', '<em>\1</em>', 'g')) AS marked FROM documents WHERE regexp_matches(text, '(?i)\bidiot\b') ORDER BY doc_id LIMIT 5")


def _analyzed(e: Engine, text: Column, index: str, key: str) -> DataFrame:
    return e.index(index).df.select(F.col(key), F.array_join(text, " ").alias("tokens"))


_add("a_standard", lambda e: _analyzed(e, analyze(F.col("text"), "standard"), "documents", "doc_id"), f"SELECT doc_id, array_to_string({_T}, ' ') AS tokens FROM documents")
_add("a_whitespace", lambda e: _analyzed(e, analyze(F.col("text"), "whitespace"), "benchmark", "item_id"), r"SELECT item_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS tokens FROM benchmark")
_add("a_shingles", lambda e: _analyzed(e, analyze(F.col("p_name"), {"tokenizer": "whitespace", "filter": ["lowercase", {"type": "shingle", "output_unigrams": False, "token_separator": "_"}]}), "part", "p_partkey"), "WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) SELECT p_partkey, array_to_string([w[i] || '_' || w[i + 1] for i in range(1, len(w))], ' ') AS tokens FROM t")
_add("a_edge_ngram", lambda e: _analyzed(e, analyze(F.col("n_name"), {"tokenizer": {"type": "edge_ngram", "min_gram": 2, "max_gram": 4}, "filter": ["lowercase"]}), "nation", "n_nationkey"), "SELECT n_nationkey, array_to_string([lower(n_name[1:k]) for k in range(2, 5) if k <= length(n_name)], ' ') AS tokens FROM nation")
_add("a_fingerprint", lambda e: _analyzed(e, analyze(F.col("p_type"), {"tokenizer": "whitespace", "filter": ["lowercase", "fingerprint"]}), "part", "p_partkey"), "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_type), ' '))), ' ') AS tokens FROM part")
_add("a_stop_length", lambda e: _analyzed(e, analyze(F.col("text"), {"tokenizer": "letter", "filter": ["lowercase", {"type": "stop"}, {"type": "length", "min": 3, "max": 8}, "unique"]}), "benchmark", "item_id").withColumn("tokens", F.array_join(F.sort_array(F.split("tokens", " ")), " ")), r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '\pL+'), lambda x: length(x) BETWEEN 3 AND 8 AND x NOT IN ('a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with')))), ' ') AS tokens FROM benchmark")
_add("a_html_strip", lambda e: e.index("pages").df.select("page_id", F.size(analyze(F.col("html"), {"char_filter": ["html_strip"], "tokenizer": "whitespace"})).cast("long").alias("n")), r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<script\b.*?</script\s*>', ' ', 'g'), '(?s)<style\b.*?</style\s*>', ' ', 'g'), '</?[A-Za-z][^>]*>|<![^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\S+')) AS BIGINT) AS n FROM pages")
_add("a_porter_stem", lambda e: _analyzed(e, analyze(F.col("text"), "english"), "benchmark", "item_id"), None)

# -- scores

_hits("s_dis_max", "part", {"query": {"dis_max": {"queries": [{"constant_score": {"filter": {"range": {"p_size": {"gte": 25}}}, "boost": 2}}, {"constant_score": {"filter": {"term": {"p_brand": "Brand#13"}}, "boost": 3}}], "tie_breaker": 0.5}}, "size": 10000}, "p_partkey; _score AS score", "WITH s AS (SELECT p_partkey, CASE WHEN p_size >= 25 THEN 2.0 ELSE 0 END AS a, CASE WHEN p_brand = 'Brand#13' THEN 3.0 ELSE 0 END AS b FROM part WHERE p_size >= 25 OR p_brand = 'Brand#13') SELECT p_partkey, round(CAST(greatest(a, b) + 0.5 * least(a, b) AS DOUBLE), 4) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 10000")
_hits("s_boosting", "part", {"query": {"boosting": {"positive": {"constant_score": {"filter": {"range": {"p_size": {"lt": 10}}}, "boost": 4}}, "negative": {"prefix": {"p_type": "S"}}, "negative_boost": 0.25}}, "size": 10000}, "p_partkey; _score AS score", "SELECT p_partkey, CAST(CASE WHEN starts_with(p_type, 'S') THEN 1.0 ELSE 4.0 END AS DOUBLE) AS score FROM part WHERE p_size < 10 ORDER BY score DESC, p_partkey LIMIT 10000")
_hits("s_field_value_factor", "part", {"query": {"function_score": {"query": {"range": {"p_size": {"lte": 5}}}, "field_value_factor": {"field": "p_retailprice", "factor": 0.5, "modifier": "log1p"}}}, "size": 100}, "p_partkey; _score AS score", "SELECT p_partkey, round(log10(p_retailprice * 0.5 + 1), 4) AS score FROM part WHERE p_size <= 5 ORDER BY log10(p_retailprice * 0.5 + 1) DESC, p_partkey LIMIT 100")
_hits("s_decay_gauss", "part", {"query": {"function_score": {"gauss": {"p_size": {"origin": 20, "scale": 5, "offset": 1}}}}, "size": 1000}, "p_partkey; _score AS score", "SELECT p_partkey, round(exp(0.5 * pow(greatest(0, abs(p_size - 20) - 1), 2) / (0.5 * 25 / ln(0.5))), 4) AS score FROM part ORDER BY greatest(0, abs(p_size - 20) - 1), p_partkey LIMIT 1000")
_hits("s_decay_exp_linear", "part", {"query": {"function_score": {"functions": [{"exp": {"p_size": {"origin": 10, "scale": 10}}}, {"linear": {"p_size": {"origin": 10, "scale": 20}}, "weight": 2}], "score_mode": "sum", "boost_mode": "replace"}}, "size": 1000}, "p_partkey; _score AS score", "SELECT p_partkey, round(exp(ln(0.5) / 10 * abs(p_size - 10)) + 2 * greatest(0, (40 - abs(p_size - 10)) / 40.0), 4) AS score FROM part ORDER BY abs(p_size - 10), p_partkey LIMIT 1000")
_hits("s_script_score", "orders", {"query": {"script_score": {"query": {"term": {"o_orderstatus": "P"}}, "script": {"source": "Math.sqrt(doc['o_totalprice'].value) + (doc['o_custkey'].value / 10)"}}}, "size": 50}, "o_orderkey; _score AS score", "SELECT o_orderkey, round(sqrt(o_totalprice) + o_custkey // 10, 4) AS score FROM orders WHERE o_orderstatus = 'P' ORDER BY sqrt(o_totalprice) + o_custkey // 10 DESC, o_orderkey LIMIT 50")
_hits("s_distance_feature", "orders", {"query": {"distance_feature": {"field": "o_orderdate", "origin": "1996-06-01", "pivot": "7d"}}, "size": 50}, "o_orderkey; _score AS score", "SELECT o_orderkey, round(604800000.0 / (604800000.0 + abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1996-06-01'))), 4) AS score FROM orders ORDER BY abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1996-06-01')), o_orderkey LIMIT 50")
_hits("s_rank_feature", "part", {"query": {"rank_feature": {"field": "p_retailprice", "saturation": {"pivot": 1000}}}, "size": 50}, "p_partkey; _score AS score", "SELECT p_partkey, round(p_retailprice / (p_retailprice + 1000), 4) AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
_hits("s_rescore", "part", {"query": {"rank_feature": {"field": "p_size", "linear": {}}}, "size": 20, "rescore": {"window_size": 15, "query": {"rescore_query": {"constant_score": {"filter": {"term": {"p_brand": "Brand#13"}}, "boost": 100}}, "query_weight": 0.5, "rescore_query_weight": 2}}}, "p_partkey; _score AS score", "WITH t AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS s, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part) SELECT p_partkey, CASE WHEN r <= 15 THEN s * 0.5 + CASE WHEN p_brand = 'Brand#13' THEN 200 ELSE 0 END ELSE s END AS score FROM t ORDER BY score DESC, p_partkey LIMIT 20")

# -- joins and nested

_rows("j_has_child", "orders", {"has_child": {"type": "line", "query": {"range": {"l_quantity": {"gte": 49}}}, "min_children": 2}}, "o_orderkey", "orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49) >= 2")
_hits("j_has_child_score", "orders", {"query": {"has_child": {"type": "line", "score_mode": "sum", "query": {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "l_quantity"}, "boost_mode": "replace"}}}}, "size": 20}, "o_orderkey; _score AS score", "SELECT o_orderkey, round(sum(l_quantity), 4) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY sum(l_quantity) DESC, o_orderkey LIMIT 20")
_rows("j_has_parent", "lineitem", {"has_parent": {"parent_type": "orders", "child_type": "line", "query": {"range": {"o_totalprice": {"gt": 450000}}}}}, "l_orderkey,l_linenumber", "lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000)")
_rows("j_parent_id", "lineitem", {"parent_id": {"type": "line", "id": 7}}, "l_orderkey,l_linenumber", "lineitem WHERE l_orderkey = 7")
_rows("j_nested", "baskets", {"nested": {"path": "lines", "query": {"bool": {"filter": [{"term": {"lines.l_returnflag": "R"}}, {"range": {"lines.l_quantity": {"gt": 48}}}]}}}}, "o_orderkey", "orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 48)")
_agg("j_nested_agg", "baskets", {"n": {"nested": {"path": "lines"}, "aggs": {"f": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"q": {"sum": {"field": "lines.l_quantity"}}, "up": {"reverse_nested": {}}}}}}}, "n>f", "SELECT l_returnflag AS f, count(*) AS doc_count, round(sum(l_quantity), 4) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
_agg("j_reverse_nested", "baskets", {"n": {"nested": {"path": "lines"}, "aggs": {"f": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"up": {"reverse_nested": {}}}}}}}, "n>f>up", "SELECT l_returnflag AS f, count(DISTINCT l_orderkey) AS doc_count FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
_agg("j_children_agg", "orders", {"c": {"children": {"type": "line"}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}, "c", "SELECT count(*) AS doc_count, round(sum(l_quantity), 4) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'", {"term": {"o_orderstatus": "P"}})
_agg("j_parent_agg", "lineitem", {"p": {"parent": {"type": "line"}, "aggs": {"t": {"sum": {"field": "o_totalprice"}}}}}, "p", "SELECT count(*) AS doc_count, round(sum(o_totalprice), 4) AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)", {"range": {"l_quantity": {"gte": 50}}})

# -- geo

_LAT, _LON = _POINT
_P = f"(SELECT c_custkey, {_LAT} AS lat, {_LON} AS lon FROM customer)"
_HAV = "2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin((radians(20.0) - radians(lon)) / 2), 2))))"
_rows("g_distance", "shops", {"geo_distance": {"distance": "3000km", "location": {"lat": 10, "lon": 20}}}, "c_custkey", f"{_P} WHERE {_HAV} <= 3000000")
_rows("g_bounding_box", "shops", {"geo_bounding_box": {"location": {"top_left": {"lat": 40, "lon": 150}, "bottom_right": {"lat": -20, "lon": -150}}}}, "c_custkey", f"{_P} WHERE lat BETWEEN -20 AND 40 AND (lon >= 150 OR lon <= -150)")
_rows("g_polygon", "shops", {"geo_polygon": {"location": {"points": ["0.5,0.5", "0.5,60.5", "50.5,0.5"]}}}, "c_custkey", f"{_P} WHERE lat > 0.5 AND lon > 0.5 AND lat < 50.5 AND lon < 60.5 AND (lon - 0.5) / 60.0 + (lat - 0.5) / 50.0 < 1")
_rows("g_shape", "shops", {"geo_shape": {"location": {"shape": {"type": "envelope", "coordinates": [[-30, 30], [30, -30]]}}}}, "c_custkey", f"{_P} WHERE lat BETWEEN -30 AND 30 AND lon BETWEEN -30 AND 30")
_hits("g_distance_sort", "shops", {"sort": [{"_geo_distance": {"location": "10,20", "unit": "km"}}], "size": 15}, "c_custkey", f"SELECT c_custkey FROM {_P} ORDER BY round({_HAV}, 3), c_custkey LIMIT 15")
_agg("g_bounds_centroid", "shops", {"b": {"geo_bounds": {"field": "location", "wrap_longitude": False}}}, "b", f"SELECT max(lat) AS b_top, min(lon) AS b_left, min(lat) AS b_bottom, max(lon) AS b_right FROM {_P}")
_agg("g_centroid", "shops", {"s": {"terms": {"field": "c_mktsegment"}, "aggs": {"c": {"geo_centroid": {"field": "location"}}}}}, "s", f"SELECT c_mktsegment AS s, count(*) AS doc_count, round(avg({_LAT}), 4) AS c_lat, round(avg({_LON}), 4) AS c_lon, count(*) AS c_count FROM customer GROUP BY 1")
_agg("g_tile_grid", "shops", {"t": {"geotile_grid": {"field": "location", "precision": 3}}}, "t", f"SELECT '3/' || CAST(floor((lon + 180) / 360 * 8) AS BIGINT) || '/' || CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8) AS BIGINT) AS t, count(*) AS doc_count FROM {_P} GROUP BY 1")
_agg("g_hash_grid", "shops", {"h": {"geohash_grid": {"field": "location", "precision": 1}}}, "h", f"WITH c AS (SELECT CAST(floor((lon + 180) / 45) AS INT) AS x, CAST(floor((lat + 90) / 45) AS INT) AS y FROM {_P}) SELECT substr('0123456789bcdefghjkmnpqrstuvwxyz', 1 + (x >> 2 & 1) * 16 + (y >> 1 & 1) * 8 + (x >> 1 & 1) * 4 + (y & 1) * 2 + (x & 1), 1) AS h, count(*) AS doc_count FROM c GROUP BY 1")
_agg("g_distance_rings", "shops", {"r": {"geo_distance": {"field": "location", "origin": "10,20", "unit": "km", "ranges": [{"to": 2000}, {"from": 2000, "to": 8000}, {"from": 8000}]}}}, "r", f"WITH d AS (SELECT {_HAV} / 1000 AS d FROM {_P}), r AS (SELECT * FROM (VALUES ('*-2000.0', NULL, 2000.0), ('2000.0-8000.0', 2000.0, 8000.0), ('8000.0-*', 8000.0, NULL)) v(k, lo, hi)) SELECT k AS r, count(d) AS doc_count FROM r LEFT JOIN d ON (lo IS NULL OR d >= lo) AND (hi IS NULL OR d < hi) GROUP BY 1", columns="r; doc_count")

# -- hits

_hits("h_sort_page", "orders", {"sort": [{"o_orderpriority": "asc"}, {"o_totalprice": "desc"}], "from": 20, "size": 30, "_source": ["o_orderkey", "o_total*"]}, "o_orderkey; o_totalprice", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 20")
_hits("h_search_after", "orders", {"sort": [{"o_orderdate": "desc"}, {"o_orderkey": "asc"}], "search_after": ["1996-03-01", 100], "size": 10}, "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-01' OR (o_orderdate = TIMESTAMP '1996-03-01' AND o_orderkey > 100) ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
_hits("h_collapse", "orders", {"collapse": {"field": "o_orderpriority"}, "sort": [{"o_totalprice": "desc"}], "size": 10}, "o_orderpriority; o_orderkey", "SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY 1")
_hits("h_post_filter", "orders", {"post_filter": {"term": {"o_orderstatus": "F"}}, "sort": ["o_orderkey"], "size": 25}, "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 25")
_hits("h_min_score", "part", {"query": {"rank_feature": {"field": "p_size", "linear": {}}}, "min_score": 45, "size": 10000}, "p_partkey; _score AS score", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_size >= 45 ORDER BY p_size DESC, p_partkey LIMIT 10000")
_hits("h_script_fields", "part", {"sort": ["p_partkey"], "size": 20, "script_fields": {"double_size": {"script": "doc['p_size'].value * 2"}}, "_source": ["p_partkey"]}, "p_partkey; CAST(double_size AS INT) AS double_size", "SELECT p_partkey, p_size * 2 AS double_size FROM part ORDER BY 1 LIMIT 20")
_hits("h_script_sort", "part", {"sort": [{"_script": {"type": "number", "script": "doc['p_size'].value % 7", "order": "desc"}}], "size": 15}, "p_partkey", "SELECT p_partkey FROM part ORDER BY p_size % 7 DESC, p_partkey LIMIT 15")
_hits("h_nested_sort", "baskets", {"sort": [{"lines.l_quantity": {"order": "desc", "mode": "avg", "nested": {"path": "lines"}}}], "size": 10}, "o_orderkey", "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY round(avg(l_quantity), 9) DESC, o_orderkey LIMIT 10")
_hits("h_named_queries", "nation", {"query": {"bool": {"should": [{"term": {"n_regionkey": {"value": 1, "_name": "one"}}}, {"prefix": {"n_name": {"value": "C", "_name": "c"}}}]}}, "size": 25}, "n_nationkey; array_join(matched_queries, ',') AS names", "SELECT n_nationkey, array_to_string(list_filter([CASE WHEN n_regionkey = 1 THEN 'one' END, CASE WHEN starts_with(n_name, 'C') THEN 'c' END], lambda x: x IS NOT NULL), ',') AS names FROM nation WHERE n_regionkey = 1 OR starts_with(n_name, 'C')")
_hits("h_docvalue_fields", "orders", {"sort": ["o_orderkey"], "size": 10, "docvalue_fields": [{"field": "o_orderdate", "format": "yyyy/MM/dd"}], "_source": False}, "CAST(_id AS BIGINT) AS o_orderkey; `fields.o_orderdate`[0] AS d", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders ORDER BY 1 LIMIT 10")
_add("h_slices_cover", lambda e: e.search("orders", {"slice": {"id": 0, "max": 2}, "size": 0}).matched.select("o_orderkey").unionByName(e.search("orders", {"slice": {"id": 1, "max": 2}, "size": 0}).matched.select("o_orderkey")), "SELECT o_orderkey FROM orders")
_add("h_multi_index", lambda e: e.search("nation,region", {"size": 100}).hits.select("_index", F.col("_id").cast("long").alias("key"), F.coalesce("n_name", "r_name").alias("name")), "SELECT 'nation' AS _index, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT), r_name FROM region")
_add("h_alias_filter", lambda e: e.search("urgent", {"size": 0}).matched.select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
_add("h_explain", lambda e: e.explain("part", 5, {"bool": {"must": [{"range": {"p_size": {"gte": 0}}}], "should": [{"constant_score": {"filter": {"exists": {"field": "p_name"}}, "boost": 2}}]}}).select("p_partkey", "matched", F.col("value").cast("double").alias("value")), "SELECT p_partkey, true AS matched, CAST(3 AS DOUBLE) AS value FROM part WHERE p_partkey = 5")
_add("h_termvectors", lambda e: e.termvectors("benchmark", 0, ["text"]).select("term", "term_freq"), f"SELECT term, count(*) AS term_freq FROM (SELECT unnest({_T}) AS term FROM benchmark WHERE item_id = 0) GROUP BY 1")
_add("h_field_caps", lambda e: e.field_caps("nation").select("field", "type", "aggregatable"), "SELECT * FROM (VALUES ('n_nationkey', 'integer', true), ('n_name', 'keyword', true), ('n_regionkey', 'integer', true)) v(field, type, aggregatable)")
_add("h_mget", lambda e: sources.mget(e, [("nation", 3), ("region", 1), ("nation", 999)]).select("position", "found", F.coalesce("n_name", "r_name").alias("name")), "SELECT 0 AS position, true AS found, n_name AS name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, true, r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 2, false, NULL")

# -- metrics

_agg("m_basic", "lineitem", {"f": {"terms": {"field": "l_returnflag"}, "aggs": {"a": {"avg": {"field": "l_quantity"}}, "s": {"sum": {"field": "l_tax"}}, "lo": {"min": {"field": "l_extendedprice"}}, "hi": {"max": {"field": "l_extendedprice"}}, "n": {"value_count": {"field": "l_discount"}}, "d": {"cardinality": {"field": "l_suppkey"}}}}}, "f", "SELECT l_returnflag AS f, count(*) AS doc_count, round(avg(l_quantity), 4) AS a, round(sum(l_tax), 4) AS s, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, count(l_discount) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1")
_agg("m_stats", "events", {"t": {"terms": {"field": "event_type"}, "aggs": {"s": {"stats": {"field": "value"}}}}}, "t", "SELECT event_type AS t, count(*) AS doc_count, count(value) AS s_count, round(min(value), 4) AS s_min, round(max(value), 4) AS s_max, round(avg(value), 4) AS s_avg, round(sum(value), 4) AS s_sum FROM events GROUP BY 1")
_agg("m_extended_stats", "events", {"s": {"extended_stats": {"field": "value"}}}, "s", "SELECT count(value) AS s_count, round(avg(value), 4) AS s_avg, round(var_pop(value), 4) AS s_variance, round(var_samp(value), 4) AS s_variance_sampling, round(stddev_pop(value), 4) AS s_std_deviation, round(avg(value) + 2 * stddev_pop(value), 4) AS s_upper FROM events", columns="`s.count`; `s.avg`; `s.variance`; `s.variance_sampling`; `s.std_deviation`; `s.upper`")
_agg("m_weighted_avg", "lineitem", {"w": {"weighted_avg": {"value": {"field": "l_discount"}, "weight": {"field": "l_quantity"}}}}, "w", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS w FROM lineitem")
_agg("m_percentiles", "events", {"t": {"terms": {"field": "event_type"}, "aggs": {"p": {"percentiles": {"field": "value", "percents": [5, 50, 99]}}}}}, "t", "SELECT event_type AS t, count(*) AS doc_count, round(quantile_cont(value, 0.05), 4) AS p_5, round(quantile_cont(value, 0.5), 4) AS p_50, round(quantile_cont(value, 0.99), 4) AS p_99 FROM events GROUP BY 1")
_agg("m_percentile_ranks", "events", {"r": {"percentile_ranks": {"field": "value", "values": [10, 50]}}}, "r", "SELECT round(100 * avg(CASE WHEN value <= 10 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 4) AS r_10, round(100 * avg(CASE WHEN value <= 50 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 4) AS r_50 FROM events")
_agg("m_median_absolute_deviation", "lineitem", {"f": {"terms": {"field": "l_returnflag"}, "aggs": {"m": {"median_absolute_deviation": {"field": "l_quantity"}}}}}, "f", "WITH m AS (SELECT l_returnflag AS f, median(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT f, count(*) AS doc_count, median(abs(l_quantity - m)) AS m FROM lineitem JOIN m ON f = l_returnflag GROUP BY 1")
_agg("m_top_hits", "orders", {"p": {"terms": {"field": "o_orderpriority"}, "aggs": {"t": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}], "_source": ["o_orderkey"]}}}}}, "p", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderpriority AS p, count(*) AS doc_count, max(CASE WHEN r = 1 THEN o_orderkey END) AS first, max(CASE WHEN r = 2 THEN o_orderkey END) AS second FROM r GROUP BY 1", columns="p; doc_count; t[0].o_orderkey AS first; t[1].o_orderkey AS second")

# -- buckets

_agg("b_terms_top", "lineitem", {"k": {"terms": {"field": "l_suppkey", "size": 7, "show_other": True}}}, "k", "WITH c AS (SELECT l_suppkey AS k, count(*) AS doc_count FROM lineitem GROUP BY 1), t AS (SELECT * FROM c ORDER BY doc_count DESC, k LIMIT 7) SELECT k, doc_count, CAST((SELECT sum(doc_count) FROM c) - (SELECT sum(doc_count) FROM t) AS BIGINT) AS sum_other_doc_count FROM t")
_agg("b_terms_order_by_metric", "lineitem", {"k": {"terms": {"field": "l_suppkey", "size": 5, "order": {"rev": "desc"}}, "aggs": {"rev": {"sum": {"field": "l_extendedprice"}}}}}, "k", "SELECT l_suppkey AS k, count(*) AS doc_count, round(sum(l_extendedprice), 4) AS rev FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, k LIMIT 5")
_agg("b_terms_nested_levels", "lineitem", {"a": {"terms": {"field": "l_returnflag", "size": 2}, "aggs": {"b": {"terms": {"field": "l_linenumber", "size": 3}, "aggs": {"q": {"avg": {"field": "l_quantity"}}}}}}}, "a>b", "WITH a AS (SELECT l_returnflag AS a FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, a LIMIT 2), b AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS doc_count, round(avg(l_quantity), 4) AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r, sum(count(*)) OVER (PARTITION BY l_returnflag) AS total FROM lineitem WHERE l_returnflag IN (SELECT a FROM a) GROUP BY 1, 2) SELECT a, b, doc_count, q, CAST(total - sum(doc_count) OVER (PARTITION BY a) AS BIGINT) AS sum_other_doc_count FROM b WHERE r <= 3")
_agg("b_terms_include_exclude", "nation", {"n": {"terms": {"field": "n_name", "include": "I.*|C.*", "exclude": ["IRAQ"], "size": 25}}}, "n", "SELECT n_name AS n, count(*) AS doc_count FROM nation WHERE (starts_with(n_name, 'I') OR starts_with(n_name, 'C')) AND n_name <> 'IRAQ' GROUP BY 1")
_agg("b_terms_min_doc_count_zero", "orders", {"s": {"terms": {"field": "o_orderstatus", "min_doc_count": 0}}}, "s", "SELECT o_orderstatus AS s, count(*) FILTER (o_totalprice > 1e9) AS doc_count FROM orders GROUP BY 1", {"range": {"o_totalprice": {"gt": 1e9}}})
_agg("b_multi_terms", "lineitem", {"m": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}]}}}, "m", "SELECT l_returnflag || '|' || l_linestatus AS m, count(*) AS doc_count FROM lineitem GROUP BY 1", columns="m; doc_count")
_agg("b_rare_terms", "events", {"u": {"rare_terms": {"field": "user_id", "max_doc_count": 5}}}, "u", "SELECT user_id AS u, count(*) AS doc_count FROM events GROUP BY 1 HAVING count(*) <= 5")
_agg("b_significant_terms", "lineitem", {"s": {"significant_terms": {"field": "l_suppkey", "size": 10}}}, "s", "WITH f AS (SELECT l_suppkey AS s, count(*) AS doc_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS s, count(*) AS bg_count FROM lineitem GROUP BY 1), t AS (SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n, (SELECT count(*) FROM lineitem) AS m), x AS (SELECT f.s, doc_count, bg_count, CAST(doc_count AS DOUBLE) / n AS p, CAST(bg_count AS DOUBLE) / m AS q FROM f JOIN b USING (s), t WHERE doc_count >= 3) SELECT s, doc_count, bg_count, round((p - q) * (p / q), 4) AS score FROM x WHERE p > q ORDER BY (p - q) * (p / q) DESC, s LIMIT 10", {"term": {"l_returnflag": "R"}})
_agg("b_significant_text", "documents", {"s": {"significant_text": {"field": "text", "size": 5, "chi_square": {}}}}, "s", f"WITH d AS (SELECT doc_id, list_distinct({_T}) AS t FROM documents), g AS (SELECT * FROM d WHERE list_contains(t, 'idiot')), f AS (SELECT w AS s, count(*) AS doc_count FROM (SELECT unnest(t) AS w FROM g) GROUP BY 1), b AS (SELECT w AS s, count(*) AS bg_count FROM (SELECT unnest(t) AS w FROM d) GROUP BY 1), x AS (SELECT s, doc_count, bg_count, CAST(doc_count AS DOUBLE) AS a, CAST(bg_count - doc_count AS DOUBLE) AS b, CAST((SELECT count(*) FROM g) - doc_count AS DOUBLE) AS c, CAST((SELECT count(*) FROM d) AS DOUBLE) AS n FROM f JOIN b USING (s) WHERE doc_count >= 3), y AS (SELECT *, n - a - b - c AS e FROM x WHERE a / (a + c) > (a + b) / n) SELECT s, doc_count, bg_count, round(n * pow(a * e - b * c, 2) / ((a + c) * (a + b) * (b + e) * (c + e)), 4) AS score FROM y ORDER BY n * pow(a * e - b * c, 2) / ((a + c) * (a + b) * (b + e) * (c + e)) DESC, s LIMIT 5", {"match": {"text": "idiot"}})
_agg("b_histogram", "part", {"h": {"histogram": {"field": "p_retailprice", "interval": 250, "offset": 10, "extended_bounds": {"min": 10, "max": 3010}}, "aggs": {"s": {"avg": {"field": "p_size"}}}}}, "h", "WITH b AS (SELECT floor((p_retailprice - 10) / 250) * 250 + 10 AS h, count(*) AS n, avg(p_size) AS s FROM part GROUP BY 1), r AS (SELECT least(min(h), 10) AS lo, greatest(max(h), 3010) AS hi FROM b), g AS (SELECT lo + 250 * i AS h FROM r, generate_series(0, CAST((hi - lo) / 250 AS BIGINT)) t(i)) SELECT CAST(g.h AS DOUBLE) AS h, coalesce(n, 0) AS doc_count, round(s, 4) AS s FROM g LEFT JOIN b ON b.h = g.h")
_DAYS = "WITH b AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(d) FROM b), (SELECT max(d) FROM b), INTERVAL 1 DAY)) AS d), x AS (SELECT CAST(g.d AS TIMESTAMP) AS d, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN v END AS v FROM g LEFT JOIN b ON b.d = g.d)"
_BUY = {"term": {"event_type": "purchase"}}


def _daily(pipes: dict) -> dict:
    return {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"sum": {"field": "value"}}, **pipes}}}


_agg("b_date_histogram", "events", _daily({}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v FROM x", _BUY)
_agg("b_date_histogram_zone", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "time_zone": "+09:00", "min_doc_count": 1}}}, "d", "SELECT date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS d, count(*) AS doc_count FROM events GROUP BY 1")
_agg("b_date_histogram_fixed", "orders", {"d": {"date_histogram": {"field": "o_orderdate", "fixed_interval": "30d", "min_doc_count": 1}}}, "d", "SELECT make_timestamp(CAST(floor(epoch_ms(o_orderdate) / 2592000000.0) AS BIGINT) * 2592000000000) AS d, count(*) AS doc_count FROM orders GROUP BY 1")
_agg("b_date_histogram_week_month", "orders", {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "quarter", "min_doc_count": 1}}}, "m", "SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS m, count(*) AS doc_count FROM orders GROUP BY 1")
_agg("b_auto_date_histogram", "orders", {"d": {"auto_date_histogram": {"field": "o_orderdate", "buckets": 10}}}, "d", "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS d, count(*) AS doc_count, '1y' AS interval FROM orders GROUP BY 1")
_agg("b_variable_width_histogram", "nation", {"v": {"variable_width_histogram": {"field": "n_nationkey", "buckets": 3}}}, "v", "WITH v AS (SELECT DISTINCT CAST(n_nationkey AS DOUBLE) AS v FROM nation), g AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM v), c AS (SELECT v FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, v LIMIT 2), x AS (SELECT CAST(n_nationkey AS DOUBLE) AS n, (SELECT count(*) FROM c WHERE c.v <= n_nationkey) AS b FROM nation) SELECT round(avg(n), 4) AS v, count(*) AS doc_count, min(n) AS min, max(n) AS max FROM x GROUP BY b")
_agg("b_range", "lineitem", {"r": {"range": {"field": "l_quantity", "ranges": [{"to": 10}, {"from": 5, "to": 25}, {"from": 25}, {"from": 1000, "key": "none"}]}, "aggs": {"p": {"avg": {"field": "l_extendedprice"}}}}}, "r", "WITH r AS (SELECT * FROM (VALUES ('*-10.0', NULL, 10.0), ('5.0-25.0', 5.0, 25.0), ('25.0-*', 25.0, NULL), ('none', 1000.0, NULL)) v(r, lo, hi)) SELECT r, count(l_quantity) AS doc_count, round(avg(l_extendedprice), 4) AS p FROM r LEFT JOIN lineitem ON (lo IS NULL OR l_quantity >= lo) AND (hi IS NULL OR l_quantity < hi) GROUP BY 1", columns="r; doc_count; p")
_agg("b_date_range", "orders", {"r": {"date_range": {"field": "o_orderdate", "ranges": [{"to": "1995-01-01", "key": "old"}, {"from": "1995-01-01", "to": "1995-01-01||+1y", "key": "mid"}, {"from": "now", "key": "new"}]}}}, "r", "SELECT 'old' AS r, count(*) AS doc_count FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' UNION ALL SELECT 'mid', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT 'new', count(*) FROM orders WHERE o_orderdate >= now()::TIMESTAMP")
_agg("b_ip_range", "shops", {"r": {"ip_range": {"field": "ip", "ranges": [{"mask": "10.1.0.0/16"}, {"from": "10.2.0.0", "key": "high"}]}}}, "r", "SELECT '10.1.0.0/16' AS r, count(*) AS doc_count FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'high', count(*) FROM customer WHERE c_custkey % 4 >= 2")
_agg("b_filters", "lineitem", {"f": {"filters": {"filters": {"big": {"range": {"l_quantity": {"gt": 40}}}, "flag": {"term": {"l_returnflag": "A"}}}, "other_bucket_key": "rest"}, "aggs": {"s": {"sum": {"field": "l_quantity"}}}}}, "f", "SELECT 'big' AS f, count(*) AS doc_count, round(sum(l_quantity), 4) AS s FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'flag', count(*), round(sum(l_quantity), 4) FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'rest', count(*), round(sum(l_quantity), 4) FROM lineitem WHERE NOT (l_quantity > 40 OR l_returnflag = 'A')")
_agg("b_filter", "lineitem", {"f": {"filter": {"term": {"l_returnflag": "A"}}, "aggs": {"s": {"avg": {"field": "l_quantity"}}}}}, "f", "SELECT count(*) AS doc_count, round(avg(l_quantity), 4) AS s FROM lineitem WHERE l_returnflag = 'A'")
_agg("b_adjacency_matrix", "lineitem", {"x": {"adjacency_matrix": {"filters": {"a": {"range": {"l_quantity": {"gt": 25}}}, "b": {"term": {"l_returnflag": "N"}}, "c": {"range": {"l_discount": {"gt": 0.05}}}}}}}, "x", "WITH m AS (SELECT l_quantity > 25 AS a, l_returnflag = 'N' AS b, l_discount > 0.05 AS c FROM lineitem) SELECT k AS x, n AS doc_count FROM (SELECT 'a' AS k, count(*) FILTER (a) AS n FROM m UNION ALL SELECT 'b', count(*) FILTER (b) FROM m UNION ALL SELECT 'c', count(*) FILTER (c) FROM m UNION ALL SELECT 'a&b', count(*) FILTER (a AND b) FROM m UNION ALL SELECT 'a&c', count(*) FILTER (a AND c) FROM m UNION ALL SELECT 'b&c', count(*) FILTER (b AND c) FROM m) WHERE n > 0")
_agg("b_missing_global", "events", {"g": {"global": {}, "aggs": {"a": {"avg": {"field": "value"}}}}}, "g", "SELECT count(*) AS doc_count, round(avg(value), 4) AS a FROM events", _BUY)
_agg("b_missing", "events", {"m": {"missing": {"field": "value"}}}, "m", "SELECT count(*) AS doc_count FROM events WHERE value IS NULL")
_COMPOSITE = {"c": {"composite": {"size": 12, "sources": [{"f": {"terms": {"field": "l_returnflag", "order": "desc"}}}, {"q": {"histogram": {"field": "l_quantity", "interval": 10}}}], "after": {"f": "R", "q": 20}}, "aggs": {"t": {"avg": {"field": "l_tax"}}}}}
_agg("b_composite_after", "lineitem", _COMPOSITE, "c", "SELECT l_returnflag AS f, floor(l_quantity / 10) * 10 AS q, count(*) AS doc_count, round(avg(l_tax), 4) AS t FROM lineitem GROUP BY 1, 2 HAVING l_returnflag < 'R' OR (l_returnflag = 'R' AND floor(l_quantity / 10) * 10 > 20) ORDER BY 1 DESC, 2 LIMIT 12")
_agg("b_sampler", "part", {"s": {"sampler": {"shard_size": 50}, "aggs": {"a": {"avg": {"field": "p_retailprice"}}}}}, "s", "SELECT count(*) AS doc_count, round(avg(p_retailprice), 4) AS a FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 50)", {"rank_feature": {"field": "p_size", "linear": {}}})
_agg("b_diversified_sampler", "part", {"s": {"diversified_sampler": {"field": "p_brand", "shard_size": 200, "max_docs_per_value": 2}, "aggs": {"a": {"sum": {"field": "p_size"}}}}}, "s", "SELECT count(*) AS doc_count, CAST(sum(p_size) AS DOUBLE) AS a FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r <= 2 ORDER BY p_size DESC, p_partkey LIMIT 200)", {"rank_feature": {"field": "p_size", "linear": {}}})

# -- pipelines

_agg("p_siblings", "events", {**_daily({}), "s": {"stats_bucket": {"buckets_path": "d>v"}}}, "s", f"{_DAYS} SELECT count(v) AS s_count, round(min(v), 4) AS s_min, round(max(v), 4) AS s_max, round(avg(v), 4) AS s_avg, round(sum(v), 4) AS s_sum FROM x", _BUY)
_agg("p_extended_stats_bucket", "events", {**_daily({}), "s": {"extended_stats_bucket": {"buckets_path": "d>v"}}}, "s", f"{_DAYS} SELECT count(v) AS s_count, round(var_pop(v), 2) AS s_variance, round(stddev_pop(v), 4) AS s_std_deviation FROM x", _BUY, "`s.count`; round(`s.variance`, 2) AS s_variance; `s.std_deviation`")
_agg("p_avg_bucket_insert_zeros", "events", {**_daily({}), "s": {"avg_bucket": {"buckets_path": "d>v", "gap_policy": "insert_zeros"}}}, "s", f"{_DAYS} SELECT round(avg(coalesce(v, 0)), 4) AS s FROM x", _BUY)
_agg("p_sum_bucket", "events", {**_daily({}), "s": {"sum_bucket": {"buckets_path": "d._count"}}}, "s", f"{_DAYS} SELECT CAST(sum(n) AS DOUBLE) AS s FROM x", _BUY)
_agg("p_max_bucket", "events", {**_daily({}), "s": {"max_bucket": {"buckets_path": "d>v"}}}, "s", f"{_DAYS} SELECT round(max(v), 4) AS s FROM x", _BUY, "s")
_agg("p_percentiles_bucket", "events", {**_daily({}), "s": {"percentiles_bucket": {"buckets_path": "d>v", "percents": [50, 90]}}}, "s", f"{_DAYS}, l AS (SELECT list_sort(list(v)) AS l, count(v) AS n FROM x WHERE v IS NOT NULL) SELECT round(l[CAST(round(0.5 * (n - 1)) AS INT) + 1], 4) AS s_50, round(l[CAST(round(0.9 * (n - 1)) AS INT) + 1], 4) AS s_90 FROM l", _BUY)
_agg("p_cumulative_sum", "events", _daily({"c": {"cumulative_sum": {"buckets_path": "v"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(sum(coalesce(v, 0)) OVER (ORDER BY d), 4) AS c FROM x", _BUY)
_agg("p_derivative", "events", _daily({"c": {"derivative": {"buckets_path": "v"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(v - lag(v) OVER (ORDER BY d), 4) AS c FROM x", _BUY)
_agg("p_serial_diff", "events", _daily({"c": {"serial_diff": {"buckets_path": "_count", "lag": 7}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, CAST(n - lag(n, 7) OVER (ORDER BY d) AS DOUBLE) AS c FROM x", _BUY)
_agg("p_moving_avg", "events", _daily({"c": {"moving_avg": {"buckets_path": "_count", "window": 5}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS c FROM x", _BUY)
_agg("p_moving_avg_linear", "events", _daily({"c": {"moving_avg": {"buckets_path": "_count", "window": 3, "model": "linear"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(CASE WHEN lag(n, 3) OVER w IS NOT NULL THEN (lag(n, 3) OVER w + 2 * lag(n, 2) OVER w + 3 * lag(n) OVER w) / 6.0 WHEN lag(n, 2) OVER w IS NOT NULL THEN (lag(n, 2) OVER w + 2 * lag(n) OVER w) / 3.0 ELSE CAST(lag(n) OVER w AS DOUBLE) END, 4) AS c FROM x WINDOW w AS (ORDER BY d)", _BUY)
_agg("p_bucket_script", "events", _daily({"c": {"bucket_script": {"buckets_path": {"a": "v", "n": "_count"}, "script": "params.a / params.n"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(v / nullif(n, 0), 4) AS c FROM x", _BUY)
_agg("p_bucket_selector", "events", _daily({"c": {"bucket_selector": {"buckets_path": {"n": "_count"}, "script": "params.n > 10"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v FROM x WHERE n > 10", _BUY)
_agg("p_bucket_sort", "events", _daily({"c": {"bucket_sort": {"sort": [{"v": "desc"}], "from": 1, "size": 4}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v FROM x WHERE v IS NOT NULL ORDER BY x.v DESC, d LIMIT 4 OFFSET 1", _BUY)

# -- suggesters

_add(
    "u_term_suggest", lambda e: suggest.term_suggest(e.index("documents"), "idiat", {"field": "text", "prefix_length": 2, "accuracy": 0.4, "size": 4}).select("suggestion", "score", "freq"),
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct({_T})) AS w FROM documents), d AS (SELECT w, count(*) AS freq FROM w GROUP BY w),
    near AS (SELECT w, freq, damerau_levenshtein(w, 'idiat') AS e FROM d WHERE starts_with(w, 'id') AND length(w) >= 4)
    SELECT w AS suggestion, round(1 - e / CAST(least(length(w), 5) AS DOUBLE), 4) AS score, freq FROM near WHERE e <= 2 AND 1 - e / CAST(least(length(w), 5) AS DOUBLE) >= 0.4 ORDER BY score DESC, freq DESC, w LIMIT 4""",
)
_add("u_completion", lambda e: suggest.completion_suggest(e.index("nation").df.withColumn("_id", F.col("n_nationkey")), "in", {"field": "n_name", "size": 10}).select("text"), "SELECT n_name AS text FROM nation WHERE starts_with(lower(n_name), 'in')")


# -- documents

def _written(e: Engine) -> DataFrame:
    """Reindex, update and delete in a row."""
    sources.reindex(e, "nation", "copy", {"range": {"n_regionkey": {"lte": 2}}})
    sources.update_by_query(e, "copy", {"term": {"n_regionkey": 0}}, {"n_name": F.lower("n_name")})
    sources.delete_by_query(e, "copy", {"prefix": {"n_name": "J"}})
    return e.index("copy").df.select("n_nationkey", "n_name")


_add("d_reindex_update_delete", _written, "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_regionkey <= 2 AND NOT starts_with(CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END, 'J')")


# -- map fields, addresses, joins within one index

_rows("q_term_ip_block", "shops", {"term": {"ip": "10.1.0.0/16"}}, "c_custkey", "customer WHERE c_custkey % 4 = 1")
_rows("q_range_ip", "shops", {"range": {"ip": {"gte": "10.2.0.0", "lt": "10.3.0.0"}}}, "c_custkey", "customer WHERE c_custkey % 4 = 2")
_rows("q_flat_object_path", "signals", {"term": {"flat.k": "7"}}, "event_id", "events WHERE json_extract_string(props, '$.k') = '7'")
_rows("q_flat_object_any", "signals", {"term": {"flat": "7"}}, "event_id", "events WHERE json_extract_string(props, '$.k') = '7'")
_rows("j_join_field_child", "places", {"has_child": {"type": "nation", "query": {"prefix": {"name": "I"}}, "min_children": 2}}, "_id,name", "(SELECT 'r' || r_regionkey AS _id, r_name AS name, r_regionkey FROM region) WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND starts_with(n_name, 'I')) >= 2")
_rows("j_join_field_parent", "places", {"has_parent": {"parent_type": "region", "query": {"term": {"name": "ASIA"}}}}, "_id,name", "(SELECT 'n' || n_nationkey AS _id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
_rows("j_join_field_parent_id", "places", {"parent_id": {"type": "nation", "id": "r1"}}, "_id,name", "(SELECT 'n' || n_nationkey AS _id, n_name AS name FROM nation WHERE n_regionkey = 1)")
_hits("j_inner_hits", "baskets", {"query": {"nested": {"path": "lines", "query": {"range": {"lines.l_quantity": {"gte": 49}}}, "inner_hits": {"size": 2, "sort": [{"lines.l_quantity": "desc"}]}}}, "sort": ["o_orderkey"], "size": 40}, "o_orderkey; size(`inner_hits.lines`) AS n; `inner_hits.lines`[0].source.l_quantity AS most", "SELECT l_orderkey AS o_orderkey, CAST(least(2, count(*)) AS INT) AS n, max(l_quantity) AS most FROM lineitem WHERE l_quantity >= 49 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 ORDER BY 1 LIMIT 40")
_hits("s_rank_features", "signals", {"query": {"rank_feature": {"field": "features.user", "log": {"scaling_factor": 2}}}, "size": 30}, "event_id; _score AS score", "SELECT event_id, round(ln(2 + CAST(CAST(user_id AS FLOAT) AS DOUBLE)), 4) AS score FROM events ORDER BY CAST(user_id AS FLOAT) DESC, event_id LIMIT 30")
_rows("t_search_as_you_type", "titles", {"match": {"p_name._2gram": {"query": "part maroon"}}}, "p_partkey", "part WHERE contains(' ' || array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), ' ') || ' ', ' part maroon ')")

# -- more text

_rows("t_multi_match_most", "part", {"multi_match": {"query": "part Brand#13", "fields": ["p_name^2", "p_brand"], "type": "most_fields"}}, "p_partkey", "part WHERE list_has_any(regexp_extract_all(lower(p_name), '\\w+'), ['part', 'brand', '13']) OR p_brand = 'part Brand#13'")
_rows("t_phrase_slop", "documents", {"match_phrase": {"text": {"query": "of the", "slop": 0}}}, "doc_id", f"documents WHERE contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')")
_rows("t_query_string_wildcard", "customer", {"query_string": {"query": "c_mktsegment:BUILD* OR c_name:/Customer#0+1/"}}, "c_custkey", "customer WHERE starts_with(c_mktsegment, 'BUILD') OR regexp_full_match(c_name, 'Customer#0+1')")
_rows("t_exists_in_query_string", "events", {"query_string": {"query": "_exists_:value AND event_type:(click OR view)"}}, "event_id", "events WHERE value IS NOT NULL AND event_type IN ('click', 'view')")
_rows("t_intervals_filter", "documents", {"intervals": {"text": {"match": {"query": "idiot", "filter": {"before": {"match": {"query": "clown"}}}}}}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents) WHERE list_contains(t, 'idiot') AND list_position(t, 'idiot') < len(t) + 1 - list_position(list_reverse(t), 'clown') AND list_contains(t, 'clown')")
_rows("t_span_multi", "documents", {"span_near": {"clauses": [{"span_term": {"text": "of"}}, {"span_multi": {"match": {"prefix": {"text": {"value": "th"}}}}}], "slop": 0, "in_order": True}}, "doc_id", f"documents WHERE contains(' ' || array_to_string({_T}, ' '), ' of th')")

# -- more analysis

_add("a_ngram", lambda e: _analyzed(e, analyze(F.col("n_name"), {"tokenizer": {"type": "ngram", "min_gram": 3, "max_gram": 3}, "filter": ["lowercase"]}), "nation", "n_nationkey"), "SELECT n_nationkey, array_to_string([lower(n_name[i:i + 2]) for i in range(1, length(n_name) - 1)], ' ') AS tokens FROM nation")
_add("a_reverse_truncate", lambda e: _analyzed(e, analyze(F.col("n_name"), {"tokenizer": "keyword", "filter": ["reverse", {"type": "truncate", "length": 4}, "uppercase"]}), "nation", "n_nationkey"), "SELECT n_nationkey, upper(substr(reverse(n_name), 1, 4)) AS tokens FROM nation")
_add("a_synonym", lambda e: _analyzed(e, analyze(F.col("event_type"), {"tokenizer": "keyword", "filter": [{"type": "synonym", "synonyms": ["click, tap", "purchase => buy"]}]}), "events", "event_id"), "SELECT event_id, CASE event_type WHEN 'click' THEN 'click tap' WHEN 'purchase' THEN 'buy' ELSE event_type END AS tokens FROM events")
_add("a_asciifolding", lambda e: _analyzed(e, F.filter(analyze(F.col("text"), {"tokenizer": "letter", "filter": ["lowercase", "asciifolding"]}), lambda x: F.regexp_like(x, F.lit("^[a-z]+$"))), "benchmark", "item_id"), r"SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '\pL+'), lambda x: replace(strip_accents(x), 'ß', 'ss')), lambda x: regexp_full_match(x, '[a-z]+')), ' ') AS tokens FROM benchmark")
_add("a_pattern_char_group", lambda e: _analyzed(e, analyze(F.col("c_name"), {"tokenizer": {"type": "char_group", "tokenize_on_chars": ["#", "whitespace"]}, "filter": ["lowercase"]}), "customer", "c_custkey"), "SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(lower(c_name), '[#\\s]+'), lambda x: x <> ''), ' ') AS tokens FROM customer")
_add("a_path_hierarchy", lambda e: e.index("pages").df.select("page_id", F.size(analyze(F.col("url"), {"tokenizer": "path_hierarchy"})).cast("long").alias("n")), "SELECT page_id, CAST(len(string_split(url, '/')) AS BIGINT) AS n FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, NULL FROM pages WHERE url IS NULL")
_add("a_keep_stop", lambda e: _analyzed(e, analyze(F.col("p_type"), {"tokenizer": "whitespace", "filter": [{"type": "keep", "keep_words": ["STEEL", "BRASS", "PROMO", "ECONOMY"]}]}), "part", "p_partkey"), "SELECT p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x IN ('STEEL', 'BRASS', 'PROMO', 'ECONOMY')), ' ') AS tokens FROM part")

# -- more scores

_hits("s_function_modes", "part", {"query": {"function_score": {"functions": [{"filter": {"range": {"p_size": {"gte": 25}}}, "weight": 3}, {"filter": {"term": {"p_brand": "Brand#13"}}, "weight": 5}], "score_mode": "max", "boost_mode": "sum", "max_boost": 4}}, "size": 10000}, "p_partkey; _score AS score", "SELECT p_partkey, 1 + CAST(CASE WHEN p_brand = 'Brand#13' THEN 4 WHEN p_size >= 25 THEN 3 ELSE 0 END AS DOUBLE) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 10000")
_hits("s_decay_date", "orders", {"query": {"function_score": {"exp": {"o_orderdate": {"origin": "1996-06-01", "scale": "30d", "offset": "1d"}}}}, "size": 60}, "o_orderkey; _score AS score", "WITH d AS (SELECT o_orderkey, greatest(0, abs(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1996-06-01')) - 86400000.0) AS d FROM orders) SELECT o_orderkey, round(exp(ln(0.5) / 2592000000.0 * d), 4) AS score FROM d ORDER BY d, o_orderkey LIMIT 60")
_hits("s_distance_feature_geo", "shops", {"query": {"distance_feature": {"field": "location", "origin": "10,20", "pivot": "1000km"}}, "size": 20}, "c_custkey; _score AS score", f"SELECT c_custkey, round(1000000.0 / (1000000.0 + {_HAV}), 4) AS score FROM {_P} ORDER BY round({_HAV}, 3), c_custkey LIMIT 20")
_add("s_indices_boost", lambda e: e.search("nation,region", {"indices_boost": [{"region": 3}], "size": 30}).hits.select("_index", "_score"), "SELECT 'nation' AS _index, CAST(1 AS DOUBLE) AS _score FROM nation UNION ALL SELECT 'region', 3 FROM region")
_hits("s_rank_feature_sigmoid", "part", {"query": {"rank_feature": {"field": "p_retailprice", "sigmoid": {"pivot": 1500, "exponent": 2}}}, "size": 20}, "p_partkey; _score AS score", "SELECT p_partkey, round(pow(p_retailprice, 2) / (pow(p_retailprice, 2) + 2250000.0), 4) AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")

# -- more hits

_hits("h_sort_missing", "events", {"sort": [{"value": {"order": "asc", "missing": "_first"}}, "event_id"], "size": 40}, "event_id", "SELECT event_id FROM events ORDER BY value ASC NULLS FIRST, event_id LIMIT 40")
_hits("h_sort_unmapped", "nation", {"sort": [{"nothing": {"order": "asc", "unmapped_type": "long"}}, {"n_name": "desc"}], "size": 10}, "n_nationkey", "SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 10")
_hits("h_fields_format", "orders", {"sort": ["o_orderkey"], "size": 10, "fields": ["o_order*", {"field": "o_orderdate", "format": "epoch_millis"}], "_source": False}, "`fields.o_orderkey`[0] AS k; `fields.o_orderpriority`[0] AS p", "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders ORDER BY 1 LIMIT 10")
_add("h_point_in_time", lambda e: e.search("", {"pit": {"id": e.open_point("orders")}, "sort": [{"o_totalprice": "desc"}], "size": 12}).hits.select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
_add("h_collapse_inner_hits", lambda e: e.search("orders", {"collapse": {"field": "o_orderpriority", "inner_hits": {"name": "top", "size": 2}}, "sort": [{"o_totalprice": "desc"}], "size": 10}).hits.select("o_orderpriority", F.col("top")[1]["_id"].cast("long").alias("second")), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderpriority, o_orderkey AS second FROM r WHERE n = 2")

# -- more buckets and pipelines

_agg("b_date_histogram_dst", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day", "time_zone": "America/New_York", "min_doc_count": 1}}}, "d", "SELECT CAST(timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', ts))))) AS TIMESTAMP) AS d, count(*) AS doc_count FROM events GROUP BY 1")
_agg("b_histogram_hard_bounds", "lineitem", {"h": {"histogram": {"field": "l_quantity", "interval": 5, "hard_bounds": {"min": 10, "max": 30}, "min_doc_count": 1}}}, "h", "SELECT floor(l_quantity / 5) * 5 AS h, count(*) AS doc_count FROM lineitem WHERE floor(l_quantity / 5) * 5 BETWEEN 10 AND 30 GROUP BY 1")
_agg("b_terms_missing_value", "documents", {"l": {"terms": {"field": "lang", "missing": "none", "size": 50}}}, "l", "SELECT coalesce(lang, 'none') AS l, count(*) AS doc_count FROM documents GROUP BY 1")
_agg("b_composite_dates", "orders", {"c": {"composite": {"size": 40, "sources": [{"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}}}, {"s": {"terms": {"field": "o_orderstatus"}}}]}}}, "c", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_orderstatus AS s, count(*) AS doc_count FROM orders GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 40")
_agg("b_significant_jlh", "events", {"s": {"significant_terms": {"field": "user_id", "size": 5, "background_filter": {"exists": {"field": "event_type"}}}}}, "s", "WITH f AS (SELECT user_id AS s, count(*) AS doc_count FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id AS s, count(*) AS bg_count FROM events WHERE event_type IS NOT NULL GROUP BY 1), n AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS fg, (SELECT count(*) FROM events WHERE event_type IS NOT NULL) AS bg), x AS (SELECT s, doc_count, bg_count, CAST(doc_count AS DOUBLE) / fg AS p, CAST(bg_count AS DOUBLE) / bg AS q FROM f JOIN b USING (s), n) SELECT s, doc_count, bg_count, round((p - q) * (p / q), 4) AS score FROM x WHERE doc_count >= 3 AND p > q ORDER BY (p - q) * (p / q) DESC, s LIMIT 5", _BUY)
_agg("p_derivative_unit", "events", _daily({"c": {"derivative": {"buckets_path": "_count", "unit": "12h"}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, CAST(n - lag(n) OVER (ORDER BY d) AS DOUBLE) AS c, CAST(n - lag(n) OVER (ORDER BY d) AS DOUBLE) / 2 AS c_normalized_value FROM x", _BUY)
_agg("p_min_bucket", "events", {**_daily({}), "s": {"min_bucket": {"buckets_path": "d>v"}}}, "s", f"{_DAYS} SELECT round(min(v), 4) AS s FROM x", _BUY, "s")
_agg("p_stats_nested_path", "lineitem", {"f": {"terms": {"field": "l_returnflag"}, "aggs": {"n": {"terms": {"field": "l_linenumber"}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}, "s": {"avg_bucket": {"buckets_path": "n>q"}}}}}, "f>s", "WITH n AS (SELECT l_returnflag AS f, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT f, round(avg(q), 4) AS s FROM n GROUP BY 1")

# -- whole requests and writes


def _numbers(e: Engine, *values: int) -> DataFrame:
    return e.spark.createDataFrame(list(enumerate(values)), "i int, n long")


def _bulk(e: Engine) -> DataFrame:
    """A bulk file of all nations, written and read by the executors: each is indexed, then those of one region updated and those of another deleted."""
    rows = e.index("nation").df
    act = lambda op: F.concat(F.lit(f'{{"{op}": {{"_id": "'), F.col("n_nationkey").cast("string"), F.lit('"}}'))
    source = F.to_json(F.struct("n_name", "n_regionkey"))
    changed = F.when(F.col("n_regionkey") == 1, F.array(act("update"), F.to_json(F.struct(F.struct(F.lower("n_name").alias("n_name")).alias("doc"))))).when(F.col("n_regionkey") == 2, F.array(act("delete"))).otherwise(F.array().cast("array<string>"))
    lines = rows.select("n_nationkey", F.explode(F.concat(F.array(act("index"), source), changed)).alias("line")).select("line")
    path = f"{sources.shared_folder(e.spark)}/corvane-bulk-{uuid.uuid4().hex}"
    lines.write.text(path)
    index, _ = sources.apply_bulk(e, sources.read_bulk(e.spark, path), "loaded", "n_name string, n_regionkey long")
    return index.df.select(F.col("_id").cast("long").alias("k"), "n_name", "n_regionkey", "_version")


_add("d_bulk", _bulk, "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS _version FROM nation WHERE n_regionkey <> 2")


def _updated(e: Engine) -> DataFrame:
    sources.reindex(e, "region", "copy")
    sources.update(e, "copy", 1, {"r_name": "changed"})
    sources.update(e, "copy", 77, {"r_name": "new"}, upsert_doc={"r_regionkey": 77, "r_name": "new"})
    sources.update(e, "copy", 2, {"r_name": "as is"}, doc_as_upsert=True)
    return e.index("copy").df.select("r_regionkey", "r_name")


_add("d_update_upsert", _updated, "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'changed' WHEN 2 THEN 'as is' ELSE r_name END AS r_name FROM region UNION ALL SELECT 77, 'new'")
_add("d_get", lambda e: sources.get(e, "nation", 7).select("n_nationkey", "n_name").unionByName(sources.get(e, "nation", 777).select("n_nationkey", "n_name")), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
_add("h_count", lambda e: _numbers(e, e.count("nation,region"), e.count("orders", {"term": {"o_orderstatus": "F"}}), e.count("urgent")), "SELECT CAST(0 AS INT) AS i, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 2, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')")
_add("h_msearch", lambda e: e.msearch([("nation", {"query": {"term": {"n_regionkey": 1}}, "sort": ["n_name"], "size": 3}), ("nation", {"sort": [{"n_name": "desc"}], "size": 2})])[0].hits.select("n_nationkey").unionByName(e.msearch([("nation", {"sort": [{"n_name": "desc"}], "size": 2})])[0].hits.select("n_nationkey")), "(SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3) UNION ALL (SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 2)")
_add("h_scroll", lambda e: e.spark.createDataFrame([(int(r["n_nationkey"]),) for page in _pages(e) for r in page], "n_nationkey long"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey <> 3")


def _pages(e: Engine) -> list:
    """All pages of a scroll over nations."""
    scroll, pages = e.scrolls[e.scroll("nation", {"query": {"bool": {"must_not": [{"term": {"n_regionkey": 3}}]}}, "size": 6})], []
    while page := scroll.next():
        pages.append(page)
    return pages


_add("h_terminate_after", lambda e: _numbers(e, e.search("orders", {"terminate_after": 40, "size": 0}).total()), "SELECT CAST(0 AS INT) AS i, least(40, count(*)) AS n FROM orders")
_add("h_track_total_hits", lambda e: _numbers(e, e.search("orders", {"track_total_hits": True, "size": 0}).total()), "SELECT CAST(0 AS INT) AS i, count(*) AS n FROM orders")
_hits("h_sort_ties", "orders", {"sort": [{"o_orderstatus": "asc"}], "size": 60}, "o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 60")
_hits("h_sort_id_desc", "orders", {"sort": [{"o_orderkey": "desc"}], "from": 5, "size": 15}, "o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15 OFFSET 5")
_rows("q_must_not_lookup", "customer", {"bool": {"must_not": [{"terms": {"c_nationkey": {"index": "nation", "query": {"term": {"n_regionkey": 1}}, "path": "n_nationkey"}}}]}}, "c_custkey", "customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_rows("q_fuzzy_max_expansions", "nation", {"fuzzy": {"n_name": {"value": "IRAM", "fuzziness": 2, "max_expansions": 1}}}, "n_nationkey", "nation WHERE n_name = (SELECT n_name FROM nation WHERE damerau_levenshtein(n_name, 'IRAM') <= 2 ORDER BY 1 - damerau_levenshtein(n_name, 'IRAM') / CAST(least(length(n_name), 4) AS DOUBLE) DESC, n_name LIMIT 1)")
_rows("t_phrase_prefix_max_expansions", "documents", {"match_phrase_prefix": {"text": {"query": "of th", "max_expansions": 3}}}, "doc_id", f"(SELECT doc_id, {_T} AS t FROM documents), (SELECT list(w) AS ends FROM (SELECT DISTINCT w FROM (SELECT unnest({_T}) AS w FROM documents) WHERE starts_with(w, 'th') ORDER BY w LIMIT 3)) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND list_contains(ends, t[i + 1]))) > 0")
_add("b_terms_partitions", lambda e: e.search("orders", {"size": 0, "aggs": {"c": {"terms": {"field": "o_custkey", "size": ALL, "include": {"partition": 0, "num_partitions": 2}}}}}).aggregations["c"].select("c", "doc_count").unionByName(e.search("orders", {"size": 0, "aggs": {"c": {"terms": {"field": "o_custkey", "size": ALL, "include": {"partition": 1, "num_partitions": 2}}}}}).aggregations["c"].select("c", "doc_count")), "SELECT o_custkey AS c, count(*) AS doc_count FROM orders GROUP BY 1")
_agg("p_moving_avg_ewma", "events", _daily({"c": {"moving_avg": {"buckets_path": "_count", "window": 2, "model": "ewma", "settings": {"alpha": 0.5}}}}), "d", f"{_DAYS} SELECT d, n AS doc_count, round(v, 4) AS v, round(coalesce(0.5 * lag(n) OVER w + 0.5 * lag(n, 2) OVER w, lag(n) OVER w), 4) AS c FROM x WINDOW w AS (ORDER BY d)", _BUY)
_add("a_normalizer", lambda e: _analyzed(e, analyze(F.col("c_mktsegment"), {"tokenizer": "keyword", "filter": ["lowercase", "trim"]}), "customer", "c_custkey"), "SELECT c_custkey, lower(c_mktsegment) AS tokens FROM customer")

# -- hashes that decide scores, slices and partitions


def _nested(source: str, *steps: tuple[str, str]) -> str:
    """SQL that adds one column after another, each of those before."""
    for name, value in steps:
        source = f"SELECT *, {value} AS {name} FROM ({source})"
    return source


def _murmur_sql(key: str, digits: str, table: str, seed: int) -> str:
    """Common table expressions that end in ``m (k, h)``: the signed MurmurHash3 of the bytes whose hexadecimal digits are given."""
    word = "CAST('0x' || d[8 * i + 7:8 * i + 8] || d[8 * i + 5:8 * i + 6] || d[8 * i + 3:8 * i + 4] || d[8 * i + 1:8 * i + 2] AS UBIGINT)"
    full, rotated = "4294967296", lambda c, r: f"({c} * {1 << r} % 4294967296) | ({c} >> {32 - r})"
    times = lambda c, by: f"{c} * CAST({by} AS UBIGINT) % {full}"
    stirred = (("w1", times("w", 0xCC9E2D51)), ("w2", rotated("w1", 15)), ("w3", times("w2", 0x1B873593)))
    block = _nested("SELECT * FROM s WHERE 4 * i + 4 <= n", ("w", word), *stirred, ("x", "xor(h, w3)"), ("y", rotated("x", 13)))
    tail = _nested("SELECT * FROM s WHERE 4 * i + 4 > n", ("w", f"CASE WHEN n % 4 > 0 THEN {word} ELSE CAST(0 AS UBIGINT) END"), *stirred, ("x", "xor(xor(h, w3), CAST(n AS UBIGINT))"), ("x1", times("xor(x, x >> 16)", 0x85EBCA6B)), ("x2", times("xor(x1, x1 >> 13)", 0xC2B2AE35)), ("z", "CAST(xor(x2, x2 >> 16) AS BIGINT)"))
    return f"WITH RECURSIVE s AS (SELECT {key} AS k, {digits} AS d, length({digits}) // 2 AS n, 0 AS i, CAST({seed & 0xFFFFFFFF} AS UBIGINT) AS h FROM {table} UNION ALL SELECT k, d, n, i + 1, (y * 5 + CAST({0xE6546B64} AS UBIGINT)) % {full} FROM ({block})), m AS (SELECT k, CASE WHEN z >= 2147483648 THEN z - {full} ELSE z END AS h FROM ({tail}))"


_PACKED = "'FE' || o_orderkey || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) % 2 = 1 THEN 'F' ELSE '' END"
_MIXED = _nested("SELECT k, CAST(k AS UHUGEINT) AS u FROM (SELECT DISTINCT o_custkey AS k FROM orders)", ("u1", "xor(u, u >> 32) * CAST(5536775847593249645 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT)"), ("u2", "xor(u1, u1 >> 29) * CAST(18163797613775837673 AS UHUGEINT) % CAST(18446744073709551616 AS UHUGEINT)"), ("u3", "CAST(xor(u2, u2 >> 32) AS HUGEINT)"))
_hits("s_random_score", "part", {"query": {"function_score": {"random_score": {"seed": 5, "field": "p_partkey"}}}, "size": 10}, "p_partkey; _score AS score", f"{_murmur_sql('p_partkey', 'hex(CAST(p_partkey AS VARCHAR))', 'part', hashing.mix32(5, hashing.string_hash('part') << 10))} SELECT k AS p_partkey, round((h & 16777215) / 16777216.0, 4) AS score FROM m ORDER BY h & 16777215 DESC, k LIMIT 10")
_add("h_slice_ids", lambda e: e.search("orders", {"slice": {"id": 1, "max": 3}, "size": 0}).matched.select("o_orderkey"), f"{_murmur_sql('o_orderkey', _PACKED, 'orders', 7919)} SELECT k AS o_orderkey FROM m WHERE (h % 3 + 3) % 3 = 1")
_agg("b_terms_partition_text", "part", {"b": {"terms": {"field": "p_brand", "size": 1000, "include": {"partition": 2, "num_partitions": 3}}}}, "b", f"{_murmur_sql('p_brand', 'hex(p_brand)', '(SELECT DISTINCT p_brand FROM part)', 31)} SELECT p_brand AS b, count(*) AS doc_count FROM part WHERE p_brand IN (SELECT k FROM m WHERE (h % 3 + 3) % 3 = 2) GROUP BY 1")
_agg("b_terms_partition_number", "orders", {"c": {"terms": {"field": "o_custkey", "size": ALL, "include": {"partition": 1, "num_partitions": 4}}}}, "c", f"WITH x AS ({_MIXED}) SELECT o_custkey AS c, count(*) AS doc_count FROM orders WHERE o_custkey IN (SELECT k FROM x WHERE u3 % 4 = 1) GROUP BY 1")

# -- streams


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows over the events read as a stream, all that is there in one go."""
    schema = _frame(spark, sf, "events").schema.simpleString()
    stream = windows.open_stream(spark, f"{sf}/events.parquet*", schema.removeprefix("struct<").removesuffix(">").replace(":", " "))
    hours = windows.windowed(windows.matching(stream, _BUY), "ts", "1 day", {"v": F.sum("value")})
    path = f"{sources.shared_folder(spark)}/corvane-stream-{uuid.uuid4().hex}"
    out = windows.run_once(hours, f"{path}/out", f"{path}/state", "complete")
    return _rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("d"), "doc_count", "v"))


QUERIES["x_stream_windows"] = _streamed
ORACLE_SQL["x_stream_windows"] = "SELECT date_trunc('day', ts) AS d, count(*) AS doc_count, round(sum(value), 4) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1"
