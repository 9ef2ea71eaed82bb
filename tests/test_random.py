"""Random queries and sorts against a plain evaluator, and agreement of pages with a full sort."""

from __future__ import annotations

import functools
import random

import pytest
from pyspark.sql import functions as F

from corvane.plans.search import Engine

ROWS = 120


@pytest.fixture(scope="module")
def docs():
    r = random.Random(7)
    some = lambda make, gone=0.2: None if r.random() < gone else make()
    return [(f"{i:03d}", some(lambda: r.randint(-5, 20)), some(lambda: round(r.uniform(-3, 3), 2)), some(lambda: r.choice("abcd") * r.randint(1, 3)), some(lambda: r.random() < 0.5), some(lambda: [r.randint(0, 9) for _ in range(r.randint(0, 3))])) for i in range(ROWS)]


@pytest.fixture(scope="module")
def engine(spark, docs):
    e = Engine(spark)
    e.create("t", spark.createDataFrame(docs, "_id string, n int, d double, k string, b boolean, m array<int>"))
    return e


FIELDS = ("_id", "n", "d", "k", "b", "m")


def holds(q: dict, row: tuple) -> bool:
    kind, body = next(iter(q.items()))
    if kind == "bool":
        must, never, should = (body.get(x, []) for x in ("must", "must_not", "should"))
        met = sum(holds(x, row) for x in should)
        need = body.get("minimum_should_match", 0 if must else 1) if should else 0
        return all(holds(x, row) for x in must) and not any(holds(x, row) for x in never) and met >= (need if must else max(need, 1 if should else 0))
    name, how = ("", body) if kind == "exists" else next(iter(body.items()))
    v = row[FIELDS.index(body["field"] if kind == "exists" else name)]
    values = [x for x in (v if isinstance(v, list) else [v]) if x is not None]
    if kind == "exists":
        return bool(values)
    if kind == "term":
        return how in values
    if kind == "terms":
        return any(x in how for x in values)
    if kind == "prefix":
        return any(x.startswith(how) for x in values)
    ops = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    return any(all(ops[o](x, w) for o, w in how.items()) for x in values)


def query(r: random.Random, depth: int) -> dict:
    if depth and r.random() < 0.6:
        out = {k: [query(r, depth - 1) for _ in range(r.randint(1, 3))] for k in ("must", "must_not", "should") if r.random() < 0.6}
        if not out:
            return query(r, 0)
        if "should" in out and r.random() < 0.5:
            out["minimum_should_match"] = r.randint(1, 2)
        return {"bool": out}
    return r.choice([
        lambda: {"term": {"n": r.randint(-5, 20)}}, lambda: {"term": {"k": r.choice("abcd") * r.randint(1, 3)}}, lambda: {"term": {"b": r.random() < 0.5}}, lambda: {"term": {"m": r.randint(0, 9)}},
        lambda: {"terms": {"n": [r.randint(-5, 20) for _ in range(4)]}}, lambda: {"range": {"d": {"gte": round(r.uniform(-3, 0), 2), "lt": round(r.uniform(0, 3), 2)}}}, lambda: {"range": {"m": {"gt": r.randint(0, 8)}}},
        lambda: {"range": {"n": {r.choice(["lte", "gt"]): r.randint(-5, 20)}}}, lambda: {"exists": {"field": r.choice(FIELDS[1:])}}, lambda: {"prefix": {"k": r.choice("abcd")}},
    ])()


def test_random_queries(spark, engine, docs):
    """Many queries in one scan: each is a column that counts its rows."""
    r = random.Random(11)
    from corvane.plans.query import Compiler

    ix = engine.index("t")
    queries = [query(r, 3) for _ in range(150)]
    hits = [Compiler(ix.df, ix.mapping, engine).compile(q).hit for q in queries]
    found = ix.df.select("_id", F.array(*[F.coalesce(h, F.lit(False)) for h in hits]).alias("h")).collect()
    for row in found:
        own = next(d for d in docs if d[0] == row["_id"])
        for q, h in zip(queries, row["h"], strict=True):
            assert holds(q, own) == h, (q, own)


def ordered(docs: list, keys: list) -> list[str]:
    def compare(a: tuple, b: tuple) -> int:
        for name, down, missing in keys:
            x, y = (v[FIELDS.index(name)] for v in (a, b))
            if isinstance(x, list) or isinstance(y, list):
                pick = max if down else min
                x, y = (pick(v) if v else None for v in (x, y))
            if missing not in ("_first", "_last"):
                x, y = (missing if v is None else v for v in (x, y))
            if (x is None) != (y is None):
                return (1 if x is None else -1) * (1 if missing == "_last" else -1)
            if x != y:
                return (1 if x > y else -1) * (-1 if down else 1)
        return 1 if a[0] > b[0] else -1

    return [d[0] for d in sorted(docs, key=functools.cmp_to_key(compare))]


@pytest.mark.parametrize("seed", range(12))
def test_random_sorts_and_pages(engine, docs, seed):
    r = random.Random(seed)
    keys = [(n, r.random() < 0.5, r.choice(["_first", "_last", *([3] if n in ("n", "m") else [])])) for n in r.sample(FIELDS[1:], 2)]
    body = {"sort": [{n: {"order": "desc" if down else "asc", "missing": missing}} for n, down, missing in keys], "_source": False}
    want = ordered(docs, keys)
    start, size = r.randint(0, 60), r.randint(1, 40)
    got = [h["_id"] for h in engine.search("t", {**body, "from": start, "size": size}).hits.collect()]
    assert got == want[start : start + size]
    key = engine.scroll("t", {**body, "size": 50})
    seen: list[str] = []
    while page := engine.scrolls[key].next():
        seen += [h["_id"] for h in page]
    assert seen == want
