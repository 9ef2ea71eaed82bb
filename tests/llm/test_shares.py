"""Sharding and mixing against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import compare
import pytest

from corvane.llm import queries
from corvane.llm._common import table
from corvane.llm.mixing import mix_documents
from corvane.llm.sharding import assign_shards, shard_of_key, write_shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, shard string, taken int, _cv_x string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, s, -1, "x", -1, "y") for i, t, s in rows], SCHEMA)


def check_shards(rows, texts, shards=8, slack=None):
    """Every row once, true sizes and checksums, gapless slots, near equal bytes."""
    assert len(rows) == len(texts)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), texts, strict=True):
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    if slack is not None:
        total = sum(size.values())
        assert max(abs(size[k] - total / shards) for k in range(shards)) <= slack * total / shards


def test_sharding_of_the_table(spark):
    d = sorted(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect())
    rows = queries.op1_sharding(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, [r["text"] for r in d], slack=0.05)


def test_sharding_cases(spark):
    rows = [(0, None, "a"), (1, "", "a"), (2, "x" * 200_000, None), *[(i, "the same text over and over", "b") for i in range(3, 600)], *[(i, f"another text {i} " + "é" * (i % 40), "c") for i in range(600, 1200)]]
    out = assign_shards(docs(spark, *rows))
    assert out.columns == ["doc_id", "text", "source", "taken", "_cv_x", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_shards(out.collect(), [t for _, t, _ in rows])
    assert assign_shards(docs(spark, *rows[:1]).limit(0)).count() == 0
    check_shards(assign_shards(docs(spark, *rows[:1])).collect(), [None])
    twins = docs(spark, (None, "a b", None), (None, "a b", None), (4, "c", None))
    assert sorted(r["size"] for r in assign_shards(twins).collect()) == [2, 4, 4]


def test_a_hot_text_fills_shards(spark):
    """Copies of one text that make up most bytes are cut by the second half of the key."""
    out = assign_shards(docs(spark, *[(i, "copy " * 50, "s") for i in range(3000)]), samples=4096, ranges=256).collect()
    check_shards(out, ["copy " * 50] * 3000, slack=0.15)


def test_written_shards(spark, tmp_path):
    out = assign_shards(docs(spark, *[(i, f"text {i}", "s") for i in range(300)]), shards=3)
    write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 300 and {r["shard"] for r in back.collect()} == {0, 1, 2}


def test_splitters_are_searched_right():
    s = [(1, 5), (3, -2), (3, 9), (8, 0)]
    assert [shard_of_key(s, k) for k in [(0, 0), (1, 4), (1, 5), (3, 0), (3, 9), (9, 9)]] == [0, 0, 1, 2, 3, 4]


def plain_mix(rows, weights=(5, 2, 1), most=3, seed=17):
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % 3] for n, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), float(sum(total.values()))
    while left > 1e-9:
        free = [s for s in order if target[s] < most * total[s] - 1e-9]
        if not free:
            break
        w, share, left = sum(weight[s] for s in free), left, 0.0
        for s in free:
            target[s] += share * weight[s] / w
            if target[s] > most * total[s]:
                left += target[s] - most * total[s]
                target[s] = float(most * total[s])
    out = {}
    for i, t, s in rows:
        rate = target[s] / total[s] if total[s] else 0.0
        coin = int(hashlib.md5(f"{seed}:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        out[i] = (size[i], total[s], target[s], size[i] * (int(rate) + (coin < rate - int(rate))))
    return out


def same(got, want):
    assert set(got) == set(want)
    for k, (size, total, target, taken) in want.items():
        assert got[k][:2] == (size, total) and got[k][3] == taken and got[k][2] == pytest.approx(target, rel=1e-9)


def test_mixing_of_the_table(spark):
    d = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source").collect()]
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()}
    same(got, plain_mix(d))
    assert all(taken <= 3 * size for size, _, _, taken in got.values())
    again = {r["doc_id"]: r["taken"] for r in queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()}
    assert again == {k: v[3] for k, v in got.items()}


def test_mixing_cases(spark):
    rows = [(0, None, "a"), (1, "", "b"), (2, "one two", None), (3, "a\x0bb\x0cc d\re", "a"), (4, "x\x1cy \x85 z", "Ä"), (5, "w " * 400, "z"), *[(i, "few words here", "a") for i in range(6, 60)]]
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mix_documents(docs(spark, *rows), carry=False).collect()}
    same(got, plain_mix(rows))
    kept = mix_documents(docs(spark, *rows), emit=True)
    assert kept.columns == docs(spark, *rows[:1]).columns
    times = defaultdict(int)
    for r in kept.collect():
        times[r["doc_id"]] += 1
    assert all(times[i] * size == taken for i, (size, _, _, taken) in got.items() if size)
    assert mix_documents(docs(spark, *rows).limit(0)).count() == 0
    assert "copies" in mix_documents(docs(spark, *rows)).columns


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = compare.views(SF).execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert compare.kinds(got) == compare.kinds(want) and compare.rows(got) == compare.rows(want)
