"""What is resolved on the driver: date math, minimum_should_match, patterns, stems, edit distance, intervals, formats."""

from __future__ import annotations

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions import hashing, patterns, positions
from corvane.functions.datemath import parse_duration_ms, resolve
from corvane.functions.stem import porter
from corvane.plans.render import filter_path, written

NOW = datetime(2024, 3, 15, 13, 45, 30)


@pytest.mark.parametrize(
    ("text", "up", "want"),
    [
        ("now", False, "2024-03-15T13:45:30"), ("now-1d/d", False, "2024-03-14T00:00:00"), ("now/w", False, "2024-03-11T00:00:00"), ("now/M", True, "2024-03-31T23:59:59.999000"),
        ("2024-01-31||+1M", False, "2024-02-29T00:00:00"), ("2024-01-31||+1M/M", True, "2024-02-29T23:59:59.999000"), ("2024", True, "2024-12-31T23:59:59.999000"), ("2024-02", False, "2024-02-01T00:00:00"),
        ("2024-02-10T10:00:00Z", True, "2024-02-10T10:00:00"), ("2024-02-10T10:00:00+09:00", False, "2024-02-10T01:00:00"), ("1707561000000", False, "2024-02-10T10:30:00"), ("2024-02-10||-2h-30m", False, "2024-02-09T21:30:00"),
    ],
)
def test_date_math(text, up, want):
    assert resolve(text, now=NOW, round_up=up).isoformat() == want


def test_date_patterns():
    assert resolve("15/02/2024", fmt="dd/MM/yyyy", round_up=True) == datetime(2024, 2, 15, 23, 59, 59, 999000)
    assert resolve("20240215", fmt="yyyyMMdd") == datetime(2024, 2, 15)
    assert resolve("2024-02-15 10:11", fmt="yyyy||yyyy-MM-dd HH:mm", time_zone="+09:00") == datetime(2024, 2, 15, 1, 11)
    assert resolve("2024-03-10", time_zone="America/New_York") == datetime(2024, 3, 10, 5) and resolve("2024-03-11", time_zone="America/New_York") == datetime(2024, 3, 11, 4)
    assert written(datetime(2024, 2, 5, 3, 4, 5, 6000), "yyyy/MM/dd'T'HH:mm:ss.SSS||yyyy") == "2024/02/05T03:04:05.006"
    with pytest.raises(ValueError):
        resolve("soon")
    assert parse_duration_ms("90m") == 5_400_000


@pytest.mark.parametrize(("spec", "n", "want"), [(2, 5, 2), ("-1", 5, 4), ("75%", 5, 3), ("-25%", 5, 4), ("3<90%", 3, 3), ("3<90%", 10, 9), ("2<-25% 9<-3", 2, 2), ("2<-25% 9<-3", 8, 6), ("2<-25% 9<-3", 12, 9), ("-10", 3, 0)])
def test_minimum_should_match(spec, n, want):
    assert patterns.minimum_should_match(spec, n) == want


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("ab.*", ["ab", "abc"], ["xab", "a"]), ("a|bc", ["a", "bc"], ["ac"]), ("<8-12>", ["8", "10", "12"], ["7", "13", "010"]), ("<008-012>", ["009", "012"], ["9"]), ("~(ab)", ["a", "abc", ""], ["ab"]), ("@&~(x)", ["", "xx"], ["x"]), ("a&.*", ["a"], ["b"]), ("[a-c]{2}", ["ab"], ["a", "ad"]), ('"a.b"', ["a.b"], ["axb"]), ("^a$", ["^a$"], ["a"])],
)
def test_automaton_patterns(pattern, yes, no):
    p = re.compile(patterns.lucene(pattern))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


def test_wildcards():
    p = re.compile(patterns.wildcard(r"a*b?\*"))
    assert p.search("axxbc*") and p.search("abc*") and not p.search("abcd") and not p.search("xabc*")


def test_porter():
    words = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam predication:predic triplicate:triplic formative:form formalize:formal electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustment:adjust adoption:adopt activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    for pair in words.split():
        word, stem = pair.split(":")
        assert porter(word) == stem, word


def test_edit_distance():
    assert [positions.osa(a, b, 2) for a, b in (("abc", "acb"), ("abc", "abc"), ("ca", "abc"), ("kitten", "sitting"), ("", "ab"))] == [1, 0, 3, 3, 2]
    assert [positions.fuzziness("AUTO", t) for t in ("ab", "abc", "abcdef")] == [0, 1, 2] and positions.fuzziness("AUTO:2,4", "abcd") == 2


def test_intervals():
    tokens = "the quick brown fox jumps over the lazy dog the end".split()
    match = lambda *t, mode="unordered", gaps=-1: {"kind": "match", "terms": list(t), "mode": mode, "max_gaps": gaps}
    assert positions.evaluate_intervals(match("the", "dog", mode="ordered"), tokens) == [(6, 8)]
    assert positions.evaluate_intervals(match("dog", "fox", gaps=4), tokens) == [(3, 8)]
    assert positions.evaluate_intervals(match("dog", "fox", gaps=3), tokens) == []
    assert positions.evaluate_intervals({**match("the"), "filter": ("not_after", match("dog"))}, tokens) == [(0, 0), (6, 6)]
    assert positions.evaluate_intervals({"kind": "any_of", "rules": [match("fox"), match("quick", "fox", mode="ordered")]}, tokens) == [(3, 3)]


def test_intervals_of_long_texts_take_linear_time():
    """Every pair of such tokens would be 36 million."""
    word = lambda t: {"kind": "match", "terms": [t], "mode": "ordered", "max_gaps": -1}
    rule = {"kind": "all_of", "rules": [word("a"), word("b")], "mode": "ordered", "max_gaps": 1}
    began = time.process_time()
    assert len(positions.evaluate_intervals(rule, ["a", "b", "c"] * 6000)) == 6000
    assert len(positions.evaluate_intervals({"kind": "any_of", "rules": [word("a"), rule]}, ["a", "b", "c"] * 6000)) == 6000
    assert time.process_time() - began < 3


def test_built_in_intervals_agree(spark):
    """Rules told by built-ins are those of the plain evaluator; they need no Python, and no others are told so."""
    r = random.Random(8)
    texts = [[r.choice(["of", "the", "then", "a\nb", "other", "tha"]) for _ in range(r.randrange(9))] for _ in range(150)] + [None, [], ["of", None, "the"]]
    word = lambda *t, gaps=-1: {"kind": "match", "terms": list(t), "mode": "ordered", "max_gaps": gaps}
    th, line, either = {"kind": "regex", "pattern": "(?s)th.*"}, {"kind": "regex", "pattern": "(?s)^a.b$"}, {"kind": "any_of", "rules": [word("of"), {"kind": "regex", "pattern": "(?s)^the$"}]}
    row = lambda *rules, gaps=0: {"kind": "all_of", "rules": list(rules), "mode": "ordered", "max_gaps": gaps}
    rules = [word("of"), th, line, either, row(word("of"), th), row(th, th, th), row(either, th, word("of")), word("of", "the", "then", gaps=0), {"kind": "any_of", "rules": [row(word("of"), th), line]}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t array<string>")
    found = df.select("id", *[positions.intervals(F.col("t"), x).alias(f"r{k}") for k, x in enumerate(rules)])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for got, ts in zip(found.orderBy("id").collect(), texts, strict=True):
        if ts is None or None not in ts:
            assert [*got[1:]] == [bool(ts is not None and positions.evaluate_intervals(x, ts)) for x in rules], ts
        else:
            assert got["r1"] is True and got["r4"] is False
    for rule in (row(word("of"), th, gaps=1), {**word("of"), "filter": ("before", th)}, {"kind": "fuzzy", "term": "the", "edits": 1}):
        assert positions._built_in(F.col("t"), rule) is None


def test_filter_path():
    body = {"hits": {"total": 1, "hits": [{"_id": "1", "_source": {"a": 1, "b": {"c": 2}}}]}, "took": 3}
    assert filter_path(body, "hits.hits._source.b") == {"hits": {"hits": [{"_source": {"b": {"c": 2}}}]}}
    assert filter_path(body, "**.c") == {"hits": {"hits": [{"_source": {"b": {"c": 2}}}]}}
    assert filter_path(body, "-hits.hits._source,-took") == {"hits": {"total": 1, "hits": [{"_id": "1"}]}}
    assert filter_path(body, "t*") == {"took": 3}


def plain_murmur(data, seed):
    rotated = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    stirred = lambda k: rotated(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotated(h ^ stirred(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= stirred(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return (h ^ h >> 16) - (1 << 32 if h ^ h >> 16 > 0x7FFFFFFF else 0)


def test_murmur3(spark):
    assert plain_murmur(b"hello", 0) == 0x248BFA47
    texts = ["", "a", "ab", "abc", "abcd", "hello, world", "héllo", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for seed in (0, 31, 0xFFFFFFFF):
        got = [r[0] for r in df.select(hashing.murmur3(F.encode("t", "UTF-8"), seed)).collect()]
        assert got == [*(plain_murmur(t.encode(), seed) for t in texts), None]


def test_mix64_and_encoded_ids(spark):
    values = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789012]
    want = []
    for v in values:
        u = v % 2**64
        u = (u ^ u >> 32) * 0x4CD6944C5CC20B6D % 2**64
        u = (u ^ u >> 29) * 0xFC12C5B19D3259E9 % 2**64
        want.append((u ^ u >> 32) - (2**64 if u >= 2**63 else 0))
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(hashing.mix64(F.col("v"))).collect()] == want
    ids = {"12345": "FE12345F", "1234": "FE1234", "abcd": "69B71D", "_-AQ": "FDFFE010", "hello, you": "FF68656C6C6F2C20796F75", "": "FF"}
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(F.hex(hashing.encoded_id(F.col("i")))).collect()] == list(ids.values())
