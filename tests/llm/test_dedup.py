"""Exact and near deduplication against plain versions."""

from __future__ import annotations

import hashlib
import re

import pytest
import xxhash

from corvane.llm import queries, simhash
from corvane.llm._common import table
from corvane.llm.exact_dedup import drop_exact_copies, exact_groups
from corvane.llm.simhash import drop_near_duplicates, near_duplicates, near_links

DOC = "doc_id long, text string, n_words int, _cv_x string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], DOC)


def plain_exact(rows):
    bare = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(bare[i], []).append((-len(t or ""), i))
    return {i: (min(groups[b])[1], len(groups[b]), min(groups[b])[1] == i, hashlib.sha256(b.encode()).hexdigest()) for i, b in bare.items()}


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_exact_cases(spark):
    long = "lorem " * 3000
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "ab c", long + "x", long + "y", long.replace(" ", "") + "x", "é", "é", "a b", "x" * 64, "x" * 65, "x" * 64 + " ", "x" * 576, "x" * 577]
    got = {r["doc_id"]: tuple(r)[1:5] for r in exact_groups(docs(spark, *texts)).collect()}
    want = plain_exact(list(enumerate(texts)))
    assert got == want
    left = drop_exact_copies(docs(spark, *texts))
    assert left.columns == ["doc_id", "text", "n_words", "_cv_x"]
    assert sorted(r[0] for r in left.collect()) == sorted(i for i, x in want.items() if x[2])
    assert exact_groups(docs(spark, "a").limit(0)).count() == 0


def test_exact_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (4, "b")], "doc_id long, text string")
    got = exact_groups(d).collect()
    assert sorted((r["group_size"], r["keep_id"], r["kept"]) for r in got) == [(1, 4, True), (4, 3, False), (4, 3, False), (4, 3, False), (4, 3, True)]


def test_fingerprints(spark):
    texts = [None, "", "one", "one TWO", "One two three", "É é É a b c", "a " * 500 + "b", "x\x1cy z\x85w v q"]
    got = {r["doc_id"]: r["fingerprint"] for r in near_duplicates(docs(spark, *texts)).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert near_duplicates(docs(spark, "a").limit(0)).count() == 0


def test_simhash_matches_brute_force(spark):
    d = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    prints = {i: plain_fingerprint(t) for i, t in sorted(d.items())}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in d}
    left = drop_near_duplicates(table(spark, "/root/testdata/sf0.001", "documents"))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("hot", [4096, 3])
def test_no_link_is_lost(spark, hot):
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(8)]
    prints = set(base) | {b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))) for b in base for _ in range(25)} | {0, 1, 7, 15, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(x) for x in near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("distance", "hot"), [(0, 4096), (4, 4096), (4, 3), (7, 4096)])
def test_no_link_is_lost_at_other_distances(spark, distance, hot):
    import random

    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = set(base) | {b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, distance + 1))) for b in base for _ in range(20)} | {0, 1, 7, 0x300000003, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    got = [tuple(x) for x in near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_are_not_broadcast(spark):
    """Spark sizes the keys by the few bytes of the prints' file; they are 64 rows a print, on both sides."""
    prints = simhash.materialize(spark.range(2000).select(simhash.F.xxhash64("id").alias("fp")), "prints")
    plan = near_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [s" in plan and "BroadcastHashJoin [s" not in plan


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 300), (300, 299), (-5, 300)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(links, "a long, b long")).select("node", "label").collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == -5 for i in (100, 101, 299, 300, -5))


def test_components_take_the_first_round_from_the_links(spark, monkeypatch):
    """A star is told by its links alone: links, hooked labels, jumped labels and the check are all that is written."""
    written, real = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: written.append(tag) or real(df, tag))
    got = simhash.components(spark.createDataFrame([(3, i) for i in range(4, 30)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 3) for i in range(3, 30)} and len(written) <= 4
