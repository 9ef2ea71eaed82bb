"""The pipeline's near-dedup stage against all pairs of shingle sets."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from corvane.llm import near_sets
from corvane.llm._common import table


def plain_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(texts):
    """The smallest id of each component of all pairs at 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in sorted(texts.items())}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 5 * len(x & y) >= 4 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_group(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, f"/root/testdata/{sf}").select("doc_id").collect()]
    assert sorted(got) == sorted(plain_kept({r["doc_id"]: r["text"] for r in docs.collect()}))


@pytest.mark.parametrize("common", [1 << 17, 0, 3])
def test_no_similar_pair_is_lost(spark, monkeypatch, common):
    """Families of edited copies, shared lines, chains and short texts; whatever is known of common shingles."""
    monkeypatch.setattr(near_sets, "COMMON", common)
    r = random.Random(7)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [None, "", " \t", "a b", "A  b", "a b c d e", "a b c d e f", "a b c d f"]
    for family in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(12, 160))]
        for _ in range(8):
            words = list(words)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words) + (f" {line}" if r.random() < 0.5 else ""))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x["doc_id"] for x in near_sets.drop_similar(df).collect())
    assert got == sorted(plain_kept(dict(rows))) and len(got) < len(rows)


def test_maps_differ_in_no_more_than_the_sets():
    """For sets of any overlap, small, large and empty: what ``_maps_allow`` rests on; sets that share little differ in more bits than similar ones may."""
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 5000):
        for shared in {0, n // 4, n - n // 10, n}:
            x = np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.int64).view(np.uint64))
            a, b = x[:n], x[n - shared : 2 * n - shared]
            apart = sum(int(v).bit_count() for v in np.bitwise_xor(near_sets.parity_map(a).view(np.uint64), near_sets.parity_map(b).view(np.uint64)))
            assert apart <= len(np.setxor1d(a, b))
            if n == 300 and shared <= n // 4:
                assert apart > (len(a) + len(b)) / 9


def test_later_links_join_labels(spark):
    """Labels joined by more links are those of all links, ids without a label included; links within a component change none."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, label long")
    for links, want in (([(2, 6), (6, 20), (30, 31), (8, 9)], {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 30: 30, 31: 30, 8: 8, 9: 8}), ([(0, 9)], {1: 1, 2: 1, 5: 5, 6: 5, 8: 0, 9: 0, 0: 0}), ([], {1: 1, 2: 1, 5: 5, 6: 5, 8: 8, 9: 8})):
        got = near_sets._joined(labels, spark.createDataFrame(links, "a long, b long")).select("id", "label").collect()
        assert len(got) == len(want) and dict(tuple(r) for r in got) == want


def test_fingerprints_put_pairs_forward(spark):
    """Each set that has another within 3 bits is put forward with such a one: by SimHash and its deletion variants."""
    r, prints = random.Random(4), []
    for _ in range(6):
        base = r.getrandbits(64)
        prints += [base, base] + [base ^ sum(1 << i for i in r.sample(range(64), k)) for k in (1, 2, 3, 4, 9)]
    sets = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "_cv_row long, fp long")
    got = [tuple(x) for x in near_sets.by_fingerprint(sets).collect()]
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 3 for a, b in got)
    told = {x for pair in got for x in pair}
    assert told == {i for i, p in enumerate(prints) if any(i != j and (p ^ q).bit_count() <= 3 for j, q in enumerate(prints))} and len(got) < 2 * len(prints)


def test_shingle_rows_are_not_broadcast(spark, monkeypatch):
    """Rows that come of a set's array are many times what Spark takes from the file that holds it: no join of them by shingle is a broadcast."""
    plans, real = {}, near_sets.materialize

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag)

    monkeypatch.setattr(near_sets, "materialize", noted)
    words = [[f"w{i % 7}_{j}" for j in range(20)] for i in range(30)]
    rows = [(i, " ".join([*w[: i % 15], f"x{i}", *w[i % 15 :]])) for i, w in enumerate(words)]
    near_sets.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for tag in ("near-tried", "near-met"):
        assert "SortMergeJoin [h" in plans[tag] and "BroadcastHashJoin [h" not in plans[tag]
    assert "SortMergeJoin [s" in plans["near-tried"] and "BroadcastHashJoin [s" not in plans["near-tried"]
