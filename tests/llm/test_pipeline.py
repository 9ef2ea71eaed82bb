"""The corpus pipeline stage by stage against plain versions, on each stage's own input."""

from __future__ import annotations

from collections import Counter

import brute
import pytest
from test_near_sets import plain_kept
from test_shares import check_shards, plain_mix

import corpus_pipeline
from corvane.llm._common import materialize, table
from corvane.llm.lang_id import identify

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of the first stage and the output of each."""
    docs = [table(spark, SF, "documents")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.append(materialize(stage(spark, docs[-1], SF), f"test{n}"))
    return docs


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(stages):
    assert all(d.columns == COLUMNS for d in stages[:-1])
    assert set(COLUMNS) < set(stages[-1].columns)


def test_language_stage(stages):
    before, after = {r[0]: r for r in rows(stages[0])}, {r[0]: r for r in rows(stages[1])}
    found = {r["doc_id"]: r["lang_pred"] for r in identify(stages[0]).collect()}
    gone = {i for i, (_, text, *_) in before.items() if not any(c.isalpha() for c in text or "")}
    assert set(after) == set(before) - gone
    assert all(after[i] == (i, before[i][1], found[i], *before[i][3:]) for i in after)


def test_near_dedup_stage(stages):
    before, after = {r[0]: r for r in rows(stages[1])}, {r[0]: r for r in rows(stages[2])}
    keep = plain_kept({i: r[1] for i, r in before.items()})
    assert after == {i: before[i] for i in keep} and len(after) < len(before)


def test_decontamination_stage(spark, stages):
    before, after = {r[0]: r for r in rows(stages[2])}, {r[0]: r for r in rows(stages[3])}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = brute.contamination([(i, r[1]) for i, r in before.items()], items)
    assert after == {i: r for i, r in before.items() if not bad[i][4]} and len(after) < len(before)


def test_mixing_stage(stages):
    before = rows(stages[3])
    want = plain_mix([(r[0], r[1], r[3]) for r in before])
    got = Counter(rows(stages[4]))
    assert {r[0]: n for r, n in got.items()} == {i: taken // size for i, (size, _, _, taken) in want.items() if taken}
    assert set(got) <= set(before)


def test_sharding_stage(stages):
    out = stages[5].collect()
    assert Counter(rows(stages[5])) == Counter(rows(stages[4]))
    check_shards(out, [t for _, t in sorted((r[0], r[1]) for r in rows(stages[4]))])


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.columns) == sorted(stages[-1].columns)
    assert Counter(rows(got)) == Counter(rows(stages[-1]))


def test_hard_rows_go_through(spark):
    """Nulls in every column, repeated rows and an empty table."""
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "some words that are here", None, None, 5), (1, "some words that are here", None, None, 5), (2, "", "en", "a", 0)], table(spark, SF, "documents").schema)
    for docs in (table(spark, SF, "documents").unionByName(odd), odd.limit(0), odd):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialize(stage(spark, docs, SF), f"odd{n}")
        docs.count()
