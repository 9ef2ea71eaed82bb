"""Language ID and toxicity: held-out accuracy, and the models against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lang_id, queries, toxicity
from corvane.llm._common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, held_out int, _cv_x string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, "x", -1, "y") for i, t, lang in rows], SCHEMA)


def plain_bits(sample, text, order):
    """Code length of a text after the texts of a sample, byte by byte, by method C with exclusion."""
    count = defaultdict(lambda: defaultdict(int))
    for s in sample:
        s = b" " * order + s
        for i in range(order, len(s)):
            for k in range(order + 1):
                count[s[i - k : i]][s[i]] += 1
    bits, t = 0.0, b" " * order + text
    for i in range(order, len(t)):
        refused = set()
        for k in reversed(range(order + 1)):
            left = {x: n for x, n in count.get(t[i - k : i], {}).items() if x not in refused}
            total = sum(left.values()) + len(left)
            if t[i] in left:
                bits -= math.log2(left[t[i]] / total)
                break
            if left:
                bits -= math.log2(len(left) / total)
            refused |= set(left)
        else:
            bits += math.log2(256 - len(refused))
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths_match_the_recursion(order):
    samples = {"a": [b"the cat sat on the mat", b"a cat", b"The end"], "b": ["le chat é là".encode(), b"la table", b"aaaaaaaaab"]}
    counts = {}
    for name, texts in samples.items():
        codes, n = np.unique(np.concatenate([lang_id._codes(np.frombuffer(b" " * order + t, np.uint8), order) for t in texts]), return_counts=True)
        counts[name] = (codes, n.astype(float))
    model = lang_id.PpmModel.fit(counts, order)
    for text in (b"the mat", b"la chatte", "é?".encode(), b"xyz 99", b"\x00\xff", b"", b"aaaaaaaaaaaaaaac", bytes(range(256)), b"the cat sat on the table " * 40):
        got = model.lengths([b"the", text], model.index())[1]
        assert list(got) == pytest.approx([plain_bits(samples[x], text, order) for x in model.languages], rel=1e-5)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    codes, n = np.unique(lang_id._codes(np.frombuffer(b"    some words of a sample of some words", np.uint8)), return_counts=True)
    model = lang_id.PpmModel.fit({"a": (codes, n.astype(float))})
    text = b"some words and other words " * 50
    whole = model.lengths([text], model.index())[0]
    monkeypatch.setattr(lang_id, "_PIECE", 37)
    assert model.lengths([text], model.index())[0] == pytest.approx(whole)


def test_language_id_held_out_accuracy(spark):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "lang", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, SF).collect()}
    assert set(got) == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    known = {x for x, _ in lang.values() if x is not None}
    assert {r["lang_pred"] for r in got.values()} <= known | {"und"}
    judged = [(r["lang_pred"], lang[i][0]) for i, r in got.items() if r["held_out"] and lang[i][0] is not None and r["lang_pred"] != "und"]
    assert len(judged) > 150
    assert sum(a == b for a, b in judged) / len(judged) >= 0.97


def test_language_id_cases(spark):
    en, fr = "the quick brown fox and the dog were in the house with the cat", "le renard brun et le chien sont dans la maison avec le chat"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 34 ...", None), (103, en, None), (104, fr * 3000, None), (105, "dans la maison", "en"), (None, en, "fr")]
    out = lang_id.identify(docs(spark, *rows), carry=True)
    assert set(out.columns) == {"doc_id", "text", "lang", "_cv_x", "held_out", "lang_pred", "score"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104, 105, None)] == ["und", "und", "und", "en", "fr", "fr", "en"]
    assert got[100]["score"] == 0.0 and got[None]["held_out"] is False
    swapped = docs(spark, *rows).withColumn("lang", F.when(F.col("doc_id") == 103, "fr").otherwise(F.col("lang")))
    assert lang_id.identify(docs(spark, *rows).limit(0)).count() == 0
    nothing = lang_id.identify(docs(spark, (1, en, None))).first()
    assert nothing["lang_pred"] == "und" and nothing["score"] == 0.0
    assert swapped.count() == len(rows)


def test_toxicity_on_documents_not_trained_on(spark):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(d, labels.where(F.col("doc_id") % 2 == 0))
    got = {r["doc_id"]: r for r in toxicity.grade_toxicity(d, model=model).collect()}
    judged = [(bool(r["toxic"]), got[r["doc_id"]]["toxic"]) for r in labels.where(F.col("doc_id") % 2 == 1).collect()]
    hits, told, real = sum(a and b for a, b in judged), sum(b for _, b in judged), sum(a for a, _ in judged)
    print("precision", hits / told, "recall", hits / real, "of", real)
    assert real > 150 and hits / told >= 0.9 and hits / real >= 0.9
    assert all(0 <= r["severity"] <= 3 for r in got.values())


def test_cumulative_link_shares_weights():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 2))
    score = 2 * x[:, 0] - x[:, 1] + r.logistic(size=600)
    grades = (score > 0).astype(int) + (score > 2)
    w, cuts = toxicity.fit_cumulative_link(toxicity.SparseRows.of(x), grades, 3)
    assert cuts[0] < cuts[1] and w[0] == pytest.approx(2, abs=0.4) and w[1] == pytest.approx(-1, abs=0.3) and cuts[1] - cuts[0] == pytest.approx(2, abs=0.4)


def plain_features(text):
    """Words as bytes, and their beginnings of 3 to 7 bytes with a star, as often as they come."""
    words = [w.encode() for w in brute.words(text)]
    return Counter([*words, *(w[:n] + b"*" for w in words for n in (3, 4, 5, 6, 7) if len(w) > n)])


def test_toxicity_matches_brute_force(spark):
    """Which features are learned, and every text's severity under the learned model."""
    d = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect() if r["toxic"] is not None}
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    sample = [(bool(labels[i]), set(plain_features(t))) for i, t in d.items() if i in labels and t is not None]
    n, bad = Counter(y for y, _ in sample), Counter(f for y, fs in sample if y for f in fs)
    every = Counter(f for _, fs in sample for f in fs)

    def ratio(f):
        a, b = bad[f], every[f] - bad[f]
        share = every[f] / len(sample)
        cells = [(a, share * n[True]), (b, share * n[False]), (n[True] - a, (1 - share) * n[True]), (n[False] - b, (1 - share) * n[False])]
        return 2 * sum(k * math.log(k / e) for k, e in cells if k)

    assert set(model.weights) == {f for f, c in every.items() if c >= 8 and ratio(f) > 15}
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert set(got) == set(d)
    for i, text in d.items():
        counts = plain_features(text)
        score = sum(model.weights[f] * math.log(1 + c) for f, c in counts.items() if f in model.weights)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds] if counts else [0.0]
        assert got[i]["severity"] == pytest.approx(sum(above), abs=1e-6) and got[i]["toxic_probability"] == pytest.approx(above[0], abs=1e-6)
        assert got[i]["toxic"] == (got[i]["toxic_probability"] >= model.least)


def test_given_grades_are_learned(spark):
    words = ["calm", "rude", "vile", "awful"]
    rows = [(i, f"{words[i % 4]} talk number {i}", None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["severity"] for r in toxicity.grade_toxicity(docs(spark, *rows), labels).collect()}
    assert all(abs(got[i] - i % 4) < 0.4 for i in range(200))


def test_toxicity_cases(spark):
    rows = [(i, ("you idiot clown " if i % 2 else "a fine calm day ") + f"number {i} in the town", None) for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "idiot " * 50_000, None), (None, "calm day", None), (2, "calm day again", None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.grade_toxicity(docs(spark, *rows), labels)
    assert out.columns == ["doc_id", "toxic_probability", "severity", "toxic"]
    found = out.collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and not got[100]["toxic"] and not got[101]["toxic"] and got[102]["toxic"] and not got[None]["toxic"]
    assert toxicity.grade_toxicity(docs(spark, *rows).limit(0), labels).count() == 0
    assert not any(r["toxic"] for r in toxicity.grade_toxicity(docs(spark, *rows), labels.limit(0)).collect())
