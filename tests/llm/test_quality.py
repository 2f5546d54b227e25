"""Counts and descent against plain versions; held-out accuracy; awkward rows."""

import numpy as np
import pyarrow as pa

from fieldmark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_grams_are_sets_per_text():
    found = Q.grams(pa.array(["a b a b", None, "", "a b a b", "A! a!!", "x x"]))
    per = [found.place[found.first[k] : found.first[k + 1]] for k in range(6)]
    assert [len(p) for p in per[1:3]] == [0, 0]
    assert per[0].tolist() == per[3].tolist() and len(set(per[0].tolist())) == len(per[0])
    # x x: one word, one shape, a pair of each, a repeat
    assert len(per[5]) == 5
    assert Q.grams(pa.array(["x" * 600_000 + " y", "z"])).first[-1] > 0


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(0)
    ratio = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(ratio[r].sum() + rng.normal() > 0) for r in rows])
    w, bias = Q.fit_hinge(rows, labels, ratio, rounds=400)
    y = np.where(labels > 0, 1, -1)
    cost = 60 / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 30] = 1

    def objective(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best = objective(np.append(w, bias))
    for _ in range(300):
        assert objective(np.append(w, bias) + rng.normal(size=31) * 0.02) > best - 1e-2


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.judge(docs, labels)
    assert got.count() == 1000
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 90
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "a b", 1.0), (3, "a b", 1.0), (4, "!! " * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (4, 0), (None, 1), (9, 1), (2, 7)], "doc_id long, quality int")
    got = Q.judge(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in Q.judge(docs, labels.limit(0)).collect()} == {0.5}
    many = spark.createDataFrame([(i, f"w{i} v") for i in range(20)], "doc_id long, text string")
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in Q.judge(many, ones).collect())
    assert Q.judge(docs.limit(0), labels).count() == 0
