"""The curve visits neighbouring cells; recall and exact scores against brute force; awkward rows."""

import math

import numpy as np
import pytest

from fieldmark.llm import curve_ann as A

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (8, 2)])
def test_curve_is_continuous(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    order = np.argsort(A.hilbert_index(cells, bits))
    assert sorted(A.hilbert_index(cells, bits).tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(axis=1)
        rest = [(-s, v) for s, v in zip(scores.tolist(), ids.tolist()) if v != ids[i]]
        out[int(ids[i])] = [(v, -s) for s, v in sorted(rest)[:k]]
    return out


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=np.float64)
    want = brute(ids, x, 20, 20)
    got: dict = {}
    for r in sorted(A.nearest(table).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    place = {int(v): i for i, v in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert math.isclose(s, float(x[place[q]] @ x[place[v]]), abs_tol=1e-12)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(50)]
    good = list(rows)
    rows += [(200, None), (220, []), (240, [0.0] * 5), (260, [1.0, float("nan"), 0.0, 0.0, 0.0]), (280, [1.0, None, 0.0, 0.0, 0.0]), (300, [1.0] * 4), (320, [float("inf")] * 5), (None, [1.0] * 5), rows[0], rows[20]]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, rank string, v int")
    want = brute(np.array([i for i, _ in good]), np.array([v for _, v in good]), 20, 20)
    got: dict = {}
    for r in A.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in found] for q, found in want.items()}
    assert A.nearest(table.filter("vec_id < 3")).count() == 2
    assert A.nearest(table.limit(0)).count() == 0 and A.nearest(table.filter("vec_id = 240")).count() == 0


def test_recall_with_a_long_vector_and_a_dense_cluster(spark):
    rng, n = np.random.default_rng(3), 14_000  # a tenth is more than the least window
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1::3] = x[0] + 0.001 * rng.normal(size=(len(x[1::3]), 64))
    x[5] *= 50
    ids = np.arange(n)
    want = brute(ids, x, 100, 20)
    got: dict = {}
    for r in A.nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>"), every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = {q: len(got[q] & {v for v, _ in found}) / 20 for q, found in want.items()}
    crowded = [s for q, s in share.items() if q % 3 == 1]
    apart = [s for q, s in share.items() if q % 3 != 1]
    assert sum(crowded) / len(crowded) >= 0.9 and sum(apart) / len(apart) >= 0.9
