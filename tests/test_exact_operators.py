"""Distributed operators against brute force on small frames."""

import random

import numpy as np
import pandas as pd
import pytest

from fieldmark.operators import compare, folds, mismatch, permute, scoring
from fieldmark.operators.quantiles import quantiles
from fieldmark.operators.registry import current, key_role_errors


@pytest.mark.parametrize("buckets", [2, 8, 256])
def test_quantiles_match_numpy(spark, buckets):
    rng = random.Random(buckets)
    rows = [("a", rng.choice([0.5, 1.0, rng.gauss(0, 3)])) for _ in range(200)] + [("b", 2.0)] * 5 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {
        r["g"]: (r["n_values"], r["q1"], r["q9"])
        for r in quantiles(df, "x", {"q1": 0.1, "q9": 0.9}, by=["g"], buckets=buckets).collect()
    }
    a = [x for g, x in rows if g == "a"]
    assert got["a"][0] == 200
    assert got["a"][1:] == pytest.approx(tuple(np.quantile(a, [0.1, 0.9])))
    assert got["b"] == (5, 2.0, 2.0)
    assert "c" not in got


def test_expanding_quantiles_match_pandas(spark):
    rng = random.Random(3)
    rows = [(s, w, rng.gauss(s, 2)) for s in (1, 2) for w in range(1, 6) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "season int, week int, x double")
    got = {(r["season"], r["week"]): r["p"] for r in quantiles(df, "x", {"p": 0.75}, by=["season"], order="week").collect()}
    pdf = pd.DataFrame(rows, columns=["season", "week", "x"])
    for (s, w), value in got.items():
        pool = pdf[(pdf.season == s) & (pdf.week <= w)].x
        assert value == pytest.approx(pool.quantile(0.75))
    assert len(got) == 10


@pytest.mark.parametrize("order", [None, "week"])
@pytest.mark.parametrize("buckets,ranked_rows", [(4, 3), (2, 60)])
def test_quantiles_cut_again_match_pandas(spark, order, buckets, ranked_rows):
    rng = random.Random(buckets)
    draw = lambda s: rng.choice([1.0, 2.0, rng.gauss(s, 2), rng.lognormvariate(0, 4)])
    rows = [(s, w, draw(s or 0)) for s in (1, None) for w in range(1, 5) for _ in range(rng.randint(20, 60))]
    rows += [(3, w, 5.0) for w in range(1, 5)] + [(4, 1, None)] + [(5, w, 0.0 if w < 4 else 9.0) for w in range(1, 5)]
    df = spark.createDataFrame(rows, "season int, week int, x double")
    found = quantiles(df, "x", {"a": 0.0, "b": 0.3, "c": 1.0}, by=["season"], order=order, buckets=buckets, ranked_rows=ranked_rows)
    got = {(r["season"], r["week"] if order else 4): (r["n_values"], r["a"], r["b"], r["c"]) for r in found.collect()}
    for (s, w), values in got.items():
        pool = [x for t, v, x in rows if t == s and v <= w]
        assert values[0] == len(pool)
        assert values[1:] == pytest.approx(tuple(np.quantile(pool, [0, 0.3, 1])))
    assert len(got) == (16 if order else 4)


def test_a_huge_group_is_cut_until_ranked_buckets_are_small(spark, monkeypatch):
    from fieldmark.operators import quantiles as module

    seen, narrow = [], module._narrowed

    def watched(*args):
        seen.append(narrow(*args))
        return seen[-1]

    monkeypatch.setattr(module, "_narrowed", watched)
    df = spark.range(1_000_000).selectExpr("pow(double(id), 3) as x", "id % 3 as w")
    got = quantiles(df, "x", {"q1": 0.25, "q3": 0.75}, ranked_rows=500).first()
    assert got["n_values"] == 1_000_000
    assert (got["q1"], got["q3"]) == pytest.approx(tuple(np.quantile(np.arange(1e6) ** 3, [0.25, 0.75])), rel=1e-12)
    counts = seen[0][0]
    sizes = [r["count"] for r in counts.groupBy("_path").count().collect()]
    assert sizes and max(sizes) <= 500 and len(sizes) <= 4  # values of other buckets are gone


def brute_z(pdf, col):
    out = {}
    for r in pdf.itertuples():
        pool = pdf[(pdf.season == r.season) & (pdf.week <= r.week)]
        values = pd.concat([pool[f"home_{col}"], pool[f"away_{col}"]]).dropna()
        sd = values.std(ddof=1)
        for side in ("home", "away"):
            v = getattr(r, f"{side}_{col}")
            out[(r.game_id, side)] = (v - values.mean()) / sd if sd > 1e-9 else 0.0
    return out


def test_expanding_zscores_match_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (f"{s}-{w}-{i}", s, w, 0.3 if w == 1 else rng.gauss(0, 1), 0.3 if w == 1 else rng.gauss(0, 1))
        for s in (1, 2)
        for w in range(1, 5)
        for i in range(3)
    ]
    cols = ["game_id", "season", "week", "home_x", "away_x"]
    df = spark.createDataFrame(rows, "game_id string, season int, week int, home_x double, away_x double")
    want = brute_z(pd.DataFrame(rows, columns=cols), "x")
    for r in mismatch.expanding_zscores(df, ["x"]).collect():
        assert r["home_x_z"] == pytest.approx(want[(r["game_id"], "home")], abs=1e-9)
        assert r["away_x_z"] == pytest.approx(want[(r["game_id"], "away")], abs=1e-9)


def test_small_pools_carry_no_flag(spark):
    names = [f"{s}_{c}" for s in ("home", "away") for c in mismatch.COMPOSITE_INPUTS]
    df = spark.createDataFrame([("g", 1, 1, *[float(i) for i in range(8)])], ["game_id", "season", "week", *names])
    assert mismatch.mismatch_flag(df).first()["ol_mismatch_flag"] == 0


def test_positions_are_a_permutation_of_each_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = permute.hash_positions(df, ["g"], ["k"], 1, "pos", slice_rows=20).toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part.pos) == list(range(1, len(part) + 1)), g
    again = permute.hash_positions(df.repartition(5), ["g"], ["k"], 1, "pos", slice_rows=20).toPandas()
    merged = got.merge(again, on=["g", "k"])
    assert (merged.pos_x == merged.pos_y).all()


def test_shuffled_labels_keep_the_season_counts_and_move(spark):
    rows = [(f"g{i}", 2000 + i % 2, [True, False, None][i % 3]) for i in range(90)]
    games = spark.createDataFrame(rows, "game_id string, season int, home_covered boolean")
    out = permute.shuffle_labels(games, 4).toPandas()
    before = games.toPandas()
    assert len(out) == 90 and out.game_id.is_unique
    for s in (2000, 2001):
        a = before[before.season == s].home_covered.astype("object").fillna("push").value_counts()
        b = out[out.season == s].home_covered.astype("object").fillna("push").value_counts()
        assert a.to_dict() == b.to_dict()
    both = before.merge(out, on="game_id")
    assert (both.home_covered_x.astype(str) != both.home_covered_y.astype(str)).any()


def test_permuted_copies_change_only_their_feature(spark):
    rows = [(1, f"g{i}", float(i), float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "fold int, game_id string, a double, b double")
    out = permute.permuted_copies(df, ["a", "b"], ["fold"], ["game_id"], 2).toPandas()
    assert len(out) == 80
    merged = out.merge(df.toPandas(), on="game_id", suffixes=("", "_0"))
    only_a, only_b = merged[merged.permuted_feature == "a"], merged[merged.permuted_feature == "b"]
    assert (only_a.b == only_a.b_0).all() and (only_b.a == only_b.a_0).all()
    assert sorted(only_a.a) == sorted(only_a.a_0) and (only_a.a != only_a.a_0).any()


def test_latest_breaks_ties_by_the_later_column(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 5, 0, None)], "k string, t int, seq int, v string")
    got = {r["k"]: (r["t"], r["seq"], r["v"]) for r in compare.latest(df, ["k"], ["t", "seq"]).collect()}
    assert got == {"a": (1, 2, "y"), "b": (5, 0, None)}


def test_tombstones_hide_a_key(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, False), ("a", 2, 2, True), ("b", 1, 1, False)], "id string, updated_at int, seq int, deleted boolean"
    )
    assert [r["id"] for r in current(log, "id").collect()] == ["b"]


def test_fold_list_matches_the_standard_six():
    got = folds.fold_list(2015, 2024, 4)
    assert got == [(t, t - 4, t - 1) for t in range(2019, 2025)]
    assert folds.fold_list(2015, 2018, 4) == []
    assert [f[0] for f in folds.fold_list(2015, 2024, 4, step=2)] == [2019, 2021, 2023]


def test_universe_guard(spark):
    df = spark.range(10).selectExpr("CAST(id AS INT) AS week", "1 AS div_game")
    with pytest.raises(ValueError, match="fewer than"):
        folds.filter_universe(df, {"field": "week", "operator": "gte", "value": "5"})
    with pytest.raises(ValueError, match="unsupported"):
        folds.universe_condition("home_team", "eq", 1)
    assert folds.filter_universe(df, {"field": "div_game", "operator": "eq", "value": "true"}, 5).count() == 10


PRED = "fold int, home_spread_close double, predicted_home_cover_prob double, actual_home_covered boolean, correct int"


def test_pushes_leave_the_denominator(spark):
    df = spark.createDataFrame(
        [(1, 3.0, 0.9, True, 1), (1, 3.0, 0.2, True, 0), (1, 3.0, 0.6, None, None)], PRED
    )
    row = scoring.fold_metrics(df).first()
    assert (row["wins"], row["losses"], row["pushes"], row["n_games"], row["hit_rate"]) == (1, 1, 1, 2, 0.5)
    assert row["model_log_loss"] == pytest.approx((-np.log(0.9) - np.log(0.2)) / 2)


def test_calibration_edges_and_equal_probabilities(spark):
    rows = [(1, 0.0, p, True, 1) for p in (0.0, 0.1, 0.1000001, 1.0)]
    out = {r["bin"]: r["n_games"] for r in scoring.calibration(spark.createDataFrame(rows, PRED)).collect()}
    assert out == {0: 2, 1: 1, 9: 1}
    same = spark.createDataFrame([(1, 0.0, 0.5, True, 1)] * 3, PRED)
    assert [(r["bin"], r["n_games"]) for r in scoring.calibration(same).collect()] == [(0, 3)]


def test_empty_spread_bands_stay(spark):
    df = spark.createDataFrame([(1, -7.0, 0.9, True, 1)], PRED)
    out = {r["spread_bucket"]: (r["n_games"], r["hit_rate"]) for r in scoring.spread_slices(df).collect()}
    assert out == {"<=3": (0, None), "(3,7]": (1, 1.0), "(7,10]": (0, None), ">10": (0, None)}


def test_key_roles(spark):
    df = spark.createDataFrame(
        [("a", "game_id", ["game_id"]), ("b", "team_season_week", ["team", "week"]), ("c", "other", ["x"])],
        "dataset_id string, join_key_type string, roles array<string>",
    )
    got = {r["dataset_id"]: (r["missing"], r["extra"]) for r in key_role_errors(df).collect()}
    assert got == {"b": (["season"], []), "c": ([], ["x"])}
