"""Derived inputs: the test tables seen as plays, games, registries and predictions.

Team = nation, season = order year, week = order month, offence = the customer's nation,
defence = the supplier's nation. Registry logs come from events and orders.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.expr import correct_flag, cover_label, predicted_side
from fieldmark.operators import compare
from fieldmark.schemas import TEAM_FEATURES

N_TEAMS = 25


def opponent(team_key: Column, season: Column, week: Column) -> Column:
    """Round-robin pairing: the two keys of a game sum to 2 * week + season modulo 25."""
    return F.pmod(2 * week + season - team_key, F.lit(N_TEAMS))


def home_first(season: Column, week: Column) -> Column:
    return (season + week) % 2 == 0


def make_game_id(season: Column, week: Column, away: Column, home: Column) -> Column:
    return F.concat_ws("_", season.cast("string"), F.lpad(week.cast("string"), 2, "0"), away, home)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nation(self) -> DataFrame:
        return self.table("nation")

    def named(self, key: str, name: str, region: str | None = None) -> DataFrame:
        cols = [F.col("n_nationkey").alias(key), F.col("n_name").alias(name)]
        return self.nation.select(*cols, *([F.col("n_regionkey").alias(region)] if region else []))

    @cached_property
    def orders_by_team(self) -> DataFrame:
        """Orders with the customer's nation as team."""
        o = self.table("orders").select(
            "o_orderkey",
            F.col("o_custkey").alias("c_custkey"),
            F.year("o_orderdate").alias("season"),
            F.month("o_orderdate").alias("week"),
        )
        c = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("team_key"))
        return o.join(c, "c_custkey").drop("c_custkey")

    @cached_property
    def plays(self) -> DataFrame:
        line = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_suppkey").alias("s_suppkey"),
            "l_linenumber",
            "l_quantity",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
        )
        supp = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("def_key"))
        flag, number, status = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_linestatus")
        passed = flag == "R"
        other = opponent(F.col("team_key"), F.col("season"), F.col("week"))
        low_home = home_first(F.col("season"), F.col("week"))
        is_low = F.col("team_key") < F.col("opp_key")
        mine_home = low_home == is_low
        home = F.when(mine_home, F.col("posteam")).otherwise(F.col("opponent"))
        away = F.when(mine_home, F.col("opponent")).otherwise(F.col("posteam"))
        return (
            line.join(self.orders_by_team, "o_orderkey")
            .join(supp, "s_suppkey")
            .withColumn("opp_key", other)
            .join(self.named("team_key", "posteam"), "team_key")
            .join(self.named("def_key", "defteam"), "def_key")
            .join(self.named("opp_key", "opponent"), "opp_key")
            .select(
                F.col("o_orderkey").alias("order_id"),
                number.alias("line_no"),
                F.col("s_suppkey").alias("supp_key"),
                F.when(
                    F.col("team_key") == F.col("opp_key"),
                    make_game_id(F.col("season"), F.col("week"), F.lit("BYE"), F.col("posteam")),
                )
                .otherwise(make_game_id(F.col("season"), F.col("week"), away, home))
                .alias("game_id"),
                "posteam",
                "defteam",
                "season",
                "week",
                F.when(passed, "pass").when(flag == "A", "run").otherwise("no_play").alias("play_type"),
                F.when(number <= 4, number).alias("down"),
                F.when(passed & (F.col("l_tax") >= 0.07), 1).otherwise(0).alias("sack"),
                F.when(passed & (status == "F") & (F.col("l_discount") >= 0.08), 1).otherwise(0).alias("qb_hit"),
                (F.col("l_quantity").cast("int") - 15).alias("yards_gained"),
                F.when(
                    ~((number == 7) & (status == "F")),
                    F.round((F.col("l_discount") - F.col("l_tax")) * 100) / 4.0,
                ).alias("epa"),
                F.when(passed & (number <= 3), (F.col("l_quantity") - 25) / 2.0).alias("cpoe"),
            )
        )

    @cached_property
    def raw_plays(self) -> DataFrame:
        """Plays as landed: nullable flags, text numbers, missing sides and types, numeric ids."""
        n = F.col("line_no")
        return self.plays.select(
            (F.col("order_id") * 8 + n).alias("play_id"),
            "game_id",
            "season",
            "week",
            F.when(~((n == 6) & (F.col("yards_gained") % 5 == 0)), F.col("posteam")).alias("posteam"),
            F.when(~((n == 5) & (F.col("yards_gained") % 7 == 0)), F.col("defteam")).alias("defteam"),
            F.when(F.col("play_type") != "no_play", F.col("play_type")).alias("play_type"),
            F.col("down").cast("string").alias("down"),
            F.when(n == 7, "n/a").otherwise(F.col("yards_gained").cast("string")).alias("yards_gained"),
            "epa",
            F.when(n != 5, F.col("qb_hit").cast("double")).alias("qb_hit"),
            F.when(n != 5, F.col("sack").cast("double")).alias("sack"),
            "cpoe",
            F.when(n == 4, "none").when(n == 3, "NaN").otherwise(F.col("supp_key").cast("string")).alias(
                "passer_player_name"
            ),
            F.when(n != 2, F.col("supp_key").cast("double")).alias("rusher_player_id"),
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.orders_by_team.groupBy("team_key", "season", "week").agg(
            (F.count("*") * 7 % 38).cast("int").alias("score")
        )

    @cached_property
    def games(self) -> DataFrame:
        """One round per (season, week), 12 games and a bye."""
        season, week = F.col("season"), F.col("week")
        calendar = self.points.select("season", "week").distinct()
        keys = F.explode(F.sequence(F.lit(0), F.lit(N_TEAMS - 1))).alias("low")
        pairs = calendar.select("season", "week", keys).withColumn("high", opponent(F.col("low"), season, week))
        first = home_first(season, week)
        pairs = pairs.where(F.col("low") < F.col("high")).select(
            "season",
            "week",
            F.when(first, F.col("low")).otherwise(F.col("high")).alias("hk"),
            F.when(first, F.col("high")).otherwise(F.col("low")).alias("ak"),
        )

        def score(key: str, name: str) -> DataFrame:
            return self.points.select(F.col("team_key").alias(key), "season", "week", F.col("score").alias(name))

        hk, ak = F.col("hk"), F.col("ak")
        late = (season == 2001) & (week >= 7)
        played = (
            pairs.join(score("hk", "hs"), ["hk", "season", "week"], "left")
            .join(score("ak", "as"), ["ak", "season", "week"], "left")
            .join(self.named("hk", "home_team", "hr"), "hk")
            .join(self.named("ak", "away_team", "ar"), "ak")
        )
        out = played.select(
            make_game_id(season, week, F.col("away_team"), F.col("home_team")).alias("game_id"),
            "season",
            "week",
            F.make_date(season, week, 1 + hk % 7).alias("game_date"),
            "home_team",
            "away_team",
            F.when(~late, F.col("hs")).alias("home_score"),
            F.when(~late, F.col("as")).alias("away_score"),
            (((hk - ak) % 15).cast("double") / 2.0).alias("home_spread_close"),
            (40.5 + (hk + ak) % 9).cast("double").alias("total_close"),
            F.when(hk % 4 == 0, "dome").when(hk % 4 == 1, "retractable").when(hk % 4 == 2, "outdoors").alias("roof"),
            F.when(hk % 5 != 0, F.col("hr") == F.col("ar")).alias("div_game"),
            F.when(hk % 6 != 0, (30 + week * 4).cast("double")).alias("temp"),
            F.when(ak % 6 != 0, ak.cast("double")).alias("wind"),
            "hk",
            "ak",
        )
        return out.withColumn(
            "home_covered", cover_label(F.col("home_score"), F.col("away_score"), F.col("home_spread_close"))
        )

    @cached_property
    def raw_games(self) -> DataFrame:
        """Games as landed: raw names, text scores with null markers, text flags, mixed ids."""

        def text_score(c: str, marker: str) -> Column:
            return F.coalesce(F.col(c).cast("string"), F.lit(marker)).alias(c)

        hk = F.col("hk")
        return self.games.select(
            "game_id",
            "season",
            "week",
            F.col("game_date").cast("string").alias("gameday"),
            "home_team",
            "away_team",
            text_score("home_score", "nan"),
            text_score("away_score", "None"),
            F.col("home_spread_close").alias("spread_line"),
            F.col("total_close").alias("total_line"),
            F.when(F.col("week") == 12, "POST").otherwise("REG").alias("game_type"),
            "roof",
            F.when(F.col("div_game"), F.when(hk % 2 == 0, "True").otherwise("1"))
            .when(~F.col("div_game"), F.when(hk % 2 == 0, "False").otherwise("0"))
            .alias("div_game"),
            "temp",
            "wind",
            F.when(F.col("season") % 2 == 1, F.concat((hk + 1000).cast("string"), F.lit(".0")))
            .otherwise(F.concat(F.lit("id-"), hk.cast("string")))
            .alias("old_player_id"),
        )

    @cached_property
    def user_games(self) -> DataFrame:
        """Upload keyed by game; a tenth of the games is absent."""
        return self.games.where((F.col("hk") * 3 + F.col("ak") + F.col("week")) % 10 != 0).select(
            "game_id", (F.col("hk") * 2 + F.col("ak")).cast("string").alias("crowd")
        )

    @cached_property
    def user_team_weeks(self) -> DataFrame:
        """Upload keyed by team-week under other names; one team is absent."""
        return self.points.where(F.col("team_key") != 3).join(
            self.named("team_key", "team_name"), "team_key"
        ).select(
            "team_name",
            F.col("season").alias("year"),
            F.col("week").alias("week_number"),
            (F.col("score") / 2.0).alias("travel"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Three runs of fixed scores on the seasons after the first four."""
        hk, ak, week, season = (F.col(c) for c in ("hk", "ak", "week", "season"))
        runs = F.explode(
            F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, a, b in RUN_WEIGHTS])
        ).alias("w")
        first = self.games.agg(F.min("season")).scalar()
        scored = (
            self.games.withColumn("_first", first)
            .where(season >= F.col("_first") + 4)
            .select("*", runs)
            .withColumn(
                "predicted_home_cover_prob",
                ((hk * F.col("w.a") + ak * F.col("w.b") + week * 5 + season) % 100 + 0.5) / 100.0,
            )
        )
        side = predicted_side(F.col("predicted_home_cover_prob"))
        return scored.select(
            F.concat(F.lit("run_p"), F.col("w.r")).alias("run_id"),
            F.concat(F.lit("exp_p"), F.col("w.r") % 2).alias("experiment_id"),
            (season - F.col("_first") - 3).alias("fold"),
            "game_id",
            "season",
            "week",
            "home_team",
            "away_team",
            "home_spread_close",
            "predicted_home_cover_prob",
            side.alias("predicted_side"),
            F.col("home_covered").alias("actual_home_covered"),
            correct_flag(side, F.col("home_covered")).alias("correct"),
            (hk % 3).alias("ol_mismatch_flag"),
        )

    @cached_property
    def prediction_runs(self) -> DataFrame:
        """Run rows of the stored predictions; two stored versions of each run."""
        number = F.substring("run_id", 6, 9).cast("int")
        wins = F.count_if(F.col("correct") == 1)
        base = self.predictions.groupBy("run_id", "experiment_id").agg(
            F.concat(F.lit("scores "), F.max("run_id")).alias("name"),
            F.to_timestamp(F.lit("2002-01-01 00:00:00")).alias("_t0"),
            F.try_divide(wins.cast("double"), F.count("correct")).alias("ats_hit_rate"),
            F.count("correct").alias("n_games_evaluated"),
        )
        versions = F.explode(F.array(F.lit(0), F.lit(1))).alias("v")
        return base.select("*", versions).select(
            "run_id",
            "experiment_id",
            "name",
            (F.col("_t0") + F.make_dt_interval(days=number + F.col("v") * 10)).alias("run_at"),
            (F.col("_t0") + F.make_dt_interval(days=number + F.col("v") * 10, hours=F.lit(1))).alias("completed_at"),
            F.when(F.col("v") == 0, 0.5).otherwise(F.col("ats_hit_rate")).alias("ats_hit_rate"),
            "n_games_evaluated",
            (F.col("v") == 1).alias("gate_passed"),
            F.lit("complete").alias("status"),
            F.format_string(
                '{"home_%s":0.25,"away_%s":0.5,"temp":0.125}',
                _pick(TEAM_FEATURES, number),
                _pick(TEAM_FEATURES, number + 1),
            ).alias("feature_importances"),
        )

    @cached_property
    def config_log(self) -> DataFrame:
        """Every event is a version of its user's experiment config."""
        k = F.get_json_object("props", "$.k").cast("int")
        status = (
            F.when(F.col("event_type") == "signup", "draft")
            .when(F.col("event_type") == "view", "draft")
            .when(F.col("event_type") == "click", "running")
            .when(F.col("event_type") == "purchase", "complete")
            .otherwise("failed")
        )

        def ref(dataset: Column, column: Column) -> Column:
            return F.concat(
                F.lit('{"dataset":"'), dataset, F.lit('","column":"'), column, F.lit('","semantic_name":"'), column, F.lit('"}')
            )

        cur = F.lit("curated")
        named = _pick(TEAM_FEATURES, k * 7 + 1)
        features = F.concat(
            F.lit("["),
            ref(cur, _pick(TEAM_FEATURES, k)),
            F.lit(","),
            ref(cur, F.concat(F.lit("home_"), named)),
            F.lit(","),
            ref(cur, F.concat(F.lit("away_"), named)),
            F.lit(","),
            ref(
                F.concat(F.lit("user_datasets.ds_"), F.col("event_id") % 1600),
                F.concat(F.lit("c"), (k % 6).cast("string")),
            ),
            F.when(k % 5 == 0, F.concat(F.lit(","), ref(cur, F.lit("mystery_metric")))).otherwise(""),
            F.lit("]"),
        )
        method = F.concat(
            F.lit('{"type":"walk_forward","train_seasons":'),
            2 + k % 3,
            F.lit(',"test_seasons":1,"start_season":'),
            1995 + k % 2,
            F.lit(',"end_season":'),
            2000 + k % 2,
            F.lit("}"),
        )
        return self.table("events").select(
            F.concat(F.lit("exp_"), F.col("user_id")).alias("experiment_id"),
            F.col("event_id").alias("seq"),
            F.col("ts").alias("updated_at"),
            F.concat(F.lit("experiment "), F.col("user_id")).alias("name"),
            F.when(F.col("user_id") % 4 == 0, "home_margin").otherwise("home_covered").alias("target"),
            status.alias("status"),
            F.when(F.col("event_type") == "purchase", F.col("value") >= 50).alias("gate_passed"),
            features.alias("features"),
            method.alias("methodology"),
        )

    @cached_property
    def configs(self) -> DataFrame:
        return compare.latest(self.config_log, ["experiment_id"], ["updated_at", "seq"])

    @cached_property
    def runs(self) -> DataFrame:
        """Purchases are finished runs and errors failed ones; every seventh user never ran."""
        k = F.get_json_object("props", "$.k").cast("int")
        done = F.col("event_type") == "purchase"
        rate, n = 0.45 + k / 500.0, 200 + k
        return (
            self.table("events")
            .where(F.col("event_type").isin("purchase", "error") & (F.col("user_id") % 7 != 0))
            .select(
                F.concat(F.lit("run_"), F.col("event_id") - F.col("event_id") % 3).alias("run_id"),
                F.concat(F.lit("exp_"), F.col("user_id")).alias("experiment_id"),
                F.col("event_id").alias("seq"),
                F.concat(F.lit("run of "), F.col("user_id")).alias("name"),
                F.col("ts").alias("run_at"),
                (F.col("ts") + F.make_dt_interval(mins=F.lit(2))).alias("completed_at"),
                F.when(done, "complete").otherwise("failed").alias("status"),
                F.when(done, rate).alias("ats_hit_rate"),
                F.when(done, n).alias("n_games_evaluated"),
                F.when(done, (rate >= 0.54) & (n >= 250)).otherwise(False).alias("gate_passed"),
                (k % 7).alias("folds_complete"),
                F.lit(6).alias("folds_total"),
                (2 + k % 3).alias("training_window_years"),
                F.when(k % 10 == 0, "[SHUFFLE_LABELS=True]").alias("notes"),
                F.when(~done, "model fit failed").alias("error_message"),
                F.format_string(
                    '{"home_%s":%s,"away_%s":%s}',
                    _pick(TEAM_FEATURES, k),
                    (k / 128.0).cast("string"),
                    _pick(TEAM_FEATURES, k),
                    ((100 - k) / 128.0).cast("string"),
                ).alias("feature_importances"),
            )
        )

    @cached_property
    def dataset_log(self) -> DataFrame:
        """Every order is a version of its customer's dataset."""
        status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        return self.table("orders").select(
            F.concat(F.lit("ds_"), F.col("o_custkey")).alias("dataset_id"),
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderdate").alias("updated_at"),
            F.col("o_orderdate").alias("upload_date"),
            F.when(status == "F", "ready").when(status == "O", "uploading").otherwise("mapping").alias("status"),
            F.when(level == "2", "restricted").when(level != "1", "open").alias("license_tag"),
            F.when(level == "5", "game_id")
            .when(level == "3", "team_season_week")
            .when(level == "4", "player_season_week")
            .alias("join_key_type"),
            (F.col("o_orderkey") % 11 == 0).alias("deleted"),
        )

    @cached_property
    def datasets(self) -> DataFrame:
        return compare.latest(self.dataset_log, ["dataset_id"], ["updated_at", "seq"])

    @cached_property
    def dataset_columns(self) -> DataFrame:
        key = F.col("o_orderkey")
        versions = self.table("orders").select(
            F.concat(F.lit("ds_"), F.col("o_custkey")).alias("dataset_id"),
            F.concat(F.lit("c"), key % 6).alias("column_name"),
            key.alias("seq"),
            F.when(key % 4 != 0, F.concat(F.lit("metric "), key % 6)).alias("semantic_name"),
            F.lit(None).cast("string").alias("description"),
            F.when(key % 3 == 0, "categorical").when(key % 3 == 1, "numeric").alias("data_type"),
            (key % 6 == 0).alias("is_join_key"),
            ((key % 100) / 100.0).alias("null_rate"),
        )
        return compare.latest(versions, ["dataset_id", "column_name"], ["seq"])


_views: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """One set of lazy view definitions per session and folder; no data is kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        _views[key] = Views(spark, sf_dir)
    return _views[key]


# (run number, weight of the home key, weight of the away key)
RUN_WEIGHTS = [(1, 37, 17), (2, 13, 29), (3, 7, 3)]


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index % len(names))
