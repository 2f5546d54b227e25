"""Catalogue and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.checks.register import query
from fieldmark.checks.sql_views import NAMES, VIEWS
from fieldmark.operators import catalog, profile, registry, serve
from fieldmark.schemas import GAME_CONTEXT
from fieldmark.session import materialise

CONTEXT = "['rest_differential', 'div_game', 'roof_dome', 'temp', 'wind']"
VIEWS["v_active"] = f"""
SELECT unnest(list_concat(list_transform({NAMES}, lambda x: concat('home_', x)), list_transform({NAMES}, lambda x: concat('away_', x)), {CONTEXT})) AS semantic_name
"""
VIEWS["v_ufeat"] = """
SELECT concat('user_datasets.', c.dataset_id, '.', c.column_name) AS feature_id, COALESCE(c.semantic_name, c.column_name) AS semantic_name,
  concat('user_datasets.', c.dataset_id) AS dataset, COALESCE(c.data_type, 'numeric') AS data_type, COALESCE(d.join_key_type, 'game_id') AS join_key_type,
  COALESCE(d.license_tag, 'open') AS license_tag, FALSE AS deprecated
FROM v_dcols c JOIN v_ds d USING (dataset_id) WHERE d.status = 'ready' AND NOT c.is_join_key
"""
VIEWS["v_allfeat"] = f"""
SELECT concat('curated.', semantic_name) AS feature_id, semantic_name, 'curated' AS dataset, 'numeric' AS data_type, 'game_id' AS join_key_type,
  'open' AS license_tag, FALSE AS deprecated FROM v_active
UNION ALL SELECT concat('curated.', n), n, 'curated', 'numeric', 'game_id', 'open', TRUE FROM (SELECT unnest({NAMES}) AS n) t
UNION ALL SELECT * FROM v_ufeat
"""
_FEATURE = "feature_id semantic_name dataset data_type join_key_type license_tag deprecated:b"

# --- catalogue ----------------------------------------------------------------------------


@query("k1_catalog_use", "semantic_name configs:i", """
SELECT a.semantic_name, COUNT(DISTINCT r.experiment_id) AS configs FROM v_active a
LEFT JOIN v_refs r ON r.dataset = 'curated' AND r."column" = a.semantic_name GROUP BY 1""")
def _k1(v):
    """Active catalogue entries with the number of configs that use each."""
    refs = catalog.feature_refs(v.configs).where("dataset = 'curated'").select(F.col("column").alias("semantic_name"), "experiment_id")
    return catalog.active_catalog(v.spark).join(refs, "semantic_name", "left").groupBy("semantic_name").agg(
        F.countDistinct("experiment_id").alias("configs")
    )


@query("k2_tombstone_use", "semantic_name deprecated_reason configs:i", f"""
SELECT t.n AS semantic_name, 'Feature removed from curated catalog during v2 rebuild' AS deprecated_reason, COUNT(DISTINCT r.experiment_id) AS configs
FROM (SELECT unnest({NAMES}) AS n) t LEFT JOIN v_refs r ON r.dataset = 'curated' AND r."column" = t.n GROUP BY 1, 2""")
def _k2(v):
    refs = catalog.feature_refs(v.configs).where("dataset = 'curated'").select(F.col("column").alias("semantic_name"), "experiment_id")
    return catalog.deprecated_catalog(v.spark).join(refs, "semantic_name", "left").groupBy("semantic_name", "deprecated_reason").agg(
        F.countDistinct("experiment_id").alias("configs")
    )


@query("g4_full_catalog", _FEATURE, "SELECT * FROM v_allfeat")
def _g4(v):
    return catalog.list_features(v.datasets, v.dataset_columns, include_deprecated=True)


@query("k3_filtered_catalog", _FEATURE, "SELECT * FROM v_allfeat WHERE NOT deprecated AND data_type = 'numeric' AND join_key_type = 'game_id'")
def _k3(v):
    return catalog.list_features(v.datasets, v.dataset_columns, data_type="numeric", join_key_type="game_id")


@query("c13_user_features", _FEATURE, "SELECT * FROM v_ufeat")
def _c13(v):
    return catalog.user_features(v.datasets, v.dataset_columns)


@query("k4_deprecated_refs", "experiment_id name deprecated_reason", f"""
SELECT experiment_id, "column" AS name, 'Feature removed from curated catalog during v2 rebuild' AS deprecated_reason FROM v_refs
WHERE dataset = 'curated' AND "column" IN (SELECT unnest({NAMES}))""")
def _k4(v):
    return catalog.deprecated_refs(v.configs)


@query("k4_deprecated_flag", "experiment_id has_deprecated_features:b", f"""
SELECT c.experiment_id, BOOL_OR(r."column" IN (SELECT unnest({NAMES}))) AS has_deprecated_features
FROM v_cfg c JOIN v_refs r USING (experiment_id) GROUP BY 1""")
def _k4_flag(v):
    return catalog.flag_deprecated(v.configs)


_ORDER = f"list_position({NAMES}, b)"


@query("k5_resolved_columns", "experiment_id position:i model_column", f"""
SELECT experiment_id, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY block, pos) AS position, model_column FROM (
  SELECT w.experiment_id, s.block, w.pos, concat(s.side, '_', w.base) AS model_column
  FROM (SELECT experiment_id, regexp_replace("column", '^(home|away)_', '') AS base, MIN(pos) AS pos FROM v_refs WHERE dataset = 'curated' GROUP BY 1, 2) w
  CROSS JOIN (VALUES (0, 'home'), (1, 'away')) AS s(block, side) WHERE w.base IN (SELECT unnest({NAMES}))
  UNION ALL SELECT c.experiment_id, 2, t.i, t.n FROM v_cfg c CROSS JOIN (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate([*GAME_CONTEXT, "rest_differential"]))}) AS t(i, n)
) u WHERE experiment_id NOT IN (SELECT experiment_id FROM v_refs WHERE dataset = 'curated'
  AND regexp_replace("column", '^(home|away)_', '') NOT IN (SELECT unnest({NAMES})) AND "column" NOT IN ({", ".join(f"'{c}'" for c in catalog.CONTEXT_ENTRIES)}))""")
def _k5(v):
    return catalog.resolve_all(v.configs)


@query("k6_importance_rows", "run_id seq:i feature importance:f", """
SELECT run_id, seq, concat('home_', imp_name) AS feature, k / 128.0 AS importance FROM v_runs
UNION ALL SELECT run_id, seq, concat('away_', imp_name), (100 - k) / 128.0 FROM v_runs""")
def _k6(v):
    from fieldmark.operators.compare import importance_long

    keyed = v.runs.withColumn("run_id", F.concat_ws("|", "run_id", F.col("seq").cast("string")))
    parts = F.split("run_id", "\\|")
    return importance_long(keyed).select(parts[0].alias("run_id"), parts[1].cast("bigint").alias("seq"), "feature", "importance")


@query("c15_reference_errors", "experiment_id dataset column problem", f"""
SELECT r.experiment_id, r.dataset, r."column",
  CASE WHEN r.dataset = 'curated' THEN 'unknown_feature' WHEN d.dataset_id IS NULL THEN 'dataset_missing'
       WHEN d.status <> 'ready' THEN 'dataset_not_ready' ELSE 'unknown_column' END AS problem
FROM v_refs r LEFT JOIN v_ds d ON r.dataset = concat('user_datasets.', d.dataset_id)
LEFT JOIN v_dcols c ON c.dataset_id = d.dataset_id AND c.column_name = r."column"
WHERE (r.dataset = 'curated' AND r."column" = 'mystery_metric')
   OR (r.dataset <> 'curated' AND (d.dataset_id IS NULL OR d.status <> 'ready' OR c.column_name IS NULL))""")
def _c15(v):
    return catalog.reference_errors(v.configs, v.datasets, v.dataset_columns)


@query("g5_unknown_columns", "column_name n:i", f"""
SELECT "column" AS column_name, COUNT(*) AS n FROM v_refs WHERE dataset = 'curated' AND "column" NOT IN (SELECT semantic_name FROM v_active)
  AND "column" NOT IN (SELECT unnest({NAMES})) GROUP BY 1""")
def _g5(v):
    known = catalog.active_catalog(v.spark).unionByName(catalog.deprecated_catalog(v.spark)).select(F.col("semantic_name").alias("column_name"))
    refs = catalog.feature_refs(v.configs).where("dataset = 'curated'").withColumnRenamed("column", "column_name")
    return refs.join(known, "column_name", "left_anti").groupBy("column_name").agg(F.count("*").alias("n"))


# --- registries ---------------------------------------------------------------------------

_CFG = "experiment_id seq:i name target status gate_passed:b"


@query("r1_registered", "experiment_id status versions:i", """
SELECT experiment_id, 'draft' AS status, COUNT(*) AS versions FROM v_cfg_log WHERE status = 'draft' GROUP BY 1""")
def _r1(v):
    from fieldmark.session import scratch_path

    path = scratch_path(v.spark, "configs")
    registry.register(path, v.config_log.where("status = 'draft'"), "draft")
    return v.spark.read.parquet(path).groupBy("experiment_id", "status").agg(F.count("*").alias("versions"))


@query("r2_current_configs", _CFG, "SELECT * FROM v_cfg")
def _r2(v):
    return registry.current(v.config_log, "experiment_id")


@query("r2_updated_configs", _CFG, """
SELECT experiment_id, CASE WHEN status = 'running' THEN seq + 1 ELSE seq END AS seq, name, target,
  CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, gate_passed FROM v_cfg""")
def _r2_update(v):
    """Cancel everything that is running: append new versions, read the latest view."""
    new = registry.update(
        v.config_log,
        "experiment_id",
        {"status": F.lit("failed")},
        F.to_timestamp(F.lit("2030-01-01 00:00:00")),
        F.col("status") == "running",
    )
    return registry.current(v.config_log.unionByName(new), "experiment_id")


@query("r3_completed_configs", "experiment_id status gate_passed:b latest_run_id run_count:i", """
SELECT c.experiment_id, COALESCE(r.status, c.status) AS status, CASE WHEN r.run_id IS NOT NULL THEN COALESCE(r.gate_passed, FALSE) ELSE c.gate_passed END AS gate_passed,
  r.run_id AS latest_run_id, COALESCE(n.n, 0) AS run_count
FROM v_cfg c LEFT JOIN v_latest_runs r USING (experiment_id) LEFT JOIN (SELECT experiment_id, COUNT(DISTINCT run_id) AS n FROM v_runs GROUP BY 1) n USING (experiment_id)""")
def _r3(v):
    return registry.completion(v.configs, v.runs)


@query("r4_expired_uploads", "dataset_id status", """
SELECT dataset_id, CASE WHEN status = 'uploading' AND upload_date <= TIMESTAMP '2000-06-15 00:30:00' - INTERVAL 30 MINUTE THEN 'error' ELSE status END AS status FROM v_ds""")
def _r4(v):
    return registry.expire_uploads(v.datasets, F.to_timestamp(F.lit("2000-06-15 00:30:00")))


@query("r5_d37_upload_profile", "dataset_id column_name data_type null_rate:f", """
SELECT 'games' AS dataset_id, c AS column_name, t AS data_type, ROUND(r, 6) AS null_rate FROM (
  SELECT unnest(['game_id', 'home_score', 'home_covered', 'roof', 'temp']) AS c, unnest(['categorical', 'numeric', 'boolean', 'categorical', 'numeric']) AS t,
    unnest([a, b, d, e, f]) AS r
  FROM (SELECT 1 - COUNT(game_id) / COUNT(*) AS a, 1 - COUNT(home_score) / COUNT(*) AS b, 1 - COUNT(home_covered) / COUNT(*) AS d,
    1 - COUNT(roof) / COUNT(*) AS e, 1 - COUNT(temp) / COUNT(*) AS f FROM v_games) g) x""")
def _r5(v):
    from fieldmark.session import scratch_path
    from fieldmark.sources.sinks import replace_partitions

    upload = v.games.select("game_id", "home_score", "home_covered", "roof", "temp")
    path = scratch_path(v.spark, "columns")
    for _ in range(2):
        replace_partitions(registry.profile_upload(upload, "games"), path, ["column_name"], "dataset_id")
    return v.spark.read.parquet(path)


@query("d37_column_profile", "column_name data_type null_rate:f", """
SELECT unnest(['doc_id', 'quality', 'toxic']) AS column_name, 'numeric' AS data_type, unnest([1 - COUNT(doc_id) / COUNT(*), 1 - COUNT(quality) / COUNT(*), 1 - COUNT(toxic) / COUNT(*)]) AS null_rate
FROM labels""")
def _d37(v):
    return profile.column_profile(v.table("labels"))


@query("r6_remapped_columns", "dataset_id column_name semantic_name null_rate:f is_join_key:b", """
SELECT u.dataset_id, u.column_name, concat('new ', u.column_name) AS semantic_name, COALESCE(p.null_rate, 0) AS null_rate, u.column_name IN ('c1', 'c2') AS is_join_key
FROM (SELECT DISTINCT concat('ds_', o_custkey) AS dataset_id, concat('c', o_orderkey % 5) AS column_name FROM orders) u
LEFT JOIN v_dcols p ON p.dataset_id = u.dataset_id AND p.column_name = u.column_name""")
def _r6(v):
    updates = (
        v.table("orders")
        .select(F.concat(F.lit("ds_"), "o_custkey").alias("dataset_id"), F.concat(F.lit("c"), F.col("o_orderkey") % 5).alias("column_name"))
        .distinct()
        .withColumn("semantic_name", F.concat(F.lit("new "), "column_name"))
    )
    keys = updates.where(F.col("column_name").isin("c1", "c2"))
    return registry.remap_columns(v.dataset_columns, updates, keys)


@query("r7_key_role_errors", "dataset_id join_key_type missing extra", """
SELECT dataset_id, join_key_type, m AS missing, e AS extra FROM (
  SELECT dataset_id, join_key_type,
    CASE join_key_type WHEN 'game_id' THEN 'game_id' WHEN 'player_season_week' THEN 'player_id,season' ELSE 'season' END AS m,
    CASE join_key_type WHEN 'game_id' THEN 'team,week' WHEN 'player_season_week' THEN 'team' ELSE '' END AS e, seq
  FROM v_ds WHERE join_key_type IS NOT NULL AND seq % 2 = 0
  UNION ALL SELECT dataset_id, join_key_type, CASE join_key_type WHEN 'game_id' THEN 'game_id' ELSE 'player_id' END,
    CASE join_key_type WHEN 'game_id' THEN 'season,team,week' ELSE 'team' END, seq
  FROM v_ds WHERE join_key_type IN ('game_id', 'player_season_week') AND seq % 2 = 1) x""")
def _r7(v):
    given = v.datasets.where(F.col("join_key_type").isNotNull()).select(
        "dataset_id",
        "join_key_type",
        F.when(F.col("seq") % 2 == 0, F.array(F.lit("team"), F.lit("week")))
        .otherwise(F.array(F.lit("team"), F.lit("season"), F.lit("week")))
        .alias("roles"),
    )
    out = registry.key_role_errors(given)
    return out.withColumns({c: F.concat_ws(",", c) for c in ("missing", "extra")})


@query("r8_deleted_keys", "dataset_id seq:i status", "SELECT dataset_id, seq, status FROM v_ds WHERE NOT deleted")
def _r8(v):
    return registry.current(v.dataset_log, "dataset_id")


@query("r8_rewritten_log", "dataset_id seq:i", """
SELECT dataset_id, seq FROM v_ds_log WHERE dataset_id NOT IN (SELECT dataset_id FROM v_ds WHERE status = 'mapping')""")
def _r8_log(v):
    return registry.delete(v.dataset_log, v.datasets.where("status = 'mapping'"), "dataset_id")


@query("r9_referenced_datasets", "dataset_id status", """
SELECT dataset_id, status FROM v_ds WHERE concat('user_datasets.', dataset_id) IN (SELECT dataset FROM v_refs)""")
def _r9(v):
    return registry.referenced_datasets(v.datasets, catalog.feature_refs(v.configs))


@query("r10_snapshots", "framework_id name base_experiment_id snapshot_id snapshot_name snapshot_status snapshot_target", """
SELECT concat('fw_', experiment_id) AS framework_id, name, experiment_id AS base_experiment_id, concat('fw_', experiment_id) AS snapshot_id,
  concat('Framework config fw_', experiment_id) AS snapshot_name, 'draft' AS snapshot_status, target AS snapshot_target FROM v_cfg""")
def _r10(v):
    out = registry.snapshot(v.configs)
    names = {"snapshot_id": "experiment_id", "snapshot_name": "name", "snapshot_status": "status", "snapshot_target": "target"}
    return out.withColumns({k: F.get_json_object("config_snapshot", f"$.{p}") for k, p in names.items()})


@query("r10_patched", "experiment_id name target", """
SELECT experiment_id, CASE WHEN seq % 3 = 0 THEN 'renamed' ELSE name END AS name, target FROM v_cfg""")
def _r10_patch(v):
    changes = v.configs.where("seq % 3 = 0").select(
        "experiment_id", F.lit("renamed").alias("name"), F.lit(None).cast("string").alias("target")
    )
    return registry.patch(v.configs, changes, "experiment_id", ["name", "target"])


@query("r11_c12_run_status", "experiment_id status run_id progress:f error_message", """
SELECT c.experiment_id, c.status, r.run_id, r.folds_complete / CAST(r.folds_total AS DOUBLE) AS progress, r.error_message
FROM v_cfg c LEFT JOIN v_latest_runs r USING (experiment_id)""")
def _r11(v):
    return registry.run_status(v.configs, v.runs)


@query("r12_rejected_transitions", "experiment_id action reason", """
SELECT q.experiment_id, q.action, CASE WHEN c.status IS NULL THEN 'not_found' WHEN q.action = 'run' THEN 'already_running' ELSE 'invalid_status' END AS reason
FROM (SELECT DISTINCT concat('exp_', user_id + 5) AS experiment_id, CASE WHEN event_type IN ('click', 'view') THEN 'run' ELSE 'cancel' END AS action FROM events) q
LEFT JOIN v_cfg c USING (experiment_id)
WHERE c.status IS NULL OR (q.action = 'run' AND c.status = 'running') OR (q.action = 'cancel' AND c.status <> 'running')""")
def _r12(v):
    requests = (
        v.table("events")
        .select(
            F.concat(F.lit("exp_"), F.col("user_id") + 5).alias("experiment_id"),
            F.when(F.col("event_type").isin("click", "view"), "run").otherwise("cancel").alias("action"),
        )
        .distinct()
    )
    return registry.rejected_transitions(v.configs, requests)


@query("b21_open_data", "dataset_id license_tag", "SELECT dataset_id, license_tag FROM v_ds WHERE license_tag = 'open'")
def _b21(v):
    return registry.open_data(v.datasets)


@query("b22_refresh_candidates", "experiment_id status", "SELECT experiment_id, status FROM v_cfg WHERE gate_passed AND status <> 'running'")
def _b22(v):
    return registry.refresh_candidates(v.configs)


@query("b28_f6_dataset_page", "dataset_id status license_tag", """
SELECT dataset_id, status, license_tag FROM v_ds WHERE status = 'ready' AND license_tag = 'open' ORDER BY upload_date DESC, dataset_id LIMIT 21""")
def _b28(v):
    found = registry.list_datasets(v.datasets, "ready", "open")
    return serve.page(found, [F.desc("upload_date"), F.asc("dataset_id")], 20)


@query("b29_c10_experiments_with_runs", _CFG, """
SELECT * FROM v_cfg WHERE experiment_id IN (SELECT experiment_id FROM v_runs) AND target = 'home_covered'""")
def _b29(v):
    return registry.list_experiments(v.configs, v.runs, status="complete", target="home_covered")


@query("b29_experiments_by_status", _CFG, "SELECT * FROM v_cfg WHERE status = 'complete' AND gate_passed")
def _b29_status(v):
    finished = v.configs.where("status = 'complete'")
    return registry.list_experiments(finished, v.runs, gate_passed=True)


def _saved_log(v):
    """A saved copy of every config; every fourth is deleted again."""
    made = registry.snapshot(v.configs).join(v.configs.select(F.col("experiment_id").alias("base_experiment_id"), F.col("seq").alias("n"), F.col("updated_at").alias("created_at")), "base_experiment_id")
    made = made.withColumns({"updated_at": F.col("created_at"), "seq": F.lit(1).cast("bigint"), "based_on": F.lit(None).cast("bigint"), "writer": F.lit("w"), "deleted": F.lit(False)})
    made = materialise(made, "saved")
    gone = registry.deleted_saved(made, made.where("n % 4 = 0"), F.col("created_at") + F.make_dt_interval(days=F.lit(1)))
    return made.unionByName(gone)


@query("f6_saved_configs", "framework_id name base_experiment_id page:i", """
SELECT concat('fw_', experiment_id) AS framework_id, name, experiment_id AS base_experiment_id,
  (ROW_NUMBER() OVER (ORDER BY updated_at DESC, concat('fw_', experiment_id)) - 1) // 50 AS page FROM v_cfg WHERE seq % 4 <> 0""")
def _f6_saved(v):
    """The pages of all saved configs that are not deleted, newest first."""
    return registry.list_saved(_saved_log(v), 50, every=True)
