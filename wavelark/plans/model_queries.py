from pyspark.sql import functions as F

from wavelark.operators import (
    calibration, context, decisions, evaluation, forest, group_split, leakage, matrix, oneclass, quality,
    reconstruction, scenarios, splits, suspicion, windows,
)
from wavelark.plans.catalog import query, rounded
from wavelark.plans.context_queries import desktop_features, desktop_reference, reference
from wavelark.plans.oracle_views import CONTEXT, DESKTOP_CONTEXT, OBS, TEMPORAL
from wavelark.plans.views import desktop_rows, observations
from wavelark.schema import CONTEXTUAL_FULL_V1, DESKTOP_FEATURES, RADIO_FEATURE_SETS, SPLIT_SEED
from wavelark.session import stored


def temporal(spark, sf_dir):
    return windows.rssi_temporal(windows.beacon_profile(observations(spark, sf_dir)))


def temporal_rich(spark, sf_dir):
    return quality.filter_temporal_rich(temporal(spark, sf_dir))


@query("contextual_split", f"""WITH {OBS}, p AS (SELECT event_id, session_id,
    row_number() OVER (PARTITION BY session_id ORDER BY elapsed_ms, event_id) - 1 AS pos_, count(*) OVER (PARTITION BY session_id) AS n FROM obs),
c AS (SELECT *, CAST(floor(n * 0.40::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.30::DOUBLE) AS BIGINT) AS b, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS c FROM p)
SELECT event_id, session_id, CASE WHEN pos_ < a THEN 'reference' WHEN pos_ < a + b THEN 'model_train' WHEN pos_ < a + b + c THEN 'validation'
    ELSE 'test_normal' END AS context_split FROM c""")
def contextual_split(spark, sf_dir):
    return splits.contextual_split(observations(spark, sf_dir)).select("event_id", "session_id", "context_split")


# The greedy rule group by group, largest first, over the state of the three splits.
@query("group_split", f"""WITH RECURSIVE {TEMPORAL}, s AS (SELECT source_dataset, network_identity_id, session_id, window_start_ms,
    CASE WHEN source_dataset = 'mendeley_rogue_ap' THEN 'network_identity_id' ELSE 'session_id' END AS split_group_type,
    CASE WHEN source_dataset = 'mendeley_rogue_ap' THEN network_identity_id ELSE session_id END AS split_group_id FROM temporal),
g AS (SELECT source_dataset, split_group_id, count(*)::DOUBLE AS size FROM s GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY size DESC, substr(sha256('{SPLIT_SEED}|' || split_group_id), 1, 16), split_group_id) AS n,
    sum(size) OVER (PARTITION BY source_dataset) AS total,
    list_transform(['train', 'validation', 'test'], lambda x: substr(sha256('{SPLIT_SEED}|' || split_group_id || '|' || x), 1, 16)) AS tie FROM g),
walk AS (SELECT DISTINCT source_dataset, 0::BIGINT AS n, [0::DOUBLE, 0::DOUBLE, 0::DOUBLE] AS held, 0::BIGINT AS pick FROM o
    UNION ALL SELECT source_dataset, n, list_transform(held, lambda h, i: CASE WHEN i = pick THEN h + size ELSE h END), pick FROM (
        SELECT *, list_sort(list_transform(list_filter([1, 2, 3], lambda i: d[i] = list_max(d)), lambda i: {{'hash': tie[i], 'i': i}}))[1].i::BIGINT AS pick FROM (
            SELECT o.*, held, list_transform([0.70::DOUBLE, 0.15::DOUBLE, 0.15::DOUBLE], lambda r, i: (total * r - held[i]) / greatest(total * r, 1)) AS d
            FROM walk w JOIN o ON o.source_dataset = w.source_dataset AND o.n = w.n + 1)))
SELECT source_dataset, network_identity_id, session_id, window_start_ms, ['train', 'validation', 'test'][pick] AS split, split_group_type, split_group_id
FROM s JOIN o USING (source_dataset, split_group_id) JOIN walk USING (source_dataset, n)""")
def group_split_rows(spark, sf_dir):
    return group_split.group_split(stored(temporal(spark, sf_dir), "temporal")).select(
        "source_dataset", "network_identity_id", "session_id", "window_start_ms", "split", "split_group_type",
        "split_group_id")


PSEUDO_SPLIT = f"""WITH {TEMPORAL}, s AS (SELECT *, CASE WHEN source_dataset = 'mendeley_rogue_ap' THEN network_identity_id ELSE session_id END AS split_group_id,
    CASE WHEN source_dataset = 'mendeley_rogue_ap' THEN 'network_identity_id' ELSE 'session_id' END AS split_group_type,
    CASE WHEN window_start_ms >= 5000 THEN 'train' ELSE 'test' END AS split FROM temporal)"""


def pseudo_split(spark, sf_dir):
    by_network = F.col("source_dataset") == "mendeley_rogue_ap"
    return temporal(spark, sf_dir).withColumns({
        "split_group_id": F.when(by_network, F.col("network_identity_id")).otherwise(F.col("session_id")),
        "split_group_type": F.when(by_network, "network_identity_id").otherwise("session_id"),
        "split": F.when(F.col("window_start_ms") >= 5000, "train").otherwise("test")})


@query("leaking_groups", f"""{PSEUDO_SPLIT} SELECT source_dataset, split_group_type, split_group_id, count(DISTINCT split) AS splits
FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT split) > 1""")
def leaking_groups(spark, sf_dir):
    return splits.leaking_groups(pseudo_split(spark, sf_dir))


@query("split_summary", f"""{PSEUDO_SPLIT} SELECT source_dataset, split, count(*) AS "rows", count(DISTINCT split_group_id) AS split_groups,
    count(DISTINCT session_id) AS sessions, count(DISTINCT network_identity_id) AS network_identities FROM s GROUP BY 1, 2""")
def split_summary(spark, sf_dir):
    return splits.split_summary(pseudo_split(spark, sf_dir))


@query("balanced_sources", f"""WITH {OBS}, r AS (SELECT event_id, source_dataset, row_number() OVER (PARTITION BY source_dataset
    ORDER BY sha256('20260831|' || event_id), event_id) AS pos_, count(*) OVER (PARTITION BY source_dataset) AS n FROM obs)
SELECT event_id, source_dataset FROM r WHERE pos_ <= (SELECT min(n) FROM r)""")
def balanced_sources(spark, sf_dir):
    return splits.balance_sources(observations(spark, sf_dir).select("event_id", "source_dataset"), "event_id")


@query("session_split_plan", f"""WITH {OBS}, s AS (SELECT session_id, count(*) AS "rows" FROM obs GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY sha256('20260831|' || session_id)) - 1 AS pos_ FROM s)
SELECT session_id, "rows", true AS runtime_ready, 'ready' AS plan_status,
    CASE WHEN pos_ = 0 THEN 'reference' WHEN pos_ IN (1, 2) THEN 'model_train' WHEN pos_ = 3 THEN 'validation' WHEN pos_ = 4 THEN 'test_normal'
    WHEN (pos_ - 5) % 4 < 2 THEN 'model_train' WHEN (pos_ - 5) % 4 = 2 THEN 'validation' ELSE 'test_normal' END AS split FROM p""")
def session_split_plan(spark, sf_dir):
    sessions = observations(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows")).withColumn("runtime_ready", F.lit(True))
    return splits.session_split_plan(sessions)


@query("contextual_matrix", f"""WITH {CONTEXT} SELECT ssid_bssid_count, bssid_changed, channel_changed, security_changed, security_strength_delta,
    is_hidden, label, source_dataset, session_id, elapsed_ms, ssid_hash, bssid_hash, context_available, context_resolution, feature_complete,
    ssid_missing, configured_beacon_interval_delta_ms, attack_type, is_synthetic FROM ctx WHERE feature_complete""")
def contextual_matrix(spark, sf_dir):
    features = context.transform_contextual(observations(spark, sf_dir), context.freeze(reference(spark, sf_dir)))
    return matrix.feature_matrix(features.where("feature_complete"), CONTEXTUAL_FULL_V1)


COMPLETE = RADIO_FEATURE_SETS["complete_v1"]
SCALER_SQL = ", ".join(
    f"round(avg({f}), 9) AS mean_{f}, round(CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END, 9) AS scale_{f}"
    for f in COMPLETE)


@query("scaler_fit", f"WITH {TEMPORAL} SELECT {SCALER_SQL} FROM temporal")
def scaler_fit(spark, sf_dir):
    scaler = matrix.fit_scaler(temporal(spark, sf_dir), COMPLETE)
    return rounded(scaler, *scaler.columns)


SCALED_SQL = ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM temporal)) / (SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END FROM temporal), 7) + 0.0 AS {f}"
    for f in COMPLETE)


@query("scaler_transform", f"WITH {TEMPORAL} SELECT network_group_id, window_start_ms, label, {SCALED_SQL} FROM temporal")
def scaler_transform(spark, sf_dir):
    rows = temporal(spark, sf_dir)
    scaled = matrix.apply_scaler(rows, matrix.fit_scaler(rows, COMPLETE), COMPLETE)
    return rounded(scaled.select("network_group_id", "window_start_ms", "label", *COMPLETE), *COMPLETE, digits=7)


@query("variance_report", f"WITH {TEMPORAL} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS distinct_values, round(avg({f}), 7) AS mean, round(var_pop({f}), 7) AS variance_population FROM temporal"
    for f in ["window_count", "rssi_min_dbm"]))
def variance_report(spark, sf_dir):
    report = matrix.variance_report(temporal(spark, sf_dir), ["window_count", "rssi_min_dbm"])
    return rounded(report, "mean", "variance_population", digits=7)


# A plain score on desktop features that both engines compute exactly.
SCORED = DESKTOP_CONTEXT + """,
scored AS (SELECT d.*, o.label AS truth, o.attack_type AS attack, 2 * bssid_changed + security_changed * 0.5::DOUBLE
    - security_strength_delta * 0.25::DOUBLE + ssid_bssid_count * 0.0625::DOUBLE + d.rssi_dbm / -1000 AS anomaly_score
    FROM dctx d JOIN obs o USING (event_id) WHERE d.context_available AND d.feature_complete)
"""


def scored(spark, sf_dir):
    rows = context.transform_desktop(
        desktop_rows(spark, sf_dir, truth=True), desktop_reference(spark, sf_dir)).where(context.eligible())
    score = (2 * F.col("bssid_changed") + F.col("security_changed") * 0.5 - F.col("security_strength_delta") * 0.25
             + F.col("ssid_bssid_count") * 0.0625 + F.col("rssi_dbm") / -1000)
    return rows.withColumn("anomaly_score", score)


THRESHOLD = 1.0


@query("threshold_calibration", f"""WITH {SCORED}, v AS (SELECT anomaly_score FROM scored WHERE truth = 0),
t AS (SELECT quantile_cont(anomaly_score, 0.95) AS q FROM v)
SELECT round(q, 9) AS threshold, 0.05::DOUBLE AS target_false_positive_rate,
    round((SELECT count(*) FROM v WHERE anomaly_score > q) / (SELECT count(*) FROM v), 9) AS validation_realized_false_positive_rate,
    (SELECT count(*) FROM v) AS validation_rows, 0.95::DOUBLE AS quantile FROM t""")
def threshold_calibration(spark, sf_dir):
    out = calibration.calibrate(scored(spark, sf_dir).where(F.col("truth") == 0))
    return rounded(out, "threshold", "validation_realized_false_positive_rate")


@query("prediction", f"WITH {SCORED} SELECT event_id, CAST(anomaly_score > 1.0 AS BIGINT) AS prediction FROM scored")
def prediction(spark, sf_dir):
    return calibration.predict(scored(spark, sf_dir), THRESHOLD).select("event_id", "prediction")


@query("binary_metrics", f"""WITH {SCORED},
m AS (SELECT count(*) FILTER (truth = 0 AND NOT anomaly_score > 1.0) AS tn, count(*) FILTER (truth = 0 AND anomaly_score > 1.0) AS fp,
    count(*) FILTER (truth = 1 AND NOT anomaly_score > 1.0) AS fn, count(*) FILTER (truth = 1 AND anomaly_score > 1.0) AS tp FROM scored),
d AS (SELECT anomaly_score AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below, sum(pos) OVER (ORDER BY s DESC) AS caught,
    sum(pos + neg) OVER (ORDER BY s DESC) AS flagged FROM d),
a AS (SELECT sum(pos * (below + neg / 2.0)) AS area, sum(pos * caught / flagged) AS prec FROM r)
SELECT tn + fp AS normal_rows, fn + tp AS attack_rows, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 9) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS "precision", round(tp / (tp + fn), 9) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(fp / (fp + tn), 9) AS false_positive_rate,
    round(fn / (fn + tp), 9) AS false_negative_rate, round(area / ((tn + fp)::DOUBLE * (fn + tp)), 9) AS roc_auc,
    round(prec / (fn + tp), 9) AS pr_auc FROM m, a""")
def binary_metrics(spark, sf_dir):
    out = evaluation.binary_metrics(scored(spark, sf_dir), THRESHOLD, label="truth")
    return rounded(out, "accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate",
                   "roc_auc", "pr_auc")


@query("normal_only_summary", f"""WITH {SCORED} SELECT count(*) AS "rows", count(*) FILTER (anomaly_score > 1.0) AS false_positive_count,
    round(avg(anomaly_score), 9) AS score_mean, round(min(anomaly_score), 9) AS score_min, round(max(anomaly_score), 9) AS score_max,
    count(*) FILTER (NOT anomaly_score > 1.0) AS true_negative_count,
    round(count(*) FILTER (anomaly_score > 1.0) / count(*), 9) AS false_positive_rate,
    round(quantile_cont(anomaly_score, 0.5), 9) AS score_median FROM scored WHERE truth = 0""")
def normal_only_summary(spark, sf_dir):
    out = evaluation.normal_summary(scored(spark, sf_dir).where(F.col("truth") == 0), THRESHOLD)
    return rounded(out, "score_mean", "score_min", "score_max", "false_positive_rate", "score_median")


@query("recall_by_attack_type", f"""WITH {SCORED} SELECT coalesce(attack, 'unknown') AS attack, count(*) AS "rows",
    count(*) FILTER (anomaly_score > 1.0) AS detected, round(count(*) FILTER (anomaly_score > 1.0) / count(*), 9) AS recall,
    round(quantile_cont(anomaly_score, 0.5), 9) AS score_median FROM scored GROUP BY 1""")
def recall_by_attack_type(spark, sf_dir):
    return rounded(evaluation.recall_by(scored(spark, sf_dir), "attack", THRESHOLD), "recall", "score_median")


@query("recall_by_session", f"""WITH {SCORED} SELECT session_id, count(*) AS "rows", count(*) FILTER (anomaly_score > 1.0) AS detected,
    round(count(*) FILTER (anomaly_score > 1.0) / count(*), 9) AS recall FROM scored WHERE truth = 1 GROUP BY 1""")
def recall_by_session(spark, sf_dir):
    rows = scored(spark, sf_dir).where(F.col("truth") == 1)
    return rounded(evaluation.recall_by(rows, "session_id", THRESHOLD, with_median=False), "recall")


@query("score_distribution", f"""WITH {SCORED} SELECT context_resolution, count(*) AS "rows", round(avg(anomaly_score), 9) AS score_mean,
    round(stddev_pop(anomaly_score), 9) AS score_std, round(min(anomaly_score), 9) AS score_min, round(max(anomaly_score), 9) AS score_max,
    count(*) FILTER (anomaly_score > 1.0) AS threshold_exceedance_count,
    round(count(*) FILTER (anomaly_score > 1.0) / count(*), 9) AS threshold_exceedance_rate,
    round(quantile_cont(anomaly_score, 0.5), 9) AS score_median FROM scored GROUP BY 1""")
def score_distribution(spark, sf_dir):
    out = evaluation.score_distribution(scored(spark, sf_dir), "context_resolution", THRESHOLD)
    return rounded(out, "score_mean", "score_std", "score_min", "score_max", "threshold_exceedance_rate", "score_median")


# Controlled sessions: late sessions, whose target is the BSSID with the smallest hash in the session. One of them was taken
# elsewhere, and in another a second BSSID is labelled.
CONTROLLED = DESKTOP_CONTEXT + """,
tgt AS (SELECT session_id, min(bssid_hash) AS target, max(bssid_hash) AS second FROM desk WHERE session_id >= 'sess_05' GROUP BY 1),
ctl AS (SELECT d.* EXCLUDE (label, environment), CAST(d.bssid_hash = t.target OR (session_id = 'sess_07' AND d.bssid_hash = t.second) AS BIGINT) AS label,
    CASE WHEN session_id = 'sess_06' THEN 'lab' ELSE 'home' END AS environment FROM dctx d JOIN tgt t USING (session_id))
"""


def controlled_rows(spark, sf_dir):
    rows, session = desktop_features(spark, sf_dir).where(F.col("session_id") >= "sess_05"), F.col("session_id")
    targets = rows.groupBy("session_id").agg(F.min("bssid_hash").alias("target"), F.max("bssid_hash").alias("second"))
    hit = (F.col("bssid_hash") == F.col("target")) | ((session == "sess_07") & (F.col("bssid_hash") == F.col("second")))
    return rows.join(targets, "session_id").withColumns({
        "label": hit.cast("long"), "environment": F.when(session == "sess_06", "lab").otherwise("home")})


@query("controlled_eligibility", f"""WITH {CONTROLLED},
g AS (SELECT session_id, count(*) AS "rows", sum(label)::BIGINT AS attack_rows, count(*) FILTER (context_available) AS context_available,
    count(*) FILTER (feature_complete) AS eligible, count(*) FILTER (feature_complete AND label = 1) AS eligible_attack,
    min(bssid_hash) FILTER (label = 1) AS target_bssid_hash, bool_and(environment = 'home') AS environment_matches,
    count(DISTINCT bssid_hash) FILTER (label = 1) = 1 AS single_target FROM ctl GROUP BY 1
    UNION ALL SELECT NULL, count(*), sum(label)::BIGINT, count(*) FILTER (context_available), count(*) FILTER (feature_complete),
    count(*) FILTER (feature_complete AND label = 1), NULL, bool_and(environment = 'home'),
    (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT bssid_hash) FILTER (label = 1) AS n FROM ctl GROUP BY session_id)) FROM ctl)
SELECT *, "rows" - attack_rows AS normal_rows, eligible - eligible_attack AS eligible_normal,
    round(eligible / "rows", 9) AS eligible_rate, round(eligible_attack / attack_rows, 9) AS attack_target_eligible_rate,
    eligible > 0 AND eligible / "rows" >= 0.7 AS coverage_passes,
    eligible_attack > 0 AND eligible_attack / attack_rows >= 0.7 AS target_coverage_passes FROM g""")
def controlled_eligibility(spark, sf_dir):
    out = evaluation.controlled_eligibility(controlled_rows(spark, sf_dir), "home")
    return rounded(out, "eligible_rate", "attack_target_eligible_rate")


# Sessions that break one rule each, beside the two faults above; row by row where a rule is about rows.
@query("controlled_gates", f"""WITH {CONTROLLED}, r AS (SELECT session_id, bssid_hash, environment, CASE WHEN session_id = 'sess_08' THEN 0 ELSE label END AS label,
    CASE WHEN session_id = 'sess_08' THEN false ELSE label = 1 END AS flag_, session_id = 'sess_05' AND event_id % 7 = 0 AS fake, session_id = 'sess_09' AND event_id % 5 = 0 AS odd FROM ctl)
SELECT session_id, concat_ws(',', CASE WHEN bool_or(environment <> 'home') THEN 'attack_environment_mismatch' END, CASE WHEN bool_or(odd) THEN 'attack_type_missing' END,
    CASE WHEN count(DISTINCT bssid_hash) FILTER (label = 1) > 1 THEN 'several_target_bssids' END, CASE WHEN bool_or(fake) THEN 'synthetic_rows' END,
    CASE WHEN sum(label) = 0 THEN 'target_not_observed' END) AS broken FROM r GROUP BY 1""")
def controlled_gates(spark, sf_dir):
    session, late = F.col("session_id"), F.col("session_id") == "sess_08"
    rows = controlled_rows(spark, sf_dir).withColumn("label", F.when(late, F.lit(0).cast("long")).otherwise(F.col("label"))).withColumns({
        "session_label": F.lit(1), "is_attack_target": F.col("label") == 1, "source_dataset": F.lit("own_windows_attack"),
        "is_synthetic": (session == "sess_05") & (F.col("event_id") % 7 == 0),
        "attack_type": F.when((session != "sess_09") | (F.col("event_id") % 5 != 0), "evil_twin")})
    return evaluation.controlled_gates(rows, "home").select("session_id", F.array_join("broken", ",").alias("broken"))


SUSPICION = DESKTOP_CONTEXT + """,
sus0 AS (SELECT *, context_available AND feature_complete AS ok, bssid_changed <> 0 AS b, security_changed <> 0 AS s, security_strength_delta < 0 AS w,
    2 * CAST(bssid_changed <> 0 AS BIGINT) + 2 * CAST(security_changed <> 0 AS BIGINT) + CAST(security_strength_delta < 0 AS BIGINT) AS pts FROM dctx),
sus AS (SELECT event_id, session_id, CASE WHEN ok THEN CAST(pts > 0 AS BIGINT) END AS suspected_label, CASE WHEN ok THEN pts END AS suspicion_score,
    CASE WHEN NOT ok THEN 'not_evaluable' WHEN pts <= 0 THEN 'normal_like' WHEN pts = 1 THEN 'low_suspicion' WHEN pts <= 3 THEN 'medium_suspicion'
        ELSE 'high_suspicion' END AS suspicion_level,
    CASE WHEN NOT ok THEN 'not_evaluable' WHEN b AND s AND w THEN 'possible_evil_twin_with_security_downgrade'
        WHEN b AND s THEN 'possible_evil_twin_with_security_change' WHEN b THEN 'possible_evil_twin_new_bssid'
        WHEN s AND w THEN 'security_profile_anomaly_with_downgrade' WHEN s THEN 'security_profile_anomaly'
        WHEN w THEN 'weaker_security_observation' ELSE 'no_evil_twin_hypothesis' END AS hypothesis_type,
    CASE WHEN NOT ok THEN '' ELSE concat_ws('|', CASE WHEN b THEN 'new_bssid_for_known_ssid' END, CASE WHEN s THEN 'security_profile_changed' END,
        CASE WHEN w THEN 'security_strength_lower_than_reference' END) END AS heuristic_reasons,
    CASE WHEN ok AND ssid_bssid_count > 1 THEN 'known_ssid_has_multiple_reference_bssids' ELSE '' END AS context_notes FROM sus0)
"""
LEVEL_SQL = ", ".join(f"count(*) FILTER (suspicion_level = '{l}') AS {l}" for l in suspicion.LEVELS)


@query("suspicion_labels", f"WITH {SUSPICION} SELECT * FROM sus")
def suspicion_labels(spark, sf_dir):
    return suspicion.suspicion(desktop_features(spark, sf_dir)).select(
        "event_id", "session_id", "suspected_label", "suspicion_score", "suspicion_level", "hypothesis_type",
        "heuristic_reasons", "context_notes")


@query("suspicion_summary", f"""WITH {SUSPICION} SELECT session_id, count(*) AS "rows", count(suspected_label) AS eligible,
    count(*) - count(suspected_label) AS not_evaluable, count(*) FILTER (suspected_label = 1) AS suspected,
    count(*) FILTER (suspected_label = 0) AS non_suspected, {LEVEL_SQL},
    round(CASE WHEN count(suspected_label) = 0 THEN 0 ELSE count(*) FILTER (suspected_label = 1) / count(suspected_label) END, 9) AS suspected_rate,
    grouping(session_id) = 1 AS is_total FROM (SELECT * REPLACE (nullif(session_id, 'sess_06') AS session_id) FROM sus) GROUP BY ROLLUP (session_id)""")
def suspicion_summary(spark, sf_dir):
    labels = suspicion.suspicion(desktop_features(spark, sf_dir)).withColumn(
        "session_id", F.nullif("session_id", F.lit("sess_06")))  # a group without a key beside the total
    return rounded(suspicion.suspicion_summary(labels, "session_id"), "suspected_rate")


SCENARIO = DESKTOP_CONTEXT + """,
basel AS (SELECT * FROM dctx WHERE context_available AND feature_complete AND context_resolution = 'ssid_hash' AND bssid_changed = 0
    AND security_changed = 0 AND abs(security_strength_delta) <= 1e-9),
ref5 AS (SELECT b.*, p.security_types AS types, p.security_strength_median AS med FROM basel b JOIN dprof p ON p.ssid_hash = b.ssid_hash),
pick AS (SELECT *, CASE WHEN NOT list_contains(types, 'OPEN') THEN 'OPEN' WHEN NOT list_contains(types, 'LEGACY_PRIVACY') THEN 'LEGACY_PRIVACY'
        WHEN NOT list_contains(types, 'WPA2_OR_NEWER') THEN 'WPA2_OR_NEWER' END AS other,
    CASE WHEN NOT list_contains(types, 'WPA2_OR_NEWER') AND 3 < med THEN 'WPA2_OR_NEWER' WHEN NOT list_contains(types, 'LEGACY_PRIVACY') AND 1 < med THEN 'LEGACY_PRIVACY'
        WHEN NOT list_contains(types, 'OPEN') AND 0 < med THEN 'OPEN' END AS lower FROM ref5),
scn0 AS (
    SELECT event_id, session_id, scan_index, ssid_hash, bssid_hash, 'hypothetical_control' AS scenario_type, security_type, CAST(security_strength AS DOUBLE) AS strength, false AS fresh FROM pick
    UNION ALL SELECT event_id, session_id, scan_index, ssid_hash, bssid_hash, 'hypothetical_new_bssid', security_type, security_strength, true FROM pick
    UNION ALL SELECT event_id, session_id, scan_index, ssid_hash, bssid_hash, 'ablation_weaker_security_only', security_type, greatest(0, med - 1), false FROM pick WHERE med > 0
    UNION ALL SELECT event_id, session_id, scan_index, ssid_hash, bssid_hash, 'hypothetical_new_bssid_security_change', other, med, true FROM pick WHERE other IS NOT NULL
    UNION ALL SELECT event_id, session_id, scan_index, ssid_hash, bssid_hash, 'hypothetical_new_bssid_security_downgrade', lower,
        CASE lower WHEN 'OPEN' THEN 0 WHEN 'LEGACY_PRIVACY' THEN 1 ELSE 3 END, true FROM pick WHERE lower IS NOT NULL),
scn AS (SELECT event_id AS source_row_index, session_id AS source_session_id, scan_index AS source_scan_index, scenario_type, ssid_hash, security_type,
    strength AS security_strength, 'hypothetical-' || scenario_type || '-' || session_id AS session_id,
    CASE WHEN fresh THEN sha256('desktop-hypothetical-bssid|' || scenario_type || '|' || ssid_hash || '|' || bssid_hash || '|' || session_id || '|' || scan_index || '|0')
        ELSE bssid_hash END AS bssid_hash FROM scn0)
"""


def baseline(spark, sf_dir, ref):
    return scenarios.baseline_rows(context.transform_desktop(desktop_rows(spark, sf_dir), ref))


@query("scenario_baseline", f"WITH {SCENARIO} SELECT event_id, session_id FROM basel")
def scenario_baseline(spark, sf_dir):
    return baseline(spark, sf_dir, desktop_reference(spark, sf_dir)).select("event_id", "session_id")


@query("scenario_rows", f"WITH {SCENARIO} SELECT * FROM scn")
def scenario_rows(spark, sf_dir):
    ref = desktop_reference(spark, sf_dir)
    return scenarios.generate_scenarios(baseline(spark, sf_dir, ref), ref).select(
        "source_row_index", "source_session_id", "source_scan_index", "scenario_type", "ssid_hash", "security_type",
        "security_strength", "session_id", "bssid_hash")


@query("scenario_features", f"""WITH {SCENARIO}, f AS (SELECT s.*, p.security_types AS types, p.security_strength_median AS med,
    EXISTS (SELECT 1 FROM dmember m WHERE m.ssid_hash = s.ssid_hash AND m.bssid_hash = s.bssid_hash) AS known
    FROM scn s JOIN dprof p ON p.ssid_hash = s.ssid_hash)
SELECT scenario_type, count(*) AS "rows", count(*) AS feature_complete, count(*) FILTER (NOT known) AS bssid_changed,
    count(*) FILTER (NOT list_contains(types, security_type)) AS security_changed,
    count(*) FILTER (security_strength < med) AS weaker_security FROM f GROUP BY 1""")
def scenario_features(spark, sf_dir):
    ref = desktop_reference(spark, sf_dir)
    return scenarios.scenario_features(scenarios.generate_scenarios(baseline(spark, sf_dir, ref), ref), ref)


@query("scenario_evaluation", f"""WITH {SCENARIO}, f AS (SELECT s.*, 2 * CAST(NOT EXISTS (SELECT 1 FROM dmember m WHERE m.ssid_hash = s.ssid_hash
        AND m.bssid_hash = s.bssid_hash) AS BIGINT) + 0.5 * CAST(NOT list_contains(p.security_types, s.security_type) AS BIGINT)
        - 0.25::DOUBLE * (s.security_strength - p.security_strength_median) AS sc
    FROM scn s JOIN dprof p ON p.ssid_hash = s.ssid_hash),
g AS (SELECT scenario_type, count(*) AS n, count(*) FILTER (sc > 0.2) AS a, min(sc) AS mn, avg(sc) AS me, median(sc) AS md,
    quantile_cont(sc, 0.95) AS p95, max(sc) AS mx FROM f GROUP BY 1)
SELECT scenario_type, n AS input_rows, n AS eligible_rows, 0 AS not_evaluable_rows, a AS anomaly_count, n - a AS normal_count,
    round(a / n, 9) AS threshold_exceedance_rate, round(mn, 9) + 0.0 AS score_min, round(me, 9) + 0.0 AS score_mean, round(md, 9) + 0.0 AS score_median,
    round(p95, 9) + 0.0 AS score_p95, round(mx, 9) + 0.0 AS score_max, round(CASE WHEN scenario_type <> 'hypothetical_control' THEN a / n
        - (SELECT a / n FROM g WHERE scenario_type = 'hypothetical_control') END, 9) + 0.0 AS delta_to_control FROM g""")
def scenario_evaluation(spark, sf_dir):
    ref = desktop_reference(spark, sf_dir)
    made = context.transform_desktop(scenarios.generate_scenarios(baseline(spark, sf_dir, ref), ref), ref)
    score = 2 * F.col("bssid_changed") + F.col("security_changed") * 0.5 - F.col("security_strength_delta") * 0.25
    sessions = desktop_rows(spark, sf_dir).select("session_id").distinct()
    out = scenarios.evaluate_scenarios(made.withColumn("anomaly_score", score), sessions, 0.2)
    return rounded(out, "threshold_exceedance_rate", "score_min", "score_mean", "score_median", "score_p95", "score_max",
                   "delta_to_control")


# Kernel expansion whose support is the distinct training vectors, weighted by how often they occur.
KERNEL = DESKTOP_CONTEXT + """,
ktrain AS (SELECT ssid_bssid_count AS a, bssid_changed AS b, security_changed AS c, security_strength_delta AS d FROM dctx
    WHERE feature_complete AND session_id <= 'sess_04'),
ksc AS (SELECT avg(a) AS ma, coalesce(nullif(stddev_pop(a), 0), 1) AS sa, avg(b) AS mb, coalesce(nullif(stddev_pop(b), 0), 1) AS sb,
    avg(c) AS mc, coalesce(nullif(stddev_pop(c), 0), 1) AS scc, avg(d) AS md, coalesce(nullif(stddev_pop(d), 0), 1) AS sd FROM ktrain),
ksv AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / scc AS c, (d - md) / sd AS d, count(*) / (SELECT count(*) FROM ktrain) AS alpha
    FROM ktrain, ksc GROUP BY ALL),
krow AS (SELECT event_id, session_id, context_available, feature_complete, (ssid_bssid_count - ma) / sa AS a, (bssid_changed - mb) / sb AS b,
    (security_changed - mc) / scc AS c, (security_strength_delta - md) / sd AS d FROM dctx, ksc),
kvec AS (SELECT DISTINCT a, b, c, d FROM krow WHERE feature_complete),
kval AS (SELECT v.a, v.b, v.c, v.d, 0.5 - sum(alpha * exp(-0.25 * ((v.a - s.a) ** 2 + (v.b - s.b) ** 2 + (v.c - s.c) ** 2 + (v.d - s.d) ** 2))) AS score
    FROM kvec v, ksv s GROUP BY 1, 2, 3, 4),
kscore AS (SELECT r.*, round(score, 7) AS score FROM krow r LEFT JOIN kval USING (a, b, c, d))
"""


def kernel_parts(spark, sf_dir):
    ref = desktop_reference(spark, sf_dir)
    rows = context.transform_desktop(desktop_rows(spark, sf_dir), ref).where(context.eligible())
    train = stored(rows.where(F.col("session_id") <= "sess_04").select(*DESKTOP_FEATURES), "training-rows")
    scaler = stored(matrix.fit_scaler(train, DESKTOP_FEATURES), "scaler")
    folded = stored(train.groupBy(*DESKTOP_FEATURES).agg(F.count(F.lit(1)).alias("_n")), "training-vectors")
    total = folded.agg(F.sum("_n").alias("n")).scalar()
    support = matrix.apply_scaler(folded.withColumn("alpha", F.col("_n") / total), scaler, DESKTOP_FEATURES)
    return rows, ref, scaler, support.select(*DESKTOP_FEATURES, "alpha")


def kernel_score(support):
    def score(df):
        out = oneclass.score_one_class(df, support, 0.5, 0.25, DESKTOP_FEATURES)
        return rounded(out, "anomaly_score", digits=7)
    return score


@query("kernel_scores", f"WITH {KERNEL} SELECT event_id, score + 0.0 AS anomaly_score FROM kscore WHERE feature_complete")
def kernel_scores(spark, sf_dir):
    rows, _, scaler, support = kernel_parts(spark, sf_dir)
    scaled = matrix.apply_scaler(rows, scaler, DESKTOP_FEATURES)
    return kernel_score(support)(scaled).select("event_id", "anomaly_score")


@query("runtime_decisions", f"""WITH {KERNEL} SELECT event_id, CASE WHEN feature_complete THEN 'ready' ELSE 'insufficient_history' END AS status,
    CASE WHEN feature_complete THEN score + 0.0 END AS anomaly_score, CASE WHEN feature_complete THEN 0.25::DOUBLE END AS threshold,
    CASE WHEN feature_complete THEN score > 0.25 END AS is_anomaly,
    CASE WHEN NOT feature_complete THEN 'unavailable' WHEN score > 0.25 THEN 'high' ELSE 'low' END AS suspicion_level FROM kscore""")
def runtime_decisions(spark, sf_dir):
    _, ref, scaler, support = kernel_parts(spark, sf_dir)
    out = decisions.decide(desktop_rows(spark, sf_dir), ref, scaler, kernel_score(support), 0.25)
    return out.select("event_id", "status", "anomaly_score", "threshold", "is_anomaly", "suspicion_level")


def radio_rows(spark, sf_dir):
    key = F.concat_ws("|", "network_group_id", "window_start_ms", "label")
    rich = stored(temporal_rich(spark, sf_dir).select(key.alias("row_key"), "label", *COMPLETE), "radio-rows")
    return matrix.apply_scaler(rich, matrix.fit_scaler(rich.where(F.col("label") == 0), COMPLETE), COMPLETE)


@query("one_class_fit")
def one_class_fit(spark, sf_dir):
    rows = radio_rows(spark, sf_dir)
    model = oneclass.fit_one_class(rows.where(F.col("label") == 0), COMPLETE)
    return oneclass.score_random_features(rows, model).select("row_key", "label", "anomaly_score")


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    rows = radio_rows(spark, sf_dir)
    nodes = forest.fit_forest(rows.where(F.col("label") == 0), COMPLETE, row_key="row_key")
    return forest.score_forest(rows, nodes, COMPLETE).select("row_key", "label", "anomaly_score")


@query("reconstruction_error")
def reconstruction_error(spark, sf_dir):
    rows = radio_rows(spark, sf_dir)
    model = reconstruction.fit_reconstruction(rows.where(F.col("label") == 0), COMPLETE, 3)
    return reconstruction.score_reconstruction(rows, model).select("row_key", "label", "anomaly_score")


@query("source_leakage_probe")
def source_leakage_probe(spark, sf_dir):
    rows = stored(temporal_rich(spark, sf_dir), "probe-rows")
    session = F.col("session_id")
    held = {"validation": rows.where((session >= "sess_05") & (session < "sess_08")), "test": rows.where(session >= "sess_08")}
    train, out = rows.where(session < "sess_05"), None
    for name in RADIO_FEATURE_SETS:
        part = leakage.source_leakage(train, held, name).withColumn("feature_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Small models given in full, so that SQL can score with them what the fitted ones score above.
TERMS = [([0.03, 0.2, -0.01, 0.02, 0.1, 0.3], 0.4, 0.5), ([-0.02, 0.05, 0.04, -0.03, -0.2, 0.1], 1.7, -0.25), ([0.01, -0.3, 0.02, 0.02, 0.05, -0.4], 3.1, 0.75)]
TERMS_SQL = " + ".join(
    f"{w} * sqrt(2 / {len(TERMS)}::DOUBLE) * cos({' + '.join(f'{o} * {f}' for o, f in zip(omega, COMPLETE))} + {offset})" for omega, offset, w in TERMS)


@query("random_feature_scores", f"WITH {TEMPORAL} SELECT network_group_id, window_start_ms, label, round(0.1::DOUBLE - ({TERMS_SQL}), 7) + 0.0 AS anomaly_score FROM temporal")
def random_feature_scores(spark, sf_dir):
    terms = spark.createDataFrame([(i, *t) for i, t in enumerate(TERMS)], "term long, omega array<double>, offset double, weight double")
    model = oneclass.OneClassModel(terms, spark.createDataFrame([(0.1,)], "rho double"), tuple(COMPLETE))
    scored = oneclass.score_random_features(temporal(spark, sf_dir), model)
    return rounded(scored.select("network_group_id", "window_start_ms", "label", "anomaly_score"), "anomaly_score", digits=7)


# Nodes (tree, node, feature, cut, rows in the node): leaves have no feature.
TREES = [(0, 0, 0, -55.0, 8), (0, 1, -1, 0.0, 5), (0, 2, 5, 2.5, 3), (0, 5, -1, 0.0, 1), (0, 6, -1, 0.0, 2), (1, 0, 1, 3.0, 8), (1, 1, -1, 0.0, 7), (1, 2, -1, 0.0, 1)]


def mean_path(n):
    """Mean depth of an unsuccessful search among n rows, as SQL."""
    return f"(2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n})" if n > 2 else str(float(n == 2))


def walked(tree, node=0, depth=0):
    """One tree as nested cases: the depth of the leaf a row ends in, and what its rows would add."""
    _, _, feature, cut, size = next(t for t in TREES if t[:2] == (tree, node))
    if feature < 0:
        return f"({depth} + {mean_path(size)})"
    return f"CASE WHEN {COMPLETE[feature]} > {cut} THEN {walked(tree, 2 * node + 2, depth + 1)} ELSE {walked(tree, 2 * node + 1, depth + 1)} END"


@query("forest_scores", f"""WITH {TEMPORAL} SELECT network_group_id, window_start_ms, label,
    round(2 ** (-(({walked(0)}) + ({walked(1)})) / 2 / {mean_path(8)}) - 0.5, 7) + 0.0 AS anomaly_score FROM temporal""")
def forest_scores(spark, sf_dir):
    nodes = spark.createDataFrame([(*t, 8) for t in TREES], forest.NODES)
    scored = forest.score_forest(temporal(spark, sf_dir), nodes, COMPLETE)
    return rounded(scored.select("network_group_id", "window_start_ms", "label", "anomaly_score"), "anomaly_score", digits=7)


MEANS = [-60.0, 2.0, -70.0, -50.0, 0.5, 2.0]
LOADINGS = [(0.6, 0.0), (0.0, 0.8), (0.6, 0.1), (0.5, -0.1), (0.1, 0.5), (0.1, 0.3)]
CENTRED = [f"({f} - {m})" for f, m in zip(COMPLETE, MEANS)]
AXES_SQL = ", ".join("(" + " + ".join(f"{c} * {w[j]}" for c, w in zip(CENTRED, LOADINGS)) + f") AS z{j}" for j in range(2))
ERROR_SQL = " + ".join(f"({c} - (z0 * {w[0]} + z1 * {w[1]})) ** 2" for c, w in zip(CENTRED, LOADINGS))


@query("reconstruction_scores", f"""WITH {TEMPORAL}, z AS (SELECT *, {AXES_SQL} FROM temporal)
SELECT network_group_id, window_start_ms, label, round(({ERROR_SQL}) / 6, 9) + 0.0 AS anomaly_score FROM z""")
def reconstruction_scores(spark, sf_dir):
    model = reconstruction.ReconstructionModel(tuple(COMPLETE), tuple(MEANS), tuple(LOADINGS))
    scored = reconstruction.score_reconstruction(temporal(spark, sf_dir), model)
    return rounded(scored.select("network_group_id", "window_start_ms", "label", "anomaly_score"), "anomaly_score", digits=9)
