"""Synthetic what-if rows made from unchanged observations, and how scores react to them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import tolerant_true
from wavelark.operators.checks import rate, require_columns
from wavelark.operators.context import Reference, eligible, left_join, transform_desktop
from wavelark.operators.evaluation import _cut, _spread
from wavelark.operators.ordering import fold_values
from wavelark.session import stored

# Security choices from weakest to strongest.
SECURITY_CHOICES = [("OPEN", 0.0), ("LEGACY_PRIVACY", 1.0), ("WPA2_OR_NEWER", 3.0)]
CONTROL = "hypothetical_control"
# Scenario, family, expected level, expected signals.
SCENARIOS = [
    (CONTROL, "control_copy", "normal_like", []),
    ("hypothetical_new_bssid", "hypothetical_evil_twin", "medium_suspicion", ["new_bssid_for_known_ssid"]),
    ("ablation_weaker_security_only", "feature_ablation", "low_suspicion",
     ["security_strength_lower_than_reference"]),
    ("hypothetical_new_bssid_security_change", "hypothetical_evil_twin", "high_suspicion",
     ["new_bssid_for_known_ssid", "security_profile_changed"]),
    ("hypothetical_new_bssid_security_downgrade", "hypothetical_evil_twin", "high_suspicion",
     ["new_bssid_for_known_ssid", "security_profile_changed", "security_strength_lower_than_reference"]),
]
CLEARED = {"label": "long", "session_label": "long", "is_attack_target": "boolean", "attack_type": "string"}


def baseline_rows(features: DataFrame) -> DataFrame:
    """Real rows that match the reference of the SSID they name in every respect."""
    rows = features
    if "is_synthetic" in features.columns:
        rows = rows.where(~tolerant_true(F.col("is_synthetic")))
    return rows.where(
        eligible() & (F.col("context_resolution") == "ssid_hash") & (F.col("bssid_changed") == 0)
        & (F.col("security_changed") == 0) & (F.abs("security_strength_delta") <= 1e-9))


def _scenario(i: int, strength: Column, kind: Column, new_bssid: bool, when: Column | None) -> Column:
    name, family, level, signals = SCENARIOS[i]
    made = F.struct(
        F.lit(name).alias("scenario_type"), F.lit(family).alias("scenario_family"),
        F.lit(level).alias("expected_suspicion_level"), F.lit("|".join(signals)).alias("hypothetical_expected_signals"),
        kind.alias("security_type"), strength.cast("double").alias("security_strength"),
        F.lit(new_bssid).alias("new_bssid"))
    return made if when is None else F.when(when, made)


def generate_scenarios(baseline: DataFrame, ref: Reference, row_key: str = "event_id") -> DataFrame:
    """Up to five rows per baseline row: a control and four controlled changes."""
    require_columns(baseline, ["ssid_hash", "bssid_hash", "security_type", "security_strength", "session_id",
                               "scan_index", row_key], "scenarios")
    own = ref.profiles.where(F.col("security_strength_median").isNotNull()).select(
        F.col("ssid_hash").alias("_ssid"), F.col("security_types").alias("_types"),
        F.col("security_strength_median").alias("_median"), F.col("bssid_count").alias("_known"))
    rows = baseline.join(own, F.col("ssid_hash") == F.col("_ssid"))
    choices = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("strength")) for t, s in SECURITY_CHOICES])
    unused = F.filter(choices, lambda c: ~F.array_contains("_types", c["type"]))
    other = F.try_element_at(unused, F.lit(1))
    lower = F.try_element_at(F.filter(unused, lambda c: c["strength"] < F.col("_median")), F.lit(-1))
    kind, strength, median = F.col("security_type"), F.col("security_strength"), F.col("_median")
    plans = F.array_compact(F.array(
        _scenario(0, strength, kind, False, None),
        _scenario(1, strength, kind, True, None),
        _scenario(2, F.greatest(F.lit(0.0), median - 1), kind, False, median > 0),
        _scenario(3, median, other["type"], True, other.isNotNull()),
        _scenario(4, lower["strength"], lower["type"], True, lower.isNotNull()),
    ))
    kept = [c for c in baseline.columns if c not in ("security_type", "security_strength", "source_dataset",
                                                     "session_id", "is_synthetic", *CLEARED)]
    kept = [c for c in kept if c not in ("context_ssid_hash", "context_resolution", "context_available",
                                         "feature_complete", "ssid_bssid_count", "bssid_changed",
                                         "security_changed", "security_strength_delta")]
    session = F.coalesce(F.col("session_id"), F.lit("unknown"))
    made = rows.select(*kept, session.alias("source_session_id"), F.col("scan_index").alias("source_scan_index"),
                       F.col(row_key).alias("source_row_index"), "_known", F.inline(plans))
    prefix = F.concat_ws("|", F.lit("desktop-hypothetical-bssid"), "scenario_type", "ssid_hash", "bssid_hash",
                         "source_session_id", F.col("source_scan_index").cast("string"), F.lit(""))
    made = made.withColumn("_prefix", F.when(F.col("new_bssid"), prefix))
    first = F.sha2(F.concat("_prefix", F.lit("0")), 256)
    members = ref.members.select(F.col("ssid_hash").alias("_m_ssid"), F.col("bssid_hash").alias("_m_bssid"))
    # Rows that keep their address have no new one; where the members are many, these rows are spread out.
    tried = left_join(made.withColumn("_new", first), members, {"ssid_hash": "_m_ssid", "_new": "_m_bssid"}, "_new")
    # A made-up address that is already known takes the next salt; with k known ones, k + 1 salts suffice.
    clash = tried.where(F.col("_m_bssid").isNotNull()).select("ssid_hash", "_prefix", "_known").distinct()
    next_salt = clash.withColumn("_salt", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_known")))).withColumn(
        "_again", F.sha2(F.concat("_prefix", F.col("_salt").cast("string")), 256)).join(
        members, (F.col("ssid_hash") == F.col("_m_ssid")) & (F.col("_again") == F.col("_m_bssid")), "left_anti",
    ).groupBy(F.col("_prefix").alias("_taken")).agg(F.min_by("_again", "_salt").alias("_again"))
    # Clashes are rare and counted by their file, so the rows themselves stay where they are.
    resolved = left_join(tried, stored(next_salt, "next-salts"), {"_prefix": "_taken"}, "_prefix")
    known = F.col("_m_bssid").isNotNull()
    out = resolved.withColumns({
        "bssid_hash": F.when(F.col("_prefix").isNull(), F.col("bssid_hash"))
        .when(known, F.col("_again")).otherwise(F.col("_new")),
        "source_dataset": F.lit("own_windows_hypothetical"),
        "session_id": F.concat(F.lit("hypothetical-"), "scenario_type", F.lit("-"), "source_session_id"),
        "evaluation_type": F.lit("hypothetical_stress_test"),
        "ground_truth_available": F.lit(False),
        "is_synthetic": F.lit(True),
        **{c: F.lit(None).cast(t) for c, t in CLEARED.items() if c in baseline.columns},
    })
    return out.drop("_prefix", "_taken", "_new", "_again", "_m_ssid", "_m_bssid", "_known", "new_bssid")


def scenario_features(scenarios: DataFrame, ref: Reference) -> DataFrame:
    return transform_desktop(scenarios, ref).groupBy("scenario_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("feature_complete").alias("feature_complete"),
        F.count_if(F.col("bssid_changed") != 0).alias("bssid_changed"),
        F.count_if(F.col("security_changed") != 0).alias("security_changed"),
        F.count_if(F.col("security_strength_delta") < 0).alias("weaker_security"))


def evaluate_scenarios(scored: DataFrame, test_sessions: DataFrame, threshold) -> DataFrame:
    """Threshold exceedance per scenario and its distance to the unmodified control.

    Fails on a row that is not synthetic or does not come from one of the test sessions.
    """
    require_columns(scored, ["scenario_type", "source_session_id", "is_synthetic", "anomaly_score"], "scenarios")
    allowed = test_sessions.select(F.col("session_id").alias("_allowed")).distinct()
    joined = scored.join(allowed, F.col("source_session_id") == F.col("_allowed"), "left")
    wrong = F.col("_allowed").isNull() | ~tolerant_true(F.col("is_synthetic"))
    checked = joined.withColumn("scenario_type", F.when(wrong, F.raise_error(
        F.lit("scenarios: row is not synthetic or not from a test session"))).otherwise(F.col("scenario_type")))
    # One fold of scores serves all counts and quantiles, so that rows are generated and scored once.
    kinds = ["scenario_type", "_ok", "anomaly_score"]
    folded = stored(checked.withColumn("_ok", eligible()).groupBy(*kinds).agg(F.count(F.lit(1)).alias("n")), "scenario-scores")
    over = F.col("_ok") & (F.col("anomaly_score") > _cut(threshold))

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))

    inputs = folded.groupBy("scenario_type").agg(
        F.sum("n").alias("input_rows"), rows(F.col("_ok")).alias("eligible_rows"),
        rows(~F.col("_ok")).alias("not_evaluable_rows"), rows(over).alias("anomaly_count"))
    scores = fold_values(folded.where("_ok"), "anomaly_score", ["scenario_type"], {"n": F.col("n")})
    spread = _spread(scores, ["scenario_type"], threshold, {"score_median": 0.5, "score_p95": 0.95}, "anomaly_score")
    both = inputs.join(spread.drop("rows", "score_std", "threshold_exceedance_count", "threshold_exceedance_rate"),
                       "scenario_type", "left").withColumns({
        "normal_count": F.col("eligible_rows") - F.col("anomaly_count"),
        "threshold_exceedance_rate": rate(F.col("anomaly_count"), F.col("eligible_rows"))})
    control = inputs.where(F.col("scenario_type") == CONTROL).select(
        rate(F.col("anomaly_count"), F.col("eligible_rows")).alias("r")).scalar()
    return both.withColumn("delta_to_control", F.when(
        F.col("scenario_type") != CONTROL, F.col("threshold_exceedance_rate") - control))
