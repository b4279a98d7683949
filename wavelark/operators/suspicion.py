"""Heuristic suspicion labels on desktop features. They are hints, never attack labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import rate, require_columns
from wavelark.operators.context import eligible
from wavelark.schema import DESKTOP_FEATURES

LEVELS = ["normal_like", "low_suspicion", "medium_suspicion", "high_suspicion"]


def suspicion(features: DataFrame) -> DataFrame:
    require_columns(features, ["context_available", "feature_complete", *DESKTOP_FEATURES], "suspicion labels")
    ok = eligible()
    bssid = F.col("bssid_changed") != 0
    security = F.col("security_changed") != 0
    weaker = F.col("security_strength_delta") < 0
    points = bssid.cast("long") * 2 + security.cast("long") * 2 + weaker.cast("long")
    level = (F.when(points <= 0, LEVELS[0]).when(points == 1, LEVELS[1])
             .when(points <= 3, LEVELS[2]).otherwise(LEVELS[3]))
    # Hypothesis names, most specific first.
    hypothesis = (
        F.when(bssid & security & weaker, "possible_evil_twin_with_security_downgrade")
        .when(bssid & security, "possible_evil_twin_with_security_change")
        .when(bssid, "possible_evil_twin_new_bssid")
        .when(security & weaker, "security_profile_anomaly_with_downgrade")
        .when(security, "security_profile_anomaly")
        .when(weaker, "weaker_security_observation")
        .otherwise("no_evil_twin_hypothesis"))
    reasons = F.concat_ws(
        "|", F.when(bssid, "new_bssid_for_known_ssid"), F.when(security, "security_profile_changed"),
        F.when(weaker, "security_strength_lower_than_reference"))
    notes = F.when(F.col("ssid_bssid_count") > 1, "known_ssid_has_multiple_reference_bssids").otherwise("")
    return features.withColumns({
        "suspected_label": F.when(ok, (points > 0).cast("long")),
        "suspicion_score": F.when(ok, points),
        "suspicion_level": F.when(ok, level).otherwise("not_evaluable"),
        "hypothesis_type": F.when(ok, hypothesis).otherwise("not_evaluable"),
        "heuristic_reasons": F.when(ok, reasons).otherwise(""),
        "context_notes": F.when(ok, notes).otherwise(""),
        "label_source": F.lit("heuristic_exploratory_v2"),
        "ground_truth_available": F.lit(False),
    })


def suspicion_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """Counts per source and, with a `by` column, one overall row, marked by `is_total`."""
    evaluable = F.col("suspected_label").isNotNull()
    grouped = df.rollup(by) if by else df.groupBy()
    out = grouped.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(evaluable).alias("eligible"),
        F.count_if(~evaluable).alias("not_evaluable"), F.count_if(F.col("suspected_label") == 1).alias("suspected"),
        F.count_if(F.col("suspected_label") == 0).alias("non_suspected"),
        *[F.count_if(F.col("suspicion_level") == level).alias(level) for level in LEVELS],
        *([(F.grouping(by) == 1).alias("is_total")] if by else []))
    return out.withColumn("suspected_rate", rate(F.col("suspected"), F.col("eligible")))
