"""Checks on whole capture sessions before anything is frozen."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import number, strict_boolean, strip
from wavelark.operators.checks import optional, rate
from wavelark.operators.context import build_desktop_reference, coverage, transform_desktop
from wavelark.operators.ordering import fold_values, running_counts
from wavelark.operators.splits import session_split_plan
from wavelark.schema import DESKTOP_SPLITS, SPLIT_SEED
from wavelark.session import stored

# Limits of the session checks.
MINIMUM_SESSIONS, MINIMUM_SCANS = 5, 3
MIN_BSSID_COVERAGE, MIN_COMPLETENESS, MIN_ELIGIBLE = 0.99, 0.70, 0.70
# Column names of the imported tables.
CLEAR_IDENTIFIERS = ["ssid", "bssid", "ssid_clear", "bssid_clear", "raw_ssid", "raw_bssid"]
# Column names of the imported tables.
REQUIRED = ["source_dataset", "session_id", "environment", "ssid_hash", "bssid_hash", "security_type",
            "security_strength", "label", "attack_type", "is_synthetic"]
# Column names of the imported tables.
CANDIDATE_FIELDS = ["ssid_hash", "bssid_hash", "security_type", "security_strength"]
SHA256 = "^[0-9a-fA-F]{64}$"
LANES = 12


def content_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Order-free digest of a group's row contents, duplicates counted.

    Each row's SHA-256 is cut into twelve 20-bit numbers that are summed. Sums combine before the
    shuffle, so a group of any size costs one small record per task.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(columns)])
    hashed = df.select(*by, F.sha2(text, 256).alias("_h"))
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 5 * i, 5), 16, 10).cast("long")).alias(f"_l{i}") for i in range(LANES)]
    sums = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *lanes)
    return sums.select(*by, F.sha2(F.concat_ws("|", "_n", *[f"_l{i}" for i in range(LANES)]), 256).alias(name))


def fingerprint(obs: DataFrame) -> DataFrame:
    """Content fingerprint per session, blind to the session's name and environment."""
    columns = [c for c in obs.columns if c not in ("session_id", "environment")]
    return content_digest(obs, columns, ["session_id"], "content_fingerprint")


def duplicate_groups(fingerprints: DataFrame) -> DataFrame:
    """Sessions whose content occurs more than once, one row per session."""
    copies = fingerprints.groupBy("content_fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    return fingerprints.join(copies.where(F.col("copies") > 1), "content_fingerprint").select(
        "content_fingerprint", "session_id", "copies")


def _blocked(name: str, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))


def preflight(obs: DataFrame, manifests: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per session with its measures, the sorted list of blockers and the warnings.

    `manifests` has a row per session (session_id and any of scan_count, rows, runtime_ready,
    environment, label, attack_present, source_dataset); a session without rows is `empty_session`. With `folder`, sessions are told
    by that column, and rows whose own session_id differs from it block the session.
    """
    foreign = F.lit(False) if folder is None else ~F.col("_named").eqNullSafe(F.col("session_id"))
    if folder is not None:
        obs = obs.withColumn("_named", F.col("session_id").cast("string")).withColumn("session_id", F.col(folder)).drop(folder)
    have = set(obs.columns)
    missing = [c for c in REQUIRED if c not in have]
    clear = [c for c in CLEAR_IDENTIFIERS if c in have]
    ssid, bssid = optional(obs, "ssid_hash"), optional(obs, "bssid_hash")
    label, attack = number(optional(obs, "label")), optional(obs, "attack_type")
    complete = ~F.greatest(*[optional(obs, c).isNull() for c in CANDIDATE_FIELDS])

    def breach(name, condition):
        if name not in have:
            return F.lit(0).cast("long")
        return F.count_if(F.coalesce(condition, F.lit(True)))

    folded = obs.groupBy("session_id", F.nullif(strip(optional(obs, "environment")), F.lit("")).alias("_place")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(bssid).alias("_bssids"), F.count_if(complete).alias("_complete"),
        breach("source_dataset", F.col("source_dataset") != "own_windows").alias("_source"),
        breach("label", label != 0).alias("_label"),
        F.count_if(attack.isNotNull() & (strip(attack) != "")).alias("_attack"),
        breach("is_synthetic", strict_boolean(optional(obs, "is_synthetic"))).alias("_synthetic"),
        F.count_if(foreign).alias("_foreign"),
        F.count_if(ssid.isNotNull() & ~ssid.rlike(SHA256)).alias("_ssid_form"),
        F.count_if(bssid.isNotNull() & ~bssid.rlike(SHA256)).alias("_bssid_form"),
        F.min(optional(obs, "captured_at_utc", "timestamp")).alias("_start"),
        F.max(optional(obs, "captured_at_utc", "timestamp")).alias("_end"))
    sums = ["rows", "_bssids", "_complete", "_source", "_label", "_attack", "_synthetic", "_foreign", "_ssid_form", "_bssid_form"]
    measured = folded.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count_distinct("_place").alias("_places"),
        F.min("_place").alias("_place"), F.min("_start").alias("time_start_utc"), F.max("_end").alias("time_end_utc"))
    kinds = {"scan_count": "long", "rows": "long", "runtime_ready": "boolean", "environment": "string",
             "label": "long", "attack_present": "boolean", "source_dataset": "string"}
    told = [c for c in kinds if c in manifests.columns]
    m = manifests.select("session_id", *[F.col(c).alias(f"m_{c}") for c in told])
    s = m.join(measured, "session_id", "full").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in sums})

    def manifest(c):
        return F.col(f"m_{c}") if c in told else F.lit(None).cast(kinds[c])

    rows = F.col("rows")
    bssid_coverage, completeness = rate(F.col("_bssids"), rows), rate(F.col("_complete"), rows)
    place, places = F.col("_place"), F.coalesce("_places", F.lit(0).cast("long"))
    # Blocker names.
    blockers = F.array_compact(F.array(
        _blocked("bssid_hash_coverage_below_099", bssid_coverage < MIN_BSSID_COVERAGE),
        _blocked("bssid_hash_not_sha256", F.col("_bssid_form") > 0),
        _blocked("clear_wifi_identifier_columns_present", F.lit(bool(clear))),
        _blocked("desktop_candidate_completeness_below_070", completeness < MIN_COMPLETENESS),
        _blocked("empty_session", rows == 0),
        _blocked("environment_missing", places == 0),
        _blocked("manifest_attack_present", manifest("attack_present")),
        _blocked("manifest_environment_mismatch",
                 (strip(manifest("environment")) != "") & (strip(manifest("environment")) != place)),
        _blocked("manifest_label_not_zero", manifest("label") != 0),
        _blocked("manifest_row_count_mismatch", manifest("rows") != rows),
        _blocked("manifest_source_dataset_not_own_windows", manifest("source_dataset") != "own_windows"),
        _blocked("multiple_environments_in_session", places > 1),
        _blocked("required_interim_columns_missing", F.lit(bool(missing))),
        _blocked("row_attack_type_present", F.col("_attack") > 0),
        _blocked("row_is_synthetic_not_false", F.col("_synthetic") > 0),
        _blocked("row_label_not_zero", F.col("_label") > 0),
        _blocked("row_session_id_mismatch", F.col("_foreign") > 0),
        _blocked("row_source_dataset_not_own_windows", F.col("_source") > 0),
        _blocked("runtime_ready_false", ~manifest("runtime_ready")),
        _blocked("scan_count_below_runtime_minimum", manifest("scan_count") < MINIMUM_SCANS),
        _blocked("ssid_hash_not_sha256", F.col("_ssid_form") > 0),
    ))
    duplicates = duplicate_groups(fingerprint(obs.drop("_named"))).select("session_id", F.lit("duplicate_session_content").alias("_copy"))
    return s.withColumns({
        "environment": F.when(places == 1, place).otherwise(F.nullif(strip(manifest("environment")), F.lit(""))),
        "bssid_hash_coverage": bssid_coverage, "desktop_candidate_completeness": completeness,
        "_blockers": blockers,
    }).join(duplicates, "session_id", "left").withColumn(
        "blockers", F.sort_array(F.array_compact(F.concat("_blockers", F.array("_copy")))),
    ).select(
        "session_id", "environment", "rows", manifest("scan_count").alias("scan_count"),
        "bssid_hash_coverage", "desktop_candidate_completeness", "time_start_utc", "time_end_utc",
        "blockers", (F.size("blockers") == 0).alias("valid"),
        # Fixed value: warning name.
        F.array_compact(F.array(_blocked("captured_at_utc_unavailable", F.col("time_start_utc").isNull() | F.col("time_end_utc").isNull()))).alias("warnings"))


def overlap_pairs(sessions: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Sessions whose closed time ranges overlap, each pair once.

    Of two overlapping ranges one starts inside the other. Only the enclosing side is spread over
    the buckets it covers; the starting side sits in one bucket, so every pair meets exactly once.
    """
    width = F.expr(f"CAST(unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {bucket}) AS BIGINT)")
    timed = sessions.where(F.col("time_start_utc").isNotNull() & F.col("time_end_utc").isNotNull()).select(
        "session_id", F.unix_micros("time_start_utc").alias("s"), F.unix_micros("time_end_utc").alias("e"))

    def slot(c):
        return F.floor(F.col(c) / width)

    outer = timed.select(F.col("session_id").alias("o_id"), F.col("s").alias("o_s"), F.col("e").alias("o_e"),
                         F.explode(F.sequence(slot("s"), slot("e"))).alias("slot"))
    inner = timed.select(F.col("session_id").alias("i_id"), F.col("s").alias("i_s"), slot("s").alias("slot"))
    first = (F.col("i_s") > F.col("o_s")) | ((F.col("i_s") == F.col("o_s")) & (F.col("i_id") > F.col("o_id")))
    pairs = outer.join(inner, "slot").where(first & (F.col("i_s") <= F.col("o_e")))
    return pairs.select(F.least("o_id", "i_id").alias("session_a"), F.greatest("o_id", "i_id").alias("session_b"))


def overlap_counts(sessions: DataFrame) -> DataFrame:
    """Per session with a time range, how many other sessions its closed range overlaps.

    Those are all sessions that start before its end, less those that ended before its start: two running counts over
    the distinct times, so the work grows with the sessions and not with the pairs.
    """
    timed = sessions.where(F.col("time_start_utc").isNotNull() & F.col("time_end_utc").isNotNull()).select(
        "session_id", F.unix_micros("time_start_utc").alias("_s"), F.unix_micros("time_end_utc").alias("_e"))
    points = timed.select(F.explode(F.array(
        F.struct(F.col("_s").alias("at"), F.lit(1).alias("start"), F.lit(0).alias("end")),
        F.struct(F.col("_e").alias("at"), F.lit(0).alias("start"), F.lit(1).alias("end")))).alias("p")).select("p.*")
    folded = fold_values(points, "at", counts={"start": F.col("start"), "end": F.col("end")})
    ranked = stored(running_counts(folded, "at", ["start", "end"]), "session-times")
    begun = ranked.select(F.col("at").alias("_e"), F.col("cum_start").alias("_begun"))
    over = ranked.select(F.col("at").alias("_s"), (F.col("cum_end") - F.col("end")).alias("_over"))
    return timed.join(begun, "_e").join(over, "_s").select(
        "session_id", (F.col("_begun") - F.col("_over") - 1).alias("overlapping_sessions"))


def overlaps_of(sessions: DataFrame, session_id: str) -> DataFrame:
    """The sessions that overlap one given session."""
    own = sessions.where(F.col("session_id") == session_id).select(
        F.struct(F.col("time_start_utc").alias("s"), F.col("time_end_utc").alias("e")).alias("t")).scalar()
    return sessions.where((F.col("session_id") != session_id) & (F.col("time_start_utc") <= own["e"]) & (
        F.col("time_end_utc") >= own["s"])).select("session_id")


def coverage_dry_run(obs: DataFrame, sessions: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Share of usable rows per split if the plan were frozen now."""
    plan = session_split_plan(sessions, seed).select("session_id", "split").where(F.col("split").isNotNull())
    rows = obs.join(plan, "session_id")
    ref = build_desktop_reference(rows.where(F.col("split") == "reference"))
    out = coverage(transform_desktop(rows.where(F.col("split") != "reference"), ref))
    return out.withColumn("below_minimum", F.col("eligible_rate") < MIN_ELIGIBLE)


def preflight_status(checked: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: counts, the one status (earlier reasons win), the common environment, all blockers and the warnings."""
    duplicate, usable = F.array_contains("blockers", "duplicate_session_content"), F.col("valid")
    place = F.when(usable, F.col("environment"))
    counts = checked.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(usable).alias("valid_sessions"),
        F.count_if(~usable).alias("invalid_sessions"), F.count_if(duplicate).alias("duplicate_sessions"),
        # Two different environments exist exactly when the smallest and largest differ.
        F.coalesce(F.min(place) != F.max(place), F.lit(False)).alias("mixed_environments"),
        F.when(F.min(place) == F.max(place), F.min(place)).alias("environment"),
        F.array_distinct(F.flatten(F.collect_set("blockers"))).alias("_found"))
    low = covered.agg(F.count(F.lit(1)).alias("n"), F.count_if("below_minimum").alias("low")).select(
        ((F.col("n") < 3) | (F.col("low") > 0)).alias("x")).scalar()
    overlap = F.lit(False)
    if {"time_start_utc", "time_end_utc"} <= set(checked.columns):
        overlap = F.coalesce(overlap_counts(checked.where(usable)).agg(F.max("overlapping_sessions").alias("n")).scalar() > 0, F.lit(False))
    enough = F.col("valid_sessions") >= MINIMUM_SESSIONS
    # Names of statuses, blockers and warnings.
    return counts.withColumns({
        "status": F.when(F.col("sessions") == 0, "blocked_no_real_sessions")
        .when(F.col("duplicate_sessions") > 0, "blocked_duplicate_session_content")
        .when(F.col("invalid_sessions") > 0, "blocked_invalid_sessions")
        .when(~enough, "blocked_insufficient_valid_sessions")
        .when(F.col("mixed_environments"), "blocked_mixed_normal_environments")
        .when(low, "blocked_candidate_reference_coverage")
        .otherwise("ready_for_split_freeze"),
        "blockers": F.sort_array(F.array_compact(F.concat("_found", F.array(
            _blocked("multiple_environments_in_desktop_candidate_v1_normal_cohort", F.col("mixed_environments")),
            _blocked("candidate_reference_eligible_rate_below_070", enough & ~F.col("mixed_environments") & low))))),
        "warnings": F.array_compact(F.array(_blocked("temporal_overlap_between_sessions", overlap)))}).drop("_found")


def frozen_drift(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Every session of either side: unchanged, mutated, missing or unassigned."""
    f = frozen.select("session_id", "split", F.col("content_fingerprint").alias("frozen_fingerprint"))
    c = current.select("session_id", "content_fingerprint")
    return f.join(c, "session_id", "full").withColumn("state", (
        F.when(F.col("frozen_fingerprint").isNull(), "unassigned")
        .when(F.col("content_fingerprint").isNull(), "missing")
        .when(F.col("content_fingerprint") != F.col("frozen_fingerprint"), "mutated")
        .otherwise("unchanged")))


def assignment_digest(assignments: DataFrame) -> DataFrame:
    """One digest for a whole set of assignments, whatever order they are stored in."""
    return content_digest(assignments, ["session_id", "split", "content_fingerprint"], [], "split_digest")


def check_disjoint(assignments: DataFrame) -> DataFrame:
    """Split sizes and whether each session is in one split and every split is filled."""
    repeated = assignments.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("r")).scalar()
    counts = assignments.agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in DESKTOP_SPLITS],
        F.count_if(~F.coalesce(F.col("split").isin(DESKTOP_SPLITS), F.lit(False))).alias("unknown_splits"),
    ).withColumn("repeated_sessions", repeated)
    return counts.withColumn("valid", (
        (F.col("repeated_sessions") == 0) & (F.col("unknown_splits") == 0) & (F.col("reference") == 1)
        & (F.col("model_train") >= 2) & (F.col("validation") >= 1) & (F.col("test_normal") >= 1)))
