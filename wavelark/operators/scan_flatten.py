"""Nested scan documents as desktop observations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import present_or_fail
from wavelark.operators.context import left_join
from wavelark.schema import CONTROLLED_COLUMNS, DESKTOP_TYPES, project
from wavelark.session import stored

ENTRY = ["ssid_hash", "bssid_hash", "ssid_not_broadcast", "rssi_dbm", "link_quality", "beacon_interval_ms", "tsf_us",
         "host_timestamp_100ns", "center_frequency_khz", "ds_parameter_channel", "security_type", "security_strength",
         "security_source", "ie_blob_size", "ie_parser_truncated"]
NATIVE = ["phy_id", "bss_type", "phy_type", "in_reg_domain"]


def _entries(scans: DataFrame) -> DataFrame:
    heard = scans.select("*", F.explode("interfaces").alias("_interface"))
    return heard.select("*", F.explode("_interface.bss_entries").alias("_entry")).withColumns({
        "interface_guid": F.col("_interface.interface.guid"),
        "scan_index": F.coalesce("scan_index", F.lit(-1).cast("long")),
        **{c: F.col(f"_entry.{c}") for c in ENTRY},
        **{c: F.col(f"_entry.native.{c}") for c in NATIVE}})


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def flatten_scans(scans: DataFrame, session_id, environment) -> DataFrame:
    """Normal observations; one without a BSSID hash fails the job."""
    rows = _entries(scans).withColumns({
        "source_dataset": F.lit("own_windows"), "session_id": _col(session_id), "environment": _col(environment),
        "collection_mode": F.lit("windows_native_wifi_scan"), "observation_type": F.lit("windows_bss_scan"),
        "label": F.lit(0), "attack_type": F.lit(None), "is_synthetic": F.lit(False)})
    out = project(rows, DESKTOP_TYPES)
    return out.withColumn("bssid_hash", present_or_fail("bssid_hash", "scan observation"))


def flatten_controlled(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Observations of controlled sessions.

    The job fails if a session has no manifest, if the label disagrees with the target flag or the target flag with the
    manifest's target, and if a session holds another number of target rows than its manifest promises, or no row at all where it
    promises some.
    """
    promised = F.col("matched_observation_count") if "matched_observation_count" in manifest.columns else F.lit(None).cast("long")
    told = manifest.select("session_id", "environment", "attack_type", "target_bssid_hash", promised.alias("_promised"), F.lit(True).alias("_told"))
    rows = _entries(scans)
    found = rows.groupBy("session_id").agg(
        F.count_if(F.coalesce(F.col("_entry.is_attack_target"), F.lit(False))).alias("_targets"), F.lit(True).alias("_heard"))
    # One row a session, written once: a session of any number of rows is joined with it where its rows are.
    told = stored(told.join(found, "session_id", "left"), "controlled-sessions")
    # A promise without any row keeps a row of its own to fail on; other sessions without rows are no matter.
    empty = told.where(F.col("_heard").isNull() & (F.coalesce("_promised", F.lit(0)) > 0))
    rows = left_join(rows.drop(*[c for c in told.columns if c != "session_id"]), told.withColumnRenamed("session_id", "_session"),
                     {"session_id": "_session"}, "session_id").drop("_session").unionByName(empty, allowMissingColumns=True)
    refused = F.when(F.col("_entry").isNull(), F.raise_error(F.lit("controlled session: targets are promised, but there is no observation"))).when(
        F.col("_told").isNull(), F.raise_error(F.lit("controlled session without a manifest"))).when(
        F.col("_targets") != F.col("_promised"), F.raise_error(F.lit("controlled session: number of target rows differs from the manifest")))
    label = F.coalesce(F.col("_entry.observation_label"), F.lit(-1))
    target = F.coalesce(F.col("_entry.is_attack_target"), F.lit(False))
    agrees = (label == target.cast("int")) & (target == (F.col("bssid_hash") == F.col("target_bssid_hash")))
    rows = rows.withColumns({
        "source_dataset": F.lit("own_windows_attack"), "collection_mode": F.lit("windows_native_wifi_scan"),
        "observation_type": F.lit("windows_bss_scan"), "session_label": F.lit(1), "is_synthetic": F.lit(False),
        "is_attack_target": target,
        "label": F.when(refused.isNotNull(), refused.cast("long")).when(F.coalesce(agrees, F.lit(False)), label).otherwise(
            F.raise_error(F.lit("controlled session: label, target flag and manifest disagree")))})
    kinds = dict(DESKTOP_TYPES) | {"session_label": "long", "is_attack_target": "boolean"}
    return project(rows, [(c, kinds[c]) for c in CONTROLLED_COLUMNS])


def controlled_violations(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per session, how far target and normal rows depart from what its manifest promises."""
    target = F.col("label") == 1
    counts = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(target).alias("attack_rows"), F.count_if(~target).alias("normal_rows"))
    return manifest.join(counts, "session_id", "left").select(
        "session_id", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        F.coalesce("attack_rows", F.lit(0).cast("long")).alias("attack_rows"),
        F.coalesce("normal_rows", F.lit(0).cast("long")).alias("normal_rows"),
        (F.coalesce("attack_rows", F.lit(0).cast("long")) != F.col("matched_observation_count")).alias("count_differs"))
