"""Beacon gaps and tumbling radio profiles."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions.identity import stable_group_id
from wavelark.functions.radio import channel_to_frequency_mhz, wifi_band
from wavelark.functions.text import number
from wavelark.operators.checks import optional, require_columns
from wavelark.operators.ordering import dealt, with_previous
from wavelark.sources.tables import write_once

MISSING_BSSID = "__MISSING_BSSID__"
GROUP_KEYS = ["source_dataset", "session_id", "_attack", "_bssid"]
# Columns of a profile, in order.
PROFILE_COLUMNS = [
    "source_dataset", "session_id", "network_identity_id", "network_group_id",
    "window_start_ms", "label", "attack_type", "is_synthetic", "rssi_mean_dbm",
    "beacon_count", "observed_inter_beacon_ms", "inter_beacon_sample_count", "channel",
    "frequency_mhz", "wifi_band", "configured_beacon_interval_ms", "security_type",
]


def _with_group_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_attack": F.coalesce(optional(df, "attack_type").cast("string"), F.lit("")),
        "_bssid": F.coalesce(F.col("bssid").cast("string"), F.lit(MISSING_BSSID)),
        "elapsed_ms": number(F.col("elapsed_ms")),
    })


def _window_start(column: str, width_ms: int) -> Column:
    return F.floor(F.col(column) / F.lit(float(width_ms))) * F.lit(float(width_ms))


def inter_beacon_gap(df: DataFrame, tie_break: Sequence[str] = ("event_id",)) -> DataFrame:
    """Time since the previous beacon of the same source, session, attack and BSSID.

    A network is cut into ranges of time and `tie_break`, wherever its rows are dense.
    """
    require_columns(df, ["source_dataset", "session_id", "elapsed_ms", "bssid"], "beacon gap")
    # Rows without a time come last and have no gap of their own.
    order = [F.col("elapsed_ms").asc_nulls_last(), *[F.col(c) for c in tie_break if c in df.columns]]
    rows = dealt(_with_group_keys(df), GROUP_KEYS, order)
    return (
        with_previous(rows, GROUP_KEYS, order, F.col("_block"), {"_before": "elapsed_ms"})
        .withColumn("inter_beacon_ms", F.col("elapsed_ms") - F.col("_before"))
        .drop("_before", "_attack", "_bssid")
    )


def _first_by(value: Column, order: Column) -> Column:
    """Earliest value that is not NULL."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def beacon_profile(df: DataFrame, window_ms: int = 1000,
                   tie_break: Sequence[str] = ("event_id",),
                   block_windows: int = 3600) -> DataFrame:
    """One row per network group and tumbling window of individual beacons.

    Gaps may cross windows. Inside a window they add up to last - first, and the one gap that
    enters it is first - (last of the previous window), so the mean gap comes from window
    totals and no row-level lag over a whole network is needed.
    """
    require_columns(df, ["source_dataset", "session_id", "elapsed_ms", "bssid", "rssi_dbm",
                         "channel", "advertised_channel", "label", "is_synthetic"], "beacon profile")
    configured = ("configured_beacon_interval_ms" if "configured_beacon_interval_ms" in df.columns
                  else "beacon_interval_ms")
    advertised = number(F.col("advertised_channel"))
    rows = _with_group_keys(df).select(
        *GROUP_KEYS, "elapsed_ms",
        _window_start("elapsed_ms", window_ms).alias("_window"),
        number(F.col("rssi_dbm")).alias("_rssi"),
        F.when(advertised > 0, advertised).otherwise(number(F.col("channel"))).alias("_channel"),
        number(optional(df, configured, "double")).alias("_interval"),
        optional(df, "security_type").alias("_security"),
        "label", "is_synthetic",
        F.struct("elapsed_ms", *[c for c in tie_break if c in df.columns]).alias("_order"),
    )
    order = F.col("_order")
    totals = rows.groupBy(*GROUP_KEYS, "_window").agg(
        F.avg("_rssi").alias("rssi_mean_dbm"),
        F.count(F.lit(1)).alias("beacon_count"),
        F.count("elapsed_ms").alias("_timed"),
        F.min("elapsed_ms").alias("_first"),
        F.max("elapsed_ms").alias("_last"),
        _first_by(F.col("_channel"), order).alias("channel"),
        F.percentile("_interval", F.lit(0.5)).alias("configured_beacon_interval_ms"),
        _first_by(F.col("_security"), order).alias("security_type"),
        _first_by(F.col("label"), order).alias("label"),
        _first_by(F.col("is_synthetic"), order).alias("is_synthetic"),
    )
    block = F.coalesce(F.floor(F.col("_window") / (window_ms * block_windows)), F.lit(2**62))
    chained = with_previous(totals, GROUP_KEYS, ["_window"], block, {"_before": "_last"})
    start = F.coalesce("_before", "_first")
    samples = F.col("_timed") - F.when(F.col("_before").isNull() & (F.col("_timed") > 0), 1).otherwise(0)
    frequency = channel_to_frequency_mhz(F.col("channel"))
    return (
        chained.where(F.col("rssi_mean_dbm").isNotNull())
        .withColumns({
            "inter_beacon_sample_count": samples.cast("long"),
            "observed_inter_beacon_ms": F.when(samples > 0, (F.col("_last") - start) / samples),
            "frequency_mhz": frequency,
            "wifi_band": wifi_band(frequency),
            "network_identity_id": stable_group_id(F.col("source_dataset"), F.col("_bssid")),
            "network_group_id": stable_group_id(*[F.col(c) for c in GROUP_KEYS]),
            "attack_type": F.nullif(F.col("_attack"), F.lit("")),
            "window_start_ms": F.col("_window"),
        })
        .select(*PROFILE_COLUMNS)
    )


def aggregate_profile(df: DataFrame) -> DataFrame:
    """The same profile from rows that already are one-second aggregates."""
    require_columns(df, ["source_dataset", "session_id", "elapsed_ms", "ap_id", "rssi_dbm",
                         "frequency_mhz", "beacon_count", "label", "is_synthetic"], "aggregate profile")
    measured = ("measured_inter_beacon_ms" if "measured_inter_beacon_ms" in df.columns
                else "beacon_interval_ms")
    rows = df.where(F.col("wifi_standard") == "802.11n") if "wifi_standard" in df.columns else df
    rows = rows.withColumns({
        "_rssi": number(F.col("rssi_dbm")),
        "_gap": number(F.col(measured)),
        "_count": number(F.col("beacon_count")).cast("long"),
    }).where(F.col("_rssi").isNotNull() & F.col("_gap").isNotNull())
    frequency = number(F.col("frequency_mhz"))
    source, session, ap = F.col("source_dataset"), F.col("session_id"), F.col("ap_id")
    return rows.select(
        source, session,
        stable_group_id(source, ap).alias("network_identity_id"),
        stable_group_id(source, session, ap).alias("network_group_id"),
        _window_start("elapsed_ms", 1000).alias("window_start_ms"),
        "label",
        optional(df, "attack_type").alias("attack_type"),
        "is_synthetic",
        F.col("_rssi").alias("rssi_mean_dbm"),
        F.col("_count").alias("beacon_count"),
        F.col("_gap").alias("observed_inter_beacon_ms"),
        F.col("_count").alias("inter_beacon_sample_count"),
        number(optional(df, "channel", "double")).alias("channel"),
        frequency.alias("frequency_mhz"),
        wifi_band(frequency).alias("wifi_band"),
        F.lit(None).cast("double").alias("configured_beacon_interval_ms"),
        F.lit(None).cast("string").alias("security_type"),
    )


TEMPORAL_KEYS = ["source_dataset", "session_id", "network_identity_id", "network_group_id",
                 "_attack", "label", "is_synthetic", "_block_start"]


def rssi_temporal(profile: DataFrame, window_ms: int = 5000) -> DataFrame:
    """RSSI statistics over blocks of a window profile."""
    require_columns(profile, ["source_dataset", "session_id", "network_identity_id",
                              "network_group_id", "window_start_ms", "rssi_mean_dbm", "label",
                              "is_synthetic"], "temporal profile")
    rows = profile.withColumns({
        "_attack": F.coalesce(optional(profile, "attack_type").cast("string"), F.lit("")),
        "_at": number(F.col("window_start_ms")),
        "_rssi": number(F.col("rssi_mean_dbm")),
    }).where(F.col("_rssi").isNotNull()).withColumn("_block_start", _window_start("_at", window_ms))
    return rows.groupBy(*TEMPORAL_KEYS).agg(
        F.avg("_rssi").alias("rssi_mean_dbm"),
        F.stddev_pop("_rssi").alias("rssi_std_db"),
        F.min("_rssi").alias("rssi_min_dbm"),
        F.max("_rssi").alias("rssi_max_dbm"),
        (F.max_by("_rssi", "_at") - F.min_by("_rssi", "_at")).alias("rssi_delta_db"),
        F.count(F.lit(1)).alias("window_count"),
    ).select(
        "source_dataset", "session_id", "network_identity_id", "network_group_id",
        F.col("_block_start").alias("window_start_ms"), "label",
        F.nullif(F.col("_attack"), F.lit("")).alias("attack_type"), "is_synthetic",
        "rssi_mean_dbm", "rssi_std_db", "rssi_min_dbm", "rssi_max_dbm", "rssi_delta_db",
        "window_count",
    )


def build_profiles(normal: DataFrame, aggregates: DataFrame,
                   attack: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every window profile of one run, by name; nothing is computed until one is used."""
    out = {
        "normal_beacon_1s": beacon_profile(normal),
        "aggregate_beacon_1s": aggregate_profile(aggregates),
    }
    if attack is not None:
        out["attack_beacon_1s"] = beacon_profile(attack)
    for name in list(out):
        out[name.replace("beacon_1s", "rssi_5s")] = rssi_temporal(out[name])
    return out


def write_profiles(normal: DataFrame, aggregates: DataFrame, root: str, attack: DataFrame | None = None) -> dict[str, str]:
    """Writes every profile of one run below `root` and returns the paths by name.

    The one-second profiles are computed once: the five-second ones read what was written. A table that is there
    already is refused.
    """
    spark, paths = normal.sparkSession, {}
    for name, df in build_profiles(normal, aggregates, attack).items():
        if "beacon_1s" in name:
            paths[name] = f"{root}/{name}"
            write_once(df, paths[name])
    for name in list(paths):
        coarse = name.replace("beacon_1s", "rssi_5s")
        paths[coarse] = f"{root}/{coarse}"
        write_once(rssi_temporal(spark.read.parquet(paths[name])), paths[coarse])
    return paths
