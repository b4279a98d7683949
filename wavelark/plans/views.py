"""Network observations derived from the `events` table.

Six hours of event time become one second, three days become one session, so window, session
and reference operators all have something to do at every scale factor.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.functions.identity import hash_bssid, hash_ssid
from wavelark.session import configure

SESSION_US = 259_200_000_000
EPOCH_US = 1_704_067_200_000_000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the compressed clock and the drift flags."""
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    rows = events.select(
        "event_id", "user_id", "value", "event_type", us.alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumns({"blk": F.expr(f"us div {SESSION_US}"), "rem": F.col("us") % SESSION_US})
    return rows.withColumns({
        "d_bssid": (F.col("blk") >= 6) & (F.col("k") % 25 == 3),
        "d_sec": (F.col("blk") >= 5) & (F.col("k") % 20 == 3),
    })


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    user, k = F.col("user_id"), F.col("k")
    device = F.lower(F.lpad(F.hex(user + F.when(F.col("d_bssid"), 1000).otherwise(0)), 4, "0"))
    bssid = F.concat(
        F.when(user % 4 == 0, "02").otherwise("00"), F.lit(":00:00:00:"),
        F.substring(device, 1, 2), F.lit(":"), F.substring(device, 3, 2))
    channel = user % 13 + 1
    drift = F.col("d_bssid") | F.col("d_sec")
    return t.select(
        "event_id",
        F.when(user % 3 == 0, "zenodo_v2i").otherwise("mendeley_rogue_ap").alias("source_dataset"),
        F.concat(F.lit("sess_"), F.lpad(F.col("blk").cast("string"), 2, "0")).alias("session_id"),
        F.expr("rem div 21600000").alias("elapsed_ms"),
        F.when(k % 10 != 0, F.concat(F.lit("net_"), user % 40)).alias("ssid"),
        bssid.alias("bssid"),
        (F.lit(-30.0) - F.least("value", F.lit(90.0))).alias("rssi_dbm"),
        channel.alias("channel"),
        F.when(k % 7 == 0, 0).when(k % 11 == 0, 14).otherwise(channel).alias("advertised_channel"),
        F.when(k % 8 == 5, 204.8).when(k % 16 == 3, 51.2).otherwise(102.4).alias("configured_beacon_interval_ms"),
        F.when(F.col("d_sec"), "OPEN").when(user % 5 == 0, "WPA").otherwise("WPA2").alias("security_type"),
        (k % 10 == 0).alias("is_hidden"),
        F.when(k % 17 == 0, F.col("us") % 1_000_000).otherwise(F.col("rem")).alias("beacon_timestamp_us"),
        drift.cast("long").alias("label"),
        F.when(F.col("d_bssid") & F.col("d_sec"), "bssid_and_security")
        .when(F.col("d_bssid"), "new_bssid").when(F.col("d_sec"), "security_downgrade")
        .alias("attack_type"),
        drift.alias("is_synthetic"),
    )


def desktop_rows(spark: SparkSession, sf_dir: str, clear: bool = False, truth: bool = False) -> DataFrame:
    """Imported desktop observations: hashed identifiers and numeric security strength.

    On demand with clear identifiers, and with the label and attack that the import does not know.
    """
    o = observations(spark, sf_dir)
    captured = F.timestamp_micros(
        F.lit(EPOCH_US) + F.substring("session_id", 6, 2).cast("long") * SESSION_US
        + F.col("elapsed_ms") * 21_600_000)
    strength = F.when(F.col("security_type") == "OPEN", 0).when(F.col("security_type") == "WPA", 2).otherwise(3)
    return o.select(
        "event_id",
        F.lit("own_windows").alias("source_dataset"),
        "session_id",
        F.lit("home").alias("environment"),
        captured.alias("captured_at_utc"),
        F.expr("elapsed_ms div 1000").alias("scan_index"),
        F.concat(F.lit("if_"), F.col("channel") % 2).alias("interface_guid"),
        hash_ssid(F.col("ssid")).alias("ssid_hash"),
        hash_bssid(F.col("bssid")).alias("bssid_hash"),
        F.col("ssid").isNull().alias("ssid_not_broadcast"),
        "rssi_dbm",
        F.col("configured_beacon_interval_ms").alias("beacon_interval_ms"),
        F.col("beacon_timestamp_us").alias("tsf_us"),
        ((F.col("channel") * 5 + 2407) * 1000).alias("center_frequency_khz"),
        F.when(F.col("advertised_channel") > 0, F.col("advertised_channel")).alias("ds_parameter_channel"),
        "security_type",
        strength.cast("long").alias("security_strength"),
        F.when(F.col("security_type") == "OPEN", "capability_privacy_bit").otherwise("rsn_ie").alias("security_source"),
        (F.col("channel") * 10).alias("ie_blob_size"),
        (F.col("event_id") % 50 == 0).alias("ie_parser_truncated"),
        F.lit(0).cast("long").alias("label"),
        F.lit(None).cast("string").alias("attack_type"),
        F.lit(False).alias("is_synthetic"),
        *(["ssid", "bssid"] if clear else []),
        *([F.col("label").alias("truth"), F.col("attack_type").alias("attack")] if truth else []),
    )
