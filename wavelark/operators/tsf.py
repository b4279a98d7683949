"""Access-point uptime counters against a frozen reference, and MAC address bits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.identity import clean_mac, hash_bssid, hash_identifier, local_admin_bit, multicast_bit
from wavelark.functions.text import number
from wavelark.operators.checks import require_columns
from wavelark.operators.ordering import fold_values, folded_quantiles


def build_tsf_reference(df: DataFrame) -> DataFrame:
    """Count, range and median of the counter per session and BSSID."""
    require_columns(df, ["session_id", "bssid", "beacon_timestamp_us"], "TSF reference")
    rows = df.select(
        "session_id", hash_bssid(F.col("bssid")).alias("bssid_hash"),
        number(F.col("beacon_timestamp_us")).alias("tsf_us"),
    ).dropna(subset=["session_id", "bssid_hash", "tsf_us"])
    keys = ["session_id", "bssid_hash"]
    folded = fold_values(rows, "tsf_us", keys)
    ranges = folded.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.min("tsf_us").alias("min_tsf_us"), F.max("tsf_us").alias("max_tsf_us"))
    return ranges.join(folded_quantiles(folded, "tsf_us", {"median_tsf_us": 0.5}, keys), keys)


def transform_tsf(df: DataFrame, reference: DataFrame, session_col: str = "session_id") -> DataFrame:
    require_columns(df, [session_col, "bssid", "beacon_timestamp_us"], "TSF features")
    ref = reference.select(
        F.col("session_id").alias("_session"), F.col("bssid_hash").alias("_bssid"), F.col("max_tsf_us").alias("_max"))
    kept = [c for c in df.columns if c not in (session_col, "bssid", "beacon_timestamp_us")]
    rows = df.select(
        *kept, F.col(session_col).alias("source_session_id"), hash_bssid(F.col("bssid")).alias("bssid_hash"),
        number(F.col("beacon_timestamp_us")).alias("current_tsf_us"))
    joined = rows.join(ref, (F.col("source_session_id") == F.col("_session"))
                       & (F.col("bssid_hash") == F.col("_bssid")), "left")
    now, peak = F.col("current_tsf_us"), F.col("_max")
    return joined.select(
        *kept, "source_session_id", "bssid_hash",
        (now.isNotNull() & peak.isNotNull()).alias("tsf_reference_available"),
        F.when(now.isNotNull(), peak).alias("tsf_reference_max_us"),
        "current_tsf_us",
        (now < peak).cast("double").alias("tsf_reference_monotonic_violation"),
        ((now - peak) / 1000.0).alias("tsf_delta_from_reference_max_ms"),
        (F.log1p(now) - F.log1p(peak)).alias("tsf_log_ratio_to_reference_max"))


def transform_local_admin(df: DataFrame) -> DataFrame:
    require_columns(df, ["bssid"], "MAC address bits")
    bssid = F.col("bssid")
    return df.select(
        *[c for c in df.columns if c != "bssid"],
        hash_identifier("bssid", clean_mac(bssid)).alias("bssid_hash"),
        local_admin_bit(bssid).alias("bssid_local_admin_flag"),
        multicast_bit(bssid).alias("bssid_multicast_flag"))
