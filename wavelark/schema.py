"""Column contracts shared by every stage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The canonical observation, in output order.
CANONICAL_TYPES = [
    ("source_dataset", "string"),
    ("session_id", "string"),
    ("environment", "string"),
    ("collection_mode", "string"),
    ("collector_id", "string"),
    ("location_id", "string"),
    ("position_x", "double"),
    ("position_y", "double"),
    ("position_z", "double"),
    ("observation_type", "string"),
    ("timestamp", "timestamp"),
    ("elapsed_ms", "double"),
    ("ssid", "string"),
    ("bssid", "string"),
    ("ap_id", "string"),
    ("receiver_address", "string"),
    ("transmitter_address", "string"),
    ("mac_timestamp_raw", "double"),
    ("addresses_anonymized", "boolean"),
    ("ssid_anonymized", "boolean"),
    ("rssi_dbm", "double"),
    ("rssi_kind", "string"),
    ("rssi_all_frames_mean_dbm", "double"),
    ("channel", "long"),
    ("advertised_channel", "long"),
    ("frequency_mhz", "double"),
    ("channel_width_mhz", "double"),
    ("channel_utilization_pct", "double"),
    ("channel_utilization_estimated", "boolean"),
    ("beacon_interval_raw", "double"),
    ("beacon_interval_ms", "double"),
    ("configured_beacon_interval_ms", "double"),
    ("measured_inter_beacon_ms", "double"),
    ("beacon_interval_kind", "string"),
    ("beacon_timestamp_us", "double"),
    ("beacon_count", "long"),
    ("security_type", "string"),
    ("privacy_enabled", "boolean"),
    ("wifi_standard", "string"),
    ("has_ht", "boolean"),
    ("num_clients", "long"),
    ("sequence_number", "long"),
    ("frame_type", "string"),
    ("vendor", "string"),
    ("oui", "string"),
    ("country_code", "string"),
    ("is_hidden", "boolean"),
    ("frame_length_bytes", "long"),
    ("label", "long"),
    ("attack_type", "string"),
    ("is_synthetic", "boolean"),
]
CANONICAL_COLUMNS = [name for name, _ in CANONICAL_TYPES]

# One imported desktop observation (normal collection).
DESKTOP_TYPES = [
    ("source_dataset", "string"),
    ("session_id", "string"),
    ("environment", "string"),
    ("collection_mode", "string"),
    ("observation_type", "string"),
    ("captured_at_utc", "timestamp"),
    ("scan_index", "long"),
    ("interface_guid", "string"),
    ("ssid_hash", "string"),
    ("bssid_hash", "string"),
    ("ssid_not_broadcast", "boolean"),
    ("rssi_dbm", "double"),
    ("link_quality", "long"),
    ("beacon_interval_ms", "double"),
    ("tsf_us", "long"),
    ("host_timestamp_100ns", "long"),
    ("center_frequency_khz", "long"),
    ("ds_parameter_channel", "long"),
    ("security_type", "string"),
    ("security_strength", "long"),
    ("security_source", "string"),
    ("ie_blob_size", "long"),
    ("ie_parser_truncated", "boolean"),
    ("phy_id", "long"),
    ("bss_type", "string"),
    ("phy_type", "string"),
    ("in_reg_domain", "boolean"),
    ("label", "long"),
    ("attack_type", "string"),
    ("is_synthetic", "boolean"),
]
DESKTOP_COLUMNS = [name for name, _ in DESKTOP_TYPES]
CONTROLLED_COLUMNS = (
    DESKTOP_COLUMNS[: DESKTOP_COLUMNS.index("label")]
    + ["session_label", "label", "is_attack_target"]
    + DESKTOP_COLUMNS[DESKTOP_COLUMNS.index("attack_type"):]
)

# Feature lists of the trained profiles.
DESKTOP_FEATURES = [
    "ssid_bssid_count", "bssid_changed", "security_changed", "security_strength_delta",
]
CONTEXTUAL_V1 = [
    "ssid_bssid_count", "bssid_changed", "channel_changed", "security_changed",
    "security_strength_delta", "is_hidden", "configured_beacon_interval_ms",
]
CONTEXTUAL_FULL_V1 = CONTEXTUAL_V1[:-1]
CONTEXTUAL_VARIABLE_ONLY_V1 = ["ssid_bssid_count", "channel_changed"]
CONTEXTUAL_CORE_V2 = [
    "ssid_bssid_count", "bssid_changed", "security_changed", "security_strength_delta",
    "is_hidden",
]
RADIO_FEATURE_SETS = {
    "conservative_v1": ["rssi_std_db", "rssi_delta_db", "window_count"],
    "conservative_v2": ["rssi_std_db", "rssi_delta_db"],
    "complete_v1": [
        "rssi_mean_dbm", "rssi_std_db", "rssi_min_dbm", "rssi_max_dbm", "rssi_delta_db",
        "window_count",
    ],
}

# Columns that describe a row and may never enter a feature matrix.
METADATA_COLUMNS = [
    "source_dataset", "session_id", "network_identity_id", "network_group_id",
    "window_start_ms", "split", "split_group_type", "split_group_id", "elapsed_ms",
    "ssid_hash", "bssid_hash", "context_available", "context_resolution",
    "feature_complete", "ssid_missing", "configured_beacon_interval_delta_ms",
    "label", "attack_type", "is_synthetic",
]

SPLIT_SEED = 20260831
DESKTOP_SPLITS = ["reference", "model_train", "validation", "test_normal"]


def scan_schema() -> T.StructType:
    """One scan document: scan, its interfaces and their observed networks."""
    native = T.StructType([
        T.StructField("phy_id", T.LongType()),
        T.StructField("bss_type", T.StringType()),
        T.StructField("phy_type", T.StringType()),
        T.StructField("in_reg_domain", T.BooleanType()),
    ])
    entry = T.StructType([
        T.StructField("ssid_hash", T.StringType()),
        T.StructField("bssid_hash", T.StringType()),
        T.StructField("ssid_not_broadcast", T.BooleanType()),
        T.StructField("rssi_dbm", T.DoubleType()),
        T.StructField("link_quality", T.LongType()),
        T.StructField("beacon_interval_ms", T.DoubleType()),
        T.StructField("tsf_us", T.LongType()),
        T.StructField("host_timestamp_100ns", T.LongType()),
        T.StructField("center_frequency_khz", T.LongType()),
        T.StructField("ie_blob_size", T.LongType()),
        T.StructField("ie_parser_truncated", T.BooleanType()),
        T.StructField("ds_parameter_channel", T.LongType()),
        T.StructField("security_type", T.StringType()),
        T.StructField("security_strength", T.LongType()),
        T.StructField("security_source", T.StringType()),
        T.StructField("observation_label", T.LongType()),
        T.StructField("is_attack_target", T.BooleanType()),
        T.StructField("native", native),
    ])
    interface = T.StructType([
        T.StructField("interface", T.StructType([T.StructField("guid", T.StringType())])),
        T.StructField("bss_entries", T.ArrayType(entry)),
    ])
    return T.StructType([
        T.StructField("session_id", T.StringType()),
        T.StructField("scan_index", T.LongType()),
        T.StructField("captured_at_utc", T.TimestampType()),
        T.StructField("interfaces", T.ArrayType(interface)),
    ])


def project(df: DataFrame, types: list[tuple[str, str]]) -> DataFrame:
    """Exactly these columns in this order; columns the input lacks become typed NULLs."""
    present = set(df.columns)
    return df.select([
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in types
    ])


def ensure_canonical(df: DataFrame) -> DataFrame:
    return project(df, CANONICAL_TYPES)
