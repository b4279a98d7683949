"""Raw captures of every source as canonical observations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.identity import clean_ssid
from wavelark.functions.radio import channel_to_frequency_mhz
from wavelark.functions.security import normalize_security
from wavelark.functions.text import (
    decode_byte_literal, flag, number, parse_compact_timestamp, parse_coordinates, parse_token_map, position_key, whole,
)
from wavelark.operators.checks import optional, require_columns
from wavelark.schema import ensure_canonical
from wavelark.session import stored

# Source names, time unit, radio standards and channels.
BEACON_SOURCE = "mendeley_rogue_ap"
AGGREGATE_SOURCE = "zenodo_v2i"
FRAME_SOURCE = "zenodo_station_management_frames"
FINGERPRINT_SOURCE = "zenodo_longterm_wifi"
TIME_UNIT_MS = 1.024
RADIO = {"n": ("802.11n", 6), "ac": ("802.11ac", 40), "ad": ("802.11ad", 2)}
FRAME_TYPES = {"Dot11Beacon": "beacon", "Dot11ProbeReq": "probe_request", "Dot11ProbeResp": "probe_response"}


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _lookup(value: Column, table: dict) -> Column:
    out = F
    for key, result in table.items():
        out = out.when(value == key, result)
    return out


def normalize_beacons(raw: DataFrame, session_id, label: int, attack_type=None, is_synthetic: bool = False) -> DataFrame:
    """Individual beacons. `session_id` and `attack_type` may be values or columns."""
    c = F.col
    interval = number(c("BeaconInterval"))
    advertised, width = whole(c("DSChannel")), whole(c("HTChannelWidth"))
    channel = whole(c("Channel"))
    return ensure_canonical(raw.select(
        F.lit(BEACON_SOURCE).alias("source_dataset"), _col(session_id).alias("session_id"),
        F.lit("unknown").alias("environment"), F.lit("beacon_capture").alias("collection_mode"),
        F.lit("raw_beacon").alias("observation_type"), number(c("Timestamp_ms")).alias("elapsed_ms"),
        c("SSID").alias("ssid"), c("BSSID").alias("bssid"), number(c("RSSI")).alias("rssi_dbm"),
        F.lit("single_beacon").alias("rssi_kind"), channel.alias("channel"),
        F.when(advertised > 0, advertised).alias("advertised_channel"),
        channel_to_frequency_mhz(channel).alias("frequency_mhz"),
        F.when(width > 0, width).alias("channel_width_mhz"), interval.alias("beacon_interval_raw"),
        (interval * TIME_UNIT_MS).alias("beacon_interval_ms"),
        (interval * TIME_UNIT_MS).alias("configured_beacon_interval_ms"),
        F.lit("configured_80211_tu").alias("beacon_interval_kind"), number(c("BeaconTimestamp")).alias("beacon_timestamp_us"),
        F.lit(1).alias("beacon_count"), normalize_security(c("Encryption")).alias("security_type"),
        flag(c("Privacy")).alias("privacy_enabled"), flag(c("HasHT")).alias("has_ht"),
        whole(c("SequenceNumber")).alias("sequence_number"), F.lit("beacon").alias("frame_type"),
        c("VendorName").alias("vendor"), c("OUI").alias("oui"), c("CountryCode").alias("country_code"),
        flag(c("IsHidden")).alias("is_hidden"), whole(c("FrameLength")).alias("frame_length_bytes"),
        F.lit(label).alias("label"), _col(attack_type).alias("attack_type"), F.lit(is_synthetic).alias("is_synthetic"),
    ))


def _with_start(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """Adds the group's start. The few starts are stored first, so their size decides the join."""
    starts = stored(rows.groupBy(F.col(key).alias("_key")).agg(start.alias("_start")), "starts")
    return rows.join(starts, F.col(key) == F.col("_key"), "left").drop("_key")


def normalize_aggregates(raw: DataFrame) -> DataFrame:
    """One-second radio aggregates; -100 dBm, 1.0 s and negative utilisation mean "not measured"."""
    c = F.col
    rows = _with_start(
        raw.withColumns({"_trace": c("traceNr").cast("string"), "_time": number(c("systime"))}), "_trace", F.min("_time"))
    rssi, gap, load = number(c("meanBeaconRssi")), number(c("meanInterBeaconTime")), number(c("channelUtil"))
    gap = F.when(gap != 1.0, gap)
    standard, channel = ({k: v[i] for k, v in RADIO.items()} for i in (0, 1))
    return ensure_canonical(rows.select(
        F.lit(AGGREGATE_SOURCE).alias("source_dataset"), F.concat(F.lit("trace_"), "_trace").alias("session_id"),
        F.lit("vehicular_residential").alias("environment"), F.lit("vehicular_experiment").alias("collection_mode"),
        optional(raw, "receiverId").alias("collector_id"), F.lit("aggregate_1s").alias("observation_type"),
        F.timestamp_micros((c("_time") * 1_000_000).cast("long")).alias("timestamp"),
        ((c("_time") - c("_start")) * 1000).alias("elapsed_ms"), c("senderId").alias("ap_id"),
        F.when(rssi != -100, rssi).alias("rssi_dbm"), F.lit("mean_beacon_1s").alias("rssi_kind"),
        number(c("rssiMean")).alias("rssi_all_frames_mean_dbm"), _lookup(c("wifiType"), channel).alias("channel"),
        number(c("channelFreq")).alias("frequency_mhz"), number(c("channelBw")).cast("long").alias("channel_width_mhz"),
        F.when(load >= 0, load).alias("channel_utilization_pct"),
        (c("_trace").startswith("4") & c("wifiType").isin("n", "ac")).alias("channel_utilization_estimated"),
        gap.alias("beacon_interval_raw"), (gap * 1000).alias("beacon_interval_ms"),
        (gap * 1000).alias("measured_inter_beacon_ms"), F.lit("measured_mean_interarrival").alias("beacon_interval_kind"),
        whole(c("nBeacons")).alias("beacon_count"), _lookup(c("wifiType"), standard).alias("wifi_standard"),
        whole(c("nrClients")).alias("num_clients"), F.lit(0).alias("label"), F.lit(False).alias("is_synthetic"),
    ))


def aggregate_profiles(df: DataFrame) -> dict[str, DataFrame]:
    standard = F.col("wifi_standard")
    return {
        "all_normal": df,
        "beacon_profile": df.where((standard == "802.11n") & F.col("rssi_dbm").isNotNull()
                                   & F.col("beacon_interval_ms").isNotNull()),
        "desktop_aux": df.where(standard.isin("802.11n", "802.11ac")),
        "ad_aux": df.where(standard == "802.11ad"),
    }


def _mac(value: Column) -> Column:
    return F.lower(clean_ssid(value))


def normalize_frames(raw: DataFrame, capture_id) -> DataFrame:
    """Management frames. Only beacons and probe responses name an access point."""
    require_columns(raw, ["Timestamp", "type", "MAC_timestamp", "rssi", "addr1", "addr2", "addr3", "SSID"], "frames")
    c = F.col
    rows = _with_start(
        raw.withColumns({"_capture": _col(capture_id), "_time": number(c("Timestamp"))}), "_capture", F.min("_time"))
    kind = F.coalesce(_lookup(c("type"), FRAME_TYPES), F.lower(c("type").cast("string")))
    bssid = F.when(kind.isin("beacon", "probe_response"), F.coalesce(_mac(c("addr3")), _mac(c("addr2"))))
    return ensure_canonical(rows.select(
        F.lit(FRAME_SOURCE).alias("source_dataset"), c("_capture").alias("session_id"),
        F.lit("public_train_station").alias("environment"), F.lit("public_station_capture").alias("collection_mode"),
        F.lit("belgian_train_station").alias("location_id"), F.lit("management_frame").alias("observation_type"),
        F.timestamp_micros(F.round(c("_time") * 1_000_000).cast("long")).alias("timestamp"),
        ((c("_time") - c("_start")) * 1000.0).alias("elapsed_ms"), decode_byte_literal(c("SSID")).alias("ssid"),
        bssid.alias("bssid"), bssid.alias("ap_id"), _mac(c("addr1")).alias("receiver_address"),
        _mac(c("addr2")).alias("transmitter_address"), number(c("MAC_timestamp")).alias("mac_timestamp_raw"),
        F.lit(True).alias("addresses_anonymized"), F.lit(True).alias("ssid_anonymized"),
        number(c("rssi")).alias("rssi_dbm"), F.lit("management_frame_signal").alias("rssi_kind"),
        (kind == "beacon").cast("long").alias("beacon_count"), kind.alias("frame_type"),
        F.lit(0).alias("label"), F.lit(False).alias("is_synthetic"),
    ))


def frame_profiles(df: DataFrame) -> dict[str, DataFrame]:
    kind = F.col("frame_type")
    return {
        "beacons": df.where(kind == "beacon"), "probe_responses": df.where(kind == "probe_response"),
        "probe_requests": df.where(kind == "probe_request"),
        "ap_frames": df.where(kind.isin("beacon", "probe_response")),
    }


def frame_summary(df: DataFrame) -> DataFrame:
    """Per capture and overall (`is_total`): counts by kind, RSSI range and rows that break a rule."""
    kind = F.col("frame_type")
    broken = ((F.col("label") != 0) | F.col("is_synthetic")
              | ((kind == "probe_request") & F.col("bssid").isNotNull()))
    return df.rollup("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(kind == "beacon").alias("beacons"),
        F.count_if(kind == "probe_response").alias("probe_responses"),
        F.count_if(kind == "probe_request").alias("probe_requests"),
        F.count_if(kind.isin("beacon", "probe_response")).alias("ap_frames"),
        F.min("rssi_dbm").alias("rssi_min_dbm"), F.max("rssi_dbm").alias("rssi_max_dbm"),
        F.count_if(broken).alias("violations"), (F.grouping("session_id") == 1).alias("is_total"))


def parse_samples(aligned: DataFrame) -> DataFrame:
    """Typed fingerprint samples with their two access-point maps and the time since session start."""
    typed = aligned.select(
        "collection", "session_id", "line", parse_compact_timestamp(F.col("timestamps")).alias("timestamp"),
        parse_coordinates(F.col("coordinates")).alias("at"), parse_token_map(F.col("rssis")).alias("rssis"),
        parse_token_map(F.col("channels")).alias("channels"))
    known = F.col("timestamp").isNotNull()
    rows = _with_start(typed, "session_id", F.min_by("timestamp", F.when(known, F.col("line"))))
    return rows.withColumn("elapsed_ms", (F.unix_micros("timestamp") - F.unix_micros("_start")) / 1000.0).drop("_start")


def normalize_fingerprints(aligned: DataFrame) -> DataFrame:
    """One row per sample and access point heard."""
    c = F.col
    mode = F.when(c("collection") == "site_surveys", "site_survey").otherwise("monitoring_device")
    rows = parse_samples(aligned).select("*", F.explode("rssis").alias("ap_id", "rssi_dbm"))
    channel = F.try_element_at("channels", c("ap_id"))
    return ensure_canonical(rows.select(
        F.lit(FINGERPRINT_SOURCE).alias("source_dataset"), "session_id",
        F.lit("university_building_indoor").alias("environment"), mode.alias("collection_mode"),
        c("at.x").alias("position_x"), c("at.y").alias("position_y"), c("at.z").alias("position_z"),
        F.lit("wifi_fingerprint_ap").alias("observation_type"), "timestamp", "elapsed_ms", "ap_id", "rssi_dbm",
        F.lit("wifi_scan_ap").alias("rssi_kind"), channel.alias("channel"),
        channel_to_frequency_mhz(channel).alias("frequency_mhz"), F.lit(0).alias("label"),
        F.lit(False).alias("is_synthetic"),
    ))


def locate(df: DataFrame, monitors: DataFrame, points: DataFrame) -> DataFrame:
    """Fills collector and location from the lookup tables (`key`, `id`) of devices and points."""
    c = F.col
    fixed = c("collection_mode") == "monitoring_device"
    m = monitors.select(c("key").alias("_m_key"), c("id").alias("_monitor"))
    p = points.select(c("key").alias("_p_key"), c("id").alias("_point"))
    rows = df.withColumns({
        "_k3": F.when(fixed, position_key(c("position_x"), c("position_y"), c("position_z"))),
        "_k2": F.when(~fixed, position_key(c("position_x"), c("position_y")))})
    out = rows.join(m, c("_k3") == c("_m_key"), "left").join(p, c("_k2") == c("_p_key"), "left")
    return out.withColumns({
        "collector_id": c("_monitor"),
        "location_id": F.coalesce(F.concat(F.lit("monitor_"), "_monitor"), "_point"),
    }).select(*df.columns)


def fingerprint_summary(samples: DataFrame) -> DataFrame:
    """One row over parsed samples: sessions, samples, observations, APs, missing channels, time range."""
    per_session = samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"),
    ).agg(F.count("session_id").alias("sessions"), F.sum("n").alias("samples"),
          F.min("t0").alias("timestamp_min"), F.max("t1").alias("timestamp_max"))
    heard = samples.select(F.explode("rssis").alias("ap_id", "rssi"), "channels").groupBy("ap_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.try_element_at("channels", F.col("ap_id")).isNull()).alias("lost"),
    ).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("observations"),
          F.coalesce(F.sum("lost"), F.lit(0).cast("long")).alias("missing_channel"), F.count("ap_id").alias("unique_aps"))
    h = heard.select(F.struct("*").alias("h")).scalar()
    return per_session.withColumns({k: h[k] for k in ("observations", "missing_channel", "unique_aps")})
