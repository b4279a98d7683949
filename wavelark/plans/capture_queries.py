from pyspark.sql import functions as F

from wavelark.operators import elements, normalize, profiling, scan_flatten, windows
from wavelark.plans.catalog import query, rounded
from wavelark.plans.oracle_views import DESKTOP, OBS, band, freq
from wavelark.plans.views import EPOCH_US, desktop_rows, observations, ticks
from wavelark.session import fresh_path, stored
from wavelark.sources import aligned, captures, scans, tables

TEXT = "string"


def raw_beacons(spark, sf_dir):
    """Observations as the text columns of a raw beacon capture."""
    c = F.col
    return observations(spark, sf_dir).select(
        "event_id", "session_id", c("elapsed_ms").cast(TEXT).alias("Timestamp_ms"), c("ssid").alias("SSID"), c("bssid").alias("BSSID"),
        c("rssi_dbm").cast(TEXT).alias("RSSI"), c("channel").cast(TEXT).alias("Channel"),
        c("advertised_channel").cast(TEXT).alias("DSChannel"), F.when(c("event_id") % 3 == 0, "NaN").otherwise("20").alias("HTChannelWidth"),
        F.when(c("event_id") % 11 == 0, "n/a").when(c("event_id") % 4 == 1, "200").otherwise("100").alias("BeaconInterval"), c("beacon_timestamp_us").cast(TEXT).alias("BeaconTimestamp"),
        F.when(c("event_id") % 9 == 0, "wpa2-ent").otherwise(F.concat(F.lit(" "), F.lower("security_type"))).alias("Encryption"),
        (c("security_type") != "OPEN").cast("int").cast(TEXT).alias("Privacy"), F.lit("1").alias("HasHT"),
        F.when(c("event_id") % 5 == 0, "bad").otherwise(c("event_id").cast(TEXT)).alias("SequenceNumber"),
        F.lit("acme").alias("VendorName"), F.substring("bssid", 1, 8).alias("OUI"), F.lit("BE").alias("CountryCode"),
        c("is_hidden").cast("int").cast(TEXT).alias("IsHidden"), F.lit("240").alias("FrameLength"),
        c("label").cast(TEXT).alias("is_rogue"), c("attack_type").alias("_rogue_type"))


def beacon_sql(where: str, session: str, label: int, attack: str, synthetic: str) -> str:
    return f"""WITH {OBS} SELECT {session} AS session_id, CAST(elapsed_ms AS DOUBLE) AS elapsed_ms, ssid, bssid, round(rssi_dbm, 9) AS rssi_dbm, channel,
    CASE WHEN advertised_channel > 0 THEN advertised_channel END AS advertised_channel, {freq('channel')} AS frequency_mhz,
    CASE WHEN event_id % 3 <> 0 THEN 20 END AS channel_width_mhz, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 204.8 ELSE 102.4 END::DOUBLE AS beacon_interval_ms,
    CASE WHEN event_id % 9 = 0 THEN 'OTHER' ELSE security_type END AS security_type, security_type <> 'OPEN' AS privacy_enabled,
    CASE WHEN event_id % 5 <> 0 THEN event_id END AS sequence_number, is_hidden, 240 AS frame_length_bytes, {label} AS label,
    {attack} AS attack_type, {synthetic} AS is_synthetic FROM obs{where}"""


BEACON_SHOWN = ["session_id", "elapsed_ms", "ssid", "bssid", "rssi_dbm", "channel", "advertised_channel", "frequency_mhz",
                "channel_width_mhz", "beacon_interval_ms", "security_type", "privacy_enabled", "sequence_number", "is_hidden",
                "frame_length_bytes", "label", "attack_type", "is_synthetic"]


@query("normalized_beacons", beacon_sql("", "session_id", 0, "CAST(NULL AS VARCHAR)", "false"))
def normalized_beacons(spark, sf_dir):
    out = normalize.normalize_beacons(raw_beacons(spark, sf_dir), F.col("session_id"), 0)
    return rounded(out.select(BEACON_SHOWN), "rssi_dbm", "beacon_interval_ms")


@query("beacon_session_files", beacon_sql("", "'session_of=' || session_id", 0, "CAST(NULL AS VARCHAR)", "false"))
def beacon_session_files(spark, sf_dir):
    root = fresh_path(spark, "beacons")
    raw = raw_beacons(spark, sf_dir).withColumnRenamed("session_id", "session_of")
    raw.write.partitionBy("session_of").option("header", True).csv(root)
    return rounded(captures.read_normal_beacons(spark, root).select(BEACON_SHOWN), "rssi_dbm", "beacon_interval_ms")


@query("labelled_rogue", beacon_sql(" WHERE label = 1", "'synthetic_rogue'", 1, "attack_type", "true"))
def labelled_rogue(spark, sf_dir):
    out = captures.labelled_rogue(raw_beacons(spark, sf_dir))
    return rounded(out.select(BEACON_SHOWN), "rssi_dbm", "beacon_interval_ms")


def raw_aggregates(spark, sf_dir):
    c = F.col
    kind = F.element_at(F.array(F.lit("n"), F.lit("ac"), F.lit("ad"), F.lit("n")), (c("user_id") % 4 + 1).cast("int"))
    return ticks(spark, sf_dir).select(
        "event_id", (c("blk") + 398).cast(TEXT).alias("traceNr"), (c("us") / 1_000_000 + 1_704_067_200).cast(TEXT).alias("systime"),
        F.concat(F.lit("ap-"), "user_id").alias("senderId"), F.concat(F.lit("rx-"), c("blk")).alias("receiverId"),
        F.when(c("k") % 6 == 0, "-100").otherwise((F.lit(-30.0) - F.least("value", F.lit(90.0))).cast(TEXT)).alias("meanBeaconRssi"),
        c("value").cast(TEXT).alias("rssiMean"), kind.alias("wifiType"), F.lit("2437").alias("channelFreq"), F.lit("20").alias("channelBw"),
        F.when(c("k") % 4 == 0, "-1").otherwise("35.5").alias("channelUtil"),
        F.when(c("k") % 8 == 0, "1.0").otherwise("0.125").alias("meanInterBeaconTime"), (c("k") % 9).cast(TEXT).alias("nBeacons"),
        (c("user_id") % 3).cast(TEXT).alias("nrClients"))


AGGREGATE = OBS.split("obs0 AS")[0].rstrip().rstrip(",") + f""",
agg0 AS (SELECT *, CAST(blk + 398 AS VARCHAR) AS trace, us / 1000000 + 1704067200 AS t,
    CASE user_id % 4 WHEN 1 THEN 'ac' WHEN 2 THEN 'ad' ELSE 'n' END AS kind,
    nullif(CASE WHEN k % 6 <> 0 THEN CAST(-30.0 AS DOUBLE) - least(value, 90.0::DOUBLE) END, -100) AS rssi FROM ticks),
agg AS (SELECT 'zenodo_v2i' AS source_dataset, 'trace_' || trace AS session_id, 'rx-' || blk AS collector_id, (t - min(t) OVER (PARTITION BY trace)) * 1000 AS elapsed_ms,
    'ap-' || user_id AS ap_id, rssi AS rssi_dbm, CASE kind WHEN 'n' THEN 6 WHEN 'ac' THEN 40 ELSE 2 END AS channel, 2437.0::DOUBLE AS frequency_mhz,
    CASE WHEN k % 4 <> 0 THEN 35.5::DOUBLE END AS channel_utilization_pct, trace LIKE '4%' AND kind <> 'ad' AS channel_utilization_estimated,
    CASE WHEN k % 8 <> 0 THEN 125.0::DOUBLE END AS measured_inter_beacon_ms, k % 9 AS beacon_count,
    '802.11' || kind AS wifi_standard, user_id % 3 AS num_clients, 0 AS label FROM agg0)
"""
AGGREGATE_SHOWN = ["source_dataset", "session_id", "collector_id", "elapsed_ms", "ap_id", "rssi_dbm", "channel", "frequency_mhz",
                   "channel_utilization_pct", "channel_utilization_estimated", "measured_inter_beacon_ms", "beacon_count",
                   "wifi_standard", "num_clients", "label"]


def aggregates(spark, sf_dir):
    return normalize.normalize_aggregates(raw_aggregates(spark, sf_dir))


@query("normalized_aggregates", f"WITH {AGGREGATE} SELECT * REPLACE (round(elapsed_ms, 2) AS elapsed_ms, round(rssi_dbm, 9) AS rssi_dbm) FROM agg")
def normalized_aggregates(spark, sf_dir):
    rows = aggregates(spark, sf_dir).select(AGGREGATE_SHOWN)
    return rounded(rounded(rows, "rssi_dbm"), "elapsed_ms", digits=2)


@query("aggregate_profiles", f"""WITH {AGGREGATE} SELECT 'all_normal' AS profile, count(*) AS "rows" FROM agg
UNION ALL SELECT 'beacon_profile', count(*) FROM agg WHERE wifi_standard = '802.11n' AND rssi_dbm IS NOT NULL AND measured_inter_beacon_ms IS NOT NULL
UNION ALL SELECT 'desktop_aux', count(*) FROM agg WHERE wifi_standard IN ('802.11n', '802.11ac') UNION ALL SELECT 'ad_aux', count(*) FROM agg WHERE wifi_standard = '802.11ad'""")
def aggregate_profiles(spark, sf_dir):
    out = None
    for name, df in normalize.aggregate_profiles(aggregates(spark, sf_dir)).items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("profile", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("aggregate_profile_1s", f"""WITH {AGGREGATE} SELECT source_dataset, session_id, substr(sha256(source_dataset || '|' || ap_id), 1, 20) AS network_identity_id,
    substr(sha256(source_dataset || '|' || session_id || '|' || ap_id), 1, 20) AS network_group_id, floor(elapsed_ms / 1000) * 1000 AS window_start_ms, label,
    CAST(NULL AS VARCHAR) AS attack_type, false AS is_synthetic, round(rssi_dbm, 9) AS rssi_mean_dbm, beacon_count, measured_inter_beacon_ms AS observed_inter_beacon_ms,
    beacon_count AS inter_beacon_sample_count, CAST(channel AS DOUBLE) AS channel, frequency_mhz, {band('frequency_mhz')} AS wifi_band,
    CAST(NULL AS DOUBLE) AS configured_beacon_interval_ms, CAST(NULL AS VARCHAR) AS security_type
FROM agg WHERE wifi_standard = '802.11n' AND rssi_dbm IS NOT NULL AND measured_inter_beacon_ms IS NOT NULL""")
def aggregate_profile_1s(spark, sf_dir):
    return rounded(windows.aggregate_profile(aggregates(spark, sf_dir)), "rssi_mean_dbm")


PROFILE_KEYS = "source_dataset, session_id, coalesce(attack_type, ''), bssid"


@query("profile_build", f"""WITH {OBS}, {AGGREGATE[AGGREGATE.index("agg0 AS"):]}, used AS (SELECT * FROM agg
    WHERE wifi_standard = '802.11n' AND rssi_dbm IS NOT NULL AND measured_inter_beacon_ms IS NOT NULL)
SELECT 'normal_beacon_1s' AS profile, count(*) AS "rows" FROM (SELECT DISTINCT {PROFILE_KEYS}, elapsed_ms // 1000 FROM obs WHERE label = 0)
UNION ALL SELECT 'normal_rssi_5s', count(*) FROM (SELECT DISTINCT {PROFILE_KEYS}, elapsed_ms // 5000 FROM obs WHERE label = 0)
UNION ALL SELECT 'attack_beacon_1s', count(*) FROM (SELECT DISTINCT {PROFILE_KEYS}, elapsed_ms // 1000 FROM obs WHERE label = 1)
UNION ALL SELECT 'attack_rssi_5s', count(*) FROM (SELECT DISTINCT {PROFILE_KEYS}, elapsed_ms // 5000 FROM obs WHERE label = 1)
UNION ALL SELECT 'aggregate_beacon_1s', count(*) FROM used
UNION ALL SELECT 'aggregate_rssi_5s', count(*) FROM (SELECT DISTINCT session_id, ap_id, floor(floor(elapsed_ms / 1000) * 1000 / 5000) FROM used)""")
def profile_build(spark, sf_dir):
    """Row count of every profile that one build wrote."""
    rows = observations(spark, sf_dir)
    paths = windows.write_profiles(rows.where("label = 0"), aggregates(spark, sf_dir), fresh_path(spark, "profiles"), rows.where("label = 1"))
    out = None
    for name, path in paths.items():
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("profile", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("aggregate_dataset_profile", f"""WITH {AGGREGATE} SELECT wifi_standard, count(*) AS "rows", count(rssi_dbm) AS valid_beacon_rssi,
    count(measured_inter_beacon_ms) AS valid_beacon_interval, count(rssi_dbm + measured_inter_beacon_ms) AS valid_both FROM agg GROUP BY 1""")
def aggregate_dataset_profile(spark, sf_dir):
    return profiling.profile_aggregates(raw_aggregates(spark, sf_dir))


@query("aggregate_dataset_values", f"""WITH {AGGREGATE} SELECT count(DISTINCT session_id) AS traces, '2437.0' AS frequencies_mhz, '0,1,2' AS client_count_values FROM agg""")
def aggregate_dataset_values(spark, sf_dir):
    row = profiling.aggregate_values(raw_aggregates(spark, sf_dir))
    return row.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("frequencies_mhz", "client_count_values")})


@query("beacon_dataset_profile", f"""WITH {OBS} SELECT count(*) AS normal_rows, count(DISTINCT session_id) AS sessions, count(DISTINCT bssid) AS unique_bssids,
    count(DISTINCT ssid) AS unique_ssids, count(*) FILTER (ssid IS NULL) AS missing_ssid, round(min(rssi_dbm), 9) AS rssi_min_dbm, round(max(rssi_dbm), 9) AS rssi_max_dbm,
    min(channel) AS channel_min, max(channel) AS channel_max, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CASE WHEN event_id % 4 = 1 THEN '200.0' ELSE '100.0' END AS v
        FROM obs WHERE event_id % 11 <> 0)) AS beacon_interval_unique FROM obs""")
def beacon_dataset_profile(spark, sf_dir):
    row = profiling.profile_beacons(raw_beacons(spark, sf_dir))
    return rounded(row.withColumn("beacon_interval_unique", F.array_join(F.col("beacon_interval_unique").cast("array<string>"), ",")),
                   "rssi_min_dbm", "rssi_max_dbm")


@query("beacon_interval_counts", f"""WITH {OBS} SELECT CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 200 ELSE 100 END::DOUBLE AS beacon_interval,
    count(*) AS "rows" FROM obs GROUP BY 1""")
def beacon_interval_counts(spark, sf_dir):
    return profiling.beacon_intervals(raw_beacons(spark, sf_dir))


@query("aggregate_value_counts", f"""WITH {AGGREGATE} SELECT 'trace' AS field, trace AS value, count(*) AS "rows" FROM agg0 GROUP BY 2
UNION ALL SELECT 'frequency_mhz', '2437.0', count(*) FROM agg0 UNION ALL SELECT 'clients', CAST(user_id % 3 AS VARCHAR), count(*) FROM agg0 GROUP BY 2""")
def aggregate_value_counts(spark, sf_dir):
    return profiling.aggregate_value_counts(raw_aggregates(spark, sf_dir))


@query("attack_counts", f"WITH {OBS} SELECT attack_type AS _rogue_type, count(*) AS \"rows\" FROM obs WHERE label = 1 GROUP BY 1")
def attack_counts(spark, sf_dir):
    return profiling.attack_counts(raw_beacons(spark, sf_dir))


def raw_frames(spark, sf_dir):
    c = F.col
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Dot11Beacon", "Dot11ProbeResp", "Dot11ProbeReq", "Dot11Auth")]),
                        (c("event_id") % 4 + 1).cast("int"))
    mac = F.format_string("AA:BB:CC:00:00:%02x", (c("user_id") % 200).cast("int"))
    ssid = F.when(c("k") % 10 == 0, "b''").when(c("k") % 10 == 1, "b'caf\\xc3\\xa9'").when(c("k") % 10 == 2, "plain").otherwise(
        F.concat(F.lit("b'NET_"), c("user_id") % 40, F.lit("'")))
    return ticks(spark, sf_dir).select(
        "event_id", F.concat(F.lit("capture_"), c("blk") % 2 + 1).alias("capture"), (c("us") / 1_000_000 + 1_704_067_200).cast(TEXT).alias("Timestamp"),
        kind.alias("type"), c("us").cast(TEXT).alias("MAC_timestamp"), (-(c("k") % 60)).cast(TEXT).alias("rssi"), mac.alias("addr1"),
        mac.alias("addr2"), F.when(c("k") % 3 != 0, mac).alias("addr3"), ssid.alias("SSID"))


FRAME = OBS.split("obs0 AS")[0].rstrip().rstrip(",") + """,
fr0 AS (SELECT *, 'capture_' || (blk % 2 + 1) AS session_id, us / 1000000 + 1704067200 AS t, CASE event_id % 4 WHEN 0 THEN 'beacon' WHEN 1 THEN 'probe_response'
    WHEN 2 THEN 'probe_request' ELSE 'dot11auth' END AS frame_type, 'aa:bb:cc:00:00:' || lpad(lower(to_hex(user_id % 200)), 2, '0') AS mac,
    CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'café' WHEN 2 THEN 'plain' ELSE 'NET_' || (user_id % 40) END AS ssid FROM ticks),
fr AS (SELECT event_id, session_id, (t - min(t) OVER (PARTITION BY session_id)) * 1000 AS elapsed_ms, ssid,
    CASE WHEN frame_type IN ('beacon', 'probe_response') THEN mac END AS bssid, mac AS transmitter_address, -CAST(k % 60 AS DOUBLE) AS rssi_dbm,
    CAST(frame_type = 'beacon' AS BIGINT) AS beacon_count, frame_type FROM fr0)
"""


@query("normalized_frames", f"WITH {FRAME} SELECT session_id, round(elapsed_ms, 2) AS elapsed_ms, ssid, bssid, transmitter_address, rssi_dbm + 0.0 AS rssi_dbm, beacon_count, frame_type FROM fr")
def normalized_frames(spark, sf_dir):
    out = normalize.normalize_frames(raw_frames(spark, sf_dir), F.col("capture"))
    return rounded(out.select("session_id", "elapsed_ms", "ssid", "bssid", "transmitter_address", "rssi_dbm", "beacon_count",
                              "frame_type"), "elapsed_ms", "rssi_dbm", digits=2)


@query("frame_profiles", f"""WITH {FRAME} SELECT 'beacons' AS profile, count(*) AS "rows" FROM fr WHERE frame_type = 'beacon'
UNION ALL SELECT 'probe_responses', count(*) FROM fr WHERE frame_type = 'probe_response' UNION ALL SELECT 'probe_requests', count(*) FROM fr WHERE frame_type = 'probe_request'
UNION ALL SELECT 'ap_frames', count(*) FROM fr WHERE frame_type IN ('beacon', 'probe_response')""")
def frame_profiles(spark, sf_dir):
    out = None
    for name, df in normalize.frame_profiles(normalize.normalize_frames(raw_frames(spark, sf_dir), F.col("capture"))).items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("profile", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("frame_summary", f"""WITH {FRAME} SELECT session_id, count(*) AS frames, count(*) FILTER (frame_type = 'beacon') AS beacons,
    count(*) FILTER (frame_type = 'probe_response') AS probe_responses, count(*) FILTER (frame_type = 'probe_request') AS probe_requests,
    count(*) FILTER (frame_type IN ('beacon', 'probe_response')) AS ap_frames, min(rssi_dbm) + 0.0 AS rssi_min_dbm, max(rssi_dbm) + 0.0 AS rssi_max_dbm,
    0 AS violations, grouping(session_id) = 1 AS is_total FROM fr GROUP BY ROLLUP (session_id)""")
def frame_summary(spark, sf_dir):
    out = normalize.frame_summary(normalize.normalize_frames(raw_frames(spark, sf_dir), F.col("capture")))
    return rounded(out, "rssi_min_dbm", "rssi_max_dbm")


@query("frame_dataset_profile", f"""WITH {FRAME} SELECT count(*) AS frames, count(*) FILTER (frame_type = 'beacon') AS beacons,
    count(*) FILTER (frame_type = 'probe_response') AS probe_responses, count(*) FILTER (frame_type = 'probe_request') AS probe_requests,
    count(DISTINCT mac) AS unique_transmitters, count(DISTINCT CASE WHEN k % 3 <> 0 THEN mac END) AS unique_bssid_field_values,
    count(DISTINCT coalesce(ssid, '')) AS unique_ssid_values, min(-CAST(k % 60 AS DOUBLE)) + 0.0 AS rssi_min_dbm, max(-CAST(k % 60 AS DOUBLE)) + 0.0 AS rssi_max_dbm FROM fr0""")
def frame_dataset_profile(spark, sf_dir):
    return rounded(profiling.profile_frames(raw_frames(spark, sf_dir)), "rssi_min_dbm", "rssi_max_dbm")


def sample_parts(spark, sf_dir):
    """The four lines of every fingerprint sample, as the numbered lines of separate files."""
    c = F.col
    user = c("user_id")
    stamp = F.when(c("event_id") % 11 != 0, F.date_format(F.timestamp_micros(c("us") + EPOCH_US), "yyyyMMddHHmmssSSS")).otherwise("")
    place = F.concat_ws(",", (user / 8).cast(TEXT), (user % 7).cast(TEXT), F.lit("1.25"))
    near, far = F.concat(F.lit("ap"), user), F.concat(F.lit("ap"), user + 1)
    rssi = F.concat(near, F.lit(":-"), c("k") % 60 + 1, F.lit(","), far, F.lit(":-70,:5,x"))
    channel = F.when(c("k") % 5 != 0, F.concat(near, F.lit(":"), user % 13 + 1)).otherwise("")
    rows = ticks(spark, sf_dir).select(
        F.when(user % 2 == 0, "site_surveys").otherwise("mon_devices").alias("collection"),
        F.concat(F.when(user % 2 == 0, "site_survey_").otherwise("monitoring_device_"), c("blk")).alias("session_id"),
        c("event_id").alias("line"),
        F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in zip(aligned.PARTS, [stamp, place, rssi, channel])]).alias("p"))
    return rows.select("collection", "session_id", "line", F.inline("p"))


SAMPLE = OBS.split("obs0 AS")[0].rstrip().rstrip(",") + f""",
sm0 AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'site_surveys' ELSE 'mon_devices' END AS collection,
    CASE WHEN user_id % 2 = 0 THEN 'site_survey' ELSE 'monitoring_device' END AS mode,
    CASE WHEN event_id % 11 <> 0 THEN (us // 1000) END AS ms FROM ticks),
sm AS (SELECT *, mode || '_' || blk AS session_id, CAST(ms - first_value(ms IGNORE NULLS) OVER (PARTITION BY mode, blk ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS elapsed_ms FROM sm0),
fp AS (SELECT event_id, session_id, collection, mode AS collection_mode, user_id, user_id / 8 AS position_x, CAST(user_id % 7 AS DOUBLE) AS position_y, 1.25::DOUBLE AS position_z,
    elapsed_ms, ms, 'ap' || user_id AS ap_id, CAST(-(k % 60 + 1) AS DOUBLE) AS rssi_dbm, CASE WHEN k % 5 <> 0 THEN user_id % 13 + 1 END AS channel FROM sm
    UNION ALL SELECT event_id, session_id, collection, mode, user_id, user_id / 8, CAST(user_id % 7 AS DOUBLE), 1.25, elapsed_ms, ms, 'ap' || (user_id + 1), -70.0, NULL FROM sm)
"""


def samples(spark, sf_dir):
    return aligned.align(sample_parts(spark, sf_dir))


@query("aligned_samples", f"""WITH {SAMPLE} SELECT collection, session_id, event_id AS line, 'ap' || user_id || ':-' || (k % 60 + 1) || ',ap' || (user_id + 1) || ':-70,:5,x' AS rssis FROM sm""")
def aligned_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("collection", "session_id", "line", "rssis")


@query("normalized_fingerprints", f"""WITH {SAMPLE} SELECT session_id, collection_mode, position_x, position_y, position_z, elapsed_ms, ap_id, rssi_dbm, channel,
    {freq('channel')} AS frequency_mhz FROM fp""")
def normalized_fingerprints(spark, sf_dir):
    return normalize.normalize_fingerprints(samples(spark, sf_dir)).select(
        "session_id", "collection_mode", "position_x", "position_y", "position_z", "elapsed_ms", "ap_id", "rssi_dbm", "channel",
        "frequency_mhz")


def lookup_lines(spark, sf_dir, with_height):
    """Lookup file lines for every fourth device."""
    users = ticks(spark, sf_dir).where(F.col("user_id") % 4 < 2).select("user_id").distinct()
    parts = [F.concat(F.lit("d"), "user_id"), (F.col("user_id") / 8).cast(TEXT), (F.col("user_id") % 7).cast(TEXT)]
    return users.select(F.col("user_id").alias("line"), F.concat_ws(",", *parts, *([F.lit("1.251")] if with_height else [])).alias("value"))


@query("located_fingerprints", f"""WITH {SAMPLE} SELECT session_id, ap_id, elapsed_ms, CASE WHEN user_id % 4 = 1 THEN 'd' || user_id END AS collector_id,
    CASE WHEN user_id % 4 = 1 THEN 'monitor_d' || user_id WHEN user_id % 4 = 0 THEN 'rp_d' || user_id END AS location_id FROM fp""")
def located_fingerprints(spark, sf_dir):
    monitors = aligned.monitor_points(lookup_lines(spark, sf_dir, True))
    points = aligned.reference_points(lookup_lines(spark, sf_dir, False))
    return normalize.locate(normalize.normalize_fingerprints(samples(spark, sf_dir)), monitors, points).select(
        "session_id", "ap_id", "elapsed_ms", "collector_id", "location_id")


@query("fingerprint_summary", f"""WITH {SAMPLE} SELECT (SELECT count(DISTINCT session_id) FROM sm) AS sessions, (SELECT count(*) FROM sm) AS samples, count(*) AS observations,
    count(*) FILTER (channel IS NULL) AS missing_channel, count(DISTINCT ap_id) AS unique_aps, min(ms) AS first_ms, max(ms) AS last_ms FROM fp""")
def fingerprint_summary(spark, sf_dir):
    row = normalize.fingerprint_summary(normalize.parse_samples(samples(spark, sf_dir)))
    epoch = EPOCH_US // 1000
    return row.withColumns({"first_ms": F.unix_millis("timestamp_min") - epoch, "last_ms": F.unix_millis("timestamp_max") - epoch}).drop(
        "timestamp_min", "timestamp_max")


@query("fingerprint_dataset_profile", f"""WITH {SAMPLE},
a AS (SELECT collection, count(DISTINCT session_id) AS sessions, count(*) AS samples, grouping(collection) = 1 AS is_total FROM sm GROUP BY ROLLUP (collection)),
b AS (SELECT collection, count(*) AS observations, count(DISTINCT ap_id) AS unique_aps, count(*) FILTER (channel IS NULL) AS missing_channel,
    min(rssi_dbm)::BIGINT AS rssi_min_dbm, max(rssi_dbm)::BIGINT AS rssi_max_dbm, grouping(collection) = 1 AS is_total FROM fp GROUP BY ROLLUP (collection))
SELECT a.collection, a.is_total, sessions, samples, observations, unique_aps, missing_channel, rssi_min_dbm, rssi_max_dbm FROM a JOIN b ON a.collection IS NOT DISTINCT FROM b.collection AND a.is_total = b.is_total""")
def fingerprint_dataset_profile(spark, sf_dir):
    return profiling.profile_fingerprints(normalize.parse_samples(samples(spark, sf_dir)))


@query("common_channels", f"WITH {SAMPLE} SELECT channel, count(*) AS observations FROM fp WHERE channel IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def common_channels(spark, sf_dir):
    return profiling.common_channels(normalize.parse_samples(samples(spark, sf_dir)))


def scan_documents(spark, sf_dir, target=None):
    """One scan document per observation."""
    rows = desktop_rows(spark, sf_dir)
    label = F.lit(None).cast("long") if target is None else target.cast("long")
    entry = F.struct(
        "ssid_hash", "bssid_hash", "ssid_not_broadcast", "rssi_dbm", F.lit(50).cast("long").alias("link_quality"), "beacon_interval_ms",
        "tsf_us", F.lit(None).cast("long").alias("host_timestamp_100ns"), "center_frequency_khz", "ie_blob_size", "ie_parser_truncated",
        "ds_parameter_channel", "security_type", "security_strength", "security_source", label.alias("observation_label"),
        label.cast("boolean").alias("is_attack_target"),
        F.struct(F.col("event_id").alias("phy_id"), F.lit("infrastructure").alias("bss_type"), F.lit("ht").alias("phy_type"),
                 F.lit(True).alias("in_reg_domain")).alias("native"))
    interface = F.struct(F.struct(F.col("interface_guid").alias("guid")).alias("interface"), F.array(entry).alias("bss_entries"))
    return rows.select("session_id", F.col("event_id").alias("scan_index"), "captured_at_utc", F.array(interface).alias("interfaces"))


FLAT = f"""WITH {DESKTOP} SELECT session_id, event_id AS scan_index, epoch_us(captured_at_utc) AS captured_us, interface_guid, ssid_hash, bssid_hash, rssi_dbm,
    tsf_us, security_type, security_strength, event_id AS phy_id, 'ht' AS phy_type, 0 AS label FROM desk"""
FLAT_SHOWN = ["session_id", "scan_index", "captured_us", "interface_guid", "ssid_hash", "bssid_hash", "rssi_dbm", "tsf_us", "security_type",
              "security_strength", "phy_id", "phy_type", "label"]


def shown(df):
    return df.withColumn("captured_us", F.unix_micros("captured_at_utc")).select(FLAT_SHOWN)


@query("flattened_scans", FLAT)
def flattened_scans(spark, sf_dir):
    return shown(scan_flatten.flatten_scans(scan_documents(spark, sf_dir), F.col("session_id"), "home"))


@query("scan_document_files", FLAT)
def scan_document_files(spark, sf_dir):
    path = fresh_path(spark, "scans")
    scan_documents(spark, sf_dir).write.json(path)
    return shown(scan_flatten.flatten_scans(scans.read_scan_jsonl(spark, path), F.col("session_id"), "home"))


TARGETS = DESKTOP + """,
tg AS (SELECT session_id, min(bssid_hash) AS target FROM desk GROUP BY 1),
ct AS (SELECT d.*, d.bssid_hash = target AS hit, target FROM desk d JOIN tg USING (session_id))
"""


def manifest(spark, sf_dir):
    rows = desktop_rows(spark, sf_dir)
    targets = stored(rows.groupBy("session_id").agg(F.min("bssid_hash").alias("target_bssid_hash")), "targets")
    counts = rows.join(targets, "session_id").groupBy("session_id", "target_bssid_hash").agg(
        F.count_if(F.col("bssid_hash") == F.col("target_bssid_hash")).alias("matched_observation_count"))
    return counts.withColumns({"environment": F.lit("lab"), "attack_type": F.lit("evil_twin")})


def controlled(spark, sf_dir):
    told = stored(manifest(spark, sf_dir), "manifest")
    docs = scan_documents(spark, sf_dir).join(told.select("session_id", "target_bssid_hash"), "session_id")
    marked = F.transform("interfaces", lambda i: i.withField("bss_entries", F.transform(i["bss_entries"], lambda e: e.withField(
        "is_attack_target", e["bssid_hash"] == F.col("target_bssid_hash")).withField(
        "observation_label", (e["bssid_hash"] == F.col("target_bssid_hash")).cast("long")))))
    docs = docs.withColumn("interfaces", marked).drop("target_bssid_hash")
    return scan_flatten.flatten_controlled(docs, told), told


@query("controlled_scans", f"""WITH {TARGETS} SELECT session_id, event_id AS scan_index, 'lab' AS environment, bssid_hash, 1 AS session_label, CAST(hit AS BIGINT) AS label,
    hit AS is_attack_target, 'evil_twin' AS attack_type FROM ct""")
def controlled_scans(spark, sf_dir):
    return controlled(spark, sf_dir)[0].select("session_id", "scan_index", "environment", "bssid_hash", "session_label", "label",
                                               "is_attack_target", "attack_type")


@query("controlled_violations", f"""WITH {TARGETS} SELECT session_id, count(*) AS "rows", count(*) FILTER (hit) AS attack_rows, count(*) FILTER (NOT hit) AS normal_rows,
    false AS count_differs FROM ct GROUP BY 1""")
def controlled_violations(spark, sf_dir):
    return scan_flatten.controlled_violations(*controlled(spark, sf_dir))


@query("table_round_trip", f"WITH {OBS} SELECT CAST(event_id AS VARCHAR) AS event_id, ssid, bssid, CAST(channel AS VARCHAR) AS channel FROM obs")
def table_round_trip(spark, sf_dir):
    path = fresh_path(spark, "table") + ".csv.gz"
    tables.write_once(observations(spark, sf_dir).select("event_id", "ssid", "bssid", "channel"), path, "csv.gz")
    return tables.read_table(spark, path)


def raw_elements(spark, sf_dir):
    """Captures with an element blob put together from the observation."""
    c = F.col

    def element(number, payload):
        size = F.lpad(F.hex((F.length(payload) / 2).cast("long")), 2, "0")
        return F.concat(F.lit(f"{number:02X}"), size, payload)

    suite = F.when(c("event_id") % 7 == 0, "000FAC08").otherwise("000FAC02")
    rsn = F.concat(F.lit("0100000FAC040100000FAC040100"), suite, F.lit("0000"))
    kind = c("security_type")
    blob = F.concat(
        element(0, F.hex(F.coalesce("ssid", F.lit("")))), element(3, F.lpad(F.hex("advertised_channel"), 2, "0")),
        F.when(kind == "WPA2", element(48, rsn)).when(kind == "WPA", element(221, F.lit("0050F20101"))).otherwise(""),
        F.when(c("event_id") % 50 == 0, "DD09AB").otherwise(""))
    return observations(spark, sf_dir).select(
        c("event_id").alias("capture_id"), F.when(c("event_id") % 2 == 0, 0x11).otherwise(0x01).alias("capability_info"),
        F.unhex(blob).alias("ie_blob"))


@query("information_elements", f"""WITH {OBS}, e AS (SELECT event_id AS capture_id, event_id % 50 = 0 AS truncated, 0 AS position, 0 AS element_id, hex(coalesce(ssid, '')) AS data FROM obs
    UNION ALL SELECT event_id, event_id % 50 = 0, 1, 3, lpad(to_hex(advertised_channel), 2, '0') FROM obs
    UNION ALL SELECT event_id, event_id % 50 = 0, 2, 48, '0100000FAC040100000FAC040100000FAC0' || CASE WHEN event_id % 7 = 0 THEN '8' ELSE '2' END || '0000' FROM obs WHERE security_type = 'WPA2'
    UNION ALL SELECT event_id, event_id % 50 = 0, 2, 221, '0050F20101' FROM obs WHERE security_type = 'WPA') SELECT * FROM e""")
def information_elements(spark, sf_dir):
    return elements.explode_elements(raw_elements(spark, sf_dir)).withColumn("data", F.hex("data"))


POSTURE = f"""WITH {OBS}, p AS (SELECT event_id AS capture_id, CASE WHEN security_type = 'WPA2' THEN CASE WHEN event_id % 7 = 0 THEN 'WPA3_SAE' ELSE 'WPA2_OR_NEWER' END
    WHEN security_type = 'WPA' THEN 'WPA' WHEN event_id % 2 = 0 THEN 'LEGACY_PRIVACY' ELSE 'OPEN' END AS st, security_type AS was, advertised_channel AS ac FROM obs),
q AS (SELECT capture_id, st AS security_type, CASE st WHEN 'OPEN' THEN 0 WHEN 'LEGACY_PRIVACY' THEN 1 WHEN 'WPA' THEN 2 WHEN 'WPA2_OR_NEWER' THEN 3 ELSE 4 END AS security_strength,
    CASE was WHEN 'WPA2' THEN 'rsn_ie' WHEN 'WPA' THEN 'wpa_vendor_ie' ELSE 'capability_privacy_bit' END AS security_source, CASE WHEN ac > 0 THEN ac END AS ds_parameter_channel FROM p)"""


@query("security_posture", f"{POSTURE} SELECT * FROM q")
def security_posture(spark, sf_dir):
    return elements.security_posture(raw_elements(spark, sf_dir)).drop("capability_info", "truncated")


@query("posture_counts", f"{POSTURE} SELECT security_type, security_source, count(*) AS captures FROM q GROUP BY 1, 2")
def posture_counts(spark, sf_dir):
    return elements.posture_counts(elements.security_posture(raw_elements(spark, sf_dir)))
