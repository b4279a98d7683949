"""The derived observations once more, as DuckDB SQL, for the side-by-side check."""

TICKS = """
tick0 AS (SELECT event_id, user_id, value, event_type, epoch_us(ts) - 1704067200000000 AS us,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
tick1 AS (SELECT *, us // 259200000000 AS blk, us % 259200000000 AS rem FROM tick0),
ticks AS (SELECT *, blk >= 6 AND k % 25 = 3 AS d_bssid, blk >= 5 AND k % 20 = 3 AS d_sec FROM tick1)
"""

OBS = TICKS + """,
obs0 AS (SELECT *, lpad(lower(to_hex(user_id + CASE WHEN d_bssid THEN 1000 ELSE 0 END)), 4, '0') AS device FROM ticks),
obs AS (SELECT event_id,
    CASE WHEN user_id % 3 = 0 THEN 'zenodo_v2i' ELSE 'mendeley_rogue_ap' END AS source_dataset,
    'sess_' || lpad(CAST(blk AS VARCHAR), 2, '0') AS session_id,
    rem // 21600000 AS elapsed_ms,
    CASE WHEN k % 10 <> 0 THEN 'net_' || (user_id % 40) END AS ssid,
    CASE WHEN user_id % 4 = 0 THEN '02' ELSE '00' END || ':00:00:00:' || substr(device, 1, 2) || ':' || substr(device, 3, 2) AS bssid,
    CAST(-30.0 AS DOUBLE) - least(value, CAST(90.0 AS DOUBLE)) AS rssi_dbm,
    user_id % 13 + 1 AS channel,
    CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 0 THEN 14 ELSE user_id % 13 + 1 END AS advertised_channel,
    CAST(CASE WHEN k % 8 = 5 THEN 204.8 WHEN k % 16 = 3 THEN 51.2 ELSE 102.4 END AS DOUBLE) AS configured_beacon_interval_ms,
    CASE WHEN d_sec THEN 'OPEN' WHEN user_id % 5 = 0 THEN 'WPA' ELSE 'WPA2' END AS security_type,
    k % 10 = 0 AS is_hidden,
    CASE WHEN k % 17 = 0 THEN us % 1000000 ELSE rem END AS beacon_timestamp_us,
    CAST(d_bssid OR d_sec AS BIGINT) AS label,
    CASE WHEN d_bssid AND d_sec THEN 'bssid_and_security' WHEN d_bssid THEN 'new_bssid'
         WHEN d_sec THEN 'security_downgrade' END AS attack_type,
    d_bssid OR d_sec AS is_synthetic FROM obs0)
"""

HASHED = OBS + """,
hobs AS (SELECT *, sha256('ssid|' || ssid) AS ssid_hash, sha256('bssid|' || upper(bssid)) AS bssid_hash FROM obs)
"""

DESKTOP = HASHED + """,
desk AS (SELECT event_id, 'own_windows' AS source_dataset, session_id, 'home' AS environment,
    make_timestamp(1704067200000000 + CAST(substr(session_id, 6, 2) AS BIGINT) * 259200000000 + elapsed_ms * 21600000) AS captured_at_utc,
    elapsed_ms // 1000 AS scan_index, 'if_' || (channel % 2) AS interface_guid, ssid_hash, bssid_hash,
    ssid IS NULL AS ssid_not_broadcast, rssi_dbm, configured_beacon_interval_ms AS beacon_interval_ms,
    beacon_timestamp_us AS tsf_us, (channel * 5 + 2407) * 1000 AS center_frequency_khz,
    CASE WHEN advertised_channel > 0 THEN advertised_channel END AS ds_parameter_channel,
    security_type, CASE security_type WHEN 'OPEN' THEN 0 WHEN 'WPA' THEN 2 ELSE 3 END AS security_strength,
    CASE WHEN security_type = 'OPEN' THEN 'capability_privacy_bit' ELSE 'rsn_ie' END AS security_source,
    channel * 10 AS ie_blob_size, event_id % 50 = 0 AS ie_parser_truncated,
    0 AS label, CAST(NULL AS VARCHAR) AS attack_type, false AS is_synthetic FROM hobs)
"""

FREQ = """(CASE WHEN {c} BETWEEN 1 AND 13 THEN 2407 + 5 * {c} WHEN {c} = 14 THEN 2484
    WHEN {c} BETWEEN 32 AND 177 THEN 5000 + 5 * {c} END)"""
BAND = """(CASE WHEN {f} IS NULL THEN NULL WHEN {f} >= 2400 AND {f} < 2500 THEN '2.4GHz'
    WHEN {f} >= 4900 AND {f} < 5925 THEN '5GHz' WHEN {f} >= 5925 AND {f} < 7125 THEN '6GHz'
    WHEN {f} >= 57000 AND {f} <= 71000 THEN '60GHz' ELSE 'OTHER' END)"""


def freq(c: str) -> str:
    return "CAST(" + FREQ.format(c=c) + " AS DOUBLE)"


def band(f: str) -> str:
    return BAND.format(f=f)


# Windows of beacons, straight from the definition: a lag over every network's rows.
BEACON = OBS + f""",
gap AS (SELECT *, coalesce(attack_type, '') AS att, coalesce(bssid, '__MISSING_BSSID__') AS bs,
    elapsed_ms - lag(elapsed_ms) OVER (PARTITION BY source_dataset, session_id, coalesce(attack_type, ''), bssid
        ORDER BY elapsed_ms, event_id) AS gap FROM obs),
win AS (SELECT source_dataset, session_id, att, bs, CAST(elapsed_ms // 1000 * 1000 AS DOUBLE) AS window_start_ms,
    avg(rssi_dbm) AS rssi_mean_dbm, count(*) AS beacon_count, avg(gap) AS observed_inter_beacon_ms,
    count(gap) AS inter_beacon_sample_count,
    CAST(arg_min(CASE WHEN advertised_channel > 0 THEN advertised_channel ELSE channel END, elapsed_ms * 10000000000 + event_id) AS DOUBLE) AS channel,
    quantile_cont(configured_beacon_interval_ms, 0.5) AS configured_beacon_interval_ms,
    arg_min(security_type, elapsed_ms * 10000000000 + event_id) AS security_type,
    arg_min(label, elapsed_ms * 10000000000 + event_id) AS label,
    arg_min(is_synthetic, elapsed_ms * 10000000000 + event_id) AS is_synthetic
    FROM gap GROUP BY 1, 2, 3, 4, 5),
beacon AS (SELECT source_dataset, session_id,
    substr(sha256(source_dataset || '|' || bs), 1, 20) AS network_identity_id,
    substr(sha256(source_dataset || '|' || session_id || '|' || att || '|' || bs), 1, 20) AS network_group_id,
    window_start_ms, label, nullif(att, '') AS attack_type, is_synthetic, rssi_mean_dbm, beacon_count,
    observed_inter_beacon_ms, inter_beacon_sample_count, channel, {freq('channel')} AS frequency_mhz,
    {band(freq('channel'))} AS wifi_band, configured_beacon_interval_ms, security_type FROM win)
"""

TEMPORAL = BEACON + """,
temporal AS (SELECT source_dataset, session_id, network_identity_id, network_group_id,
    floor(window_start_ms / 5000) * 5000 AS window_start_ms, label, attack_type, is_synthetic,
    avg(rssi_mean_dbm) AS rssi_mean_dbm, stddev_pop(rssi_mean_dbm) AS rssi_std_db,
    min(rssi_mean_dbm) AS rssi_min_dbm, max(rssi_mean_dbm) AS rssi_max_dbm,
    arg_max(rssi_mean_dbm, b.window_start_ms) - arg_min(rssi_mean_dbm, b.window_start_ms) AS rssi_delta_db,
    count(*) AS window_count FROM beacon b GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)
"""

# Reference of the first two sessions, hidden rows counted for the only SSID of their BSSID.
CONTEXT = HASHED + """,
refrow AS (SELECT * FROM hobs WHERE session_id <= 'sess_01'),
member AS (SELECT DISTINCT ssid_hash, bssid_hash FROM refrow WHERE ssid_hash IS NOT NULL),
owner AS (SELECT bssid_hash, count(*) AS ssid_count, CASE WHEN count(*) = 1 THEN min(ssid_hash) END AS only_ssid FROM member GROUP BY 1),
fact AS (SELECT ssid_hash, channel, security_type, configured_beacon_interval_ms AS itv, 1 AS seen FROM refrow WHERE ssid_hash IS NOT NULL
    UNION ALL SELECT only_ssid, channel, security_type, NULL, 0 FROM refrow r JOIN owner o USING (bssid_hash)
    WHERE r.ssid_hash IS NULL AND only_ssid IS NOT NULL),
rnk AS (SELECT *, CASE security_type WHEN 'OPEN' THEN 0 WHEN 'WEP' THEN 1 WHEN 'WPA' THEN 2 WHEN 'WPA2' THEN 3 WHEN 'WPA3' THEN 4 END AS rk FROM fact),
prof AS (SELECT ssid_hash, list_sort(list(DISTINCT channel)) AS channels, list_sort(list(DISTINCT security_type)) AS security_types,
    quantile_cont(CAST(rk AS DOUBLE), 0.5) AS security_rank_median,
    quantile_cont(itv, 0.5) AS configured_beacon_interval_median_ms, sum(seen)::BIGINT AS observations,
    (SELECT count(*) FROM member m WHERE m.ssid_hash = rnk.ssid_hash) AS bssid_count FROM rnk GROUP BY ssid_hash),
resolved AS (SELECT h.*, CASE WHEN p.ssid_hash IS NOT NULL THEN h.ssid_hash ELSE o.only_ssid END AS resolved_ssid_hash,
    CASE WHEN p.ssid_hash IS NOT NULL THEN 'ssid' WHEN o.only_ssid IS NOT NULL THEN 'bssid_fallback' ELSE 'none' END AS context_resolution
    FROM hobs h LEFT JOIN prof p ON h.ssid_hash = p.ssid_hash LEFT JOIN owner o ON h.bssid_hash = o.bssid_hash),
ctx0 AS (SELECT r.event_id, r.source_dataset, r.session_id, r.elapsed_ms, r.ssid_hash, r.bssid_hash,
    p.ssid_hash IS NOT NULL AS context_available, r.context_resolution,
    CAST(r.ssid IS NULL AS DOUBLE) AS ssid_missing,
    r.configured_beacon_interval_ms - p.configured_beacon_interval_median_ms AS configured_beacon_interval_delta_ms,
    r.label, r.attack_type, r.is_synthetic, CAST(p.bssid_count AS DOUBLE) AS ssid_bssid_count,
    CASE WHEN p.ssid_hash IS NOT NULL THEN CAST(NOT EXISTS (SELECT 1 FROM member m WHERE m.ssid_hash = r.resolved_ssid_hash
        AND m.bssid_hash = r.bssid_hash) AS DOUBLE) END AS bssid_changed,
    CAST(NOT list_contains(p.channels, r.channel) AS DOUBLE) AS channel_changed,
    CAST(NOT list_contains(p.security_types, r.security_type) AS DOUBLE) AS security_changed,
    CASE r.security_type WHEN 'OPEN' THEN 0 WHEN 'WPA' THEN 2 WHEN 'WPA2' THEN 3 END - p.security_rank_median AS security_strength_delta,
    CAST(r.is_hidden AS DOUBLE) AS is_hidden, r.configured_beacon_interval_ms
    FROM resolved r LEFT JOIN prof p ON p.ssid_hash = r.resolved_ssid_hash),
ctx AS (SELECT *, context_available AND ssid_bssid_count IS NOT NULL AND bssid_changed IS NOT NULL AND channel_changed IS NOT NULL
    AND security_changed IS NOT NULL AND security_strength_delta IS NOT NULL AS feature_complete FROM ctx0)
"""

# Desktop reference of the given sessions and the four features of every row.
DESKTOP_CONTEXT = DESKTOP + """,
dref AS (SELECT * FROM desk WHERE session_id <= 'sess_00' AND ssid_hash IS NOT NULL AND bssid_hash IS NOT NULL),
dmember AS (SELECT DISTINCT ssid_hash, bssid_hash FROM dref),
downer AS (SELECT bssid_hash, CASE WHEN count(*) = 1 THEN min(ssid_hash) END AS only_ssid FROM dmember GROUP BY 1),
dprof AS (SELECT ssid_hash, count(DISTINCT bssid_hash) AS bssid_count, list_sort(list(DISTINCT security_type)) AS security_types,
    quantile_cont(CAST(security_strength AS DOUBLE), 0.5) AS security_strength_median, count(*) AS reference_rows,
    count(DISTINCT session_id) AS reference_sessions FROM dref GROUP BY 1),
dres AS (SELECT d.*, CASE WHEN p.ssid_hash IS NOT NULL THEN d.ssid_hash ELSE o.only_ssid END AS context_ssid_hash,
    CASE WHEN p.ssid_hash IS NOT NULL THEN 'ssid_hash' WHEN o.only_ssid IS NOT NULL THEN 'bssid_fallback' ELSE 'unresolved' END AS context_resolution
    FROM desk d LEFT JOIN dprof p ON d.ssid_hash = p.ssid_hash LEFT JOIN downer o ON d.bssid_hash = o.bssid_hash),
dctx0 AS (SELECT r.*, p.ssid_hash IS NOT NULL AS context_available, CAST(p.bssid_count AS DOUBLE) AS ssid_bssid_count,
    CASE WHEN p.ssid_hash IS NOT NULL THEN CAST(NOT EXISTS (SELECT 1 FROM dmember m WHERE m.ssid_hash = r.context_ssid_hash
        AND m.bssid_hash = r.bssid_hash) AS DOUBLE) END AS bssid_changed,
    CAST(NOT list_contains(p.security_types, r.security_type) AS DOUBLE) AS security_changed,
    r.security_strength - p.security_strength_median AS security_strength_delta
    FROM dres r LEFT JOIN dprof p ON p.ssid_hash = r.context_ssid_hash),
dctx AS (SELECT *, context_available AND security_changed IS NOT NULL AND security_strength_delta IS NOT NULL
    AND bssid_changed IS NOT NULL AS feature_complete FROM dctx0)
"""
