from pyspark.sql import functions as F

from wavelark.functions import identity, radio, security, text
from wavelark.operators import quality, windows
from wavelark.plans.catalog import query, rounded, rounded_sql
from wavelark.plans.oracle_views import BEACON, HASHED, OBS, TEMPORAL, band, freq
from wavelark.plans.views import observations, ticks
from wavelark.schema import CANONICAL_TYPES, ensure_canonical

BEACON_FLOATS = ("rssi_mean_dbm", "observed_inter_beacon_ms", "configured_beacon_interval_ms")
TEMPORAL_FLOATS = ("rssi_mean_dbm", "rssi_std_db", "rssi_min_dbm", "rssi_max_dbm", "rssi_delta_db")
TEMPORAL_ROUNDED = rounded_sql("temporal", *TEMPORAL_FLOATS)


@query("observation_view", f"WITH {OBS} SELECT * FROM obs")
def observation_view(spark, sf_dir):
    return observations(spark, sf_dir)


@query("inter_beacon_gap", f"WITH {BEACON} SELECT event_id, gap::DOUBLE AS inter_beacon_ms FROM gap")
def inter_beacon_gap(spark, sf_dir):
    return windows.inter_beacon_gap(observations(spark, sf_dir)).select("event_id", "inter_beacon_ms")


@query("beacon_profile_1s", f"WITH {BEACON} {rounded_sql('beacon', *BEACON_FLOATS)}")
def beacon_profile_1s(spark, sf_dir):
    return rounded(windows.beacon_profile(observations(spark, sf_dir)), *BEACON_FLOATS)


@query("rssi_temporal_5s", f"WITH {TEMPORAL} {TEMPORAL_ROUNDED}")
def rssi_temporal_5s(spark, sf_dir):
    profile = windows.beacon_profile(observations(spark, sf_dir))
    return rounded(windows.rssi_temporal(profile), *TEMPORAL_FLOATS)


@query("temporal_rich_5s", f"""WITH {TEMPORAL}, r AS ({TEMPORAL_ROUNDED})
SELECT *, true AS q_rssi_plausible, true AS q_temporal_complete, true AS q_window_has_multiple_samples,
    true AS q_temporal_basic, true AS q_temporal_rich FROM r
WHERE rssi_mean_dbm BETWEEN -110 AND 0 AND rssi_min_dbm BETWEEN -110 AND 0 AND rssi_max_dbm BETWEEN -110 AND 0
  AND window_count >= 2""")
def temporal_rich_5s(spark, sf_dir):
    profile = windows.beacon_profile(observations(spark, sf_dir))
    rich = quality.filter_temporal_rich(windows.rssi_temporal(profile))
    return rounded(rich, *TEMPORAL_FLOATS)


@query("beacon_quality_flags", f"""WITH {BEACON},
f AS (SELECT network_group_id, window_start_ms,
    coalesce(rssi_mean_dbm BETWEEN -110 AND 0, false) AS q_rssi_plausible,
    coalesce(frequency_mhz > 0, false) AS q_frequency_present,
    coalesce(beacon_count >= 1, false) AS q_beacon_count_positive,
    coalesce(observed_inter_beacon_ms > 0, false) AS q_inter_beacon_positive FROM beacon)
SELECT *, q_rssi_plausible AND q_frequency_present AND q_beacon_count_positive AS q_beacon_core FROM f""")
def beacon_quality_flags(spark, sf_dir):
    flagged = quality.beacon_flags(windows.beacon_profile(observations(spark, sf_dir)))
    return flagged.select("network_group_id", "window_start_ms",
                          *[c for c in flagged.columns if c.startswith("q_")])


@query("temporal_quality_flags", f"""WITH {TEMPORAL},
f AS (SELECT network_group_id, window_start_ms, label,
    rssi_mean_dbm BETWEEN -110 AND 0 AND rssi_min_dbm BETWEEN -110 AND 0 AND rssi_max_dbm BETWEEN -110 AND 0 AS q_rssi_plausible,
    rssi_std_db IS NOT NULL AND rssi_delta_db IS NOT NULL AND window_count IS NOT NULL AS q_temporal_complete,
    window_count >= 2 AS q_window_has_multiple_samples, window_count FROM temporal),
g AS (SELECT *, q_rssi_plausible AND q_temporal_complete AND window_count >= 1 AS q_temporal_basic FROM f)
SELECT * EXCLUDE (window_count), q_temporal_basic AND q_window_has_multiple_samples AS q_temporal_rich FROM g""")
def temporal_quality_flags(spark, sf_dir):
    flagged = quality.temporal_flags(
        windows.rssi_temporal(windows.beacon_profile(observations(spark, sf_dir))))
    return flagged.select("network_group_id", "window_start_ms", "label",
                          *[c for c in flagged.columns if c.startswith("q_")])


@query("quality_summary", f"""WITH {BEACON},
f AS (SELECT coalesce(rssi_mean_dbm BETWEEN -110 AND 0, false) AS a,
    coalesce(observed_inter_beacon_ms > 0, false) AS b FROM beacon),
t AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM f),
u AS (SELECT 'q_rssi_plausible' AS flag, n AS "rows", na AS passed FROM t
      UNION ALL SELECT 'q_inter_beacon_positive', n, nb FROM t)
SELECT flag, "rows", passed, "rows" - passed AS failed, round(passed / "rows", 9) AS pass_rate FROM u""")
def quality_summary(spark, sf_dir):
    flagged = quality.beacon_flags(windows.beacon_profile(observations(spark, sf_dir)))
    return rounded(quality.quality_summary(
        flagged, ["q_rssi_plausible", "q_inter_beacon_positive"]), "pass_rate")


@query("canonical_schema", f"WITH {OBS} SELECT " + ", ".join(
    (f"CAST({n} AS {'DOUBLE' if t == 'double' else 'BIGINT' if t == 'long' else 'BOOLEAN' if t == 'boolean' else 'VARCHAR'}) AS {n}"
     if n in ("source_dataset", "session_id", "elapsed_ms", "ssid", "bssid", "rssi_dbm", "channel",
              "advertised_channel", "configured_beacon_interval_ms", "security_type", "is_hidden",
              "beacon_timestamp_us", "label", "attack_type", "is_synthetic")
     else f"CAST(NULL AS {dict(string='VARCHAR', double='DOUBLE', long='BIGINT', boolean='BOOLEAN', timestamp='TIMESTAMP')[t]}) AS {n}")
    for n, t in CANONICAL_TYPES) + " FROM obs")
def canonical_schema(spark, sf_dir):
    return ensure_canonical(observations(spark, sf_dir))


@query("radio_functions", f"""WITH {OBS}, c AS (SELECT event_id, channel * 13 AS wide, channel, advertised_channel FROM obs)
SELECT event_id, {freq('wide')} AS frequency_mhz, {band(freq('wide'))} AS wifi_band,
    {band('CAST(wide * 500 AS DOUBLE)')} AS any_band,
    CASE WHEN advertised_channel > 0 THEN advertised_channel END AS valid_channel,
    CAST(CASE WHEN advertised_channel > 0 THEN channel <> advertised_channel END AS DOUBLE) AS mismatch FROM c""")
def radio_functions(spark, sf_dir):
    wide = F.col("channel") * 13
    frequency = radio.channel_to_frequency_mhz(wide)
    return observations(spark, sf_dir).select(
        "event_id", frequency.alias("frequency_mhz"), radio.wifi_band(frequency).alias("wifi_band"),
        radio.wifi_band(wide * 500).alias("any_band"),
        radio.valid_advertised_channel(F.col("advertised_channel")).alias("valid_channel"),
        radio.channel_mismatch(F.col("channel"), F.col("advertised_channel")).alias("mismatch"),
    )


@query("security_functions", """WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' wpa2 ' WHEN 'view' THEN 'Open'
    WHEN 'error' THEN 'wep' WHEN 'purchase' THEN NULL ELSE event_type END AS raw FROM events),
n AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN upper(trim(raw)) IN ('OPEN', 'WEP', 'WPA', 'WPA2', 'WPA3')
    THEN upper(trim(raw)) ELSE 'OTHER' END AS security FROM s)
SELECT event_id, security, CAST(CASE security WHEN 'OPEN' THEN 0 WHEN 'WEP' THEN 1 WHEN 'WPA' THEN 2
    WHEN 'WPA2' THEN 3 WHEN 'WPA3' THEN 4 END AS DOUBLE) AS security_rank FROM n""")
def security_functions(spark, sf_dir):
    kind = F.col("event_type")
    raw = (F.when(kind == "click", " wpa2 ").when(kind == "view", "Open").when(kind == "error", "wep")
           .when(kind == "purchase", F.lit(None)).otherwise(kind))
    return ticks(spark, sf_dir).select(
        "event_id", security.normalize_security(raw).alias("security"),
        security.security_rank(raw).alias("security_rank"))


@query("identity_functions", f"""WITH {HASHED} SELECT event_id, ssid_hash, bssid_hash,
    substr(sha256(source_dataset || '|' || coalesce(ssid, '')), 1, 20) AS group_id,
    sha256('if_' || channel || '|' || bssid) AS network_id,
    CAST((CAST('0x' || substr(bssid, 1, 2) AS BIGINT) & 2) // 2 AS DOUBLE) AS local_admin,
    CAST(CAST('0x' || substr(bssid, 1, 2) AS BIGINT) & 1 AS DOUBLE) AS multicast FROM hobs""")
def identity_functions(spark, sf_dir):
    ssid, bssid = F.col("ssid"), F.col("bssid")
    return observations(spark, sf_dir).select(
        "event_id", identity.hash_ssid(ssid).alias("ssid_hash"), identity.hash_bssid(bssid).alias("bssid_hash"),
        identity.stable_group_id(F.col("source_dataset"), ssid).alias("group_id"),
        identity.network_id(F.concat(F.lit("if_"), "channel"), bssid).alias("network_id"),
        identity.local_admin_bit(bssid).alias("local_admin"), identity.multicast_bit(bssid).alias("multicast"))


@query("text_functions", """WITH t AS (SELECT event_id, user_id, value,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'TRUE' WHEN event_id % 2 = 0 THEN ' no ' ELSE 'maybe' END AS said,
    CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y%m%d%H%M%S') || substr(strftime(ts, '%f'), 1, 3) END AS stamp, ts FROM events)
SELECT event_id, 'ap_' || user_id AS ap_id, CAST(-(user_id % 60) AS BIGINT) AS ap_value, 2 AS ap_count,
    CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END AS stamp_ms,
    CAST(user_id AS DOUBLE) AS x, value AS y, CASE WHEN event_id % 4 <> 0 THEN 1.5::DOUBLE END AS z,
    coalesce(said = 'TRUE', false) AS tolerant,
    CASE said WHEN 'TRUE' THEN true WHEN ' no ' THEN false END AS strict,
    -value AS score FROM t""")
def text_functions(spark, sf_dir):
    e = F.col("event_id")
    said = F.when(e % 5 == 0, F.lit(None)).when(e % 3 == 0, "TRUE").when(e % 2 == 0, " no ").otherwise("maybe")
    line = F.concat(F.lit("ap_"), "user_id", F.lit(":7, bad:x ,:3,other:-4,ap_"), "user_id",
                    F.lit(":-"), F.col("user_id") % 60, F.lit(","))
    moment = F.timestamp_micros(F.col("us") + 1_704_067_200_000_000)
    stamp = F.when(e % 7 != 0, F.date_format(moment, "yyyyMMddHHmmssSSS"))
    place = text.parse_coordinates(F.concat(
        F.col("user_id").cast("string"), F.lit(", "), F.col("value").cast("string"), F.lit(","),
        F.when(e % 4 != 0, "1.5").otherwise("")))
    tokens = text.parse_token_map(line)
    ap = F.concat(F.lit("ap_"), "user_id")
    return ticks(spark, sf_dir).select(
        "event_id", ap.alias("ap_id"), F.element_at(tokens, ap).alias("ap_value"),
        F.size(tokens).cast("long").alias("ap_count"),
        F.unix_millis(text.parse_compact_timestamp(stamp)).alias("stamp_ms"),
        place["x"].alias("x"), place["y"].alias("y"), place["z"].alias("z"),
        text.tolerant_true(said).alias("tolerant"), text.strict_boolean(said).alias("strict"),
        text.anomaly_score(F.col("value"), False).alias("score"))
