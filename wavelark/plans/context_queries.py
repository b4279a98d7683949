from pyspark.sql import functions as F

from wavelark.operators import channels, context, tsf
from wavelark.plans.catalog import query, rounded
from wavelark.plans.oracle_views import CONTEXT, DESKTOP_CONTEXT, HASHED
from wavelark.plans.views import desktop_rows, observations


def early(df):
    """The first two sessions; networks that drift later are unknown to them, or known in part."""
    return df.where(F.col("session_id") <= "sess_01")


def early_desktop(df):
    return df.where(F.col("session_id") <= "sess_00")


def reference(spark, sf_dir):
    return context.build_reference(early(observations(spark, sf_dir)))


def desktop_reference(spark, sf_dir):
    return context.freeze(context.build_desktop_reference(early_desktop(desktop_rows(spark, sf_dir))))


def desktop_features(spark, sf_dir):
    return context.transform_desktop(desktop_rows(spark, sf_dir), desktop_reference(spark, sf_dir))


@query("ssid_reference", f"""WITH {CONTEXT} SELECT ssid_hash, bssid_count, array_to_string(channels, ',') AS channels,
    array_to_string(security_types, ',') AS security_types, security_rank_median,
    configured_beacon_interval_median_ms, observations FROM prof""")
def ssid_reference(spark, sf_dir):
    return reference(spark, sf_dir).profiles.select(
        "ssid_hash", "bssid_count", F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"),
        F.array_join("security_types", ",").alias("security_types"), "security_rank_median",
        "configured_beacon_interval_median_ms", "observations")


@query("bssid_ssid_map", f"""WITH {CONTEXT} SELECT bssid_hash, ssid_hash, ssid_count FROM member JOIN owner USING (bssid_hash)""")
def bssid_ssid_map(spark, sf_dir):
    members = reference(spark, sf_dir).members
    return members.join(context.bssid_ssids(members).select("bssid_hash", "ssid_count"), "bssid_hash")


@query("context_resolution", f"""WITH {CONTEXT} SELECT event_id, ssid_hash, bssid_hash, resolved_ssid_hash, context_resolution,
    context_resolution <> 'none' AS context_available FROM resolved""")
def context_resolution(spark, sf_dir):
    return context.resolve_context(observations(spark, sf_dir), context.freeze(reference(spark, sf_dir))).select(
        "event_id", "ssid_hash", "bssid_hash", "resolved_ssid_hash", "context_resolution", "context_available")


@query("contextual_features", f"WITH {CONTEXT} SELECT * FROM ctx")
def contextual_features(spark, sf_dir):
    ref = context.freeze(reference(spark, sf_dir))
    return context.transform_contextual(observations(spark, sf_dir), ref, keep=("event_id",))


@query("contextual_core_v2", f"""WITH {CONTEXT} SELECT ssid_bssid_count, bssid_changed, security_changed,
    security_strength_delta, is_hidden FROM ctx WHERE feature_complete""")
def contextual_core_v2(spark, sf_dir):
    features = context.transform_contextual(observations(spark, sf_dir), context.freeze(reference(spark, sf_dir)))
    return context.select_core_v2(features.where("feature_complete"))


CHANNEL = HASHED + """,
cref AS (SELECT *, CASE WHEN advertised_channel > 0 THEN advertised_channel END AS adv FROM hobs WHERE session_id <= 'sess_01'),
cmember AS (SELECT DISTINCT ssid_hash, bssid_hash FROM cref WHERE ssid_hash IS NOT NULL),
cowner AS (SELECT bssid_hash, CASE WHEN count(*) = 1 THEN min(ssid_hash) END AS only_ssid FROM cmember GROUP BY 1),
cpair AS (SELECT DISTINCT coalesce(r.ssid_hash, o.only_ssid) AS ssid_hash, adv FROM cref r LEFT JOIN cowner o ON o.bssid_hash = r.bssid_hash
    WHERE adv IS NOT NULL AND coalesce(r.ssid_hash, o.only_ssid) IS NOT NULL),
cset AS (SELECT ssid_hash, list_sort(list(adv)) AS channels FROM cpair GROUP BY 1)
"""


@query("advertised_channel_reference", f"WITH {CHANNEL} SELECT ssid_hash, array_to_string(channels, ',') AS channels FROM cset")
def advertised_channel_reference(spark, sf_dir):
    ref = context.freeze(channels.build_channel_reference(early(observations(spark, sf_dir))))
    return ref.profiles.select("ssid_hash", F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"))


@query("channel_semantics", f"""WITH {CHANNEL},
x AS (SELECT h.*, CASE WHEN c.ssid_hash IS NOT NULL THEN h.ssid_hash ELSE o.only_ssid END AS r,
    CASE WHEN advertised_channel > 0 THEN advertised_channel END AS adv
    FROM hobs h LEFT JOIN cset c ON c.ssid_hash = h.ssid_hash LEFT JOIN cowner o ON o.bssid_hash = h.bssid_hash)
SELECT event_id, channel AS capture_channel, adv AS advertised_channel, CAST(channel <> adv AS DOUBLE) AS capture_advertised_mismatch,
    CAST(NOT list_contains(c.channels, adv) AS DOUBLE) AS advertised_channel_changed
FROM x LEFT JOIN cset c ON c.ssid_hash = x.r""")
def channel_semantics(spark, sf_dir):
    rows = observations(spark, sf_dir)
    out = channels.transform_channels(rows, context.freeze(channels.build_channel_reference(early(rows))))
    return out.select("event_id", "capture_channel", "advertised_channel", "capture_advertised_mismatch",
                      "advertised_channel_changed")


TSF = HASHED + """,
tref AS (SELECT session_id, bssid_hash, count(*) AS count, CAST(min(beacon_timestamp_us) AS DOUBLE) AS min_tsf_us,
    CAST(max(beacon_timestamp_us) AS DOUBLE) AS max_tsf_us, quantile_cont(CAST(beacon_timestamp_us AS DOUBLE), 0.5) AS median_tsf_us
    FROM hobs WHERE elapsed_ms < 6000 GROUP BY 1, 2)
"""


def tsf_reference_rows(spark, sf_dir):
    return observations(spark, sf_dir).where(F.col("elapsed_ms") < 6000)


@query("tsf_reference", f"WITH {TSF} SELECT * FROM tref")
def tsf_reference(spark, sf_dir):
    return tsf.build_tsf_reference(tsf_reference_rows(spark, sf_dir))


@query("tsf_features", f"""WITH {TSF} SELECT event_id, h.session_id AS source_session_id, h.bssid_hash,
    max_tsf_us IS NOT NULL AS tsf_reference_available, max_tsf_us AS tsf_reference_max_us,
    CAST(beacon_timestamp_us AS DOUBLE) AS current_tsf_us,
    CAST(beacon_timestamp_us < max_tsf_us AS DOUBLE) AS tsf_reference_monotonic_violation,
    round((beacon_timestamp_us - max_tsf_us) / 1000.0, 6) + 0.0 AS tsf_delta_from_reference_max_ms,
    round(ln(1.0 + beacon_timestamp_us) - ln(1.0 + max_tsf_us), 9) + 0.0 AS tsf_log_ratio_to_reference_max
FROM hobs h LEFT JOIN tref t ON t.session_id = h.session_id AND t.bssid_hash = h.bssid_hash""")
def tsf_features(spark, sf_dir):
    out = tsf.transform_tsf(
        observations(spark, sf_dir).select("event_id", "session_id", "bssid", "beacon_timestamp_us"),
        tsf.build_tsf_reference(tsf_reference_rows(spark, sf_dir)))
    return rounded(rounded(out, "tsf_log_ratio_to_reference_max"), "tsf_delta_from_reference_max_ms", digits=6)


@query("local_admin_bits", f"""WITH {HASHED} SELECT event_id, bssid_hash,
    CAST((CAST('0x' || substr(bssid, 1, 2) AS BIGINT) & 2) // 2 AS DOUBLE) AS bssid_local_admin_flag,
    CAST(CAST('0x' || substr(bssid, 1, 2) AS BIGINT) & 1 AS DOUBLE) AS bssid_multicast_flag FROM hobs""")
def local_admin_bits(spark, sf_dir):
    return tsf.transform_local_admin(observations(spark, sf_dir).select("event_id", "bssid"))


@query("desktop_reference", f"""WITH {DESKTOP_CONTEXT} SELECT ssid_hash, bssid_count, array_to_string(security_types, ',') AS security_types,
    security_strength_median, reference_rows, reference_sessions FROM dprof""")
def desktop_reference_profiles(spark, sf_dir):
    profiles = context.build_desktop_reference(early_desktop(desktop_rows(spark, sf_dir))).profiles
    return profiles.withColumn("security_types", F.array_join("security_types", ","))


@query("desktop_features", f"""WITH {DESKTOP_CONTEXT} SELECT event_id, session_id, context_ssid_hash, context_resolution, context_available,
    ssid_bssid_count, bssid_changed, security_changed, security_strength_delta, feature_complete FROM dctx""")
def desktop_feature_rows(spark, sf_dir):
    return desktop_features(spark, sf_dir).select(
        "event_id", "session_id", "context_ssid_hash", "context_resolution", "context_available",
        "ssid_bssid_count", "bssid_changed", "security_changed", "security_strength_delta", "feature_complete")


@query("reference_coverage", f"""WITH {DESKTOP_CONTEXT} SELECT session_id, count(*) AS "rows",
    count(*) FILTER (context_available AND feature_complete) AS eligible,
    count(*) FILTER (NOT context_available) AS context_unavailable,
    round(count(*) FILTER (context_available AND feature_complete) / count(*), 9) AS eligible_rate FROM dctx GROUP BY 1""")
def reference_coverage(spark, sf_dir):
    return rounded(context.coverage(desktop_features(spark, sf_dir), by="session_id"), "eligible_rate")
