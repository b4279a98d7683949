from pyspark.sql import functions as F

from wavelark.functions.identity import network_id
from wavelark.operators import context, dashboard, history, networks
from wavelark.plans.catalog import query, rounded
from wavelark.plans.context_queries import desktop_reference
from wavelark.plans.oracle_views import DESKTOP_CONTEXT
from wavelark.plans.views import desktop_rows
from wavelark.session import fresh_path, stored
from wavelark.sources import store

STORE = DESKTOP_CONTEXT + """,
st0 AS (SELECT d.*, o.ssid, o.bssid, d.session_id || '-' || lpad(CAST(scan_index AS VARCHAR), 2, '0') AS scan_id,
    sha256(interface_guid || '|' || o.bssid) AS network_id, CASE WHEN d.session_id < 'sess_05' THEN 1 ELSE 2 END AS model_version_id,
    event_id % 97 <> 0 AS analysed, CASE WHEN feature_complete THEN 2 * bssid_changed + 0.5::DOUBLE * security_changed - 0.25::DOUBLE * security_strength_delta + d.rssi_dbm / -1000 END AS anomaly_score
    FROM dctx d JOIN obs o USING (event_id)),
st AS (SELECT *, min(epoch_us(captured_at_utc)) OVER (PARTITION BY scan_id) AS observed_us, anomaly_score > 0.2 AS is_anomaly,
    CASE WHEN NOT feature_complete THEN 'unavailable' WHEN anomaly_score > 0.2 THEN 'high' ELSE 'low' END AS suspicion_level FROM st0),
scan AS (SELECT scan_id AS id, min(observed_us) AS observed_us, count(*) AS total_networks, count(DISTINCT interface_guid) AS interface_count,
    count(*) FILTER (analysed) AS feature_count, count(*) FILTER (analysed) AS detection_count, count(*) FILTER (analysed AND is_anomaly) AS anomaly_count,
    count(*) FILTER (analysed AND NOT is_anomaly) AS normal_count, count(*) FILTER (analysed AND is_anomaly IS NULL) AS insufficient_history_count FROM st GROUP BY 1
    UNION ALL SELECT session_id || '-none', min(epoch_us(captured_at_utc)), 0, 2, 0, 0, 0, 0, 0 FROM desk GROUP BY session_id),
det AS (SELECT * FROM st WHERE analysed),
model AS (SELECT CASE WHEN session_id < 'sess_05' THEN 1 ELSE 2 END AS id, CASE WHEN session_id < 'sess_05' THEN 'desktop-a' ELSE 'desktop-b' END AS version_name,
    min(epoch_us(captured_at_utc)) AS created_us, min(session_id) >= 'sess_05' AS active, count(*) FILTER (analysed) AS detection_count FROM st0 GROUP BY 1, 2)
"""


def scored_scans(spark, sf_dir):
    rows = context.transform_desktop(desktop_rows(spark, sf_dir, clear=True), desktop_reference(spark, sf_dir))
    ready = context.eligible()
    score = (2 * F.col("bssid_changed") + F.col("security_changed") * 0.5 - F.col("security_strength_delta") * 0.25
             + F.col("rssi_dbm") / -1000)
    scan = F.concat_ws("-", "session_id", F.lpad(F.col("scan_index").cast("string"), 2, "0"))
    scored = rows.withColumns({
        "scan_id": scan, "observation_id": F.col("event_id"), "observed_at_utc": F.col("captured_at_utc"),
        "network_id": network_id(F.col("interface_guid"), F.col("bssid")),
        "status": F.when(F.col("event_id") % 97 == 0, "unavailable").when(ready, "ready").otherwise("insufficient_history"),
        "anomaly_score": F.when(ready, score), "threshold": F.when(ready, F.lit(0.2)),
        "model_version_id": F.when(F.col("session_id") < "sess_05", 1).otherwise(2).cast("long")})
    times = stored(scored.groupBy("scan_id").agg(F.min("captured_at_utc").alias("observed_at_utc")), "scan-times")
    return scored.drop("observed_at_utc").join(times, "scan_id").withColumns({
        "is_anomaly": F.when(ready, F.col("anomaly_score") > 0.2),
        "suspicion_level": F.when(~ready, "unavailable").when(F.col("anomaly_score") > 0.2, "high").otherwise("low")})


def told_scans(spark, sf_dir):
    """All scans with their times, and one in every session that saw no network."""
    rows = desktop_rows(spark, sf_dir)
    scan = F.concat_ws("-", "session_id", F.lpad(F.col("scan_index").cast("string"), 2, "0"))
    seen = rows.groupBy(scan.alias("scan_id")).agg(F.min("captured_at_utc").alias("observed_at_utc"))
    none = rows.groupBy(F.concat("session_id", F.lit("-none")).alias("scan_id")).agg(F.min("captured_at_utc").alias("observed_at_utc"))
    return seen.withColumn("interface_count", F.lit(None).cast("long")).unionByName(none.withColumn("interface_count", F.lit(2).cast("long")))


def versions(spark, sf_dir):
    name = F.when(F.col("session_id") < "sess_05", "desktop-a").otherwise("desktop-b")
    return desktop_rows(spark, sf_dir).groupBy(name.alias("version_name")).agg(
        F.min("captured_at_utc").alias("created_at_utc"), (F.count(F.lit(1)) / 1000.0).alias("threshold"),
    ).withColumn("algorithm", F.lit("one_class"))


def registry(spark, sf_dir):
    """A registry holding the first version, refreshed with it and joined by the second."""
    found = versions(spark, sf_dir)
    held = found.where(F.col("version_name") == "desktop-a").select(
        F.lit(1).cast("long").alias("id"), "version_name", "algorithm", F.lit(0.0).alias("threshold"), "created_at_utc",
        F.lit(True).alias("active"))
    return store.upsert_model_version(held, found)


def database(spark, sf_dir):
    """The store of one data folder, written anew for every query."""
    root = fresh_path(spark, "store")
    store.ingest(scored_scans(spark, sf_dir), root, scans=told_scans(spark, sf_dir), models=registry(spark, sf_dir))
    return store.read_store(spark, root)


def micros(df, **names):
    """Timestamps as microseconds, so both engines print them alike."""
    return df.withColumns({new: F.unix_micros(old) for old, new in names.items()}).drop(*names)


@query("model_registry", f"""WITH {STORE}, c AS (SELECT id, count(*) / 1000.0::DOUBLE AS threshold FROM (SELECT CASE WHEN session_id < 'sess_05' THEN 1 ELSE 2 END AS id FROM desk) GROUP BY 1)
SELECT id, version_name, 'one_class' AS algorithm, threshold, created_us, active FROM model JOIN c USING (id)""")
def model_registry(spark, sf_dir):
    return micros(registry(spark, sf_dir), created_at_utc="created_us")


@query("persisted_scans", f"""WITH {STORE} SELECT id, observed_us, total_networks, interface_count FROM scan""")
def persisted_scans(spark, sf_dir):
    return micros(database(spark, sf_dir)["scan_session"].select("id", "observed_at_utc", "total_networks", "interface_count"), observed_at_utc="observed_us")


@query("persisted_observations", f"""WITH {STORE} SELECT event_id AS id, scan_id AS scan_session_id, network_id,
    sha256('interface-guid|' || interface_guid) AS interface_guid_hash, ssid_hash, sha256('bssid|' || bssid) AS bssid_hash, tsf_us, security_type FROM st""")
def persisted_observations(spark, sf_dir):
    return database(spark, sf_dir)["network_observation"].select(
        "id", "scan_session_id", "network_id", "interface_guid_hash", "ssid_hash", "bssid_hash", "tsf_us", "security_type")


@query("persisted_detections", f"""WITH {STORE} SELECT event_id AS id, scan_id AS scan_session_id, model_version_id, round(anomaly_score, 9) + 0.0 AS anomaly_score,
    is_anomaly, suspicion_level, observed_us AS created_us FROM det""")
def persisted_detections(spark, sf_dir):
    # Half of the sessions, then all: the scans stored already are left out, also those without a network.
    root, scored, told = fresh_path(spark, "store"), stored(scored_scans(spark, sf_dir), "scored"), told_scans(spark, sf_dir)
    early = F.col("scan_id") < "sess_06"
    store.ingest(scored.where(early), root, scans=told.where(early), models=registry(spark, sf_dir))
    store.ingest(scored, root, scans=told, repeated="skip")
    return micros(rounded(store.read_store(spark, root)["detection"].select("id", "scan_session_id", "model_version_id", "anomaly_score", "is_anomaly",
                                      "suspicion_level", "created_at_utc"), "anomaly_score"), created_at_utc="created_us")


@query("persisted_features", f"""WITH {STORE} SELECT event_id AS id, event_id AS network_observation_id, ssid_bssid_count, bssid_changed,
    security_changed, security_strength_delta, context_available, context_resolution, feature_complete FROM det""")
def persisted_features(spark, sf_dir):
    return database(spark, sf_dir)["network_features"].drop("scan_session_id", "scan_date")


@query("scan_history", f"""WITH {STORE} SELECT * EXCLUDE (normal_count) FROM scan ORDER BY observed_us DESC, id DESC LIMIT 25 OFFSET 10""")
def scan_history(spark, sf_dir):
    return micros(history.list_scans(database(spark, sf_dir), 25, 10), observed_at_utc="observed_us")


@query("scan_detail", f"WITH {STORE} SELECT * EXCLUDE (normal_count) FROM scan WHERE id = 'sess_06-05'")
def scan_detail(spark, sf_dir):
    return micros(history.scan_detail(database(spark, sf_dir), "sess_06-05"), observed_at_utc="observed_us")


@query("scan_observations", f"""WITH {STORE} SELECT event_id AS id, ssid_hash, sha256('bssid|' || bssid) AS bssid_hash, ssid_bssid_count, bssid_changed,
    context_resolution, event_id AS detection_id, is_anomaly, suspicion_level FROM det WHERE scan_id = 'sess_06-05'
    UNION ALL SELECT event_id, ssid_hash, sha256('bssid|' || bssid), NULL, NULL, NULL, NULL, NULL, NULL FROM st WHERE scan_id = 'sess_06-05' AND NOT analysed
    ORDER BY 1 LIMIT 50 OFFSET 2""")
def scan_observations(spark, sf_dir):
    return history.scan_observations(database(spark, sf_dir), "sess_06-05", 50, 2).select(
        "id", "ssid_hash", "bssid_hash", "ssid_bssid_count", "bssid_changed", "context_resolution", "detection_id",
        "is_anomaly", "suspicion_level")


@query("anomaly_history", f"""WITH {STORE} SELECT event_id AS id, scan_id AS scan_session_id, round(anomaly_score, 9) AS anomaly_score FROM det
WHERE is_anomaly AND suspicion_level = 'high' AND model_version_id = 2 ORDER BY observed_us DESC, event_id DESC LIMIT 100""")
def anomaly_history(spark, sf_dir):
    rows = history.list_detections(database(spark, sf_dir), 100, 0, True, "high", 2)
    return rounded(rows.select("id", "scan_session_id", "anomaly_score"), "anomaly_score")


@query("detection_total", f"WITH {STORE} SELECT count(*) AS total FROM det WHERE is_anomaly = false")
def detection_total(spark, sf_dir):
    return history.total(history.filter_detections(database(spark, sf_dir), is_anomaly=False))


@query("detection_detail", f"""WITH {STORE} SELECT event_id AS detection_id, scan_id AS detection_scan_session_id, suspicion_level AS detection_suspicion_level,
    det.network_id AS observation_network_id, security_changed, m.version_name, m.active, m.detection_count
FROM det JOIN model m ON m.id = det.model_version_id WHERE event_id = 700""")
def detection_detail(spark, sf_dir):
    return history.detection_detail(database(spark, sf_dir), 700).select(
        "detection_id", "detection_scan_session_id", "detection_suspicion_level", "observation_network_id",
        "security_changed", "version_name", "active", "detection_count")


@query("model_history", f"WITH {STORE} SELECT id, version_name, active, created_us, detection_count FROM model")
def model_history(spark, sf_dir):
    rows = history.list_models(database(spark, sf_dir)).select("id", "version_name", "active", "created_at_utc", "detection_count")
    return micros(rows, created_at_utc="created_us")


@query("model_detail", f"WITH {STORE} SELECT id, version_name, detection_count FROM model WHERE id = 1")
def model_detail(spark, sf_dir):
    return history.get_model(database(spark, sf_dir), 1).select("id", "version_name", "detection_count")


@query("dashboard_overview", f"""WITH {STORE} SELECT (SELECT count(*) FROM scan) AS scan_count, count(*) AS observation_count,
    count(DISTINCT network_id) AS unique_network_count, count(*) FILTER (analysed) AS feature_count, count(*) FILTER (analysed) AS detection_count,
    count(*) FILTER (analysed AND is_anomaly) AS anomaly_count, count(*) FILTER (analysed AND NOT is_anomaly) AS normal_count,
    count(*) FILTER (analysed AND is_anomaly IS NULL) AS insufficient_history_count, (SELECT count(*) FROM model) AS model_version_count,
    round(count(*) FILTER (analysed) / count(*), 9) AS analysis_coverage_rate,
    round(count(*) FILTER (analysed AND is_anomaly) / count(is_anomaly) FILTER (analysed), 9) AS anomaly_rate_among_decided,
    (SELECT max(observed_us) FROM scan) AS latest_scan_us, max(observed_us) FILTER (analysed) AS latest_detection_us FROM st""")
def dashboard_overview(spark, sf_dir):
    row = rounded(dashboard.overview(database(spark, sf_dir)), "analysis_coverage_rate", "anomaly_rate_among_decided")
    return micros(row, latest_scan_at_utc="latest_scan_us", latest_detection_at_utc="latest_detection_us")


@query("suspicion_distribution", f"""WITH {STORE} SELECT l.v AS suspicion_level, count(det.event_id) AS detections
FROM (VALUES ('low'), ('medium'), ('high'), ('unavailable')) l(v) LEFT JOIN det ON det.suspicion_level = l.v GROUP BY 1""")
def suspicion_distribution(spark, sf_dir):
    return dashboard.suspicion_distribution(database(spark, sf_dir))


@query("scan_trends", f"""WITH {STORE} SELECT id, observed_us, total_networks AS network_count, feature_count, detection_count, anomaly_count, normal_count,
    insufficient_history_count FROM scan ORDER BY observed_us DESC, id DESC LIMIT 30""")
def scan_trends(spark, sf_dir):
    return micros(dashboard.trends(database(spark, sf_dir), 30), observed_at_utc="observed_us")


@query("recent_detections", f"""WITH {STORE} SELECT event_id AS id, scan_id AS scan_session_id, suspicion_level FROM det ORDER BY observed_us DESC, event_id DESC LIMIT 5""")
def recent_detections(spark, sf_dir):
    return dashboard.recent(database(spark, sf_dir))["detections"].select("id", "scan_session_id", "suspicion_level")


@query("active_model", f"WITH {STORE} SELECT id, version_name, detection_count FROM model WHERE active")
def active_model(spark, sf_dir):
    return dashboard.active_model(database(spark, sf_dir)).select("id", "version_name", "detection_count")


@query("latest_activity", f"""WITH {STORE}, s AS (SELECT * FROM scan ORDER BY observed_us DESC, id DESC LIMIT 1),
d AS (SELECT * FROM det ORDER BY observed_us DESC, event_id DESC LIMIT 1)
SELECT s.observed_us AS latest_scan_us, s.total_networks AS latest_scan_network_count, s.detection_count AS latest_scan_detection_count,
    s.anomaly_count AS latest_scan_anomaly_count, s.insufficient_history_count AS latest_scan_insufficient_history_count,
    d.observed_us AS latest_detection_us, d.suspicion_level AS latest_detection_suspicion_level, d.is_anomaly AS latest_detection_is_anomaly,
    (SELECT version_name FROM model WHERE active) AS active_model FROM s, d""")
def latest_activity(spark, sf_dir):
    row = dashboard.latest(database(spark, sf_dir))
    return micros(row, latest_scan_at_utc="latest_scan_us", latest_detection_at_utc="latest_detection_us")


def listed(spark, sf_dir):
    return scored_scans(spark, sf_dir).select(
        "event_id", "ssid", "bssid", "security_type", F.lit("ht").alias("phy_type"), "suspicion_level", "rssi_dbm")


@query("network_search", f"""WITH {STORE} SELECT event_id, ssid, bssid, security_type, suspicion_level FROM st WHERE suspicion_level = 'high'
    AND (contains(lower(coalesce(ssid, '')), 'net_1') OR contains(lower(bssid), 'net_1'))""")
def network_search(spark, sf_dir):
    return networks.search(listed(spark, sf_dir), " NET_1 ", "high").select(
        "event_id", "ssid", "bssid", "security_type", "suspicion_level")


@query("network_order", f"""WITH {STORE} SELECT event_id, suspicion_level, row_number() OVER (
ORDER BY CASE suspicion_level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'unavailable' THEN 2 ELSE 1 END DESC, rssi_dbm DESC,
    lower(coalesce(ssid, '')), bssid, event_id) - 1 AS position FROM st""")
def network_order(spark, sf_dir):
    return networks.positions(listed(spark, sf_dir), "suspicion_desc", "event_id").select("event_id", "suspicion_level", "position")


# Names with accents and in capitals beside plain ones: the collation tells neither apart.
@query("network_name_order", f"""WITH {STORE}, n AS (SELECT *, CASE event_id % 3 WHEN 0 THEN upper(ssid) WHEN 1 THEN replace(ssid, 'e', 'é') ELSE ssid END AS shown FROM st)
SELECT event_id, row_number() OVER (ORDER BY strip_accents(lower(coalesce(shown, 'SSID não transmitido'))), rssi_dbm DESC, lower(coalesce(shown, '')), bssid, event_id) - 1 AS position FROM n""")
def network_name_order(spark, sf_dir):
    n = F.col("event_id") % 3
    named = listed(spark, sf_dir).withColumn("ssid", F.when(n == 0, F.upper("ssid")).when(n == 1, F.replace("ssid", F.lit("e"), F.lit("é"))).otherwise(F.col("ssid")))
    return networks.positions(named, "ssid_asc", "event_id").select("event_id", "position")


@query("network_suspicion_counts", f"""WITH {STORE} SELECT l.v AS suspicion_level, count(st.event_id) AS networks
FROM (VALUES ('low'), ('medium'), ('high'), ('unavailable')) l(v) LEFT JOIN st ON st.suspicion_level = l.v GROUP BY 1""")
def network_suspicion_counts(spark, sf_dir):
    return networks.suspicion_counts(listed(spark, sf_dir))


@query("history_page_totals", f"""WITH {STORE}, p AS (SELECT * FROM scan ORDER BY observed_us DESC, id DESC LIMIT 25)
SELECT sum(total_networks)::BIGINT AS observations, sum(anomaly_count)::BIGINT AS anomalies, sum(insufficient_history_count)::BIGINT AS insufficient FROM p""")
def history_page_totals(spark, sf_dir):
    return networks.page_totals(history.list_scans(database(spark, sf_dir), 25))
