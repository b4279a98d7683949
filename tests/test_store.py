import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import dashboard, history, networks
from wavelark.sources import store

T0 = datetime(2024, 1, 1)
SCORED = ("scan_id string, observed_at_utc timestamp, observation_id long, network_id string, interface_guid string, ssid string, bssid string, "
          "ssid_not_broadcast boolean, rssi_dbm long, security_type string, status string, ssid_bssid_count double, bssid_changed double, "
          "security_changed double, security_strength_delta double, context_available boolean, context_resolution string, "
          "feature_complete boolean, anomaly_score double, threshold double, is_anomaly boolean, suspicion_level string, model_version_id long")


def scored(n_scans=3):
    rows, i = [], 0
    for s in range(n_scans):
        for status, anomaly, level in (("ready", True, "high"), ("ready", False, "low"), ("insufficient_history", None, "unavailable"), ("not_available", None, "unavailable")):
            i += 1
            ready = status == "ready"
            rows.append((f"scan{s}", T0 + timedelta(hours=s), i, f"net{i % 5}", "g", "" if i % 2 else "Home", "aa", False, -50, "WPA2", status,
                         1.0, 0.0, 0.0, 0.0, ready, "ssid_hash", ready, 0.5 if ready else None, 0.2 if ready else None, anomaly, level, 1))
    return rows


MODELS = "id long, version_name string, algorithm string, threshold double, created_at_utc timestamp, active boolean"


@pytest.fixture
def db(spark, frame, tmp_path):
    models = frame([(1, "v1", "x", 0.1, T0, True), (2, "v2", "x", 0.2, T0, False)], MODELS)
    store.ingest(frame(scored(), SCORED), str(tmp_path), models=models)
    return store.read_store(spark, str(tmp_path))


def test_persist(db, frame):
    assert db["scan_session"].count() == 3 and db["network_observation"].count() == 12
    assert db["network_features"].count() == 9 and db["detection"].count() == 9
    assert db["network_observation"].where("ssid_hash is null").count() == 6
    assert "ssid" not in db["network_observation"].columns
    again = store.persist_scans(frame(scored(4), SCORED), db["scan_session"], repeated="skip")
    assert again["scan_session"].count() == 1 and again["detection"].count() == 3
    with pytest.raises(Exception, match="stored already"):
        store.persist_scans(frame(scored(4), SCORED), db["scan_session"])["scan_session"].collect()


def test_scans_without_networks(frame):
    scans = frame([("scan0", T0, 1), ("empty", T0, 2)], "scan_id string, observed_at_utc timestamp, interface_count long")
    got = {r["id"]: (r["total_networks"], r["interface_count"]) for r in store.persist_scans(frame(scored(1), SCORED), scans=scans)["scan_session"].collect()}
    assert got["empty"] == (0, 2) and set(got) == {"scan0", "empty"}


def test_numbers_told_of_every_scan_are_not_counted_in_the_rows(frame):
    whole = "scan_id string, observed_at_utc timestamp, interface_count long not null, total_networks long not null"
    told = [("scan0", T0, 2, 4), ("empty", T0, 1, 0)]
    tables = store.persist_scans(frame(scored(1), SCORED), scans=frame(told, whole))
    assert {(r["id"], r["interface_count"], r["total_networks"]) for r in tables["scan_session"].collect()} == {("scan0", 2, 4), ("empty", 1, 0)}
    assert "Aggregate" not in tables["scan_session"]._jdf.queryExecution().optimizedPlan().toString()
    # A number that is missing, or may be, is counted.
    for columns in (whole.replace(" not null", ""), whole.rsplit(",", 1)[0]):
        scans = frame([("scan0", T0, 2, None)[:columns.count(",") + 1]], columns)
        assert [(r["interface_count"], r["total_networks"]) for r in store.persist_scans(frame(scored(1), SCORED), scans=scans)["scan_session"].collect()] == [(2, 4)]


TOLD = "scan_id string, observed_at_utc timestamp, interface_count long"


def test_the_manifest_tells_what_was_written(spark, frame, tmp_path):
    """Ids that another evaluation would draw anew."""
    drawn = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    sessions = frame([(T0, None, 1, 0)] * 5, "observed_at_utc timestamp, negotiated_api_version string, interface_count long, total_networks long").select(
        drawn().alias("id"), "*", F.to_date("observed_at_utc").alias("scan_date"))
    store.append_scans({"scan_session": sessions}, str(tmp_path), "one")
    ids = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/scan_session").collect())
    done = one(store.manifest(spark, str(tmp_path)))
    assert (done["scans"], done["first_scan"], done["last_scan"]) == (5, ids[0], ids[-1])


def test_scans_the_caller_left_out_are_not_looked_for(spark, frame, tmp_path):
    store.ingest(frame(scored(1), SCORED), str(tmp_path), repeated="left out")
    later = [r for r in scored(2) if r[0] != "scan0"]
    store.ingest(frame(later, SCORED), str(tmp_path), scans=frame([("scan1", T0 + timedelta(hours=1), 1)], TOLD), repeated="left out")
    assert names(spark, str(tmp_path)) == ["scan0", "scan1"] and names(spark, str(tmp_path), "network_observation") == list(range(1, 9))


def names(spark, root, table="scan_session"):
    return sorted(r["id"] for r in store.read_store(spark, root)[table].select("id").collect())


def test_repeated_scans_are_refused_also_without_networks(spark, frame, tmp_path):
    root, none = str(tmp_path), frame(scored(0), SCORED)
    store.ingest(none, root, scans=frame([("empty", T0, 2)], TOLD))
    assert names(spark, root) == ["empty"] and names(spark, root, "network_observation") == []
    for rows, told in [(none, [("empty", T0, 2)]), (frame(scored(1), SCORED), [("scan0", T0, 1), ("empty", T0 + timedelta(minutes=1), 2)])]:
        with pytest.raises(ValueError, match="stored already"):
            store.ingest(rows, root, scans=frame(told, TOLD))
    with pytest.raises(Exception, match="stored already"):
        store.persist_scans(none, store.read_store(spark, root)["scan_session"], frame([("empty", T0, 2)], TOLD))["scan_session"].collect()
    store.ingest(frame(scored(1), SCORED), root, scans=frame([("scan0", T0, 1), ("empty", T0, 2)], TOLD), repeated="skip")
    assert names(spark, root) == ["empty", "scan0"] and names(spark, root, "detection") == [1, 2, 3]


def test_a_batch_appears_as_a_whole(spark, frame, tmp_path, monkeypatch):
    """An interrupted batch shows nothing; tried again it is written once, and once more it changes nothing."""
    root, real = str(tmp_path), store._commit
    store.ingest(frame(scored(1), SCORED), root, batch="one")
    later = frame([r for r in scored(3) if r[0] != "scan0"], SCORED)

    def killed(*a):
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_commit", killed)
    with pytest.raises(RuntimeError):
        store.ingest(later, root, batch="two")
    assert names(spark, root) == ["scan0"] and names(spark, root, "network_observation") == [1, 2, 3, 4]
    monkeypatch.setattr(store, "_commit", real)
    for _ in range(2):
        store.ingest(later, root, batch="two")
    assert names(spark, root) == ["scan0", "scan1", "scan2"] and names(spark, root, "network_observation") == list(range(1, 13))
    done = {(r["batch"], str(r["scan_date"]), r["scans"], r["observations"], r["first_id"], r["last_id"]) for r in store.manifest(spark, root).collect()}
    assert done == {("one", "2024-01-01", 1, 4, 1, 4), ("two", "2024-01-01", 2, 8, 5, 12)}


def test_observations_are_numbered_on(spark, frame, tmp_path):
    root = str(tmp_path)
    for name in ("scan0", "scan1"):
        rows = [r for r in scored(2) if r[0] == name]
        store.ingest(frame(rows, SCORED).drop("observation_id"), root)
    assert names(spark, root, "network_observation") == list(range(1, 9))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_ids_read_the_partitions_of_their_dates(spark, frame, tmp_path):
    """Four days in four batches; a page, a scan and a detection lead to the partitions of their days."""
    root = str(tmp_path)
    for day in range(4):
        rows = [(f"d{day}-{r[0]}", r[1] + timedelta(days=day), r[2] + 100 * day, *r[3:]) for r in scored()]
        store.ingest(frame(rows, SCORED), root, models=frame([(1, "v1", "x", 0.1, T0, True)], MODELS) if day == 0 else None)
    db = store.read_store(spark, root)
    # Ids that rise with the days: only one day's partition may be scanned, whatever else the tables hold.
    found = history.detection_detail(db, 205)
    assert one(found)["observation_id"] == 205 and "2024-01-03" in plan(found) and "2024-01-02" not in plan(found)
    assert one(history.scan_detail(db, "d1-scan2"))["detection_count"] == 3
    assert history.dates_of(db, "first_scan", "last_scan", "d1-scan2") == [T0.date() + timedelta(days=1)]
    assert "PartitionFilters: [isnotnull(scan_date" in plan(history.list_scans(db, 2, 0))
    assert history.detection_detail(db, 999).collect() == [] and history.scan_detail(db, "no").collect() == []


def test_model_upsert(frame):
    registry = frame([(1, "v1", "x", 0.1, T0, True), (4, "v2", "x", 0.1, T0, False)], MODELS)
    new = frame([("v3", "y", 0.3, T0 + timedelta(1)), ("v2", "y", 0.9, T0 + timedelta(2))], "version_name string, algorithm string, threshold double, created_at_utc timestamp")
    got = {r["version_name"]: (r["id"], r["threshold"], r["active"], r["created_at_utc"]) for r in store.upsert_model_version(registry, new).collect()}
    assert got["v1"] == (1, 0.1, False, T0) and got["v2"] == (4, 0.9, True, T0)
    assert got["v3"] == (5, 0.3, False, T0 + timedelta(1))


def test_scan_pages(db):
    rows = history.list_scans(db, 2, 0).collect()
    assert [r["id"] for r in rows] == ["scan2", "scan1"]
    r = rows[0]
    assert (r["total_networks"], r["feature_count"], r["detection_count"], r["anomaly_count"], r["insufficient_history_count"]) == (4, 3, 3, 1, 1)
    assert [r["id"] for r in history.list_scans(db, 2, 2).collect()] == ["scan0"]
    assert one(history.total(db["scan_session"]))["total"] == 3
    with pytest.raises(ValueError):
        history.list_scans(db, 0)
    assert one(history.scan_detail(db, "scan1"))["anomaly_count"] == 1


def test_observations_and_detections(db):
    rows = history.scan_observations(db, "scan1", 3, 1).collect()
    assert [(r["id"], r["detection_id"], r["suspicion_level"]) for r in rows] == [(6, 6, "low"), (7, 7, "unavailable"), (8, None, None)]
    found = history.list_detections(db, 10, 0, is_anomaly=True)
    assert [r["id"] for r in found.collect()] == [9, 5, 1]
    assert history.list_detections(db, 10, 0, suspicion_level="low", model_version_id=2).count() == 0
    d = one(history.detection_detail(db, 5))
    assert (d["observation_id"], d["version_name"], d["detection_count"], d["bssid_changed"]) == (5, "v1", 9, 0.0)
    assert [(r["id"], r["detection_count"]) for r in history.list_models(db).collect()] == [(1, 9), (2, 0)]
    assert one(history.get_model(db, 2))["detection_count"] == 0


def test_dashboard(db):
    r = one(dashboard.overview(db))
    assert (r["scan_count"], r["observation_count"], r["unique_network_count"], r["detection_count"]) == (3, 12, 5, 9)
    assert (r["anomaly_count"], r["normal_count"], r["insufficient_history_count"], r["model_version_count"]) == (3, 3, 3, 2)
    assert r["analysis_coverage_rate"] == 0.75 and r["anomaly_rate_among_decided"] == 0.5
    assert r["latest_scan_at_utc"] == T0 + timedelta(hours=2)
    levels = {x["suspicion_level"]: x["detections"] for x in dashboard.suspicion_distribution(db).collect()}
    assert levels == {"low": 3, "medium": 0, "high": 3, "unavailable": 3}
    assert [x["id"] for x in dashboard.trends(db, 2).collect()] == ["scan1", "scan2"]
    assert one(dashboard.active_model(db))["version_name"] == "v1"
    latest = one(dashboard.latest(db))
    assert (latest["latest_scan_network_count"], latest["latest_detection_suspicion_level"], latest["active_model"]) == (4, "unavailable", "v1")
    assert {k: v.count() for k, v in dashboard.recent(db, 2).items()} == {"scans": 2, "detections": 2, "active_model": 1}


def test_empty_store(db):
    empty = {name: df.where("1 = 0") for name, df in db.items()}
    r = one(dashboard.overview(empty))
    assert r["scan_count"] == r["observation_count"] == 0 and r["analysis_coverage_rate"] == 0.0 and r["latest_scan_at_utc"] is None
    assert one(dashboard.latest(empty))["active_model"] is None
    assert dashboard.trends(empty).count() == 0 and history.list_scans(empty).count() == 0


def test_networks(frame):
    rows = [("Home", "aa:01", "WPA2", "high", -50), (None, "aa:02", "OPEN", "low", -40), ("cafe", "bb:03", "WPA2", "unavailable", -60)]
    df = frame(rows, "ssid string, bssid string, security_type string, suspicion_level string, rssi_dbm long")

    def names(x):
        return [r["bssid"] for r in x.collect()]

    assert names(networks.search(df, " wpa2 ")) == ["aa:01", "bb:03"] and names(networks.search(df, "AA", "low")) == ["aa:02"]
    assert len(names(networks.search(df, "  "))) == 3
    assert names(networks.sort(df)) == ["aa:02", "aa:01", "bb:03"] == names(networks.sort(df, "signal_desc"))
    assert names(networks.sort(df, "signal_asc")) == ["bb:03", "aa:01", "aa:02"]
    assert names(networks.sort(df, "ssid_asc")) == ["bb:03", "aa:01", "aa:02"]
    assert names(networks.sort(df, "suspicion_desc")) == ["aa:01", "bb:03", "aa:02"]
    assert {r[0]: r[1] for r in networks.suspicion_counts(df).collect()} == {"high": 1, "medium": 0, "unavailable": 1, "low": 1}


def test_a_large_scan_lies_in_several_ranges(spark, frame):
    rows = frame([("scan0", T0, i, f"net{i}") for i in range(4000)], "scan_id string, observed_at_utc timestamp, observation_id long, network_id string")
    dated = rows.selectExpr("*", "to_date(observed_at_utc) AS scan_date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = store._clustered(dated, "scan_id", "observation_id")
        sizes = [n for n in spread.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 3000


def test_only_columns_of_the_tables_are_ordered(spark, frame, tmp_path):
    rows = frame(scored(), SCORED).selectExpr("*", "'unread' AS ssid_hash", "'unread' AS bssid_hash", "'unread' AS context_ssid_hash")
    assert set(rows.columns) - set(store._needed(rows).columns) == {"ssid_hash", "bssid_hash", "context_ssid_hash"}
    store.ingest(rows, str(tmp_path))
    db = store.read_store(spark, str(tmp_path))
    assert db["network_observation"].count() == 12 and db["network_observation"].where("bssid_hash = 'unread'").count() == 0
