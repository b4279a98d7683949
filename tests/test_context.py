import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import channels, context, tsf

ROW = ("source_dataset string, session_id string, elapsed_ms double, ssid string, bssid string, channel long, security_type string, "
       "configured_beacon_interval_ms double, is_hidden boolean, label long, attack_type string, is_synthetic boolean")
HOME = "00:11:22:33:44:55"


def row(ssid="Home", bssid=HOME, channel=6, security="WPA2", hidden=False, interval=102.4):
    return ("mendeley_rogue_ap", "s", 0.0, ssid, bssid, channel, security, interval, hidden, 0, None, False)


def test_changed_row(frame):
    ref = context.build_reference(frame([row()], ROW))
    got = one(context.transform_contextual(frame([row(bssid="00:11:22:33:44:99", channel=11, security="OPEN")], ROW), ref))
    assert (got["bssid_changed"], got["channel_changed"], got["security_changed"]) == (1.0, 1.0, 1.0)
    assert got["security_strength_delta"] == -3.0 and got["ssid_bssid_count"] == 1.0
    assert got["feature_complete"] and got["context_resolution"] == "ssid"
    assert "ssid" not in got.asDict() and "bssid" not in got.asDict()


def test_hidden_row_resolves_by_bssid(frame):
    ref = context.build_reference(frame([row()], ROW))
    got = one(context.transform_contextual(frame([row(ssid=None, hidden=True)], ROW), ref))
    assert got["context_resolution"] == "bssid_fallback" and got["bssid_changed"] == 0.0
    assert got["is_hidden"] == 1.0 and got["ssid_missing"] == 1.0


def test_unknown_and_ambiguous_stay_unknown(frame):
    ref = context.build_reference(frame([row(), row(ssid="Cafe")], ROW))
    both = context.transform_contextual(frame([row(ssid=None), row(ssid="Other", bssid="00:00:00:00:00:01")], ROW), ref).collect()
    assert [r["context_resolution"] for r in both] == ["none", "none"]
    assert all(r["bssid_changed"] is None and not r["feature_complete"] for r in both)


def test_orphans_add_channels_but_no_observations(frame):
    rows = [row(), row(ssid=None, channel=11, security="WPA3", interval=51.2)]
    p = one(context.build_reference(frame(rows, ROW)).profiles)
    assert p["channels"] == [6, 11] and p["security_types"] == ["WPA2", "WPA3"]
    assert p["observations"] == 1 and p["security_rank_median"] == 3.5
    assert p["configured_beacon_interval_median_ms"] == 102.4


def test_ssid_without_bssid_reports_change(frame):
    ref = context.build_reference(frame([row(bssid=None)], ROW))
    got = one(context.transform_contextual(frame([row()], ROW), ref))
    assert got["bssid_changed"] == 1.0 and got["ssid_bssid_count"] == 0.0


def test_one_row_out_per_row_in(frame):
    rows = [row(ssid=s, bssid=b) for s in ("Home", "Cafe", None, " ") for b in (HOME, "x", None)]
    ref = context.build_reference(frame(rows, ROW))
    assert context.transform_contextual(frame(rows, ROW), ref).count() == len(rows)


def test_core_selection_fails_on_null(frame):
    good = frame([(1.0, 0.0, 0.0, 0.0, 1.0)], "ssid_bssid_count double, bssid_changed double, security_changed double, security_strength_delta double, is_hidden double")
    assert context.select_core_v2(good).count() == 1
    bad = frame([(1.0, None, 0.0, 0.0, 1.0)], "ssid_bssid_count double, bssid_changed double, security_changed double, security_strength_delta double, is_hidden double")
    with pytest.raises(SparkRuntimeException, match="bssid_changed"):
        context.select_core_v2(bad).collect()


DESK = "session_id string, ssid_hash string, bssid_hash string, security_type string, security_strength double"


def test_desktop_reference_and_features(frame):
    ref = context.freeze(context.build_desktop_reference(frame(
        [("r", "S", "B1", "WPA2", 3.0), ("r", "S", "B2", "WPA2", 3.0), ("r", "S", None, "OPEN", 0.0)], DESK)))
    p = one(ref.profiles)
    assert p["bssid_count"] == 2 and p["security_types"] == ["WPA2"] and p["reference_rows"] == 2
    rows = frame([("x", "S", "B9", "OPEN", 0.0), ("x", None, "B1", "WPA2", 3.0), ("x", "Q", "B9", "WPA2", 3.0), ("x", "S", None, "WPA2", None)], DESK)
    got = context.transform_desktop(rows, ref).collect()
    assert [r["context_resolution"] for r in got] == ["ssid_hash", "bssid_fallback", "unresolved", "ssid_hash"]
    assert (got[0]["bssid_changed"], got[0]["security_changed"], got[0]["security_strength_delta"]) == (1.0, 1.0, -3.0)
    assert got[1]["bssid_changed"] == 0.0 and got[1]["ssid_bssid_count"] == 2.0
    assert got[2]["ssid_bssid_count"] is None and not got[2]["feature_complete"]
    assert got[3]["bssid_changed"] is None and not got[3]["feature_complete"]
    c = one(context.coverage(context.transform_desktop(rows, ref), by="session_id"))
    assert (c["rows"], c["eligible"], c["context_unavailable"], c["eligible_rate"]) == (4, 2, 1, 0.5)


def test_advertised_channels(frame):
    schema = "ssid string, bssid string, channel long, advertised_channel long, event_id long"
    ref = channels.build_channel_reference(frame([("A", "b1", 6, 6, 0), ("N", "b2", 6, 0, 1), (None, "b1", 1, 11, 2)], schema))
    rows = frame([("A", "b1", 1, 6, 0), ("A", "b1", 6, 3, 1), ("N", "b2", 6, 6, 2), ("A", "b1", 6, -1, 3), (None, "b1", 6, 11, 4)], schema)
    got = {r["event_id"]: (r["capture_advertised_mismatch"], r["advertised_channel_changed"]) for r in channels.transform_channels(rows, ref).collect()}
    assert got == {0: (1.0, 0.0), 1: (1.0, 1.0), 2: (0.0, None), 3: (None, None), 4: (1.0, 0.0)}


def test_counter_reference_is_scoped_to_session(frame):
    schema = "session_id string, bssid string, beacon_timestamp_us double"
    ref = tsf.build_tsf_reference(frame([("s", "aa", 1000.0), ("s", "AA ", 2000.0)], schema))
    r = one(ref)
    assert (r["count"], r["min_tsf_us"], r["max_tsf_us"], r["median_tsf_us"]) == (2, 1000.0, 2000.0, 1500.0)
    got = tsf.transform_tsf(frame([("s", "aa", 3000.0), ("s", "aa", 500.0), ("t", "aa", 500.0)], schema), ref).collect()
    assert [g["tsf_reference_monotonic_violation"] for g in got] == [0.0, 1.0, None]
    assert [g["tsf_delta_from_reference_max_ms"] for g in got] == [1.0, -1.5, None]
    assert [g["tsf_reference_available"] for g in got] == [True, True, False]


@pytest.fixture
def no_broadcast(spark):
    """A reference above the broadcast limit, and joins as they are without help at run time."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_large_reference_with_missing_and_heavy_keys(spark, no_broadcast):
    """Nine rows in ten have no SSID, half of the rest share one, and one BSSID is everywhere."""
    ref = context.freeze(context.build_desktop_reference(spark.range(3000).selectExpr(
        "concat('s', id % 300) AS ssid_hash", "concat('b', id % 1500) AS bssid_hash", "CASE WHEN id % 3 = 0 THEN 'WPA' ELSE 'WPA2' END AS security_type",
        "id % 4 AS security_strength", "'r' AS session_id")))
    rows = spark.range(20_000).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN NULL WHEN id % 20 = 0 THEN 's7' ELSE concat('s', id % 4000) END AS ssid_hash",
        "CASE WHEN id % 3 = 0 THEN 'b11' WHEN id % 3 = 1 THEN NULL ELSE concat('b', id % 2000) END AS bssid_hash", "'WPA' AS security_type", "2 AS security_strength")
    assert not context._small(ref.profiles)
    assert context.heavy_keys(rows, "ssid_hash") == ["s7"] and context.heavy_keys(rows, "bssid_hash") == ["b11"]
    spread = context.transform_desktop(rows, ref)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    got = sorted(map(str, spread.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert context._small(ref.profiles, ref.owners, ref.members)
    assert got == sorted(map(str, context.transform_desktop(rows, ref).collect()))
    # What one partition of the join gets: even shares of the rows without a key and of the heavy ones.
    salt = F.when(F.col("ssid_hash").isNull() | (F.col("ssid_hash") == "s7"), F.pmod(F.monotonically_increasing_id(), F.lit(context.SPREAD))).otherwise(F.lit(0))
    dealt = rows.withColumns({"k": F.coalesce("ssid_hash", F.lit("")), "salt": salt.cast("int")}).repartition(16, "salt", "k")
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
