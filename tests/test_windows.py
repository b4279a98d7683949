import numpy as np
import pandas as pd
import pytest

from tests.conftest import one
from wavelark.operators import quality, windows

BEACON = ("source_dataset string, session_id string, elapsed_ms double, bssid string, rssi_dbm double, channel long, "
          "advertised_channel long, configured_beacon_interval_ms double, security_type string, label long, "
          "attack_type string, is_synthetic boolean, event_id long")


def beacon(elapsed, rssi, bssid="AA", event_id=0, **more):
    row = dict(source_dataset="s", session_id="x", elapsed_ms=elapsed, bssid=bssid, rssi_dbm=rssi, channel=6,
               advertised_channel=6, configured_beacon_interval_ms=102.4, security_type="WPA2", label=0,
               attack_type=None, is_synthetic=False, event_id=event_id)
    row.update(more)
    return row


def test_one_second_windows(frame):
    rows = [beacon(t, r, event_id=i) for i, (t, r) in enumerate([(100.0, -60.0), (200.0, -62.0), (1100.0, -65.0), (1200.0, -63.0)])]
    got = windows.beacon_profile(frame(rows, BEACON)).orderBy("window_start_ms").collect()
    assert len(got) == 2
    assert got[0]["rssi_mean_dbm"] == -61.0 and got[0]["beacon_count"] == 2
    assert got[0]["observed_inter_beacon_ms"] == 100.0 and got[0]["inter_beacon_sample_count"] == 1
    assert got[0]["frequency_mhz"] == 2437.0 and got[0]["wifi_band"] == "2.4GHz"
    # The gap that enters the second window counts there: (900 + 100) / 2.
    assert got[1]["observed_inter_beacon_ms"] == 500.0 and got[1]["inter_beacon_sample_count"] == 2


def brute_profile(rows):
    """Gap by gap, the slow way."""
    df = pd.DataFrame(rows)
    df["att"] = df["attack_type"].fillna("")
    df["b"] = df["bssid"].fillna(windows.MISSING_BSSID)
    keys = ["source_dataset", "session_id", "att", "b"]
    df = df.sort_values([*keys, "elapsed_ms", "event_id"], na_position="last")
    df["gap"] = df.groupby(keys)["elapsed_ms"].diff()
    df["w"] = np.floor(df["elapsed_ms"] / 1000) * 1000
    out = df.groupby([*keys, "w"], dropna=False).agg(
        m=("rssi_dbm", "mean"), n=("rssi_dbm", "size"), g=("gap", "mean"), c=("gap", "count"), s=("security_type", "first"))
    return out[out["m"].notna()].reset_index()


def test_profile_matches_brute_force(frame):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        rows.append(beacon(
            None if i % 97 == 0 else float(rng.integers(0, 40_000)), None if i % 13 == 0 else float(-rng.integers(20, 90)),
            bssid=[None, "A", "B"][rng.integers(0, 3)], event_id=i, security_type=[None, "WPA", "WPA2"][rng.integers(0, 3)],
            attack_type=[None, None, "evil"][rng.integers(0, 3)]))
    want = brute_profile(rows)
    df = frame(rows, BEACON).repartition(7)
    for blocks in (3600, 2):
        got = windows.beacon_profile(df, block_windows=blocks).toPandas()
        assert len(got) == len(want)

        def key(d, g, c, m, s, w):
            return sorted((str(a), b, round(x, 9), str(y), -1.0 if pd.isna(z) else z)
                          for a, b, x, y, z in zip(d[g].round(6).where(d[g].notna(), -1.0), d[c], d[m], d[s].where(d[s].notna(), None), d[w]))
        assert key(got, "observed_inter_beacon_ms", "inter_beacon_sample_count", "rssi_mean_dbm", "security_type", "window_start_ms") == \
            key(want, "g", "c", "m", "s", "w")


def test_gap_blocks_do_not_matter(spark, frame):
    rows = [beacon(float(t), -50.0, event_id=i) for i, t in enumerate([5, 5, 130_000, 7, 61_000, 900_000])]
    df = frame(rows, BEACON)
    found = []
    for ranges in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        found.append({r["event_id"]: r["inter_beacon_ms"] for r in windows.inter_beacon_gap(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    wide, narrow = found
    assert wide == narrow == {0: None, 1: 0.0, 3: 2.0, 4: 60_993.0, 2: 69_000.0, 5: 770_000.0}


def test_preaggregated_and_temporal(frame):
    rows = [dict(source_dataset="v", session_id="t", elapsed_ms=1000.0 * i, ap_id="ap", rssi_dbm=r, frequency_mhz=2437.0, channel=6,
                 beacon_count=9, measured_inter_beacon_ms=100.0, wifi_standard="802.11n", label=0, attack_type=None, is_synthetic=False)
            for i, r in enumerate([-50.0, -52.0, -51.0, -55.0, -54.0])]
    profile = windows.aggregate_profile(frame(rows, (
        "source_dataset string, session_id string, elapsed_ms double, ap_id string, rssi_dbm double, frequency_mhz double, channel long, "
        "beacon_count long, measured_inter_beacon_ms double, wifi_standard string, label long, attack_type string, is_synthetic boolean")))
    assert profile.count() == 5
    block = one(windows.rssi_temporal(profile))
    assert block["window_count"] == 5 and round(block["rssi_mean_dbm"], 9) == -52.4
    assert block["rssi_delta_db"] == -4.0 and round(block["rssi_std_db"], 9) == round(np.std([-50, -52, -51, -55, -54]), 9)


def test_quality_flags(frame):
    columns = "rssi_mean_dbm double, rssi_min_dbm double, rssi_max_dbm double, rssi_std_db double, rssi_delta_db double, window_count long"
    df = frame([(-60.0, -62.0, -58.0, 1.0, 2.0, 3), (-200.0, -200.0, -200.0, 0.0, 0.0, 3), (-60.0, -62.0, -58.0, 1.0, 2.0, 1),
                (None, None, None, None, None, None)], columns)
    assert [r["q_temporal_rich"] for r in quality.temporal_flags(df).collect()] == [True, False, False, False]
    assert quality.filter_temporal_rich(df).count() == 1
    summary = one(quality.quality_summary(quality.temporal_flags(df), ["q_temporal_rich", "absent"]))
    assert (summary["passed"], summary["failed"], summary["pass_rate"]) == (1, 3, 0.25)


def test_missing_columns_are_named(frame):
    with pytest.raises(ValueError, match="rssi_dbm"):
        windows.beacon_profile(frame([("s",)], "source_dataset string"))
