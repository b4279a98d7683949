import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import elements, normalize, profiling, scan_flatten
from wavelark.schema import CANONICAL_COLUMNS, CONTROLLED_COLUMNS, DESKTOP_COLUMNS
from wavelark.sources import aligned, captures, scans, tables

BEACON_HEADER = ("Timestamp_ms,SSID,BSSID,RSSI,Channel,DSChannel,HTChannelWidth,BeaconInterval,BeaconTimestamp,Encryption,Privacy,HasHT,"
                 "SequenceNumber,VendorName,OUI,CountryCode,IsHidden,FrameLength,is_rogue,_rogue_type")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_beacon_sessions(spark, tmp_path):
    for n in (1, 2):
        write(f"{tmp_path}/session_{n}/part.csv", f"{BEACON_HEADER}\n10,Home,aa:bb,-50,6,0,20,100,77,wpa2,1,0,x,V,O,BE,0,200,0,\n")
    rows = captures.read_normal_beacons(spark, str(tmp_path))
    assert rows.columns == CANONICAL_COLUMNS
    assert sorted(r["session_id"] for r in rows.collect()) == ["session_1", "session_2"]
    r = rows.first()
    assert r["advertised_channel"] is None and r["frequency_mhz"] == 2437.0 and round(r["beacon_interval_ms"], 6) == 102.4
    assert r["security_type"] == "WPA2" and r["privacy_enabled"] is True and r["has_ht"] is False and r["sequence_number"] is None
    assert r["label"] == 0 and r["attack_type"] is None


def test_labelled_rogue(spark, tmp_path):
    row = "10,Home,aa:bb,-50,6,6,20,100,77,OPEN,0,0,5,V,O,BE,0,200"
    write(f"{tmp_path}/rogue.csv", f"{BEACON_HEADER}\n{row},1,evil\n{row},0,\n{row},bad,x\n")
    r = one(captures.read_labelled_rogue(spark, f"{tmp_path}/rogue.csv"))
    assert (r["label"], r["attack_type"], r["is_synthetic"], r["session_id"]) == (1, "evil", True, "synthetic_rogue")
    untyped = captures.labelled_rogue(spark.read.option("header", True).csv(f"{tmp_path}/rogue.csv").drop("_rogue_type"))
    assert one(untyped)["attack_type"] == "rogue"


AGG = "traceNr string, systime string, senderId string, meanBeaconRssi string, rssiMean string, wifiType string, channelFreq string, channelBw string, channelUtil string, meanInterBeaconTime string, nBeacons string, nrClients string"


def test_aggregates(frame):
    rows = [("401", "100.5", "ap-n", "-100", "-60", "n", "2437", "20", "-1", "1.0", "9", "2"),
            ("401", "99.5", "ap-n", "-55", "-60", "n", "2437", "20", "12", "0.1", "9", "2"),
            ("12", "7", "ap-d", "-55", "-60", "ad", "60480", "2160", "12", "0.1", "9", "2")]
    got = {r["elapsed_ms"]: r for r in normalize.normalize_aggregates(frame(rows, AGG)).where("wifi_standard = '802.11n'").collect()}
    assert set(got) == {0.0, 1000.0}
    lost = got[1000.0]
    assert lost["rssi_dbm"] is None and lost["measured_inter_beacon_ms"] is None and lost["channel_utilization_pct"] is None
    assert lost["channel"] == 6 and lost["channel_utilization_estimated"] and lost["session_id"] == "trace_401"
    sizes = {k: v.count() for k, v in normalize.aggregate_profiles(normalize.normalize_aggregates(frame(rows, AGG))).items()}
    assert sizes == {"all_normal": 3, "beacon_profile": 1, "desktop_aux": 2, "ad_aux": 1}
    profile = {r["wifi_standard"]: r["valid_both"] for r in profiling.profile_aggregates(frame(rows, AGG)).collect()}
    assert profile == {"802.11n": 1, "802.11ac": 0, "802.11ad": 1}


FRAMES = "Timestamp string, type string, MAC_timestamp string, rssi string, addr1 string, addr2 string, addr3 string, SSID string"


def test_frames(frame):
    rows = [("2.0", "Dot11Beacon", "1", "-40", "FF", "AA", None, "b'NETWORK_1'"), ("1.0", "Dot11ProbeResp", "1", "-50", "FF", "AA", "CC", "b''"),
            ("1.5", "Dot11ProbeReq", "1", "-60", "FF", "AA", "CC", "b'x'"), ("1.5", "Dot11Auth", "1", None, "FF", "AA", "CC", None)]
    df = normalize.normalize_frames(frame(rows, FRAMES), "capture_1")
    got = {r["frame_type"]: r for r in df.collect()}
    assert got["beacon"]["bssid"] == "aa" and got["beacon"]["ssid"] == "NETWORK_1" and got["beacon"]["elapsed_ms"] == 1000.0
    assert got["probe_response"]["bssid"] == "cc" and got["probe_response"]["ssid"] is None
    assert got["probe_request"]["bssid"] is None and got["dot11auth"]["beacon_count"] == 0
    assert {k: v.count() for k, v in normalize.frame_profiles(df).items()} == {
        "beacons": 1, "probe_responses": 1, "probe_requests": 1, "ap_frames": 2}
    total = {r["session_id"]: r for r in normalize.frame_summary(df).collect()}[None]
    assert (total["frames"], total["violations"], total["rssi_min_dbm"]) == (4, 0, -60.0)
    p = one(profiling.profile_frames(frame(rows, FRAMES)))
    assert (p["frames"], p["beacons"], p["unique_bssid_field_values"], p["unique_ssid_values"]) == (4, 1, 1, 3)


def fingerprint_root(tmp_path, times="20240101000000000\n20240101000001500\n"):
    base = f"{tmp_path}/data/mon_devices/d1"
    write(f"{base}/timestamps.csv", times)
    write(f"{base}/coordinates.csv", "1.0,2.0,3.0\n1.0,2.0,3.0\n")
    write(f"{base}/rssis.csv", "ap1:-50,ap2:-60\nap1:-55\n")
    write(f"{base}/channels.csv", "ap1:6\n\n")
    base = f"{tmp_path}/data/site_surveys/d2"
    write(f"{base}/timestamps.csv", "\n")
    write(f"{base}/coordinates.csv", "1.0000001,2.0,\n")
    write(f"{base}/rssis.csv", "ap9:-40\n")
    write(f"{base}/channels.csv", "ap9:36\n")
    write(f"{tmp_path}/data/mds_info.csv", "m0,1,2,3\nm1,1.0,2.0,3.001\nshort,1\n")
    write(f"{tmp_path}/data/coords_info.csv", "7,1,2\n8,x,2\n")
    return str(tmp_path)


def test_fingerprints(spark, tmp_path):
    root = fingerprint_root(tmp_path)
    samples = aligned.read_aligned_sessions(spark, root)
    assert samples.count() == 3
    assert aligned.read_aligned_sessions(spark, root, "mon_devices").count() == 2
    rows = normalize.locate(normalize.normalize_fingerprints(samples), aligned.read_monitor_points(spark, f"{root}/data/mds_info.csv"),
                            aligned.read_reference_points(spark, f"{root}/data/coords_info.csv"))
    got = {(r["session_id"], r["ap_id"], r["elapsed_ms"]): r for r in rows.collect()}
    assert set(got) == {("monitoring_device_d1", "ap1", 0.0), ("monitoring_device_d1", "ap2", 0.0),
                        ("monitoring_device_d1", "ap1", 1500.0), ("site_survey_d2", "ap9", None)}
    first = got[("monitoring_device_d1", "ap1", 0.0)]
    assert (first["channel"], first["frequency_mhz"], first["collector_id"], first["location_id"]) == (6, 2437.0, "m1", "monitor_m1")
    assert got[("monitoring_device_d1", "ap1", 1500.0)]["channel"] is None
    assert got[("site_survey_d2", "ap9", None)]["location_id"] == "rp_7"
    s = one(normalize.fingerprint_summary(normalize.parse_samples(samples)))
    assert (s["sessions"], s["samples"], s["observations"], s["unique_aps"], s["missing_channel"]) == (2, 3, 4, 3, 2)
    assert [(r["channel"], r["observations"]) for r in profiling.common_channels(normalize.parse_samples(samples)).collect()] == [(6, 1), (36, 1)]


def test_unequal_files_fail(spark, tmp_path):
    root = fingerprint_root(tmp_path, "20240101000000000\n")
    with pytest.raises(Exception, match="different length"):
        aligned.read_aligned_sessions(spark, root).collect()


def test_lines_are_numbered_across_splits(spark, tmp_path):
    write(f"{tmp_path}/a.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = aligned.read_numbered_lines(spark, f"{tmp_path}/a.txt")
        assert spark.read.text(f"{tmp_path}/a.txt").rdd.getNumPartitions() > 1
        assert all(r["value"] == f"line {r['line']}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


DOCUMENT = """{"scan_index": 0, "captured_at_utc": "2024-01-01T00:00:00Z", "session_id": "s", "interfaces": [{"interface": {"guid": "g"}, "bss_entries": [
{"ssid_hash": "a", "bssid_hash": "%s", "rssi_dbm": -50, "tsf_us": 5, "observation_label": %d, "is_attack_target": %s, "native": {"phy_id": 1}},
{"bssid_hash": "n", "observation_label": 0, "is_attack_target": false}]}]}""".replace("\n", "")


def test_scan_documents(spark, frame, tmp_path):
    write(f"{tmp_path}/s.jsonl", DOCUMENT % ("t", 1, "true") + "\n\n" + '{"scan_index": 1, "interfaces": []}\n')
    docs = scans.read_scan_jsonl(spark, f"{tmp_path}/s.jsonl")
    assert docs.count() == 2
    rows = scan_flatten.flatten_scans(docs, "s", "home")
    assert rows.columns == DESKTOP_COLUMNS and len(DESKTOP_COLUMNS) == 30
    assert sorted(r["bssid_hash"] for r in rows.collect()) == ["n", "t"]
    manifest = frame([("s", "lab", "evil", "t", 1)], "session_id string, environment string, attack_type string, target_bssid_hash string, matched_observation_count long")
    controlled = scan_flatten.flatten_controlled(docs, manifest)
    assert controlled.columns == CONTROLLED_COLUMNS and len(CONTROLLED_COLUMNS) == 32
    assert {r["bssid_hash"]: r["label"] for r in controlled.collect()} == {"t": 1, "n": 0}
    assert not one(scan_flatten.controlled_violations(controlled, manifest))["count_differs"]
    for bssid, label, target in (("t", 0, "true"), ("other", 1, "true"), ("t", 0, "false")):
        write(f"{tmp_path}/bad.jsonl", DOCUMENT % (bssid, label, target) + "\n")
        with pytest.raises(Exception, match="disagree|differs"):
            scan_flatten.flatten_controlled(scans.read_scan_jsonl(spark, f"{tmp_path}/bad.jsonl"), manifest).collect()
    with pytest.raises(Exception, match="without a manifest"):
        scan_flatten.flatten_controlled(docs, manifest.where("session_id <> 's'")).collect()
    with pytest.raises(Exception, match="number of target rows"):
        scan_flatten.flatten_controlled(docs, manifest.withColumn("matched_observation_count", F.lit(3))).collect()
    absent = manifest.unionByName(frame([("gone", "lab", "evil", "t", 2), ("quiet", "lab", "evil", "t", 0)], manifest.schema))
    with pytest.raises(Exception, match="no observation"):
        scan_flatten.flatten_controlled(docs, absent).collect()
    assert scan_flatten.flatten_controlled(docs, absent.where("session_id <> 'gone'")).count() == 2
    write(f"{tmp_path}/broken.jsonl", '{"scan_index": \n')
    with pytest.raises(ValueError, match="malformed.*broken.jsonl line 1$"):
        scans.read_scan_jsonl(spark, f"{tmp_path}/broken.jsonl")
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.read_scan_jsonl(spark, f"{tmp_path}/broken.jsonl", located=False).collect()
    write(f"{tmp_path}/null.jsonl", '{"session_id": "s", "interfaces": [{"bss_entries": [{"rssi_dbm": 1}]}]}\n')
    with pytest.raises(Exception, match="NULL in bssid_hash"):
        scan_flatten.flatten_scans(scans.read_scan_jsonl(spark, f"{tmp_path}/null.jsonl"), "s", "x").collect()


RSN = "0100000FAC040100000FAC040100000FAC{:02X}0000"


def tlv(number, payload):
    return f"{number:02X}{len(payload) // 2:02X}{payload}"


@pytest.mark.parametrize("blob, capability, kind, source, channel, truncated", [
    (tlv(0, "41") + tlv(48, RSN.format(2)), 0x10, "WPA2_OR_NEWER", "rsn_ie", None, False),
    (tlv(48, RSN.format(8)), 0, "WPA3_SAE", "rsn_ie", None, False),
    (tlv(48, RSN.format(9)) + tlv(221, "0050F20101"), 0, "WPA3_SAE", "rsn_ie", None, False),
    (tlv(48, RSN.format(8)[:-12]), 0, "WPA2_OR_NEWER", "rsn_ie", None, False),
    (tlv(48, "0100"), 0, "WPA2_OR_NEWER", "rsn_ie", None, False),
    (tlv(48, "0100000FAC04FFFF"), 0, "WPA2_OR_NEWER", "rsn_ie", None, False),
    (tlv(221, "0050F20101"), 0x10, "WPA", "wpa_vendor_ie", None, False),
    (tlv(3, "00") + tlv(3, "0102") + tlv(3, "0B"), 0x10, "LEGACY_PRIVACY", "capability_privacy_bit", 11, False),
    ("", 0, "OPEN", "capability_privacy_bit", None, False),
    ("03", 0, "OPEN", "capability_privacy_bit", None, True),
    (tlv(3, "06") + "30FF01", 0, "OPEN", "capability_privacy_bit", 6, True),
])
def test_security_posture(frame, blob, capability, kind, source, channel, truncated):
    df = frame([(1, bytearray(bytes.fromhex(blob)), capability)], "capture_id long, ie_blob binary, capability_info int")
    r = one(elements.security_posture(df))
    assert (r["security_type"], r["security_source"], r["ds_parameter_channel"], r["truncated"]) == (kind, source, channel, truncated)
    assert r["security_strength"] == elements.STRENGTH[kind]


def test_broken_lines_are_located_over_splits(spark, tmp_path):
    """Lines are numbered through all splits of a file, blank lines included."""
    good = '{"session_id": "s", "scan_index": 1, "interfaces": []}'
    for name, broken in (("a", {4, 900}), ("b", {1500})):
        lines = ["{not json" if i in broken else "" if i % 50 == 7 else good for i in range(1, 2001)]
        write(f"{tmp_path}/scans/{name}.jsonl", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = [(os.path.basename(r["file"]), r["line"]) for r in scans.broken_lines(spark, f"{tmp_path}/scans").orderBy("file", "line").collect()]
        assert spark.read.text(f"{tmp_path}/scans").rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.jsonl", 4), ("a.jsonl", 900), ("b.jsonl", 1500)]
    with pytest.raises(ValueError, match="a.jsonl line 4, .*a.jsonl line 900, .*b.jsonl line 1500"):
        scans.read_scan_jsonl(spark, f"{tmp_path}/scans")


def test_walk_equals_a_plain_reading(frame):
    """Random blobs, cut anywhere; empty and missing ones; elements without a payload; slices of a column."""
    rng = random.Random(5)
    blobs = [None, b"", b"\x00", b"\x03\x00", b"\x03\x05ab"]
    for _ in range(300):
        blob = b"".join(bytes([rng.choice([0, 3, 48, 221]), n]) + rng.randbytes(n) for n in [rng.choice([0, 0, 1, 4, 30, 255]) for _ in range(rng.randrange(9))])
        blobs.append(blob[:rng.randrange(len(blob) + 1)] if rng.random() < 0.5 else blob)

    def plain(blob):
        out, at, blob = [], 0, blob or b""
        while at + 2 <= len(blob) and at + 2 + blob[at + 1] <= len(blob):
            out.append((blob[at], blob[at + 2:at + 2 + blob[at + 1]]))
            at += 2 + blob[at + 1]
        return out, at < len(blob)

    rows = elements.with_elements(frame(list(enumerate(blobs)), "capture_id long, ie_blob binary")).collect()
    assert {r["capture_id"]: ([(e["element_id"], bytes(e["data"])) for e in r["elements"]], r["truncated"]) for r in rows} == dict(enumerate(map(plain, blobs)))
    part = pa.array(blobs, pa.binary()).slice(7, 50)
    blob, kind, begin, end, _ = elements.walk_elements(part)
    data, _ = elements.buffer_of(part)
    assert [(b, k, data[x:y].tobytes()) for b, k, x, y in zip(blob, kind, begin, end)] == [
        (i, k, d) for i, own in enumerate(blobs[7:57]) for k, d in plain(own)[0]]


def test_elements_in_order(frame):
    df = frame([(1, bytearray.fromhex("0001410300"), 0), (2, None, 0)], "capture_id long, ie_blob binary, capability_info int")
    got = [(r["capture_id"], r["position"], r["element_id"], r["data"]) for r in elements.explode_elements(df).orderBy("capture_id", "position").collect()]
    assert got == [(1, 0, 0, b"A"), (1, 1, 3, b""), (2, None, None, None)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    for fmt, path in (("parquet", f"{tmp_path}/t.parquet"), ("csv.gz", f"{tmp_path}/t.csv.gz")):
        tables.write_once(df, path, fmt)
        assert sorted(map(tuple, tables.read_table(spark, path, df.schema).collect())) == [(1, "x"), (2, None)]
        with pytest.raises(Exception, match="(?i)already exists"):
            tables.write_once(df, path, fmt)
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_a_large_controlled_session_is_not_sent_to_one_task(spark, frame, tmp_path):
    write(f"{tmp_path}/s.jsonl", "".join(DOCUMENT % (f"t{i % 2}", 1 - i % 2, "false" if i % 2 else "true") + "\n" for i in range(40)))
    manifest = frame([("s", "lab", "evil", "t0", 20), ("quiet", "lab", "evil", "t0", 0)],
                     "session_id string, environment string, attack_type string, target_bssid_hash string, matched_observation_count long")
    rows = scan_flatten.flatten_controlled(scans.read_scan_jsonl(spark, f"{tmp_path}/s.jsonl"), manifest)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "FullOuter" not in plan
    assert rows.count() == 80 and rows.where("label = 1").count() == 20
