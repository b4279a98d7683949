from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import evaluation, integrity, scan_validation

ROW = ("source_dataset string, session_id string, environment string, captured_at_utc timestamp, scan_index long, ssid_hash string, "
       "bssid_hash string, security_type string, security_strength long, label long, attack_type string, is_synthetic boolean")
A, B = "a" * 64, "b" * 64


def row(session="s1", environment="home", bssid=B, label=0, minute=0, scan=0, **more):
    r = dict(source_dataset="own_windows", session_id=session, environment=environment, captured_at_utc=datetime(2024, 1, 1, 0, minute),
             scan_index=scan, ssid_hash=A, bssid_hash=bssid, security_type="WPA2", security_strength=3, label=label, attack_type=None,
             is_synthetic=False)
    r.update(more)
    return r


def manifest(frame, *names, **more):
    rows = [dict(session_id=n, scan_count=3, runtime_ready=True, **more) for n in names]
    return frame(rows, "session_id string, scan_count long, runtime_ready boolean")


def blockers(frame, rows, manifests):
    return {r["session_id"]: r["blockers"] for r in integrity.preflight(frame(rows, ROW), manifests).collect()}


def test_clean_and_faulty_sessions(frame):
    rows = [row("ok"), row("label", label=1, minute=1), row("hash", bssid="xyz", minute=2), row("places", minute=3),
            row("places", environment="lab", minute=4), row("void", environment=" ", bssid=None, minute=5)]
    got = blockers(frame, rows, manifest(frame, "ok", "label", "hash", "places", "void", "empty"))
    assert got["ok"] == []
    assert got["label"] == ["row_label_not_zero"]
    assert got["hash"] == ["bssid_hash_not_sha256"]
    assert got["places"] == ["multiple_environments_in_session"]
    assert got["void"] == ["bssid_hash_coverage_below_099", "desktop_candidate_completeness_below_070", "environment_missing"]
    assert "empty_session" in got["empty"]


def test_warnings_and_foreign_rows(frame):
    rows = [row("a"), row("b", minute=1, captured_at_utc=None), row("c", minute=2), row("c", minute=3)]
    df = frame(rows, ROW).withColumn("folder", F.when(F.col("session_id") == "c", "d").otherwise(F.col("session_id")))
    got = {r["session_id"]: r for r in integrity.preflight(df, manifest(frame, "a", "b", "d"), folder="folder").collect()}
    assert (got["a"]["warnings"], got["b"]["warnings"]) == ([], ["captured_at_utc_unavailable"])
    assert got["a"]["blockers"] == [] and got["d"]["blockers"] == ["row_session_id_mismatch"]


def test_status_tells_environment_blockers_and_overlap(frame):
    rows = [r for i, s in enumerate("abcde") for r in (row(s, minute=10 * i, scan=i), row(s, minute=10 * i + (12 if s == "b" else 5), scan=i))]
    rows += [row("x", label=1, minute=59, environment="lab")]
    checked = integrity.preflight(frame(rows, ROW), manifest(frame, *"abcdex"))
    covered = frame([("a", False), ("b", True), ("c", False)], "split string, below_minimum boolean")
    r = one(integrity.preflight_status(checked, covered))
    assert (r["environment"], r["warnings"]) == ("home", ["temporal_overlap_between_sessions"])
    assert r["blockers"] == ["candidate_reference_eligible_rate_below_070", "row_label_not_zero"]
    assert one(integrity.preflight_status(checked.where("session_id <> 'b'"), covered))["warnings"] == []


def test_clear_and_missing_columns(frame):
    df = frame([row("s")], ROW)
    got = integrity.preflight(df.withColumn("ssid", F.lit("x")), manifest(frame, "s")).first()["blockers"]
    assert got == ["clear_wifi_identifier_columns_present"]
    got = integrity.preflight(df.drop("attack_type"), manifest(frame, "s")).first()["blockers"]
    assert got == ["required_interim_columns_missing"]


def test_copies_are_found_whatever_their_order(frame):
    rows = [row("a", scan=i, minute=i) for i in range(6)]
    copy = [dict(r, session_id="b", environment="elsewhere") for r in reversed(rows)]
    other = [dict(r, session_id="c") for r in rows[:-1]] + [row("c", scan=4, minute=4)]
    prints = integrity.fingerprint(frame(rows + copy + other, ROW).repartition(5))
    got = {r["session_id"]: r["content_fingerprint"] for r in prints.collect()}
    assert got["a"] == got["b"] != got["c"]
    assert sorted(r["session_id"] for r in integrity.duplicate_groups(prints).collect()) == ["a", "b"]
    assert "duplicate_session_content" in blockers(frame, rows + copy, manifest(frame, "a", "b"))["a"]


def test_overlaps_match_all_pairs(frame):
    rng = np.random.default_rng(6)
    spans = [(f"s{i:02d}", int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 5000, 60), rng.integers(0, 400, 60)))]
    spans += [("t1", 10, 10), ("t2", 10, 10), ("t3", 7, 10)]
    df = frame([(n, datetime.fromtimestamp(a), datetime.fromtimestamp(b)) for n, a, b in spans],
               "session_id string, time_start_utc timestamp, time_end_utc timestamp")
    want = sorted(tuple(sorted((x[0], y[0]))) for i, x in enumerate(spans) for y in spans[i + 1:] if x[1] <= y[2] and y[1] <= x[2])
    for bucket in ("1 hour", "1 minute"):
        got = sorted((r["session_a"], r["session_b"]) for r in integrity.overlap_pairs(df, bucket).collect())
        assert got == want
    counts = {r["session_id"]: r["overlapping_sessions"] for r in integrity.overlap_counts(df).collect()}
    assert counts == {n: sum(n in pair for pair in want) for n, _, _ in spans}
    assert {r["session_id"] for r in integrity.overlaps_of(df, "t3").collect()} == {x for pair in want if "t3" in pair for x in pair} - {"t3"}


def test_drift_and_disjointness(frame):
    frozen = frame([("a", "reference", "1"), ("b", "model_train", "2"), ("c", "model_train", "3")], "session_id string, split string, content_fingerprint string")
    current = frame([("a", "1"), ("b", "9"), ("d", "4")], "session_id string, content_fingerprint string")
    states = {r["session_id"]: r["state"] for r in integrity.frozen_drift(current, frozen).collect()}
    assert states == {"a": "unchanged", "b": "mutated", "c": "missing", "d": "unassigned"}
    digest = integrity.assignment_digest
    assert one(digest(frozen))[0] == one(digest(frozen.orderBy(F.desc("session_id")).repartition(3)))[0]
    assert one(digest(frozen))[0] != one(digest(frozen.limit(2)))[0]
    good = frame([(n, s) for n, s in zip("abcde", ["reference", "model_train", "model_train", "validation", "test_normal"])], "session_id string, split string")
    assert one(integrity.check_disjoint(good))["valid"]
    bad = one(integrity.check_disjoint(good.unionByName(frame([("a", "other")], "session_id string, split string"))))
    assert (bad["valid"], bad["repeated_sessions"], bad["unknown_splits"]) == (False, 1, 1)


def status(frame, checked, covered):
    c = frame(checked, "environment string, blockers array<string>, valid boolean")
    v = frame(covered, "split string, below_minimum boolean")
    return one(integrity.preflight_status(c, v))["status"]


def test_status_precedence(frame):
    good, full = ("home", [], True), [("a", False), ("b", False), ("c", False)]
    assert status(frame, [], []) == "blocked_no_real_sessions"
    assert status(frame, [good, ("home", ["duplicate_session_content"], False)], full) == "blocked_duplicate_session_content"
    assert status(frame, [good, ("home", ["x"], False)], full) == "blocked_invalid_sessions"
    assert status(frame, [good] * 4, full) == "blocked_insufficient_valid_sessions"
    assert status(frame, [good] * 5 + [("lab", [], True)], full) == "blocked_mixed_normal_environments"
    assert status(frame, [good] * 5, [("a", True), ("b", False), ("c", False)]) == "blocked_candidate_reference_coverage"
    assert status(frame, [good] * 5, full) == "ready_for_split_freeze"


SCAN = ("scan_index long, ssid_hash string, bssid_hash string, security_type string, security_strength long, rssi_dbm double, "
        "beacon_interval_ms double, tsf_us long, host_timestamp_100ns long, center_frequency_khz long, ie_blob_size long, "
        "ie_parser_truncated boolean, ds_parameter_channel long")


def scans(frame, counters):
    return frame([(i, A, B, "WPA2", 3, -50.0, 102.4, t, 1, 2437000, 10, False, 6) for i, t in enumerate(counters)], SCAN)


def test_readiness(frame):
    up = one(scan_validation.readiness(scans(frame, [1000, 2000, 3000])))
    assert up["ready"] and up["tsf_nondecreasing_rate"] == 1.0 and up["warnings"] == []
    down = one(scan_validation.readiness(scans(frame, [3000, 2000, 1000])))
    assert down["ready"] and down["warnings"] == ["tsf_often_decreases"]
    assert one(scan_validation.tsf_continuity(scans(frame, [3000, 2000, 1000]), block_scans=1))["decreasing_transitions"] == 2
    few = one(scan_validation.readiness(scans(frame, [1, 2])))
    assert not few["ready"] and few["warnings"] == ["few_scans"]
    none = one(scan_validation.readiness(scans(frame, [])))
    assert not none["ready"] and "no_observations" in none["warnings"]


def test_coverage_and_numbers(frame):
    got = {r["field"]: r["coverage"] for r in scan_validation.coverage(scans(frame, [0, 5])).collect()}
    assert len(got) == 12 and got["tsf_positive"] == 0.5 and got["ie_parser_not_truncated"] == 1.0
    numbers = {r["field"]: (r["count"], r["min"], r["max"], r["mean"]) for r in scan_validation.numeric_summary(scans(frame, [0, 5])).collect()}
    assert numbers["tsf_us"] == (2, 0.0, 5.0, 2.5)
    assert {r["value"]: r["count"] for r in scan_validation.value_counts(scans(frame, [0, 5]), "security_type").collect()} == {"WPA2": 2}


CONTROLLED = ("session_id string, environment string, bssid_hash string, label long, is_attack_target boolean, session_label long, "
              "is_synthetic boolean, source_dataset string, attack_type string")


def test_controlled_gates(frame):
    """Each rule broken once; an environment that differs blocks, everything else refuses the rows."""
    def rows(name, *changes):
        plain = dict(session_id=name, environment="home", bssid_hash="t", label=1, is_attack_target=True, session_label=1, is_synthetic=False,
                     source_dataset="own_windows_attack", attack_type="evil")
        return [plain, dict(plain, bssid_hash="n", label=0, is_attack_target=False), *[dict(plain, **c) for c in changes]]

    cases = {"good": [{}], "attack_environment_mismatch": [{"environment": "lab"}], "label_not_binary": [{"label": 2, "is_attack_target": None}],
             "session_label_not_one": [{"session_label": 0}], "label_differs_from_target_flag": [{"is_attack_target": False}],
             "bssid_hash_missing": [{"bssid_hash": None}], "synthetic_rows": [{"is_synthetic": True}],
             "source_dataset_not_own_windows_attack": [{"source_dataset": "x"}], "attack_type_missing": [{"attack_type": None}],
             "several_target_bssids": [{"bssid_hash": "u"}]}
    all_rows = [r for name, changes in cases.items() for r in rows(name, *changes)] + rows("target_not_observed")[1:]
    df = frame(all_rows, CONTROLLED)
    gates = evaluation.controlled_gates(df, "home")
    got = {r["session_id"]: (r["broken"], r["passes"]) for r in gates.collect()}
    assert got.pop("good") == ([], True)
    also = {"label_not_binary": ["label_differs_from_target_flag"]}
    assert got == {name: (sorted([name, *also.get(name, [])]), False) for name in [*cases, "target_not_observed"] if name != "good"}
    ok = df.where("session_id IN ('good', 'attack_environment_mismatch')")
    assert evaluation.refuse_broken(ok, gates).count() == 6
    with pytest.raises(Exception, match="synthetic_rows: synthetic_rows"):
        evaluation.refuse_broken(df.where("session_id = 'synthetic_rows'"), gates).collect()
