import hashlib

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import context, scenarios, suspicion

FEATURES = ("context_available boolean, feature_complete boolean, ssid_bssid_count double, bssid_changed double, "
            "security_changed double, security_strength_delta double")


@pytest.mark.parametrize("row, score, level, hypothesis", [
    ((True, True, 1.0, 0.0, 0.0, 0.0), 0, "normal_like", "no_evil_twin_hypothesis"),
    ((True, True, 2.0, 0.0, 0.0, -1.0), 1, "low_suspicion", "weaker_security_observation"),
    ((True, True, 1.0, 1.0, 0.0, 0.0), 2, "medium_suspicion", "possible_evil_twin_new_bssid"),
    ((True, True, 1.0, 0.0, 1.0, 0.0), 2, "medium_suspicion", "security_profile_anomaly"),
    ((True, True, 1.0, 0.0, 1.0, -1.0), 3, "medium_suspicion", "security_profile_anomaly_with_downgrade"),
    ((True, True, 1.0, 1.0, 1.0, 0.0), 4, "high_suspicion", "possible_evil_twin_with_security_change"),
    ((True, True, 1.0, 1.0, 1.0, -3.0), 5, "high_suspicion", "possible_evil_twin_with_security_downgrade"),
    ((True, False, 1.0, None, 1.0, -3.0), None, "not_evaluable", "not_evaluable"),
])
def test_levels(frame, row, score, level, hypothesis):
    got = one(suspicion.suspicion(frame([row], FEATURES)))
    assert (got["suspicion_score"], got["suspicion_level"], got["hypothesis_type"]) == (score, level, hypothesis)
    assert got["context_notes"] == ("known_ssid_has_multiple_reference_bssids" if row[2] > 1 else "")
    assert got["suspected_label"] == (None if score is None else int(score > 0))


def test_summary(frame):
    rows = [(True, True, 1.0, 0.0, 0.0, 0.0), (True, True, 1.0, 1.0, 1.0, 0.0), (False, False, None, None, None, None)]
    s = one(suspicion.suspicion_summary(suspicion.suspicion(frame(rows, FEATURES))))
    assert (s["rows"], s["eligible"], s["not_evaluable"], s["suspected"], s["high_suspicion"], s["suspected_rate"]) == (3, 2, 1, 1, 1, 0.5)


def test_summary_tells_a_missing_key_from_the_total(frame):
    rows = [("a", True, True, 1.0, 0.0, 0.0, 0.0), (None, True, True, 1.0, 1.0, 1.0, 0.0)]
    got = suspicion.suspicion_summary(suspicion.suspicion(frame(rows, "k string, " + FEATURES)), "k").collect()
    assert sorted((str(r["k"]), r["is_total"], r["rows"]) for r in got) == [("None", False, 1), ("None", True, 2), ("a", False, 1)]


DESK = ("session_id string, scan_index long, ssid_hash string, bssid_hash string, security_type string, security_strength double, "
        "is_synthetic string, event_id long, label long")


def setup(frame, kind="WPA2_OR_NEWER", strength=3.0):
    rows = frame([("s", 4, "S", "B", kind, strength, "false", 7, 0), ("s", 4, "S", "X", kind, strength, "false", 8, 0),
                  ("s", 4, "S", "B", kind, strength, "yes", 9, 0)], DESK)
    ref = context.build_desktop_reference(rows.where("event_id = 7"))
    return rows, ref


def test_scenarios(frame):
    rows, ref = setup(frame)
    base = scenarios.baseline_rows(context.transform_desktop(rows, ref))
    assert [r["event_id"] for r in base.collect()] == [7]
    made = {r["scenario_type"]: r for r in scenarios.generate_scenarios(base, ref).collect()}
    assert set(made) == {name for name, *_ in scenarios.SCENARIOS}
    assert made["hypothetical_control"]["bssid_hash"] == "B"
    salted = "desktop-hypothetical-bssid|hypothetical_new_bssid|S|B|s|4|0"
    assert made["hypothetical_new_bssid"]["bssid_hash"] == hashlib.sha256(salted.encode()).hexdigest()
    assert made["ablation_weaker_security_only"]["security_strength"] == 2.0
    change = made["hypothetical_new_bssid_security_change"]
    assert (change["security_type"], change["security_strength"]) == ("OPEN", 3.0)
    down = made["hypothetical_new_bssid_security_downgrade"]
    assert (down["security_type"], down["security_strength"]) == ("LEGACY_PRIVACY", 1.0)
    assert all(r["label"] is None and r["is_synthetic"] and r["session_id"] == f"hypothetical-{k}-s" for k, r in made.items())
    f = {r["scenario_type"]: r for r in scenarios.scenario_features(scenarios.generate_scenarios(base, ref), ref).collect()}
    assert f["hypothetical_control"]["bssid_changed"] == 0 and f["hypothetical_new_bssid"]["bssid_changed"] == 1
    assert f["ablation_weaker_security_only"]["weaker_security"] == 1


def test_open_network_gives_fewer_scenarios(frame):
    rows, ref = setup(frame, "OPEN", 0.0)
    base = scenarios.baseline_rows(context.transform_desktop(rows, ref))
    made = {r["scenario_type"] for r in scenarios.generate_scenarios(base, ref).collect()}
    assert made == {"hypothetical_control", "hypothetical_new_bssid", "hypothetical_new_bssid_security_change"}


def test_known_address_takes_the_next_salt(frame):
    prefix = "desktop-hypothetical-bssid|hypothetical_new_bssid|S|B|s|4|"
    taken = hashlib.sha256((prefix + "0").encode()).hexdigest()
    rows, _ = setup(frame)
    ref = context.build_desktop_reference(rows.where("event_id = 7").unionByName(
        rows.where("event_id = 7").withColumn("bssid_hash", F.lit(taken))))
    base = scenarios.baseline_rows(context.transform_desktop(rows.where("event_id = 7"), ref))
    made = {r["scenario_type"]: r["bssid_hash"] for r in scenarios.generate_scenarios(base, ref).collect()}
    assert made["hypothetical_new_bssid"] == hashlib.sha256((prefix + "1").encode()).hexdigest()
    assert len(made) == 5


def test_evaluation_against_control(frame):
    schema = "scenario_type string, source_session_id string, is_synthetic boolean, context_available boolean, feature_complete boolean, anomaly_score double"
    rows = [("hypothetical_control", "t", True, True, True, 0.0), ("hypothetical_control", "t", True, True, True, 2.0),
            ("hypothetical_new_bssid", "t", True, True, True, 3.0), ("hypothetical_new_bssid", "t", True, False, False, None)]
    tests = frame([("t",)], "session_id string")
    got = {r["scenario_type"]: r for r in scenarios.evaluate_scenarios(frame(rows, schema), tests, 1.0).collect()}
    assert got["hypothetical_control"]["delta_to_control"] is None
    new = got["hypothetical_new_bssid"]
    assert (new["input_rows"], new["eligible_rows"], new["anomaly_count"], new["delta_to_control"], new["score_p95"]) == (2, 1, 1, 0.5, 3.0)
    for bad in (("hypothetical_control", "other", True, True, True, 0.0), ("hypothetical_control", "t", False, True, True, 0.0)):
        with pytest.raises(SparkRuntimeException, match="test session"):
            scenarios.evaluate_scenarios(frame([bad], schema), tests, 1.0).collect()


def test_many_scenarios_stay_spread(spark, frame):
    """Rows that keep their address have nothing to look up: no exchange of the rows puts them all in one task."""
    rows, _ = setup(frame)
    ref = context.freeze(context.build_desktop_reference(rows.where("event_id = 7")))
    base = scenarios.baseline_rows(context.transform_desktop(rows.where("event_id = 7"), ref))
    made = scenarios.generate_scenarios(base, ref)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert made.count() == 5


def test_scenarios_against_a_reference_that_is_not_broadcast(spark, frame):
    rows, ref = setup(frame)
    ref = context.freeze(ref)
    base = scenarios.baseline_rows(context.transform_desktop(rows, ref))
    want = sorted(map(tuple, scenarios.generate_scenarios(base, ref).collect()), key=str)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = scenarios.generate_scenarios(base, ref)
        assert sorted(map(tuple, made.collect()), key=str) == want and len(want) == 5
        # The joins with the members and with the taken addresses go by a salt too.
        assert made._jdf.queryExecution().optimizedPlan().toString().count("_salt") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
