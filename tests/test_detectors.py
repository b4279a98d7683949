import numpy as np
import pytest

from tests.conftest import one
from wavelark.operators import context, decisions, forest, leakage, matrix, oneclass, reconstruction
from wavelark.schema import DESKTOP_FEATURES


@pytest.fixture
def cloud(frame):
    rng = np.random.default_rng(1)
    normal = rng.normal(0, 1, (400, 2))
    odd = rng.normal(0, 1, (20, 2)) + [7, 7]
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(normal)]
    rows += [(1000 + i, float(a), float(b), 1) for i, (a, b) in enumerate(odd)]
    return frame(rows, "event_id long, x double, y double, label long").repartition(4)


def separation(scored):
    pdf = scored.toPandas()
    return (pdf[pdf.label == 1]["anomaly_score"].min(), pdf[pdf.label == 0]["anomaly_score"].quantile(0.95),
            (pdf[pdf.label == 0]["anomaly_score"] > 0).mean())


def test_kernel_scores_match_numpy(frame):
    rng = np.random.default_rng(2)
    sv, alpha, x = rng.normal(size=(7, 2)), rng.uniform(size=7), rng.normal(size=(5, 2))
    support = frame([(float(a), float(b), float(w)) for (a, b), w in zip(sv, alpha)], "x double, y double, alpha double")
    rows = frame([(float(a), float(b)) for a, b in x], "x double, y double")
    want = 0.3 - (alpha * np.exp(-0.7 * ((x[:, None] - sv[None]) ** 2).sum(2))).sum(1)
    for size in (4096, 2):
        oneclass.SLICE, kept = size, oneclass.SLICE
        try:
            got = [r["anomaly_score"] for r in oneclass.score_one_class(rows, support, 0.3, 0.7, ["x", "y"]).collect()]
        finally:
            oneclass.SLICE = kept
        assert np.allclose(got, want)


def test_gamma_scale(frame):
    df = frame([(0.0, 2.0), (2.0, 4.0)], "x double, y double")
    assert np.isclose(oneclass.scale_gamma(df, ["x", "y"]), 1 / (2 * np.var([0, 2, 2, 4])))


def test_one_class_separates(cloud):
    model = oneclass.fit_one_class(cloud.where("label = 0"), ["x", "y"], iters=20)
    low, high, share = separation(oneclass.score_random_features(cloud, model))
    assert low > high and 0.01 < share < 0.12


def test_forest_separates_and_is_stable(cloud):
    nodes = forest.fit_forest(cloud.where("label = 0"), ["x", "y"], trees=60)
    assert nodes.select("tree").distinct().count() == 60
    low, high, _ = separation(forest.score_forest(cloud, nodes, ["x", "y"]))
    assert low > high
    again = forest.fit_forest(cloud.where("label = 0").repartition(7), ["x", "y"], trees=60)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    assert {r["rows"] for r in nodes.select("rows").distinct().collect()} == {256}


def test_reconstruction_error(frame):
    rng = np.random.default_rng(4)
    t = rng.normal(size=200)
    df = frame([(float(a), float(2 * a), float(b)) for a, b in zip(t, rng.normal(0, 0.01, 200))], "x double, y double, z double")
    model = reconstruction.fit_reconstruction(df, ["x", "y", "z"], 1)
    assert reconstruction.score_reconstruction(df, model).agg({"anomaly_score": "max"}).first()[0] < 0.01
    off = frame([(1.0, -2.0, 0.0)], "x double, y double, z double")
    assert one(reconstruction.score_reconstruction(off, model))["anomaly_score"] > 1.0


def test_source_probe(frame):
    rows = [("zenodo_v2i" if i % 2 else "mendeley_rogue_ap", float(i % 2) + i * 1e-3, float(i % 5)) for i in range(60)]
    df = frame(rows, "source_dataset string, rssi_std_db double, rssi_delta_db double")
    assert [r["source_target"] for r in leakage.source_target(df).limit(2).collect()] == [0.0, 1.0]
    got = leakage.source_leakage(df, {"validation": df, "test_normal": df}).collect()
    assert {r["split"] for r in got} == {"validation", "test_normal"}
    assert all(r["accuracy"] == r["balanced_accuracy"] == r["f1"] == r["roc_auc"] == 1.0 for r in got)


def test_decisions(frame):
    schema = "session_id string, ssid_hash string, bssid_hash string, security_type string, security_strength double"
    ref = context.build_desktop_reference(frame([("r", "S", "B", "WPA2", 3.0)], schema))
    rows = frame([("x", "S", "B", "WPA2", 3.0), ("x", "S", "N", "OPEN", 0.0), ("x", "Q", "N", "OPEN", 0.0)], schema)
    scaler = matrix.fit_scaler(context.transform_desktop(rows.limit(2), ref), DESKTOP_FEATURES)

    def scorer(df):
        return df.withColumn("anomaly_score", df["bssid_changed"])

    got = decisions.decide(rows, ref, scaler, scorer, 0.0).collect()
    assert [r["status"] for r in got] == ["ready", "ready", "insufficient_history"]
    assert [r["is_anomaly"] for r in got] == [False, True, None]
    assert [r["suspicion_level"] for r in got] == ["low", "high", "unavailable"]
    assert [r["bssid_changed"] for r in got] == [0.0, 1.0, None]
