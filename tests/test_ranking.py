import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import one
from wavelark.operators import calibration, evaluation, matrix, ordering


def test_quantiles_do_not_depend_on_partitions(spark, frame):
    """The same bits for random doubles, whatever the number of ranges the values are cut into."""
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 40}", None if i % 41 == 0 else float(rng.normal())) for i in range(1200)] + [("single", 1.0), ("none", None)]
    held, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            df = frame(rows, "g string, v double").repartition(parts)
            got = {r["g"]: (r["m"], r["p"]) for r in ordering.exact_quantiles(df, "v", {"m": 0.5, "p": 0.95}, ["g"]).collect()}
            whole = one(ordering.exact_quantiles(df, "v", {"m": 0.5, "p": 0.95}))
            found.append((got, tuple(whole)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] == found[2]
    assert set(found[0][0]) == {r[0] for r in rows} - {"none"}
    for g, values in found[0][0].items():
        assert np.allclose(values, np.quantile([v for k, v in rows if k == g and v is not None], [0.5, 0.95]))


def test_running_counts(frame):
    values = [float(v % 57) for v in range(500)]
    df = ordering.fold_values(frame([(v,) for v in values], "v double").repartition(5), "v")
    got = {r["v"]: r["cum_n"] for r in ordering.running_counts(df, "v").collect()}
    assert got == {v: sum(x <= v for x in values) for v in set(values)}


def test_positions_in_blocks(frame):
    rows = [(None if i % 3 else "x", i * 7 % 50, i) for i in range(50)]
    df = frame(rows, "k string, v long, i long")
    for width in (1, 7, 1000):
        got = ordering.with_position(df, ["k"], [F.col("v")], F.floor(F.col("v") / width)).collect()
        for k in (None, "x"):
            order = [r["v"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["position"])]
            assert order == sorted(order)
            assert {r["total"] for r in got if r["k"] == k} == {len(order)}


def scores(frame, pairs):
    return frame([(float(s), y) for s, y in pairs], "anomaly_score double, label long")


def test_calibration(frame):
    df = frame([(float(i),) for i in range(100)], "anomaly_score double")
    got = one(calibration.calibrate(df))
    assert round(got["threshold"], 9) == 94.05 and got["validation_realized_false_positive_rate"] == 0.05
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            calibration.calibrate(df, bad)
    for value in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            calibration.calibrate(frame([(1.0,), (value,)], "anomaly_score double")).collect()
    with pytest.raises(Exception, match="no validation scores"):
        calibration.calibrate(df.where("anomaly_score < 0")).collect()


def test_separable_scores(frame):
    got = one(evaluation.binary_metrics(scores(frame, [(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)]), 0.5))
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (2, 0, 0, 2)
    assert got["precision"] == got["recall"] == got["f1"] == got["roc_auc"] == got["pr_auc"] == 1.0


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    precision, recall = 0.0, 0.0
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        flagged = [y for s, y in pairs if s >= cut]
        now = sum(flagged) / len(pos)
        precision += (now - recall) * sum(flagged) / len(flagged)
        recall = now
    return auc, precision


def test_ranking_metrics_match_brute_force(frame):
    rng = np.random.default_rng(8)
    pairs = [(float(rng.integers(0, 20)) + 3 * y, y) for y in rng.integers(0, 2, 200).tolist()]
    auc, ap = brute_auc(pairs)
    for stretch in (lambda s: s, lambda s: np.exp(s / 5)):
        got = one(evaluation.ranking_metrics(scores(frame, [(stretch(s), y) for s, y in pairs])))
        assert abs(got["roc_auc"] - auc) < 1e-12 and abs(got["pr_auc"] - ap) < 1e-12


def test_one_class_only_is_an_error(frame):
    with pytest.raises(Exception, match="normal and attack"):
        evaluation.binary_metrics(scores(frame, [(0.1, 0)]), 0.5).collect()


def test_groups_and_normal_rows(frame):
    df = frame([("a", 1.0), ("a", 3.0), (None, 2.0)], "attack_type string, anomaly_score double")
    got = {r["attack_type"]: (r["rows"], r["detected"], r["recall"], r["score_median"]) for r in evaluation.recall_by(df, "attack_type", 1.5).collect()}
    assert got == {"a": (2, 1, 0.5, 2.0), "unknown": (1, 1, 1.0, 2.0)}
    s = one(evaluation.normal_summary(df, 1.5))
    assert (s["rows"], s["false_positive_count"], s["score_median"], s["score_mean"], s["true_negative_count"]) == (3, 2, 2.0, 2.0, 1)
    d = {r["attack_type"]: r["score_std"] for r in evaluation.score_distribution(df.dropna(), "attack_type", 1.5).collect()}
    assert d == {"a": 1.0}


def test_scaler_and_matrix(frame):
    df = frame([(1.0, 5.0, 0, "s"), (3.0, 5.0, 0, "s")], "x double, y double, label long, session_id string")
    scaler = matrix.fit_scaler(df, ["x", "y"])
    assert tuple(one(scaler)) == (2.0, 5.0, 1.0, 1.0)
    assert [(r["x"], r["y"]) for r in matrix.apply_scaler(df, scaler, ["x", "y"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert matrix.feature_matrix(df, ["x"], require_normal=True).columns == ["x", "label", "session_id"]
    with pytest.raises(ValueError, match="session_id"):
        matrix.feature_matrix(df, ["session_id"])
    with pytest.raises(Exception, match="NULL in x"):
        matrix.feature_matrix(df.withColumn("x", F.lit("bad")), ["x"]).collect()
    with pytest.raises(Exception, match="label is not 0"):
        matrix.feature_matrix(df.withColumn("label", F.lit(1)), ["x"], require_normal=True).collect()
    report = {r["feature"]: (r["distinct_values"], r["mean"], r["variance_population"]) for r in matrix.variance_report(df, ["x", "y"]).collect()}
    assert report == {"x": (2, 2.0, 1.0), "y": (1, 5.0, 0.0)}


ELIGIBLE = "session_id string, environment string, label long, bssid_hash string, context_available boolean, feature_complete boolean"


def test_controlled_eligibility(frame):
    rows = [("a", "lab", 1, "t", True, True)] * 3 + [("a", "lab", 0, "n", True, False)] + [
        ("b", "lab", 1, "t", True, True), ("b", "home", 1, "u", False, False)]
    got = {r["session_id"]: r for r in evaluation.controlled_eligibility(frame(rows, ELIGIBLE), "lab").collect()}
    assert got["a"]["eligible_rate"] == 0.75 and got["a"]["coverage_passes"] and got["a"]["single_target"]
    assert not got["b"]["single_target"] and not got["b"]["environment_matches"]
    assert got[None]["rows"] == 6 and round(got[None]["attack_target_eligible_rate"], 9) == 0.8
    assert not got[None]["coverage_passes"]
