import hashlib

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from wavelark.operators import group_split, ordering, splits, windows


def stable(value, seed):
    return int(hashlib.sha256(f"{seed}|{value}".encode()).hexdigest()[:16], 16)


def greedy(sizes, ratios, seed):
    """One group after another, as the rule is stated."""
    names = ["train", "validation", "test"]
    total = float(sum(sizes.values()))
    target = {n: total * r for n, r in zip(names, ratios)}
    held, out = dict.fromkeys(names, 0.0), {}
    for g, n in sorted(sizes.items(), key=lambda kv: (-kv[1], stable(kv[0], seed))):
        best = max(names, key=lambda s: ((target[s] - held[s]) / max(target[s], 1.0), -stable(f"{g}|{s}", seed)))
        out[g], held[best] = best, held[best] + n
    return out


@pytest.mark.parametrize("case", ["equal", "mixed", "distinct", "few"])
def test_group_split_equals_the_greedy_rule(frame, case):
    rng = np.random.default_rng(11)
    counts = {"equal": [3] * 40, "mixed": rng.integers(1, 6, 90).tolist(), "distinct": list(range(1, 25)), "few": [2, 2]}[case]
    sizes = {f"g{i}": n for i, n in enumerate(counts)}
    rows = [("mendeley_rogue_ap", "s", g) for g, n in sizes.items() for _ in range(n)]
    df = frame(rows, "source_dataset string, session_id string, network_identity_id string").repartition(5)
    got = group_split.group_split(df)
    assert got.count() == len(rows)
    assert {r[0]: r[1] for r in got.select("split_group_id", "split").distinct().collect()} == \
        greedy(sizes, (0.70, 0.15, 0.15), 20260831)


def test_no_group_in_two_splits(frame):
    rows = [(source, f"{source}-{g % 6}", f"{source}-n{g}", v) for source in ("mendeley_rogue_ap", "zenodo_v2i")
            for g in range(12) for v in range(3)]
    out = group_split.group_split(frame(rows, "source_dataset string, session_id string, network_identity_id string, value long"))
    assert splits.leaking_groups(out).count() == 0
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "validation", "test"}
    summary = splits.split_summary(out).groupBy("source_dataset").agg(F.sum("rows").alias("n")).collect()
    assert {r["n"] for r in summary} == {36}
    leaked = out.unionByName(out.limit(1).withColumn("split", F.lit("other")))
    assert splits.leaking_groups(leaked).count() == 1


def test_contextual_split_sizes(frame):
    rows = [(f"s{i % 2}", float(i // 2) if i % 10 else None, i) for i in range(40)]
    df = frame(rows, "session_id string, elapsed_ms double, event_id long")
    got = splits.contextual_split(df).groupBy("session_id", "context_split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got if r[0] == "s0"} == {
        ("s0", "reference"): 8, ("s0", "model_train"): 6, ("s0", "validation"): 3, ("s0", "test_normal"): 3}
    last = splits.contextual_split(df).where(F.col("elapsed_ms").isNull()).select("context_split").distinct().collect()
    assert [r[0] for r in last] == ["test_normal"] or {r[0] for r in last} <= {"validation", "test_normal"}
    with pytest.raises(ValueError):
        splits.contextual_split(df, (0.5, 0.3, 0.1, 0.2))


def test_crowded_second_is_cut(spark, frame):
    """Nine rows in ten lie in one session and one instant; ranges of the order share them out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40_000).selectExpr(
            "CASE WHEN id % 10 = 0 THEN concat('s', id % 7) ELSE 'hot' END AS session_id",
            "CASE WHEN id % 10 = 0 THEN id % 1000 ELSE 5 END AS elapsed_ms", "hash(id) AS event_id")
        order = [F.col("elapsed_ms").asc_nulls_last(), F.col("event_id")]
        blocks = ordering.dealt(rows, ["session_id"], order).groupBy("_block").count().collect()
        sizes = sorted(r["count"] for r in blocks)
        assert len(sizes) >= 4 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        got = {(r[0], r[1]): r[2] for r in splits.contextual_split(rows).groupBy("session_id", "context_split").count().collect()}
        assert [got["hot", s] for s in splits.CONTEXT_SPLITS] == [14_400, 10_800, 5400, 5400]
        beacons = rows.selectExpr("'x' AS source_dataset", "session_id", "'b' AS bssid", "elapsed_ms", "event_id", "CAST(NULL AS STRING) AS attack_type")
        gaps = windows.inter_beacon_gap(beacons).groupBy("session_id").agg(F.count("inter_beacon_ms").alias("n"), F.sum("inter_beacon_ms").alias("s"))
        assert {r["session_id"]: (r["n"], r["s"]) for r in gaps.collect()}["hot"] == (35_999, 0.0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_balanced_sources(frame):
    rows = [("a", i) for i in range(10)] + [("b", 100 + i) for i in range(4)]
    df = frame(rows, "source_dataset string, value long")
    got = splits.balance_sources(df, "value")
    assert {r[0]: r[1] for r in got.groupBy("source_dataset").count().collect()} == {"a": 4, "b": 4}
    again = splits.balance_sources(df.repartition(3), "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    want = sorted(range(10), key=lambda v: hashlib.sha256(f"20260831|{v}".encode()).hexdigest())[:4]
    assert sorted(r["value"] for r in got.collect() if r["source_dataset"] == "a") == sorted(want)


SESSIONS = "session_id string, environment string, rows long, runtime_ready boolean"


def test_session_plan(frame):
    four = splits.session_split_plan(frame([(f"s{i}", "e", 9, True) for i in range(4)], SESSIONS)).collect()
    assert {(r["split"], r["plan_status"]) for r in four} == {(None, "insufficient_sessions")}
    ready = frame([(f"s{i}", "e", 9, True) for i in range(5)] + [("late", "e", 9, False)], SESSIONS)
    counts = {r[0]: r[1] for r in splits.session_split_plan(ready).groupBy("split").count().collect()}
    assert counts == {"reference": 1, "model_train": 2, "validation": 1, "test_normal": 1}
    nine = {r["session_id"]: r["split"] for r in splits.session_split_plan(frame([(f"s{i}", "e", 9, True) for i in range(9)], SESSIONS)).collect()}
    order = sorted(nine, key=lambda s: hashlib.sha256(f"20260831|{s}".encode()).hexdigest())
    assert [nine[s] for s in order] == splits.FIRST_SESSIONS + splits.FURTHER_SESSIONS
    with pytest.raises(SparkRuntimeException, match="duplicate session_id"):
        splits.session_split_plan(frame([("a", "e", 1, True)] * 5, SESSIONS)).collect()


def test_empty_plan(frame):
    assert splits.session_split_plan(frame([], SESSIONS)).count() == 0


