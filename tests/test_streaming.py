import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wavelark.operators import context, matrix, scan_flatten, windows
from wavelark.operators.decisions import REASONS, decide
from wavelark.schema import DESKTOP_FEATURES
from wavelark.sources import scans, store
from wavelark.streaming import jobs

T0 = datetime(2024, 1, 1)


def drain(stream, out, checkpoint):
    (stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def document(index, bssid=None, security="WPA2"):
    entry = {"ssid_hash": "S", "bssid_hash": bssid, "security_type": security, "security_strength": 3 if security == "WPA2" else 0}
    return {"session_id": "s", "scan_index": index, "captured_at_utc": "2024-01-01T00:00:00Z",
            "interfaces": [{"interface": {"guid": "g"}, "bss_entries": [entry] if bssid else []}]}


def write(path, docs):
    path.write_text("".join(json.dumps(d) + "\n" for d in docs))


def test_scans_are_stored_once(spark, frame, tmp_path, monkeypatch):
    ref = context.build_desktop_reference(frame(
        [("r", "S", "B", "WPA2", 3)], "session_id string, ssid_hash string, bssid_hash string, security_type string, security_strength long"))
    scaler = matrix.fit_scaler(frame([(1.0, 0.0, 0.0, 0.0)], ", ".join(f"{f} double" for f in DESKTOP_FEATURES)), DESKTOP_FEATURES)

    def scorer(df):
        return df.withColumn("anomaly_score", F.col("bssid_changed") + F.col("security_changed"))

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        jobs.score_stream(scans.stream_scan_jsonl(spark, str(source)), ref, scaler, scorer, 0.5, str(out), str(tmp_path / "state")).awaitTermination()

    write(source / "1.jsonl", [document(0, "B"), document(1, "N", "OPEN"), document(0, "B"), document(7)])
    run()
    # The second file repeats scans, with and without networks; its batch is interrupted before it is committed.
    write(source / "2.jsonl", [document(1, "N", "OPEN"), document(2, "N"), document(7)])
    real = store._commit
    monkeypatch.setattr(store, "_commit", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        run()
    assert store.read_store(spark, str(out))["network_observation"].count() == 2
    monkeypatch.setattr(store, "_commit", real)
    run()
    db = store.read_store(spark, str(out))
    assert {n: db[n].count() for n in ("scan_session", "network_observation", "network_features", "detection")} == {
        "scan_session": 4, "network_observation": 3, "network_features": 3, "detection": 3}
    assert {r["id"]: (r["total_networks"], r["interface_count"]) for r in db["scan_session"].collect()} == {
        "s-0": (1, 1), "s-1": (1, 1), "s-2": (1, 1), "s-7": (0, 1)}
    got = db["detection"].orderBy("scan_session_id").collect()
    assert [(r["scan_session_id"], r["is_anomaly"], r["anomaly_score"]) for r in got] == [("s-0", False, 0.0), ("s-1", True, 2.0), ("s-2", True, 1.0)]
    assert sorted(r["id"] for r in got) == [1, 2, 3] and got[0]["reason"] == REASONS["low"] and got[1]["reason"] == REASONS["high"]
    whole = scan_flatten.flatten_scans(scans.read_scan_jsonl(spark, str(source)).dropDuplicates(["scan_index"]), F.col("session_id"), "x")
    batch = decide(whole, ref, scaler, scorer, 0.5, model_version="v1").orderBy("scan_index").collect()
    assert [r["is_anomaly"] for r in batch] == [r["is_anomaly"] for r in got] and {r["model_version"] for r in batch} == {"v1"}


def test_stored_scans_have_the_numbers_of_their_documents(spark, frame, tmp_path):
    """Several interfaces, missing lists, and repeats within a batch, of which the first document counts; nothing is sorted for that."""
    ref = context.build_desktop_reference(frame(
        [("r", "S", "B", "WPA2", 3)], "session_id string, ssid_hash string, bssid_hash string, security_type string, security_strength long"))
    scaler = matrix.fit_scaler(frame([(1.0, 0.0, 0.0, 0.0)], ", ".join(f"{f} double" for f in DESKTOP_FEATURES)), DESKTOP_FEATURES)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    many, none, quiet = document(0, "B"), document(1), document(2)
    many["interfaces"] += [{"interface": {"guid": "h"}, "bss_entries": 2 * document(0, "N")["interfaces"][0]["bss_entries"]}, {"interface": {"guid": "i"}}]
    none["interfaces"] = None
    write(source / "1.jsonl", [many, none, quiet, document(0, "X"), many, document(2, "B")])
    plans, real = [], jobs.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    jobs.stored = noted
    try:
        jobs.score_stream(scans.stream_scan_jsonl(spark, str(source)), ref, scaler, lambda df: df.withColumn("anomaly_score", F.col("bssid_changed")), 0.5,
                          str(out), str(tmp_path / "state")).awaitTermination()
    finally:
        jobs.stored = real
    db = store.read_store(spark, str(out))
    assert {r["id"]: (r["total_networks"], r["interface_count"]) for r in db["scan_session"].collect()} == {"s-0": (3, 3), "s-1": (0, 0), "s-2": (0, 1)}
    assert sorted((r["scan_session_id"], r["bssid_hash"]) for r in db["network_observation"].collect()) == [("s-0", "B"), ("s-0", "N"), ("s-0", "N")]
    assert [r.asDict() for r in db["manifest"].select("scans", "observations", "first_scan", "last_scan", "first_id", "last_id").collect()] == [
        {"scans": 3, "observations": 3, "first_scan": "s-0", "last_scan": "s-2", "first_id": 1, "last_id": 3}]
    arrived = dict(plans)["scan-batch"]
    assert "Sort" not in arrived and "Exchange" not in arrived


def test_repeats_are_dropped(spark, frame, tmp_path):
    t = T0
    frame([("a", t), ("a", t + timedelta(minutes=5)), ("b", t)], "scan_id string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scan_id string, at timestamp").parquet(str(tmp_path / "in"))
    got = drain(jobs.dedupe(stream, ["scan_id"], "at"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["scan_id"] for r in got.collect()) == ["a", "b"]


BEACON = ("source_dataset string, session_id string, bssid string, attack_type string, rssi_dbm double, channel long, advertised_channel long, "
          "label long, is_synthetic boolean, elapsed_ms long, event_id long, event_time timestamp")


def beacon(event, ms, bssid="b", rssi=-50.0, attack=None, label=0):
    return ("s", "x", bssid, attack, rssi, 1, 1, label, False, ms, event, T0 + timedelta(milliseconds=ms))


def test_chained_windows_equal_the_batch_profile(spark, frame, tmp_path):
    """Several files and runs, rows out of order, windows without a signal, and the open windows at the end."""
    rng = random.Random(7)
    rows = [beacon(i, rng.randrange(0, 60_000), f"b{rng.randrange(4)}", None if rng.random() < 0.2 else -30.0 - rng.randrange(50),
                   rng.choice([None, "x"]), rng.randrange(2)) for i in range(600)]
    rows.sort(key=lambda r: r[9] + rng.randrange(8000))
    parts = [rows[:200], rows[200:210], rows[210:]]

    def run():
        return drain(jobs.rssi_stream(spark.readStream.schema(BEACON).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))

    for part in parts:
        frame(part, BEACON).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    whole = frame(rows, BEACON)
    batch = windows.rssi_temporal(windows.beacon_profile(whole))
    open_windows = batch.count() - spark.read.parquet(str(tmp_path / "out")).count()
    assert open_windows > 0
    jobs.end_marker(whole, "event_time").write.mode("append").parquet(str(tmp_path / "in"))
    got = run().withColumn("window_start_ms", (F.unix_millis("window_start") - F.lit(int(T0.timestamp() * 1000))).cast("double"))

    def lines(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(batch.columns).collect())

    assert lines(got) == lines(batch)


def test_late_rows_are_dropped(spark, frame, tmp_path):
    def batch(*seconds):
        frame([beacon(s, 1000 * s, rssi=-50.0 - s) for s in seconds], BEACON).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(BEACON).parquet(str(tmp_path / "in"))
        return drain(jobs.rssi_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))

    batch(0, 1, 4, 7, 30)
    first = {r["window_start"]: (r["window_count"], r["rssi_delta_db"]) for r in run().collect()}
    assert first == {T0: (3, -4.0), T0 + timedelta(seconds=5): (1, 0.0)}
    batch(2, 60)
    assert {r["window_start"]: r["window_count"] for r in run().collect()}[T0] == 3


FALL = "bssid_hash string, scan_index long, tsf_us long, event_time timestamp"


def fall_rows(rows, step=60):
    return [(b, s, t, T0 + timedelta(seconds=step * s)) for b, s, t in rows]


class Watch:
    """A watch that is stopped and started again for every file."""

    def __init__(self, spark, frame, path):
        self.spark, self.frame, self.path = spark, frame, path

    def arrive(self, rows):
        rows = rows if hasattr(rows, "write") else self.frame(rows, FALL)
        rows.write.mode("append").parquet(str(self.path / "in"))
        stream = jobs.tsf_watch(self.spark.readStream.schema(FALL).parquet(str(self.path / "in")), watermark="3 minutes")
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", str(self.path / "out"))
                 .option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
        return query

    def falls(self):
        return sorted(map(tuple, self.spark.read.parquet(str(self.path / "out")).collect()))


def test_counter_falls_match_the_batch_check(spark, frame, tmp_path):
    """Scans in any order within the watermark, over several files and runs."""
    rng = random.Random(3)
    rows = [(f"b{b}", s, rng.randrange(1000)) for b in range(5) for s in range(30) for _ in range(rng.randrange(3))]
    rows += [("", 3, 1), (None, 4, 2), ("b0", 5, None)]
    rows.sort(key=lambda r: r[1] + rng.random() * 2.5)
    watch = Watch(spark, frame, tmp_path)
    for at in range(0, len(rows), 60):
        watch.arrive(fall_rows(rows[at:at + 60]))
    whole = frame(fall_rows(rows), FALL)
    query = watch.arrive(jobs.end_marker(whole, "event_time"))
    extremes = {}
    for b, s, t in rows:
        if b and t is not None:
            low, high = extremes.setdefault(b, {}).get(s, (t, t))
            extremes[b][s] = (min(low, t), max(high, t))
    want = [(b, x, y, scans[x][1], scans[y][0]) for b, scans in extremes.items()
            for x, y in zip(sorted(scans), sorted(scans)[1:]) if scans[y][0] < scans[x][1]]
    assert watch.falls() == sorted(want) and want
    # The watermark is past all scans by more than an hour, so nothing is held any more.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_counter_state_ends_an_hour_after_the_last_scan(spark, frame, tmp_path):
    watch = Watch(spark, frame, tmp_path)
    watch.arrive(fall_rows([("a", 0, 50), ("b", 0, 50)]))
    held = watch.arrive(fall_rows([("b", 20, 40), ("c", 59, 7)]))
    assert held.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    held = watch.arrive(fall_rows([("c", 70, 5), ("b", 75, 30)]))
    assert held.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # a was last seen 72 minutes before the watermark
    watch.arrive(fall_rows([("a", 90, 1), ("c", 90, 9)]))
    watch.arrive(jobs.end_marker(frame(fall_rows([("a", 90, 1)]), FALL), "event_time"))
    assert watch.falls() == [("b", 0, 20, 50, 40), ("b", 20, 75, 40, 30), ("c", 59, 70, 7, 5)]


def test_counters_of_many_networks_share_few_states(spark, frame, tmp_path, monkeypatch):
    """A bucket keeps its networks apart, whatever they share, and rows without a network hold no state."""
    monkeypatch.setattr(jobs, "WATCH_BUCKETS", 2)
    watch = Watch(spark, frame, tmp_path)
    held = watch.arrive(fall_rows([(f"b{i}", 0, 50 + i) for i in range(40)] + [(None, 1, 3), ("", 1, 3)]))
    assert 0 < held.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    watch.arrive(fall_rows([(f"b{i}", 5, 70) for i in range(0, 40, 2)] + [("b1", 3, 9), ("b1", 3, 90)]))
    query = watch.arrive(jobs.end_marker(frame(fall_rows([("b1", 5, 1)]), FALL), "event_time"))
    assert watch.falls() == [("b1", 0, 3, 51, 9)] + sorted((f"b{i}", 0, 5, 50 + i, 70) for i in range(22, 40, 2))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
