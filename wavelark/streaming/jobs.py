"""The same computations over streams."""

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavelark.functions.identity import network_id, stable_group_id
from wavelark.operators.context import Reference
from wavelark.operators.decisions import decide
from wavelark.operators.scan_flatten import flatten_scans
from wavelark.operators.windows import GROUP_KEYS, MISSING_BSSID
from wavelark.session import stored
from wavelark.sources import store


def dedupe(stream: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark of the first one."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def score_stream(scans: DataFrame, ref: Reference, scaler: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                 threshold: Column | float, out: str, checkpoint: str, environment: str = "unknown",
                 model_version_id: int | None = 1, model_version: str | None = None) -> StreamingQuery:
    """Score each batch of scan documents and store its scans, observations, features and detections under `out`.

    A batch is committed as a whole once all four tables are written; one that was interrupted is written again, and one that was
    committed is left alone. A scan (session and index) that is stored already is left out, also if it saw no network.
    """
    # Batches of another stream into the same store have other names.
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scan_id = F.concat_ws("-", "session_id", "scan_index")
        # Parsed once and written as it came; which documents count is found on ids and places alone.
        networks = F.aggregate("interfaces", F.lit(0).cast("long"), lambda n, i: n + F.greatest(F.size(i["bss_entries"]), F.lit(0)))
        arrived = stored(batch.withColumns({"scan_id": scan_id, "_at": F.monotonically_increasing_id(), "_networks": networks,
                                            "_interfaces": F.size("interfaces").cast("long")}), "scan-batch")
        kept = arrived.groupBy("scan_id").agg(F.min("_at").alias("_at"))
        held = store.stored_scans(spark, out, arrived.select(F.to_date("captured_at_utc").alias("scan_date")))
        if held is not None:
            kept = kept.join(held.withColumnRenamed("id", "scan_id"), "scan_id", "left_anti")
        # Few documents are repeats as a rule, so these are told by their places, not the others; the table is broadcast where it is small.
        repeats = stored(arrived.select("_at").join(kept.select("_at"), "_at", "left_anti"), "scan-repeats")
        fresh = arrived.join(repeats, "_at", "left_anti").drop("_at")
        rows = flatten_scans(fresh, F.col("session_id"), environment)
        rows = decide(rows, ref, scaler, scorer, threshold, model_version=model_version).withColumns({
            "scan_id": scan_id, "observed_at_utc": F.col("captured_at_utc"), "network_id": network_id(F.col("interface_guid"), F.col("bssid_hash")),
            "model_version_id": F.lit(model_version_id).cast("long")})
        told = fresh.select("scan_id", F.col("captured_at_utc").alias("observed_at_utc"), *[
            F.coalesce(c, F.lit(0)).alias(n) for c, n in (("_interfaces", "interface_count"), ("_networks", "total_networks"))])
        store.ingest(rows, out, scans=told, repeated="left out", batch=f"s-{stream}-{number}")

    return (scans.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def end_marker(rows: DataFrame, time: str, after: str = "1 day") -> DataFrame:
    """The last row of a finished source: NULLs, and a time far behind all others.

    Written as the last file of the source, it lets the watermark pass every open window and timer. No operator here emits it.
    """
    late = rows.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time))
    return late.select(*[F.col(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def beacon_stream(stream: DataFrame, time: str = "event_time", watermark: str = "10 seconds") -> DataFrame:
    """Mean signal of every network group per second of event time, with the label of the earliest beacon.

    Later beacons than the watermark are dropped. Windows lie on the event clock, so they equal the batch profile of
    elapsed times where sessions begin on whole windows.
    """
    keyed = stream.withWatermark(time, watermark).withColumns({
        "_attack": F.coalesce(F.col("attack_type"), F.lit("")), "_bssid": F.coalesce("bssid", F.lit(MISSING_BSSID)),
        "_order": F.struct("elapsed_ms", "event_id")})
    means = keyed.groupBy(F.window(time, "1 second").alias("w"), *GROUP_KEYS).agg(
        F.avg("rssi_dbm").alias("rssi_mean_dbm"), F.min_by("label", "_order").alias("label"),
        F.min_by("is_synthetic", "_order").alias("is_synthetic"))
    return means.where(F.col("rssi_mean_dbm").isNotNull()).select(
        "w", "source_dataset", "session_id", stable_group_id(F.col("source_dataset"), F.col("_bssid")).alias("network_identity_id"),
        stable_group_id(*[F.col(c) for c in GROUP_KEYS]).alias("network_group_id"), "_attack", "label", "is_synthetic", "rssi_mean_dbm")


def rssi_stream(stream: DataFrame, time: str = "event_time", watermark: str = "10 seconds") -> DataFrame:
    """Five-second signal statistics over the one-second means, as in the batch profile: two event-time aggregations in
    one stream. A window is emitted once the watermark passed it; `end_marker` closes those at the end."""
    second = F.col("w.start")
    return beacon_stream(stream, time, watermark).groupBy(
        F.window(F.window_time("w"), "5 seconds").alias("w5"), "source_dataset", "session_id", "network_identity_id", "network_group_id",
        "_attack", "label", "is_synthetic").agg(
        F.avg("rssi_mean_dbm").alias("mean"), F.stddev_pop("rssi_mean_dbm").alias("rssi_std_db"),
        F.min("rssi_mean_dbm").alias("rssi_min_dbm"), F.max("rssi_mean_dbm").alias("rssi_max_dbm"),
        (F.max_by("rssi_mean_dbm", second) - F.min_by("rssi_mean_dbm", second)).alias("rssi_delta_db"),
        F.count(F.lit(1)).alias("window_count"),
    ).select(F.col("w5.start").alias("window_start"), F.col("w5.end").alias("window_end"), "source_dataset", "session_id",
             "network_identity_id", "network_group_id", "label", F.nullif("_attack", F.lit("")).alias("attack_type"), "is_synthetic",
             F.col("mean").alias("rssi_mean_dbm"), "rssi_std_db", "rssi_min_dbm", "rssi_max_dbm", "rssi_delta_db", "window_count")


FALLS = "bssid_hash string, previous_scan long, scan_index long, previous_tsf_us long, tsf_us long"
# Per bucket of BSSIDs: the last final scan of each, and the scans the watermark has not passed yet.
WATCHED = ("names array<string>, scans array<long>, tsfs array<long>, ats array<long>, "
           "open_names array<string>, open_scans array<long>, lows array<long>, highs array<long>, times array<long>")
#: BSSIDs share the state and the calls of a bucket, as a call costs much more than the rows of one BSSID.
WATCH_BUCKETS = 2048


def _watch(keep_ms: int):
    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Holds the last scan of every BSSID of a bucket and its highest counter, and emits every fall to the next scan.

        A scan is final once the watermark passed it, so scans may arrive in any order and in any number of files; until then it
        is folded to its extremes. A BSSID with nothing open is dropped when the watermark is `keep_ms` past its last scan.
        """
        held = state.get if state.exists else ([],) * 9
        last = {name: tuple(scan) for name, *scan in zip(*held[:4])}
        open_scans = {(name, scan): tuple(rest) for name, scan, *rest in zip(*held[4:])}
        for pdf in batches:
            # The end marker and rows without a BSSID take no part.
            rows = pdf[pdf["tsf_us"].notna() & pdf["bssid_hash"].notna() & (pdf["bssid_hash"] != "")]
            if rows.empty:
                continue
            folded = rows.groupby(["bssid_hash", "scan_index"]).agg({"tsf_us": ["min", "max"], "ms": "min"})
            for (name, scan), low, high, at in folded.itertuples(name=None):
                old = open_scans.get((name, int(scan)), (low, high, at))
                open_scans[name, int(scan)] = (int(min(low, old[0])), int(max(high, old[1])), int(min(at, old[2])))
        watermark, falls = state.getCurrentWatermarkMs(), []
        for name, scan in sorted((s for s in open_scans if open_scans[s][2] <= watermark), key=lambda s: (open_scans[s][2], s[1])):
            low, high, at = open_scans.pop((name, scan))
            before = last.get(name)
            if before is not None and scan == before[0]:
                last[name] = (scan, max(high, before[1]), before[2])
                continue
            if before is not None and at - before[2] <= keep_ms and low < before[1]:
                falls.append((name, before[0], scan, before[1], low))
            last[name] = (scan, high, at)
        waiting = {name for name, _ in open_scans}
        last = {name: scan for name, scan in last.items() if name in waiting or scan[2] + keep_ms > watermark}
        if not last and not open_scans:
            if state.exists:
                state.remove()
        else:
            closed = [[*c] for c in zip(*((name, *scan) for name, scan in last.items()))] or [[]] * 4
            opened = [[*c] for c in zip(*((*s, *v) for s, v in open_scans.items()))] or [[]] * 5
            state.update((*closed, *opened))
            timers = [at for _, _, at in open_scans.values()] + [at + keep_ms for name, (_, _, at) in last.items() if name not in waiting]
            state.setTimeoutTimestamp(max(min(timers), watermark + 1))
        if falls:
            yield pd.DataFrame(falls, columns=["bssid_hash", "previous_scan", "scan_index", "previous_tsf_us", "tsf_us"])
    return watch


def tsf_watch(stream: DataFrame, time: str = "event_time", watermark: str = "10 seconds", keep: str = "1 hour") -> DataFrame:
    """Falls of the uptime counter per BSSID from one scan to the next, as in the batch check.

    Falls across a gap of more than `keep` are not looked for; that bounds the state to the BSSIDs seen within it. Rows
    without a BSSID are dealt out over all buckets.
    """
    bucket = F.pmod(F.when(F.coalesce("bssid_hash", F.lit("")) != "", F.xxhash64("bssid_hash")).otherwise(F.xxhash64(time, "tsf_us")), F.lit(WATCH_BUCKETS))
    rows = stream.withWatermark(time, watermark).select(
        bucket.alias("bucket"), "bssid_hash", F.col("scan_index").cast("long").alias("scan_index"), F.col("tsf_us").cast("long").alias("tsf_us"), time,
        F.unix_millis(time).alias("ms"))
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("bucket").applyInPandasWithState(
        _watch(keep_ms), FALLS, WATCHED, "append", GroupStateTimeout.EventTimeTimeout)
