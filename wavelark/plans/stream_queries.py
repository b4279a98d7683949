from pyspark.sql import functions as F

from wavelark.plans.capture_queries import scan_documents
from wavelark.plans.catalog import query, rounded, rounded_sql
from wavelark.plans.model_queries import KERNEL, kernel_parts, kernel_score
from wavelark.plans.oracle_views import DESKTOP, TEMPORAL
from wavelark.plans.views import EPOCH_US, desktop_rows, observations, ticks
from wavelark.schema import DESKTOP_FEATURES
from wavelark.session import fresh_path, stored
from wavelark.sources import store
from wavelark.sources.scans import stream_scan_jsonl
from wavelark.streaming import jobs

RSSI = ["rssi_mean_dbm", "rssi_std_db", "rssi_min_dbm", "rssi_max_dbm", "rssi_delta_db"]


def streamed(df, name):
    """Write rows to files and read those files as a stream."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def collected(stream, name):
    """Run a stream over what is there and hand back what it wrote."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    drained(stream, out, fresh_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def drained(stream, out, state):
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def replayed(df, part, parts, job, name, time="event_time"):
    """Let rows arrive part by part, each in files of its own that a restarted stream takes up, then the end marker."""
    spark = df.sparkSession
    source, out, state = (fresh_path(spark, f"{name}-{x}") for x in ("source", "out", "state"))
    for arriving in [*(df.where(part == i) for i in range(parts)), jobs.end_marker(df, time)]:
        arriving.write.mode("append").parquet(source)
        stream = job(spark.readStream.schema(df.schema).parquet(source))
        drained(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


# Every scan as the four stored tables hold it, and one scan a session that saw no network.
@query("scan_stream_scoring", f"""WITH {KERNEL} SELECT d.session_id || '-' || event_id AS scan_id, epoch_us(captured_at_utc) AS observed_us, 1 AS total_networks, 1 AS interface_count,
    sha256(interface_guid || '|' || bssid_hash) AS network_id, ssid_hash, bssid_hash, tsf_us, ssid_bssid_count, bssid_changed, security_changed,
    security_strength_delta, context_resolution, d.feature_complete, CASE WHEN d.feature_complete THEN score + 0.0 END AS anomaly_score,
    CASE WHEN d.feature_complete THEN score > 0.25 END AS is_anomaly,
    CASE WHEN NOT d.feature_complete THEN 'Histórico normal insuficiente para aplicar desktop_candidate_v1 a esta rede.'
        WHEN score > 0.25 THEN 'Observação acima do threshold de anomalia.' ELSE 'Observação dentro do comportamento esperado pelo modelo.' END AS reason
FROM dctx d JOIN (SELECT event_id, score FROM kscore) USING (event_id)
UNION ALL SELECT session_id || '--1', min(epoch_us(captured_at_utc)), 0, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM desk GROUP BY session_id""")
def scan_stream_scoring(spark, sf_dir):
    docs = scan_documents(spark, sf_dir)
    nothing = F.array(F.struct(F.struct(F.lit("quiet").alias("guid")).alias("interface"), F.array().cast("array<string>").alias("bss_entries")))
    quiet = stored(docs.groupBy("session_id").agg(F.min("captured_at_utc").alias("captured_at_utc")), "quiet").withColumns(
        {"scan_index": F.lit(-1).cast("long"), "interfaces": nothing})
    path, out, state = (fresh_path(spark, f"scan-stream-{x}") for x in ("in", "out", "state"))
    _, ref, scaler, support = kernel_parts(spark, sf_dir)
    late = F.col("session_id") >= "sess_06"
    # Files arrive in two runs; the second repeats scans of the first, with and without networks.
    for arriving in (docs.where(~late), docs.where(late | (F.col("scan_index") % 5 == 0))):
        arriving.write.mode("append").json(path)
        quiet.write.mode("append").json(path)
        jobs.score_stream(stream_scan_jsonl(spark, path), ref, scaler, kernel_score(support), 0.25, out, state, "home").awaitTermination()
    db = store.read_store(spark, out)
    rows = db["network_observation"].select("id", "network_id", "ssid_hash", "bssid_hash", "tsf_us")
    features = db["network_features"].select("id", *DESKTOP_FEATURES, "context_resolution", "feature_complete")
    found = rows.join(features, "id").join(db["detection"].select("id", "anomaly_score", "is_anomaly", "reason"), "id")
    scans = db["scan_session"].select(F.col("id").alias("scan_id"), F.unix_micros("observed_at_utc").alias("observed_us"), "total_networks", "interface_count")
    # Scans meet the ids of their observations first, so the wide rows are dealt out once.
    of_scan = db["network_observation"].select("id", F.col("scan_session_id").alias("scan_id"))
    return scans.join(of_scan, "scan_id", "left").join(found, "id", "left").drop("id")


@query("stream_deduplication", "SELECT event_id, user_id FROM events")
def stream_deduplication(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("event_id", "user_id", F.timestamp_micros(F.col("us") + EPOCH_US).alias("event_time"))
    twice = rows.unionByName(rows)
    return collected(jobs.dedupe(streamed(twice, "repeated"), ["event_id"], "event_time"), "deduplicated").drop("event_time")


@query("stream_rssi_profile", f"""WITH {TEMPORAL} {rounded_sql("temporal", *RSSI)}""")
def stream_rssi_profile(spark, sf_dir):
    session_ms = F.substring("session_id", 6, 2).cast("long") * 15_000
    rows = observations(spark, sf_dir).withColumn("event_time", F.timestamp_millis(session_ms + F.col("elapsed_ms")))
    third = F.least(F.floor(F.substring("session_id", 6, 2).cast("int") / 4), F.lit(2))
    out = replayed(stored(rows, "timed"), third, 3, jobs.rssi_stream, "rssi")
    start = F.unix_millis("window_start") - session_ms
    return rounded(out.withColumn("window_start_ms", start.cast("double")).drop("window_start", "window_end"), *RSSI)


# Scans of a network that are more than an hour apart are not compared.
@query("stream_tsf_watch", f"""WITH {DESKTOP}, s AS (SELECT bssid_hash, CAST(substr(session_id, 6, 2) AS BIGINT) * 12 + scan_index AS scan, min(tsf_us) AS low, max(tsf_us) AS high FROM desk GROUP BY 1, 2),
l AS (SELECT bssid_hash, lag(scan) OVER w AS previous_scan, scan AS scan_index, lag(high) OVER w AS previous_tsf_us, low AS tsf_us FROM s WINDOW w AS (PARTITION BY bssid_hash ORDER BY scan))
SELECT * FROM l WHERE tsf_us < previous_tsf_us AND scan_index - previous_scan <= 60""")
def stream_tsf_watch(spark, sf_dir):
    scan = F.substring("session_id", 6, 2).cast("long") * 12 + F.col("scan_index")
    rows = desktop_rows(spark, sf_dir).select("bssid_hash", scan.alias("scan_index"), "tsf_us", F.timestamp_seconds(scan * 60 + EPOCH_US // 1_000_000).alias("event_time"))
    # Each part reaches ten scans into the next one, dealt to either by a hash, so scans arrive out of order.
    third = F.least(F.floor((F.col("scan_index") + F.pmod(F.xxhash64("bssid_hash", "tsf_us"), F.lit(10))) / 50), F.lit(2))
    return replayed(stored(rows, "counters"), third, 3, lambda stream: jobs.tsf_watch(stream, watermark="20 minutes"), "falls")
