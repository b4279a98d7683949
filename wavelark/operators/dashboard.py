"""Dashboard figures over the scan store."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import rate
from wavelark.operators.history import list_detections, list_models_of, list_scans, page, scan_counts

LEVELS = ["low", "medium", "high", "unavailable"]


def _row(df: DataFrame):
    return df.select(F.struct("*").alias("x")).scalar()


def overview(db) -> DataFrame:
    """One row of counts, rates and latest times; zeros on an empty store."""
    scans = _row(db["scan_session"].agg(F.count(F.lit(1)).alias("n"), F.max("observed_at_utc").alias("t")))
    features = _row(db["network_features"].agg(F.count(F.lit(1)).alias("n")))
    models = _row(db["model_version"].agg(F.count(F.lit(1)).alias("n")))
    verdict = F.col("is_anomaly")
    detections = _row(db["detection"].agg(
        F.count(F.lit(1)).alias("n"), F.count_if(verdict).alias("a"), F.count_if(~verdict).alias("ok"),
        F.count_if(verdict.isNull()).alias("u"), F.max("created_at_utc").alias("t")))
    networks = db["network_observation"].groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("observation_count"),
        F.count("network_id").alias("unique_network_count"))
    return networks.select(
        scans["n"].alias("scan_count"), "observation_count", "unique_network_count", features["n"].alias("feature_count"),
        detections["n"].alias("detection_count"), detections["a"].alias("anomaly_count"),
        detections["ok"].alias("normal_count"), detections["u"].alias("insufficient_history_count"),
        models["n"].alias("model_version_count"),
        rate(detections["n"], F.col("observation_count")).alias("analysis_coverage_rate"),
        rate(detections["a"], detections["a"] + detections["ok"]).alias("anomaly_rate_among_decided"),
        scans["t"].alias("latest_scan_at_utc"), detections["t"].alias("latest_detection_at_utc"))


def suspicion_distribution(db) -> DataFrame:
    levels = db["detection"].sparkSession.createDataFrame([(v,) for v in LEVELS], "suspicion_level string")
    counts = db["detection"].groupBy("suspicion_level").agg(F.count(F.lit(1)).alias("detections"))
    return levels.join(counts, "suspicion_level", "left").select(
        "suspicion_level", F.coalesce("detections", F.lit(0).cast("long")).alias("detections"))


def trends(db, limit: int = 30) -> DataFrame:
    """The newest scans with their counts, oldest first."""
    newest = page(db["scan_session"], [F.desc("observed_at_utc"), F.desc("id")], limit, 0)
    return scan_counts(db, newest.select("id", "observed_at_utc", "scan_date", F.col("total_networks").alias("network_count"))).orderBy(
        "observed_at_utc", "id")


def active_model(db) -> DataFrame:
    one = page(db["model_version"].where("active"), [F.desc("created_at_utc"), F.desc("id")], 1, 0)
    return list_models_of({**db, "model_version": one}, one.select(F.col("id").alias("model_version_id")))


def recent(db, n: int = 5) -> dict[str, DataFrame]:
    return {"scans": list_scans(db, n), "detections": list_detections(db, n), "active_model": active_model(db)}


def latest(db) -> DataFrame:
    """One row: the latest scan and detection and the active model, NULL where there is none."""
    scan = _row(list_scans(db, 1))
    detection = _row(list_detections(db, 1))
    model = _row(active_model(db))
    one = db["scan_session"].agg(F.count(F.lit(1)).alias("_"))
    return one.select(
        scan["observed_at_utc"].alias("latest_scan_at_utc"), scan["total_networks"].alias("latest_scan_network_count"),
        scan["detection_count"].alias("latest_scan_detection_count"),
        scan["anomaly_count"].alias("latest_scan_anomaly_count"),
        scan["insufficient_history_count"].alias("latest_scan_insufficient_history_count"),
        detection["created_at_utc"].alias("latest_detection_at_utc"),
        detection["suspicion_level"].alias("latest_detection_suspicion_level"),
        detection["is_anomaly"].alias("latest_detection_is_anomaly"), model["version_name"].alias("active_model"))
