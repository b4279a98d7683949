"""Paged history over the scan store. `db` maps table names to DataFrames.

Pages are cut first, with a top-k that never sorts the whole table, and fetched: a page has at most `MAX_PAGE` rows. Counts
are then made only for its rows, in the partitions of its dates. Look-ups by id take their dates from the store's manifest.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.sources.store import FEATURE_COLUMNS, dates_of

MAX_PAGE = 200


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def fetched(few: DataFrame) -> DataFrame:
    """At most a page of rows, evaluated once."""
    return few.sparkSession.createDataFrame(few.limit(MAX_PAGE).collect(), few.schema)


def _on_dates(table: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of the given few keys; only the partitions between their dates are read."""
    days = [r["scan_date"] for r in few.select("scan_date").collect() if r["scan_date"] is not None]
    near = F.col("scan_date").between(min(days), max(days)) if days else F.lit(False)
    return table.where(near).join(F.broadcast(few.select(key)), key, "left_semi")


def _on(table: DataFrame, dates: list | None) -> DataFrame:
    return table if dates is None else table.where(F.col("scan_date").isin(dates) if dates else F.lit(False))


def scan_counts(db: dict[str, DataFrame], scans: DataFrame) -> DataFrame:
    """The given few scans with their feature, detection, anomaly and undecided counts."""
    scans = fetched(scans)
    few = scans.select(F.col("id").alias("scan_session_id"), "scan_date")
    features = _on_dates(db["network_features"], few, "scan_session_id").groupBy("scan_session_id").agg(F.count(F.lit(1)).alias("feature_count"))
    verdict = F.col("is_anomaly")
    detections = _on_dates(db["detection"], few, "scan_session_id").groupBy("scan_session_id").agg(
        F.count(F.lit(1)).alias("detection_count"), F.count_if(verdict).alias("anomaly_count"),
        F.count_if(~verdict).alias("normal_count"), F.count_if(verdict.isNull()).alias("insufficient_history_count"))
    out = scans.withColumn("scan_session_id", F.col("id")).join(features, "scan_session_id", "left").join(
        detections, "scan_session_id", "left")
    counts = ["feature_count", "detection_count", "anomaly_count", "normal_count", "insufficient_history_count"]
    return out.select(*[c for c in scans.columns if c != "scan_date"], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


# Columns of a listed scan.
SCAN_PAGE = ["id", "observed_at_utc", "total_networks", "interface_count", "scan_date"]


def list_scans(db, limit: int = 25, offset: int = 0) -> DataFrame:
    newest = page(db["scan_session"], [F.desc("observed_at_utc"), F.desc("id")], limit, offset)
    return scan_counts(db, newest.select(*SCAN_PAGE)).drop("normal_count")


def _with_analysis(db, observations: DataFrame) -> DataFrame:
    """Observations with their features and latest detection."""
    observations = fetched(observations)
    few = observations.select(F.col("id").alias("network_observation_id"), "scan_date")
    features = _on_dates(db["network_features"], few, "network_observation_id").select(
        "network_observation_id", *FEATURE_COLUMNS, "context_available", "context_resolution", "feature_complete")
    latest = _on_dates(db["detection"], few, "network_observation_id").groupBy(
        "network_observation_id").agg(F.max_by(F.struct(
            F.col("id").alias("detection_id"), "model_version_id", "anomaly_score", "threshold", "is_anomaly",
            "suspicion_level"), "id").alias("d")).select("network_observation_id", "d.*")
    return observations.withColumn("network_observation_id", F.col("id")).join(
        features, "network_observation_id", "left").join(latest, "network_observation_id", "left").drop(
        "network_observation_id", "scan_date")


def scan_observations(db, scan_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = _on(db["network_observation"], dates_of(db, "first_scan", "last_scan", scan_id)).where(F.col("scan_session_id") == scan_id)
    return _with_analysis(db, page(rows, ["id"], limit, offset))


def scan_detail(db, scan_id: str) -> DataFrame:
    scans = _on(db["scan_session"], dates_of(db, "first_scan", "last_scan", scan_id)).where(F.col("id") == scan_id)
    return scan_counts(db, scans.select(*SCAN_PAGE)).drop("normal_count")


def list_detections(db, limit: int = 50, offset: int = 0, is_anomaly: bool | None = None,
                    suspicion_level: str | None = None, model_version_id: int | None = None) -> DataFrame:
    return page(filter_detections(db, is_anomaly, suspicion_level, model_version_id),
                [F.desc("created_at_utc"), F.desc("id")], limit, offset).drop("scan_date")


def filter_detections(db, is_anomaly=None, suspicion_level=None, model_version_id=None) -> DataFrame:
    rows = db["detection"]
    if is_anomaly is not None:
        rows = rows.where(F.col("is_anomaly") == F.lit(is_anomaly))
    if suspicion_level:
        rows = rows.where(F.col("suspicion_level") == suspicion_level)
    if model_version_id is not None:
        rows = rows.where(F.col("model_version_id") == model_version_id)
    return rows


def detection_detail(db, detection_id: int) -> DataFrame:
    """The detection with its observation, that observation's features and the model's record."""
    dates = dates_of(db, "first_id", "last_id", detection_id)
    one = fetched(_on(db["detection"], dates).where(F.col("id") == detection_id))
    d = one.select(*[F.col(c).alias(f"detection_{c}") for c in one.columns if c != "scan_date"])
    few = one.select("network_observation_id", "scan_date")
    observations = _on_dates(db["network_observation"], few.withColumnRenamed("network_observation_id", "id"), "id").drop("scan_date")
    o = observations.select(*[F.col(c).alias(f"observation_{c}") for c in observations.columns])
    f = _on_dates(db["network_features"], few, "network_observation_id").select(F.col("network_observation_id").alias("_f"), *FEATURE_COLUMNS)
    m = list_models_of(db, one.select("model_version_id")).select(
        F.col("id").alias("_m"), "version_name", "algorithm", F.col("threshold").alias("model_threshold"), "active",
        "detection_count")
    return (d.join(o, F.col("detection_network_observation_id") == F.col("observation_id"))
            .join(f, F.col("observation_id") == F.col("_f"), "left")
            .join(m, F.col("detection_model_version_id") == F.col("_m"), "left").drop("_f", "_m"))


def list_models_of(db, ids: DataFrame | None) -> DataFrame:
    """Models with their detection counts, all or those of a few given ids."""
    models, detections = db["model_version"], db["detection"]
    if ids is not None:
        few = F.broadcast(ids.select("model_version_id").distinct())
        models = models.join(few, models["id"] == F.col("model_version_id"), "left_semi")
        detections = detections.join(few, "model_version_id", "left_semi")
    counts = detections.groupBy(F.col("model_version_id").alias("_id")).agg(F.count(F.lit(1)).alias("detection_count"))
    return models.join(counts, F.col("id") == F.col("_id"), "left").drop("_id").withColumn(
        "detection_count", F.coalesce("detection_count", F.lit(0).cast("long")))


def list_models(db, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(list_models_of(db, None), [F.desc("active"), F.desc("created_at_utc"), F.desc("id")], limit, offset)


def get_model(db, model_version_id: int) -> DataFrame:
    ids = db["model_version"].where(F.col("id") == model_version_id).select(F.col("id").alias("model_version_id"))
    return list_models_of(db, ids)
