"""What capture sessions there are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import rate, require_columns
from wavelark.operators.scan_validation import MIN_BSSID, MIN_OBSERVABLE, MIN_SCANS


def session_rollup(obs: DataFrame) -> DataFrame:
    """One row per session: environment, rows, scans and whether it is complete enough to use."""
    require_columns(obs, ["session_id", "environment", "scan_index", "ssid_hash", "bssid_hash", "security_type",
                          "security_strength"], "session rollup")
    observable = ~F.greatest(*[F.col(c).isNull() for c in ("ssid_hash", "bssid_hash", "security_type", "security_strength")])
    # Scans first: counting distinct scans then needs no second pass over the rows.
    scans = obs.groupBy("session_id", "scan_index").agg(
        F.min("environment").alias("environment"), F.count(F.lit(1)).alias("n"),
        F.count("bssid_hash").alias("b"), F.count_if(observable).alias("o"))
    return scans.groupBy("session_id").agg(
        F.min("environment").alias("environment"), F.sum("n").alias("rows"), F.count("scan_index").alias("scan_count"),
        ((F.count("scan_index") >= MIN_SCANS) & (rate(F.sum("b"), F.sum("n")) >= MIN_BSSID)
         & (rate(F.sum("o"), F.sum("n")) >= MIN_OBSERVABLE)).alias("runtime_ready"))
