"""Beacon capture files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.functions.text import number
from wavelark.operators.normalize import normalize_beacons


def read_beacon_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Raw rows of `session_*/*.csv`, each with the session its folder names."""
    raw = spark.read.option("header", True).csv(f"{root}/session_*/*.csv")
    return raw.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), "/(session_[^/]*)/[^/]*$", 1))


def read_normal_beacons(spark: SparkSession, root: str) -> DataFrame:
    return normalize_beacons(read_beacon_sessions(spark, root), F.col("session_id"), 0)


def labelled_rogue(processed: DataFrame) -> DataFrame:
    """Canonical attack rows: those marked as rogue, typed where the capture names a type."""
    rogue = processed.where(number(F.col("is_rogue")) == 1)
    kind = F.col("_rogue_type") if "_rogue_type" in processed.columns else F.lit("rogue")
    return normalize_beacons(rogue, "synthetic_rogue", 1, kind, True)


def read_labelled_rogue(spark: SparkSession, path: str) -> DataFrame:
    return labelled_rogue(spark.read.option("header", True).csv(path))
