"""Fingerprint sessions kept as four files whose lines belong together, and their lookup files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.functions.text import position_key, strip
from wavelark.operators.ordering import with_position

PARTS = ["timestamps", "coordinates", "rssis", "channels"]
# Collection folder and the mode its sessions were recorded in.
MODES = {"site_surveys": "site_survey", "mon_devices": "monitoring_device"}


def read_numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines with their number in the file. Large files stay split: a line is counted inside its
    split, and the lines of the earlier splits are added."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seen"))
    return with_position(lines, ["file"], [F.col("_seen")], F.col("_split"), "line", "lines").drop("_split", "_seen", "lines")


def align(parts: DataFrame) -> DataFrame:
    """One row per sample out of (collection, session_id, part, line, value); every part must have every line."""
    columns = [F.max(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in PARTS]
    rows = parts.groupBy("collection", "session_id", "line").agg(F.count(F.lit(1)).alias("_n"), *columns)
    bad = F.raise_error(F.concat(F.lit("files of different length in "), "session_id"))
    return rows.select(
        F.when(F.col("_n") == len(PARTS), F.col("collection")).otherwise(bad).alias("collection"), "session_id", "line", *PARTS)


def read_aligned_sessions(spark: SparkSession, root: str, collection: str = "all") -> DataFrame:
    folders = list(MODES) if collection == "all" else [collection]
    lines = read_numbered_lines(spark, [f"{root}/data/{f}/*/{p}.csv" for f in folders for p in PARTS])
    where = "/data/([^/]+)/([^/]+)/([^/]+)\\.csv$"
    folder = F.regexp_extract("file", where, 1)
    mode = F.when(folder == "site_surveys", MODES["site_surveys"]).otherwise(MODES["mon_devices"])
    return align(lines.select(
        folder.alias("collection"), F.concat_ws("_", mode, F.regexp_extract("file", where, 2)).alias("session_id"),
        F.regexp_extract("file", where, 3).alias("part"), "line", "value"))


def _fields(lines: DataFrame, count: int) -> DataFrame:
    parts = F.split(strip(F.col("value")), ",")
    return lines.select("line", parts.alias("p")).where(F.size("p") >= count)


def _last_of_key(rows: DataFrame, key, value) -> DataFrame:
    keyed = rows.select("line", key.alias("key"), value.alias("id")).where(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.max_by("id", "line").alias("id"))


def monitor_points(lines: DataFrame) -> DataFrame:
    """Device id by rounded x, y, z out of `id,x,y,z` lines; a later line replaces an earlier one."""
    rows = _fields(lines, 4)
    x, y, z = (F.col("p")[i].try_cast("double") for i in (1, 2, 3))
    return _last_of_key(rows, position_key(x, y, z), F.col("p")[0])


def reference_points(lines: DataFrame) -> DataFrame:
    """Reference point by rounded x, y out of `id,x,y` lines."""
    rows = _fields(lines, 3)
    x, y = (F.col("p")[i].try_cast("double") for i in (1, 2))
    return _last_of_key(rows, position_key(x, y), F.concat(F.lit("rp_"), F.col("p")[0]))


def read_monitor_points(spark: SparkSession, path: str) -> DataFrame:
    return monitor_points(read_numbered_lines(spark, path))


def read_reference_points(spark: SparkSession, path: str) -> DataFrame:
    return reference_points(read_numbered_lines(spark, path))
