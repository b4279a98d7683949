"""Session settings and the shared folder used to cut long plans."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "wavelark", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; all of them can be changed on a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Window keys are many and small, so keep object aggregates hashed well past 128 keys.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach. Local sessions may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="wavelark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    The copy survives lost executors, and its known file size lets the planner choose a
    broadcast only when the table really is below the broadcast threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
