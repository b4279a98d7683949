"""Intermediate tables in the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.session import shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: cuts lineage, and a lost executor costs nothing that was done before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join with at most so many rows of a few numbers is sent whole to every executor.
BROADCAST_ROWS = 1_000_000


def sized(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table of narrow rows for broadcasting if it is counted to be small; else joins shuffle."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: a plain one belongs to Spark's default file system, as in Spark's own readers."""
    if "://" in path:
        return path
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full

#: Rows and bytes of an Arrow batch of texts, at most.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 2000, 8 << 20


def text_batches(spark: SparkSession) -> SparkSession:
    """Rows of texts are large: smaller Arrow batches than Spark's default bound what executors and their workers hold at once."""
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-"))
        if not 0 < held <= most:
            spark.conf.set(key, str(most))
    return spark


def drawn(share: float, *columns: str):
    """Whether a row belongs to a sample of the given share, by a hash of its contents: the same rows however they are partitioned."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
