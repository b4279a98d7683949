"""Scan documents, one JSON object per line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.functions.text import strip
from wavelark.schema import scan_schema
from wavelark.sources.aligned import read_numbered_lines

SHOWN_ERRORS = 10


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines that are no scan documents; lines are numbered from 1 through all splits of a file."""
    return _broken(read_numbered_lines(spark, path)).select("file", (F.col("line") + 1).alias("line"))


def _broken(lines: DataFrame) -> DataFrame:
    told = T.StructType([*scan_schema(), T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where((strip(F.col("value")) != "") & (parsed.isNull() | parsed["_corrupt"].isNotNull()))


def read_scan_jsonl(spark: SparkSession, path: str, located: bool = True) -> DataFrame:
    """Blank lines are skipped; a line that is not a scan document is refused with its file and number.

    To that end the lines are parsed once before; only if one is broken they are numbered. With `located=False` the first
    broken line fails the job that reads it, without its number.
    """
    if located and not _broken(spark.read.text(path)).isEmpty():
        found = broken_lines(spark, path).orderBy("file", "line").limit(SHOWN_ERRORS).collect()
        raise ValueError("malformed scan document: " + ", ".join(f"{r['file']} line {r['line']}" for r in found))
    return spark.read.schema(scan_schema()).option("mode", "FAILFAST").json(path)


def stream_scan_jsonl(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(scan_schema()).option("mode", "FAILFAST")
            .option("maxFilesPerTrigger", files_per_batch).json(path))
