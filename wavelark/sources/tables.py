"""Reading and writing of plain tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV or gzipped CSV by file name; a CSV without a schema is read as text columns."""
    name = path.rstrip("/").lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if name.endswith(".parquet"):
        return reader.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path)
    raise ValueError(f"unknown table format: {path}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv.gz":
        df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError(f"unknown table format: {fmt}")
    return path


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result that must not replace an earlier one."""
    return write_table(df, path, fmt, mode="errorifexists")
