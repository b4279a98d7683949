"""Registry of runnable queries, each with the SQL it is checked against where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Drops the last bits of floating sums, whose order differs between engines."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def rounded_sql(relation: str, *names: str, digits: int = 9) -> str:
    replaced = ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)
    return f"SELECT * REPLACE ({replaced}) FROM {relation}"
