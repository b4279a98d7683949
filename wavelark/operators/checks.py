"""Entry checks and row rules."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")


def present_or_fail(name: str, what: str) -> Column:
    """The column itself; the job fails on the first NULL it meets."""
    return (
        F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{what}: NULL in {name}")))
        .otherwise(F.col(name))
        .alias(name)
    )


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
