"""Plausibility flags on window profiles."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import number


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def beacon_flags(df: DataFrame, lo: float = -110.0, hi: float = 0.0) -> DataFrame:
    plausible = _holds(number(F.col("rssi_mean_dbm")).between(lo, hi))
    frequency = _holds(number(F.col("frequency_mhz")) > 0)
    counted = _holds(number(F.col("beacon_count")) >= 1)
    return df.withColumns({
        "q_rssi_plausible": plausible,
        "q_frequency_present": frequency,
        "q_beacon_count_positive": counted,
        "q_inter_beacon_positive": _holds(number(F.col("observed_inter_beacon_ms")) > 0),
        "q_beacon_core": plausible & frequency & counted,
    })


def temporal_flags(df: DataFrame, lo: float = -110.0, hi: float = 0.0) -> DataFrame:
    plausible = reduce(lambda a, b: a & b, [
        _holds(number(F.col(c)).between(lo, hi))
        for c in ("rssi_mean_dbm", "rssi_min_dbm", "rssi_max_dbm")])
    complete = reduce(lambda a, b: a & b, [
        number(F.col(c)).isNotNull() for c in ("rssi_std_db", "rssi_delta_db", "window_count")])
    several = _holds(number(F.col("window_count")) >= 2)
    basic = plausible & complete & _holds(number(F.col("window_count")) >= 1)
    return df.withColumns({
        "q_rssi_plausible": plausible,
        "q_temporal_complete": complete,
        "q_window_has_multiple_samples": several,
        "q_temporal_basic": basic,
        "q_temporal_rich": basic & several,
    })


def filter_temporal_rich(df: DataFrame) -> DataFrame:
    return temporal_flags(df).where("q_temporal_rich")


def quality_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows, passes, failures and pass rate per flag; a NULL flag is a failure."""
    known = [f for f in flags if f in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(f).cast("boolean")).alias(f) for f in known])
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("passed")) for f in known])
    return totals.select("rows", F.inline(pairs)).select(
        "flag", "rows", "passed",
        (F.col("rows") - F.col("passed")).alias("failed"),
        F.when(F.col("rows") > 0, F.col("passed") / F.col("rows")).alias("pass_rate"),
    )
