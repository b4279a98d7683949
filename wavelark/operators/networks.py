"""Search, order and count the networks of a scan."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import strip
from wavelark.operators.ordering import dealt, with_position

SEARCHED = ["ssid", "bssid", "security_type", "phy_type", "suspicion_level"]
# Order of the levels and the text shown for a network without a name.
LEVEL_RANK = {"high": 4, "medium": 3, "unavailable": 2, "low": 1}
UNNAMED = "SSID não transmitido"


def search(df: DataFrame, q: str, level: str = "all") -> DataFrame:
    rows = df if level == "all" else df.where(F.col("suspicion_level") == level)
    text = F.lower(strip(F.lit(q)))
    if not q.strip():
        return rows
    hits = [F.coalesce(F.lower(c).contains(text), F.lit(False)) for c in SEARCHED if c in df.columns]
    return rows.where(reduce(lambda a, b: a | b, hits))


def _level() -> Column:
    return reduce(lambda acc, kv: acc.when(F.col("suspicion_level") == kv[0], kv[1]), LEVEL_RANK.items(), F)


def _order(mode: str) -> list[Column]:
    # Names follow the Portuguese collation: base letters first, neither case nor accents count.
    name = F.collate(F.coalesce(F.nullif("ssid", F.lit("")), F.lit(UNNAMED)), "pt_CI_AI")
    stable = [F.desc("rssi_dbm"), F.lower(F.coalesce("ssid", F.lit(""))), F.col("bssid")]
    first = {"default": [], "signal_desc": [F.desc("rssi_dbm")], "signal_asc": [F.asc("rssi_dbm")],
             "ssid_asc": [name], "suspicion_desc": [_level().desc()]}
    if mode not in first:
        raise ValueError(f"unknown order {mode}")
    return [*first[mode], *stable]


def sort(df: DataFrame, mode: str = "default") -> DataFrame:
    return df.orderBy(*_order(mode))


def positions(df: DataFrame, mode: str, tie: str) -> DataFrame:
    """Adds the place of every network in any of the orders, by ranges of the order, so that no task sorts them all.

    `tie` tells networks apart that are equal otherwise.
    """
    order = [*_order(mode), F.col(tie)]
    return with_position(dealt(df, [], order), [], order, F.col("_block"))


def suspicion_counts(df: DataFrame) -> DataFrame:
    levels = df.sparkSession.createDataFrame([(v,) for v in LEVEL_RANK], "suspicion_level string")
    counts = df.groupBy("suspicion_level").agg(F.count(F.lit(1)).alias("networks"))
    return levels.join(counts, "suspicion_level", "left").select(
        "suspicion_level", F.coalesce("networks", F.lit(0).cast("long")).alias("networks"))


def page_totals(scans: DataFrame) -> DataFrame:
    """Sums over the scans of one history page."""
    return scans.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name) for c, name in [
        ("total_networks", "observations"), ("anomaly_count", "anomalies"), ("insufficient_history_count", "insufficient")]])
