"""Is a set of scans complete enough to be collected as normal data?"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import number
from wavelark.operators.checks import rate
from wavelark.operators.ordering import with_previous

# Limits of the readiness gate.
MIN_SCANS, MIN_BSSID, MIN_OBSERVABLE, MIN_OPTIONAL, MIN_TSF = 3, 0.99, 0.70, 0.50, 0.90
NUMERIC_FIELDS = ["rssi_dbm", "beacon_interval_ms", "tsf_us", "center_frequency_khz"]


def _present(name):
    return F.col(name).isNotNull()


def _positive(name):
    return number(F.col(name)) > 0


COVERAGE_RULES = {
    "ssid_hash": lambda: _present("ssid_hash"),
    "bssid_hash": lambda: _present("bssid_hash"),
    "security_type": lambda: _present("security_type"),
    "security_strength": lambda: _present("security_strength"),
    "rssi_dbm": lambda: _present("rssi_dbm"),
    "beacon_interval_positive": lambda: _positive("beacon_interval_ms"),
    "tsf_positive": lambda: _positive("tsf_us"),
    "host_timestamp_positive": lambda: _positive("host_timestamp_100ns"),
    "center_frequency_positive": lambda: _positive("center_frequency_khz"),
    "ie_blob_nonempty": lambda: _positive("ie_blob_size"),
    "ie_parser_not_truncated": lambda: ~F.col("ie_parser_truncated"),
    "ds_parameter_channel": lambda: _present("ds_parameter_channel"),
}


def _coverage_row(rows: DataFrame) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(rule()).alias(name) for name, rule in COVERAGE_RULES.items()])
    return counts.select("_rows", *[rate(F.col(n), F.col("_rows")).alias(n) for n in COVERAGE_RULES])


def coverage(rows: DataFrame) -> DataFrame:
    """Share of rows that meet each of the twelve field rules."""
    one = _coverage_row(rows)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(n).alias("coverage")) for n in COVERAGE_RULES])))


def numeric_summary(rows: DataFrame, columns: Sequence[str] = tuple(NUMERIC_FIELDS)) -> DataFrame:
    values = {c: number(F.col(c)) for c in columns}
    finite = {c: F.when(F.abs(v) < float("inf"), v) for c, v in values.items()}
    one = rows.agg(*[a for c, v in finite.items() for a in (
        F.count(v).alias(f"n_{c}"), F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}"), F.avg(v).alias(f"avg_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("field"), F.col(f"n_{c}").alias("count"), F.col(f"lo_{c}").alias("min"),
        F.col(f"hi_{c}").alias("max"), F.col(f"avg_{c}").alias("mean")) for c in columns])))


def tsf_continuity(rows: DataFrame, block_scans: int = 4096) -> DataFrame:
    """How often the uptime counter of a BSSID goes back from one scan to the next.

    Inside a scan values are taken in rising order, so only the step from the highest value of a
    scan to the lowest of the next can fall; per (BSSID, scan) extremes are all that is needed.
    """
    timed = rows.where((F.col("bssid_hash") != "") & F.col("tsf_us").isNotNull())
    scans = timed.groupBy("bssid_hash", "scan_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("tsf_us").alias("low"), F.max("tsf_us").alias("high"))
    steps = with_previous(scans, ["bssid_hash"], ["scan_index"],
                          F.floor(F.coalesce("scan_index", F.lit(-1)) / block_scans), {"before": "high"})
    per_bssid = steps.groupBy("bssid_hash").agg(
        F.sum("n").alias("n"), F.count_if(F.col("low") < F.col("before")).alias("down"))
    totals = per_bssid.agg(
        F.count(F.lit(1)).alias("unique_bssids_with_tsf"), F.count_if(F.col("n") >= 2).alias("repeated_bssids_with_tsf"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("transitions"),
        F.coalesce(F.sum("down"), F.lit(0).cast("long")).alias("decreasing_transitions"))
    up = F.col("transitions") - F.col("decreasing_transitions")
    return totals.withColumns({
        "nondecreasing_transitions": up,
        "nondecreasing_rate": F.when(F.col("transitions") > 0, up / F.col("transitions"))})


def readiness(rows: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """One row: counts, rates, the gate and its warnings. `scans` also counts scans that saw nothing."""
    seen = scans.agg(F.count(F.lit(1)).alias("n")) if scans is not None else rows.agg(
        F.count_distinct("scan_index").alias("n"))
    identity = (F.col("ssid_hash") != "") & (F.col("bssid_hash") != "")
    observable = identity & _present("security_type") & _present("security_strength")
    per_bssid = rows.where(F.col("bssid_hash") != "").groupBy("bssid_hash").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("unique_bssids"), F.count_if(F.col("n") >= 2).alias("repeated_bssids"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_if(identity).alias("candidate_context_identity_rows"),
        F.count_if(observable).alias("observable_rows"),
        *[rate(F.count_if(COVERAGE_RULES[c]()), F.count(F.lit(1))).alias(f"_{c}")
          for c in ("bssid_hash", "ie_blob_nonempty", "tsf_positive")])
    b = per_bssid.select(F.struct("*").alias("b")).scalar()
    t = tsf_continuity(rows).select(F.struct("*").alias("t")).scalar()
    out = counts.withColumns({
        "scan_count": seen.select("n").scalar(), "unique_bssids": b["unique_bssids"],
        "repeated_bssids": b["repeated_bssids"], "tsf_nondecreasing_rate": t["nondecreasing_rate"],
        "observable_rate": rate(F.col("observable_rows"), F.col("observation_count"))})
    n, share = F.col("observation_count"), F.col("observable_rate")
    warnings = F.array_compact(F.array(
        F.when(F.col("scan_count") < MIN_SCANS, "few_scans"),
        F.when(n == 0, "no_observations"),
        F.when(F.col("_bssid_hash") < MIN_BSSID, "bssid_not_consistent"),
        F.when((n > 0) & (share < MIN_OBSERVABLE), "few_observable_rows"),
        F.when(F.col("_ie_blob_nonempty") < MIN_OPTIONAL, "elements_mostly_absent"),
        F.when(F.col("_tsf_positive") < MIN_OPTIONAL, "tsf_mostly_absent"),
        F.when(F.col("tsf_nondecreasing_rate") < MIN_TSF, "tsf_often_decreases")))
    ready = (F.col("scan_count") >= MIN_SCANS) & (n > 0) & (F.col("_bssid_hash") >= MIN_BSSID) & (share >= MIN_OBSERVABLE)
    return out.select(
        "scan_count", "observation_count", "unique_bssids", "repeated_bssids", "candidate_context_identity_rows",
        "observable_rows", "observable_rate", "tsf_nondecreasing_rate", ready.alias("ready"), warnings.alias("warnings"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
