"""The scan store: five tables in batches, a manifest that commits them, and the model registry.

A batch writes a folder of its own in every table, partitioned by the date of the scan and clustered by scan, and is committed by
one row per date in the manifest, written last. Readers see committed folders only, so the tables of a batch appear together; a batch
that was interrupted is written to new folders, and nothing a reader may hold is replaced. The manifest's ranges of ids lead from an id to its dates.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.functions.identity import hash_identifier
from wavelark.operators.checks import require_columns
from wavelark.operators.ordering import numbered
from wavelark.session import stored

# Tables and columns of the store, with their types.
TABLES = ["scan_session", "network_observation", "network_features", "detection", "model_version"]
SCAN_COLUMNS = {"negotiated_api_version": "string", "interface_count": "long", "total_networks": "long"}
OBSERVATION_COLUMNS = {
    "ssid_not_broadcast": "boolean", "rssi_dbm": "double", "link_quality": "long", "beacon_interval_ms": "double", "tsf_us": "long",
    "host_timestamp_100ns": "long", "center_frequency_khz": "long", "ds_parameter_channel": "long", "security_type": "string",
    "security_strength": "long", "security_source": "string", "phy_type": "string", "bss_type": "string",
    "supported_rates_mbps": "array<double>",
}
FEATURE_COLUMNS = ["ssid_bssid_count", "bssid_changed", "security_changed", "security_strength_delta"]
DETECTION_COLUMNS = {"anomaly_score": "double", "threshold": "double", "is_anomaly": "boolean", "suspicion_level": "string", "reason": "string",
                     "inference_ms": "double"}
MANIFEST = ("batch string, folder string, scan_date date, scans long, observations long, first_scan string, last_scan string, first_id long, last_id long")

SCHEMAS = {
    "scan_session": {"id": "string", "observed_at_utc": "timestamp", **SCAN_COLUMNS},
    "network_observation": {"id": "long", **dict.fromkeys(["scan_session_id", "network_id", "interface_guid_hash", "ssid_hash", "bssid_hash"], "string"),
                            **OBSERVATION_COLUMNS},
    "network_features": {"id": "long", "network_observation_id": "long", **dict.fromkeys(FEATURE_COLUMNS, "double"), "context_available": "boolean",
                         "context_resolution": "string", "feature_complete": "boolean", "scan_session_id": "string"},
    "detection": {"id": "long", "scan_session_id": "string", "network_observation_id": "long", "model_version_id": "long", **DETECTION_COLUMNS,
                  "created_at_utc": "timestamp"},
}


def _with(df: DataFrame, names: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()]


def _refused(df: DataFrame, held: DataFrame) -> DataFrame:
    """Fails on the first row of a scan that is stored already."""
    marked = df.join(held.distinct().withColumn("_held", F.lit(True)), "scan_id", "left")
    return marked.withColumn("scan_id", F.when(F.col("_held"), F.raise_error(F.lit("scan is stored already"))).otherwise(
        F.col("scan_id"))).drop("_held")


def persist_scans(scored: DataFrame, existing_scans: DataFrame | None = None, scans: DataFrame | None = None,
                  repeated: str = "fail") -> dict[str, DataFrame]:
    """Split scored observations into the four scan tables.

    Needs one row per observation with a unique, rising `observation_id`, its scan's id and time, the interface,
    ssid/bssid in clear or as ssid_hash/bssid_hash, and the analysis columns. `scans` (scan_id, observed_at_utc and, where told,
    interface_count, total_networks and negotiated_api_version) names all scans, also those that saw no network; numbers in columns
    that hold no NULL by their type are not looked for in the rows. A scan that is stored already is refused, whether it saw networks
    or not, or left out with `repeated="skip"`.
    """
    if repeated not in ("fail", "skip"):
        raise ValueError("repeated scans either fail or are skipped")
    require_columns(scored, ["scan_id", "observed_at_utc", "observation_id", "network_id", "interface_guid",
                             "ssid_not_broadcast", "status", "model_version_id"], "scan store")
    clear = "bssid" in scored.columns
    require_columns(scored, ["ssid", "bssid"] if clear else ["ssid_hash", "bssid_hash"], "scan store")
    rows = scored.withColumn("scan_date", F.to_date("observed_at_utc"))
    if existing_scans is not None:
        held = existing_scans.select(F.col("id").alias("scan_id"))
        if repeated == "skip":
            rows = rows.join(held, "scan_id", "left_anti")
            scans = scans.join(held, "scan_id", "left_anti") if scans is not None else None
        else:
            rows, scans = _refused(rows, held), _refused(scans, held) if scans is not None else None
    seen = rows.groupBy(F.col("scan_id").alias("id")).agg(
        F.min("observed_at_utc").alias("observed_at_utc"), F.count(F.lit(1)).alias("total_networks"),
        F.count_distinct("interface_guid").alias("interface_count"),
        *[F.first(c, True).alias(c) for c in ("negotiated_api_version",) if c in rows.columns])
    whole = [] if scans is None else [f.name for f in scans.schema if not f.nullable]
    if {"interface_count", "total_networks"} <= {*whole} and ("negotiated_api_version" in whole or "negotiated_api_version" not in rows.columns):
        # All is told of every scan, so the rows need not be counted.
        seen = scans.withColumnRenamed("scan_id", "id")
    elif scans is not None:
        s, o = scans.withColumnRenamed("scan_id", "id").alias("s"), seen.alias("o")

        def told(c):
            known = [F.col(f"{side}.{c}") for side, df in (("s", scans), ("o", seen)) if c in df.columns]
            return F.coalesce(*known, *([F.lit(0)] if c in ("total_networks", "interface_count") else [F.lit(None)]))

        seen = s.join(o, F.col("s.id") == F.col("o.id"), "left").select("s.id", "s.observed_at_utc", *[told(c).alias(c) for c in SCAN_COLUMNS])
    seen = seen.select("id", "observed_at_utc", *_with(seen, SCAN_COLUMNS), F.to_date("observed_at_utc").alias("scan_date"))
    if clear:
        named = ~F.coalesce("ssid_not_broadcast", F.lit(False)) & (F.coalesce("ssid", F.lit("")) != "")
        ssid, bssid = F.when(named, hash_identifier("ssid", F.col("ssid"))), hash_identifier("bssid", F.col("bssid"))
    else:
        ssid, bssid = F.when(~F.coalesce("ssid_not_broadcast", F.lit(False)), F.col("ssid_hash")), F.col("bssid_hash")
    observation = rows.select(
        F.col("observation_id").alias("id"), F.col("scan_id").alias("scan_session_id"), "network_id",
        hash_identifier("interface-guid", F.col("interface_guid")).alias("interface_guid_hash"),
        ssid.alias("ssid_hash"), bssid.alias("bssid_hash"), *_with(rows, OBSERVATION_COLUMNS), "scan_date")
    analysed = F.col("status").isin("ready", "insufficient_history")
    features = rows.where(analysed).select(
        F.col("observation_id").alias("id"), F.col("observation_id").alias("network_observation_id"),
        *_with(rows, dict.fromkeys(FEATURE_COLUMNS, "double")), F.coalesce("context_available", F.lit(False)).alias("context_available"),
        F.coalesce("context_resolution", F.lit("unresolved")).alias("context_resolution"),
        F.coalesce("feature_complete", F.lit(False)).alias("feature_complete"), F.col("scan_id").alias("scan_session_id"), "scan_date")
    detection = rows.where(analysed & F.col("model_version_id").isNotNull()).select(
        F.col("observation_id").alias("id"), F.col("scan_id").alias("scan_session_id"),
        F.col("observation_id").alias("network_observation_id"), F.col("model_version_id").cast("long").alias("model_version_id"),
        *_with(rows, DETECTION_COLUMNS), F.col("observed_at_utc").alias("created_at_utc"), "scan_date")
    return {"scan_session": seen, "network_observation": observation, "network_features": features,
            "detection": detection}


def _clustered(df: DataFrame, scan: str, within: str | None = None) -> DataFrame:
    """A task holds few dates, and a file the scans of a range, so that filters of both kinds skip files. The rows of a large
    scan are told apart by `within` and may lie in several files."""
    return df.repartitionByRange("scan_date", scan, *([within] if within else [])).sortWithinPartitions("scan_date", scan)


def _needed(scored: DataFrame) -> DataFrame:
    """The columns that the tables are made of; of clear and hashed identifiers only those that are read."""
    hashed = [] if "bssid" in scored.columns else ["ssid_hash", "bssid_hash"]
    names = {"scan_id", "observed_at_utc", "observation_id", "network_id", "interface_guid", "ssid", "bssid", "status", "model_version_id",
             "context_available", "context_resolution", "feature_complete", "negotiated_api_version", *hashed, *OBSERVATION_COLUMNS,
             *FEATURE_COLUMNS, *DETECTION_COLUMNS}
    return scored.select(*[c for c in scored.columns if c in names])


def append_scans(tables: dict[str, DataFrame], root: str, batch: str | None = None, clustered: tuple[str, ...] = ()) -> str:
    """Writes the tables as one batch and commits it. Tables named in `clustered` lie in the order of dates and scans already."""
    folder = uuid.uuid4().hex
    batch = batch or folder
    written = {}
    for name, df in tables.items():
        path = f"{root}/{name}/folder=f-{folder}"
        written[name] = path
        if "scan_date" in df.columns:
            rows = df if name in clustered else _clustered(df, "id") if name == "scan_session" else _clustered(df, "scan_session_id", "id")
            rows.write.partitionBy("scan_date").parquet(path)
        else:
            df.write.parquet(path)
    # Counted in the files, so that the rows are not computed again.
    spark = next(iter(tables.values())).sparkSession
    kinds = {name: {**SCHEMAS[name], "scan_date": "date"} for name in ("scan_session", "network_observation") if name in tables}
    read = {name: spark.read.schema(", ".join(f"{c} {t}" for c, t in kind.items())).parquet(written[name]) for name, kind in kinds.items()}
    _commit(spark, read, root, batch, f"f-{folder}")
    return batch


def _commit(spark: SparkSession, tables: dict[str, DataFrame], root: str, batch: str, folder: str) -> None:
    """One small file that appears at once; what it does not name does not exist for readers."""
    found = {}
    for name, id_column, counts in (("scan_session", "id", ("scans", "scan")), ("network_observation", "id", ("observations", "id"))):
        if name in tables:
            found[name] = tables[name].groupBy("scan_date").agg(
                F.count(F.lit(1)).alias(counts[0]), F.min(id_column).alias(f"first_{counts[1]}"), F.max(id_column).alias(f"last_{counts[1]}"))
    names = ["scan_date", "scans", "observations", "first_scan", "last_scan", "first_id", "last_id"]
    rows = None
    for df in found.values():
        rows = df if rows is None else rows.join(df, "scan_date", "full")
    rows = [] if rows is None else [tuple(r[c] if c in r else None for c in names) for r in rows.toLocalIterator()]
    table = spark.createDataFrame([(batch, folder, *r) for r in rows or [(None,) * 7]], MANIFEST)
    table.coalesce(1).write.parquet(f"{root}/manifest/part={folder}")


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """Committed batches with their dates, counts and ranges of ids; None before the first one."""
    try:
        return spark.read.schema(f"{MANIFEST}, part string").parquet(f"{root}/manifest").drop("part")
    except AnalysisException:
        return None


def stored_scans(spark: SparkSession, root: str, dates: DataFrame) -> DataFrame | None:
    """Ids of the scans stored between the first and the last of the given dates; only those partitions are read."""
    done = manifest(spark, root)
    if done is None:
        return None
    span = dates.agg(F.min("scan_date").alias("a"), F.max("scan_date").alias("b")).first()
    if span["a"] is None:
        return None
    return _committed(spark, root, "scan_session", done).where(F.col("scan_date").between(span["a"], span["b"])).select("id")


def ingest(scored: DataFrame, root: str, scans: DataFrame | None = None, repeated: str = "fail", batch: str | None = None,
           models: DataFrame | None = None) -> str:
    """Stores one batch of scored scans; computed once, whatever the number of tables.

    A batch committed before is left alone, so a retried caller changes nothing. Repeated scans are looked for among those of the same
    dates; with `repeated="fail"` they are refused before anything is written, and `repeated="left out"` says that the caller has left
    them out already. Without `observation_id`, observations are numbered on from the largest stored one. One writer at a time.
    """
    spark = scored.sparkSession
    done = manifest(spark, root)
    if batch is not None and done is not None and not done.where(F.col("batch") == batch).isEmpty():
        return batch
    # Written before it is ordered, as the borders of the ranges are sampled; ordered once, the tables are projections that keep the order.
    scored = stored(_needed(scored), "scored").withColumn("scan_date", F.to_date("observed_at_utc"))
    scored = _clustered(scored, "scan_id", "observation_id" if "observation_id" in scored.columns else "network_id").drop("scan_date")
    if "observation_id" not in scored.columns:
        last = None if done is None else done.agg(F.max("last_id").alias("m")).first()["m"]
        scored = numbered(scored, "observation_id", 1 + (last or 0))
    else:
        scored = stored(scored, "scored-scans")
    held = None
    if repeated != "left out":
        told = scored.select("scan_id", "observed_at_utc") if scans is None else stored(scans, "scans").select("scan_id", "observed_at_utc").unionByName(
            scored.select("scan_id", "observed_at_utc"))
        held = stored_scans(spark, root, told.select(F.to_date("observed_at_utc").alias("scan_date")))
        if held is not None:
            held = stored(held.join(told.select(F.col("scan_id").alias("id")), "id", "left_semi").distinct(), "repeated-scans")
            if repeated == "fail" and not held.isEmpty():
                raise ValueError("scan is stored already")
    tables = persist_scans(scored, held, scans, "skip" if repeated == "left out" else repeated)
    return append_scans({**tables, **({} if models is None else {"model_version": models})}, root, batch,
                        ("network_observation", "network_features", "detection"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def _committed(spark: SparkSession, root: str, name: str, done: DataFrame) -> DataFrame:
    read = spark.read
    if name in SCHEMAS:
        read = read.schema(", ".join(f"{c} {t}" for c, t in [*SCHEMAS[name].items(), ("folder", "string"), ("scan_date", "date")]))
    folders = done.select(F.col("folder").alias("_folder")).distinct()
    return read.parquet(f"{root}/{name}").join(folders, F.col("folder") == F.col("_folder"), "left_semi").drop("folder")


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The committed rows of all tables, and the manifest."""
    done = manifest(spark, root)
    if done is None:
        raise ValueError(f"{root} holds no committed batch")
    held = [name for name in TABLES if name != "model_version" or _exists(spark, f"{root}/{name}")]
    return {**{name: _committed(spark, root, name, done) for name in held}, "manifest": done}


def dates_of(db: dict[str, DataFrame], first: str, last: str, value) -> list | None:
    """Dates whose range of ids holds the value; few, as ids rise with time. None if the store has no manifest."""
    if "manifest" not in db:
        return None
    hit = db["manifest"].where((F.col(first) <= F.lit(value)) & (F.lit(value) <= F.col(last)))
    return [r["scan_date"] for r in hit.select("scan_date").distinct().toLocalIterator()]


def upsert_model_version(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry after adding or refreshing the new versions; only the newest of them is active.

    A refreshed version keeps its id and creation time. New ids continue after the largest one.
    """
    require_columns(new, ["version_name", "created_at_utc"], "model registry")
    kept = ["id", "created_at_utc", "active"]
    values = [c for c in registry.columns if c not in kept]
    highest = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    latest = Window.partitionBy("version_name").orderBy(F.desc("created_at_utc"))
    arriving = new.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    newest = arriving.agg(F.max_by("version_name", F.struct("created_at_utc", "version_name")).alias("v")).scalar()
    known = registry.select("version_name", F.col("id").alias("_id"), F.col("created_at_utc").alias("_made"))
    # One registry holds a handful of versions, so numbering them needs no partitioning.
    joined = arriving.join(known, "version_name", "left").withColumn(
        "_new", F.row_number().over(Window.partitionBy(F.col("_id").isNull()).orderBy("created_at_utc", "version_name")))
    fresh = joined.select(
        F.coalesce("_id", (highest + F.col("_new")).cast("long")).alias("id"),
        *[(F.col(c) if c in new.columns else F.lit(None)).alias(c) for c in values],
        F.coalesce("_made", "created_at_utc").alias("created_at_utc"),
        (F.col("version_name") == newest).alias("active"))
    old = registry.join(arriving.select("version_name"), "version_name", "left_anti").withColumn("active", F.lit(False))
    columns = ["id", *values, "created_at_utc", "active"]
    return old.select(*columns).unionByName(fresh.select(*columns))
