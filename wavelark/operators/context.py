"""References of normal networks and what-changed features against them.

A reference is kept as plain tables, one row per fact, instead of nested sets:

* ``profiles``  one row per SSID: counts, medians and its small closed sets (channels, security)
* ``members``   one row per (SSID, BSSID) pair
* ``owners``    one row per BSSID with exactly one SSID, carrying that SSID's profile

so membership is an equi-join whatever the number of access points behind one SSID.
"""

from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.identity import clean_ssid, hash_bssid, hash_ssid
from wavelark.functions.security import normalize_security, security_rank
from wavelark.functions.text import flag, number
from wavelark.operators.checks import optional, present_or_fail, require_columns
from wavelark.schema import CONTEXTUAL_CORE_V2, CONTEXTUAL_V1, DESKTOP_FEATURES
from wavelark.session import stored


@dataclass(frozen=True)
class Reference:
    profiles: DataFrame
    members: DataFrame
    owners: DataFrame


def freeze(reference: Reference) -> Reference:
    """Write the reference to the shared folder; later joins know its real size."""
    return Reference(**{
        f.name: stored(getattr(reference, f.name), f"reference-{f.name}") for f in fields(reference)})


def bssid_ssids(members: DataFrame) -> DataFrame:
    """How many SSIDs each BSSID was seen with, and the SSID where there is only one."""
    return members.groupBy("bssid_hash").agg(
        F.count(F.lit(1)).alias("ssid_count"), F.min("ssid_hash").alias("_only"),
    ).select("bssid_hash", "ssid_count",
             F.when(F.col("ssid_count") == 1, F.col("_only")).alias("ssid_hash"))


def _owners(members: DataFrame, profiles: DataFrame) -> DataFrame:
    single = bssid_ssids(members).where(F.col("ssid_hash").isNotNull()).select("bssid_hash", "ssid_hash")
    return single.join(profiles, "ssid_hash")


def build_reference(df: DataFrame) -> Reference:
    """Reference from normal rows. Rows without an SSID count for the only SSID of their BSSID."""
    require_columns(df, ["ssid", "bssid", "channel", "security_type"], "reference")
    # Distinct combinations with their multiplicity: everything below runs on this small table.
    combos = stored(df.select(
        hash_ssid(F.col("ssid")).alias("ssid_hash"),
        hash_bssid(F.col("bssid")).alias("bssid_hash"),
        number(F.col("channel")).cast("long").alias("channel"),
        normalize_security(F.col("security_type")).alias("security"),
        number(optional(df, "configured_beacon_interval_ms", "double")).alias("interval"),
    ).groupBy("ssid_hash", "bssid_hash", "channel", "security", "interval").agg(
        F.count(F.lit(1)).alias("n")), "reference-facts")
    named = combos.where(F.col("ssid_hash").isNotNull())
    members = named.where(F.col("bssid_hash").isNotNull()).select("ssid_hash", "bssid_hash").distinct()
    single = bssid_ssids(members).where(F.col("ssid_hash").isNotNull()).select("bssid_hash", "ssid_hash")
    orphans = (
        combos.where(F.col("ssid_hash").isNull() & F.col("bssid_hash").isNotNull())
        .groupBy("bssid_hash", "channel", "security").agg(F.sum("n").alias("n"))
        .join(single, "bssid_hash")
    )
    facts = named.select("ssid_hash", "channel", "security", "interval", "n", F.col("n").alias("seen")).unionByName(
        orphans.select("ssid_hash", "channel", "security", F.lit(None).cast("double").alias("interval"),
                       "n", F.lit(0).cast("long").alias("seen")))
    # Few distinct channels, names and intervals exist per SSID, so fold to them before the medians.
    folded = facts.groupBy("ssid_hash", "channel", "security", "interval").agg(
        F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    rank = security_rank(F.col("security"))
    sets = folded.groupBy("ssid_hash").agg(
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("security")).alias("security_types"),
        F.percentile(rank, F.lit(0.5), F.col("n")).alias("security_rank_median"),
        F.percentile("interval", F.lit(0.5), F.col("n")).alias("configured_beacon_interval_median_ms"),
        F.sum("seen").alias("observations"),
    )
    sizes = members.groupBy("ssid_hash").agg(F.count(F.lit(1)).alias("bssid_count"))
    profiles = sets.join(sizes, "ssid_hash", "left").withColumn(
        "bssid_count", F.coalesce("bssid_count", F.lit(0).cast("long")))
    return Reference(profiles, members, _owners(members, profiles))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


#: A key is heavy if more than one row in so many holds it; heavy and missing keys are spread over `SPREAD` partitions.
HEAVY_SHARE, SPREAD = 500, 64


def _small(*tables: DataFrame) -> bool:
    """Whether Spark will send the tables whole to every executor, by its own estimate and limit."""
    limit = tables[0].sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return all(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit for t in tables)


def heavy_keys(rows: DataFrame, column: str) -> list:
    """The keys held by more than one row in `HEAVY_SHARE`: fewer than that many, counted with partial sums per task."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    limit = rows.count() // HEAVY_SHARE
    return [r[column] for r in counts.where(F.col("n") > limit).select(column).collect()]


def _spread_join(rows: DataFrame, table: DataFrame, on: dict[str, str], by: str, heavy: list) -> DataFrame:
    """Left join of many rows with a table too large to broadcast, on equal keys (`on`: row column -> table column).

    Rows without the key `by` match nothing and are dealt out evenly; rows of its heavy keys are dealt out over copies of the
    table's rows of those keys. The other keys are joined as they are.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    left = rows.withColumn("_spread", spread)
    salt = F.when(F.col(by).isNull() | F.col(by).isin(heavy), F.col("_spread")).otherwise(F.lit(0))
    left = left.withColumns({"_salt": salt, **{f"_on_{c}": F.coalesce(c, F.lit("")) for c in on}})
    copies = F.when(F.col(on[by]).isin(heavy), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("_at", F.explode(copies))
    same = (F.col("_salt") == F.col("_at"))
    for c, t in on.items():
        same = same & (F.col(f"_on_{c}") == F.col(t)) & F.col(c).isNotNull()
    return left.join(right, same, "left").drop("_spread", "_salt", "_at", *[f"_on_{c}" for c in on])


def left_join(rows: DataFrame, table: DataFrame, on: dict[str, str], by: str) -> DataFrame:
    """Left join of many rows with a stored table on equal strings (`on`: row column -> table column), whatever the share of rows
    that lack the key `by` or hold the same one: a small table is broadcast, else missing and heavy keys are spread out."""
    if not _small(table):
        return _spread_join(rows, table, on, by, heavy_keys(rows, by))
    same = [F.col(c) == F.col(t) for c, t in on.items()]
    return rows.join(table, reduce(and_, same), "left")


def _resolve(rows: DataFrame, ref: Reference, direct: str, fallback: str, unknown: str) -> DataFrame:
    """Adds the profile fields of the resolved SSID as `ref_*`, the resolution and `known_bssid`.

    A BSSID resolved through its only SSID is a member of that SSID by construction, so
    membership is looked up only for the SSID the row itself names. References that are too large to be
    broadcast are joined with missing and heavy keys spread out.
    """
    own = _renamed(ref.profiles, "own_")
    by_bssid = _renamed(ref.owners, "via_")
    pair = _renamed(ref.members, "pair_")
    if _small(ref.profiles, ref.owners, ref.members):
        joined = (
            rows.join(own, F.col("ssid_hash") == F.col("own_ssid_hash"), "left")
            .join(by_bssid, F.col("bssid_hash") == F.col("via_bssid_hash"), "left")
            .join(pair, (F.col("ssid_hash") == F.col("pair_ssid_hash"))
                  & (F.col("bssid_hash") == F.col("pair_bssid_hash")), "left")
        )
    else:
        ssids, bssids = heavy_keys(rows, "ssid_hash"), heavy_keys(rows, "bssid_hash")
        joined = _spread_join(rows, own, {"ssid_hash": "own_ssid_hash"}, "ssid_hash", ssids)
        joined = _spread_join(joined, by_bssid, {"bssid_hash": "via_bssid_hash"}, "bssid_hash", bssids)
        joined = _spread_join(joined, pair, {"ssid_hash": "pair_ssid_hash", "bssid_hash": "pair_bssid_hash"}, "bssid_hash", bssids)
    named, via = F.col("own_ssid_hash").isNotNull(), F.col("via_ssid_hash").isNotNull()
    picked = {
        f"ref_{c}": F.when(named, F.col(f"own_{c}")).otherwise(F.col(f"via_{c}"))
        for c in ref.profiles.columns
    }
    return joined.withColumns({
        **picked,
        "context_resolution": F.when(named, direct).when(via, fallback).otherwise(unknown),
        "context_available": named | via,
        "known_bssid": F.when(named, F.col("pair_bssid_hash").isNotNull()).otherwise(via),
    }).drop(*own.columns, *by_bssid.columns, *pair.columns)


def _absent(value: Column, known: Column) -> Column:
    """1.0 when the value is not in the known set; NULL when either side is unknown."""
    return F.when(value.isNotNull() & (F.size(known) > 0),
                  (~F.array_contains(known, value)).cast("double"))


def resolve_context(df: DataFrame, ref: Reference) -> DataFrame:
    rows = df.withColumns({"ssid_hash": hash_ssid(F.col("ssid")), "bssid_hash": hash_bssid(F.col("bssid"))})
    out = _resolve(rows, ref, "ssid", "bssid_fallback", "none")
    return out.select(*rows.columns, "context_available", "context_resolution",
                      F.col("ref_ssid_hash").alias("resolved_ssid_hash"))


def transform_contextual(df: DataFrame, ref: Reference, keep: tuple[str, ...] = ()) -> DataFrame:
    """Contextual features of every row; clear identifiers do not leave this function."""
    require_columns(df, ["ssid", "bssid", "channel", "security_type"], "contextual features")
    carried = ["source_dataset", "session_id", "elapsed_ms", "label", "attack_type", "is_synthetic", *keep]
    rows = df.select(
        *[optional(df, c).alias(c) for c in carried],
        hash_ssid(F.col("ssid")).alias("ssid_hash"),
        hash_bssid(F.col("bssid")).alias("bssid_hash"),
        number(F.col("channel")).cast("long").alias("_channel"),
        normalize_security(F.col("security_type")).alias("_security"),
        number(optional(df, "configured_beacon_interval_ms", "double")).alias("configured_beacon_interval_ms"),
        flag(optional(df, "is_hidden", "boolean").cast("int")).cast("double").alias("is_hidden"),
        clean_ssid(F.col("ssid")).isNull().cast("double").alias("ssid_missing"),
    )
    known = F.col("context_available")
    out = _resolve(rows, ref, "ssid", "bssid_fallback", "none").withColumns({
        "ssid_bssid_count": F.when(known, F.col("ref_bssid_count").cast("double")),
        "bssid_changed": F.when(known & F.col("bssid_hash").isNotNull(), (~F.col("known_bssid")).cast("double")),
        "channel_changed": _absent(F.col("_channel"), F.col("ref_channels")),
        "security_changed": _absent(F.col("_security"), F.col("ref_security_types")),
        "security_strength_delta": security_rank(F.col("_security")) - F.col("ref_security_rank_median"),
        "configured_beacon_interval_delta_ms":
            F.col("configured_beacon_interval_ms") - F.col("ref_configured_beacon_interval_median_ms"),
    })
    complete = ~F.greatest(*[F.col(c).isNull() for c in CONTEXTUAL_V1])
    return out.select(
        *carried[:3], "ssid_hash", "bssid_hash", "context_available", "context_resolution",
        complete.alias("feature_complete"), "ssid_missing", "configured_beacon_interval_delta_ms",
        *carried[3:], *CONTEXTUAL_V1)


def select_core_v2(df: DataFrame) -> DataFrame:
    """The five core features; a NULL in any of them fails the job."""
    require_columns(df, CONTEXTUAL_CORE_V2, "core features")
    numeric = df.select(*[number(F.col(c)).alias(c) for c in CONTEXTUAL_CORE_V2])
    return numeric.select(*[present_or_fail(c, "core features") for c in CONTEXTUAL_CORE_V2])


def build_desktop_reference(df: DataFrame) -> Reference:
    """Reference from imported desktop rows that carry both hashes."""
    require_columns(df, ["ssid_hash", "bssid_hash", "security_type", "security_strength", "session_id"],
                    "desktop reference")
    combos = stored(df.where(F.col("ssid_hash").isNotNull() & F.col("bssid_hash").isNotNull()).select(
        "ssid_hash", "bssid_hash", "security_type",
        number(F.col("security_strength")).alias("strength"), "session_id",
    ).groupBy("ssid_hash", "bssid_hash", "security_type", "strength", "session_id").agg(
        F.count(F.lit(1)).alias("n")), "desktop-reference-facts")
    members = combos.select("ssid_hash", "bssid_hash").distinct()
    sizes = members.groupBy("ssid_hash").agg(F.count(F.lit(1)).alias("bssid_count"))
    sessions = combos.select("ssid_hash", "session_id").distinct().groupBy("ssid_hash").agg(
        F.count("session_id").alias("reference_sessions"))
    folded = combos.groupBy("ssid_hash", "security_type", "strength").agg(F.sum("n").alias("n"))
    profiles = folded.groupBy("ssid_hash").agg(
        F.sort_array(F.collect_set("security_type")).alias("security_types"),
        F.percentile("strength", F.lit(0.5), F.col("n")).alias("security_strength_median"),
        F.sum("n").alias("reference_rows"),
    ).join(sizes, "ssid_hash").join(sessions, "ssid_hash")
    return Reference(profiles, members, _owners(members, profiles))


def desktop_reference_from_observations(df: DataFrame) -> Reference:
    """The desktop reference from rows with clear identifiers, hashed on the way in."""
    hashed = df.withColumns({"ssid_hash": hash_ssid(F.col("ssid")), "bssid_hash": hash_bssid(F.col("bssid"))})
    return build_desktop_reference(hashed)


def transform_desktop(df: DataFrame, ref: Reference) -> DataFrame:
    """Input rows plus the four desktop features; anything unknown stays NULL."""
    require_columns(df, ["ssid_hash", "bssid_hash", "security_type", "security_strength"], "desktop features")
    known = F.col("context_available")
    out = _resolve(df, ref, "ssid_hash", "bssid_fallback", "unresolved").withColumns({
        "context_ssid_hash": F.col("ref_ssid_hash"),
        "ssid_bssid_count": F.when(known, F.col("ref_bssid_count").cast("double")),
        "bssid_changed": F.when(known & F.col("bssid_hash").isNotNull(), (~F.col("known_bssid")).cast("double")),
        "security_changed": F.when(
            known & F.col("security_type").isNotNull(),
            (~F.array_contains("ref_security_types", F.col("security_type"))).cast("double")),
        "security_strength_delta": number(F.col("security_strength")) - F.col("ref_security_strength_median"),
    })
    complete = ~F.greatest(*[F.col(c).isNull() for c in DESKTOP_FEATURES])
    return out.select(*df.columns, "context_ssid_hash", "context_resolution", "context_available",
                      *DESKTOP_FEATURES, (known & complete).alias("feature_complete"))


def eligible() -> Column:
    return F.col("context_available") & F.col("feature_complete")


def coverage(features: DataFrame, by: str = "split") -> DataFrame:
    return features.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(eligible()).alias("eligible"),
        F.count_if(~F.col("context_available")).alias("context_unavailable"),
    ).withColumn("eligible_rate", F.col("eligible") / F.col("rows"))
