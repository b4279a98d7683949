"""Splits that keep history, training and evaluation rows apart."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.operators.checks import require_columns
from wavelark.operators.ordering import dealt, with_position
from wavelark.schema import SPLIT_SEED

CONTEXT_SPLITS = ["reference", "model_train", "validation", "test_normal"]
# Order of the first five sessions, then of all further ones.
FIRST_SESSIONS = ["reference", "model_train", "model_train", "validation", "test_normal"]
FURTHER_SESSIONS = ["model_train", "model_train", "validation", "test_normal"]


def contextual_split(df: DataFrame, ratios: Sequence[float] = (0.40, 0.30, 0.15, 0.15),
                     tie_break: str = "event_id") -> DataFrame:
    """Cut every session, in the order of time and `tie_break`, into reference, train, validation and test rows."""
    require_columns(df, ["session_id", "elapsed_ms", tie_break], "contextual split")
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError("split ratios must add up to 1")
    order = [F.col("elapsed_ms").asc_nulls_last(), F.col(tie_break)]
    placed = with_position(dealt(df, ["session_id"], order), ["session_id"], order, F.col("_block"), "_at", "_size")
    counts = [F.floor(F.col("_size") * F.lit(float(r))) for r in ratios[:3]]
    ends = [counts[0], counts[0] + counts[1], counts[0] + counts[1] + counts[2]]
    split = F.when(F.col("_at") < ends[0], CONTEXT_SPLITS[0])
    for end, name in zip(ends[1:], CONTEXT_SPLITS[1:]):
        split = split.when(F.col("_at") < end, name)
    return placed.withColumn("context_split", split.otherwise(CONTEXT_SPLITS[3])).drop("_at", "_size")


def leaking_groups(df: DataFrame) -> DataFrame:
    keys = ["source_dataset", "split_group_type", "split_group_id"]
    return (df.select(*keys, "split").distinct().groupBy(*keys)
            .agg(F.count("split").alias("splits")).where(F.col("splits") > 1))


def balance_sources(df: DataFrame, key: str, source: str = "source_dataset",
                    seed: int = SPLIT_SEED) -> DataFrame:
    """Down-sample every source to the smallest one, deterministically by hashed key.

    Only the rows of the one hash block in which a source's quota ends need ordering; blocks
    before it are kept whole and later ones dropped, without moving their rows.
    """
    require_columns(df, [key, source], "source balancing")
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    rows = df.withColumn("_hash", digest).withColumn("_block", F.substring("_hash", 1, 3))
    sizes = rows.where(F.col(source).isNotNull()).groupBy(source, "_block").agg(F.count(F.lit(1)).alias("_n"))
    quota = sizes.groupBy(source).agg(F.sum("_n").alias("_n")).agg(F.min("_n").alias("_n"))
    before = Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.select(
        source, "_block", "_n",
        (F.lit(quota.select("_n").scalar()) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_room"),
    ).where(F.col("_room") > 0)
    # At most 4096 blocks per source.
    tagged = rows.join(F.broadcast(room), [source, "_block"])
    whole = tagged.where(F.col("_room") >= F.col("_n"))
    order = Window.partitionBy(source, "_block").orderBy("_hash", key)
    edge = (tagged.where(F.col("_room") < F.col("_n"))
            .withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("_room")).drop("_at"))
    return whole.unionByName(edge).select(*df.columns)


def split_summary(df: DataFrame) -> DataFrame:
    identity = ["network_identity_id"] if "network_identity_id" in df.columns else []
    keys = ["source_dataset", "split"]
    counted = ["split_group_id", "session_id", *identity]
    folded = df.groupBy(*keys, *counted).agg(F.count(F.lit(1)).alias("_n"))
    names = dict(split_group_id="split_groups", session_id="sessions", network_identity_id="network_identities")
    return folded.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), *[F.count_distinct(c).alias(names[c]) for c in counted])


def session_split_plan(sessions: DataFrame, seed: int = SPLIT_SEED, minimum: int = 5) -> DataFrame:
    """Assign whole sessions to splits in hashed order; below the minimum nothing is assigned."""
    require_columns(sessions, ["session_id", "runtime_ready"], "session plan")
    ready = sessions.where("runtime_ready").withColumn(
        "_rank", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("session_id")), 256))
    placed = with_position(ready, [], [F.col("_rank"), F.col("session_id")], F.substring("_rank", 1, 2), "_at", "_all")
    copies = ready.groupBy("session_id").agg(F.count(F.lit(1)).alias("_copies"))
    first = F.array(*[F.lit(s) for s in FIRST_SESSIONS])
    cycle = F.array(*[F.lit(s) for s in FURTHER_SESSIONS])
    at = F.col("_at").cast("int")
    chosen = (F.when(F.col("_all") < minimum, F.lit(None).cast("string"))
              .when(at < 5, F.try_element_at(first, at + 1))
              .otherwise(F.try_element_at(cycle, (F.greatest(at, F.lit(5)) - 5) % 4 + 1)))
    status = F.when(F.col("_all") < minimum, "insufficient_sessions").otherwise("ready")
    once = F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("duplicate session_id "), "session_id")))
    return placed.join(copies, "session_id").select(
        *sessions.columns, F.coalesce(once.cast("string"), chosen).alias("split"), status.alias("plan_status"))
