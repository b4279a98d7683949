"""Feature matrices and standard scaling."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import number
from wavelark.operators.checks import present_or_fail, require_columns
from wavelark.schema import METADATA_COLUMNS


def feature_matrix(df: DataFrame, features: Sequence[str], require_normal: bool = False) -> DataFrame:
    """Features, label and the remaining metadata. A NULL feature fails the job by name."""
    require_columns(df, [*features, "label"], "feature matrix")
    leaked = sorted(set(features) & set(METADATA_COLUMNS))
    if leaked:
        raise ValueError(f"feature matrix: metadata used as features: {', '.join(leaked)}")
    label = F.col("label").cast("long")
    if require_normal:
        label = F.when(label == 0, label).otherwise(F.raise_error(F.lit("feature matrix: label is not 0")))
    metadata = [c for c in METADATA_COLUMNS if c in df.columns and c != "label"]
    numeric = df.withColumns({f: number(F.col(f)) for f in features})
    return numeric.select(*[present_or_fail(f, "feature matrix") for f in features], label.alias("label"), *metadata)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a constant feature keeps scale 1."""
    stats = df.agg(*[F.avg(f).alias(f"mean_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"scale_{f}") for f in features])
    return stats.withColumns({
        f"scale_{f}": F.when(F.col(f"scale_{f}") == 0, 1.0).otherwise(F.col(f"scale_{f}")) for f in features})


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    s = scaler.select(F.struct("*").alias("s")).scalar()
    return df.withColumns({f: (F.col(f) - s[f"mean_{f}"]) / s[f"scale_{f}"] for f in features})


def variance_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    totals = df.agg(*[x for f in features for x in (
        F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))])
    # One pass per feature for the distinct count: folded values stay small where rows do not.
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    distinct = pairs.where(F.col("value").isNotNull()).distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("distinct_values"))
    report = totals.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"v_{f}").alias("variance_population"))
        for f in features])))
    return report.join(distinct, "feature", "left").select(
        "feature", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values"),
        "mean", "variance_population")
