"""Threshold calibration and prediction."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.ordering import fold_values, folded_quantiles


def calibrate(scores: DataFrame, fpr: float = 0.05, score: str = "anomaly_score") -> DataFrame:
    """Threshold at the 1 - fpr quantile of normal validation scores, with the realised rate."""
    if not 0.0 < fpr < 1.0:
        raise ValueError("the target false positive rate must lie between 0 and 1")
    value = F.col(score).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    folded = fold_values(scores.select(
        F.when(finite, value).otherwise(F.raise_error(F.lit("calibration: score is not finite"))).alias(score)), score)
    threshold = folded_quantiles(folded, score, {"threshold": 1.0 - fpr}).select("threshold").scalar()
    out = folded.withColumn("_cut", threshold).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("validation_rows"),
        F.sum(F.when(F.col(score) > F.col("_cut"), F.col("n")).otherwise(0)).alias("_over"))
    empty = F.when(F.col("validation_rows") == 0, F.raise_error(F.lit("calibration: no validation scores")))
    return out.select(
        F.coalesce(empty.cast("double"), threshold).alias("threshold"),
        F.lit(fpr).alias("target_false_positive_rate"),
        F.try_divide("_over", "validation_rows").alias("validation_realized_false_positive_rate"),
        "validation_rows", F.lit(1.0 - fpr).alias("quantile"))


def predict(df: DataFrame, threshold: Column | float, score: str = "anomaly_score") -> DataFrame:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn("prediction", (F.col(score) > cut).cast("long"))
