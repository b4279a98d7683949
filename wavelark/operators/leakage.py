"""Can a simple classifier tell the data sources apart from the features alone?"""

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import rate
from wavelark.operators.evaluation import ranking_metrics
from wavelark.operators.matrix import apply_scaler, fit_scaler
from wavelark.schema import RADIO_FEATURE_SETS

POSITIVE_SOURCE = "zenodo_v2i"


def source_target(df: DataFrame) -> DataFrame:
    return df.withColumn("source_target", F.coalesce(
        (F.col("source_dataset") == POSITIVE_SOURCE).cast("double"), F.lit(0.0)))


def source_leakage(train: DataFrame, tests: dict[str, DataFrame],
                   feature_set: str | Sequence[str] = "conservative_v2") -> DataFrame:
    """One row of classification metrics per test split."""
    features = RADIO_FEATURE_SETS[feature_set] if isinstance(feature_set, str) else list(feature_set)
    scaler = fit_scaler(train, features)
    pack = VectorAssembler(inputCols=features, outputCol="_packed")

    def prepared(df):
        return pack.transform(apply_scaler(source_target(df), scaler, features))

    rows = train.count()
    model = LogisticRegression(featuresCol="_packed", labelCol="source_target", maxIter=2000, regParam=1.0 / rows,
                               standardization=False).fit(prepared(train))
    out = None
    for split, df in tests.items():
        scored = model.transform(prepared(df)).select(
            F.col("source_target").cast("int").alias("label"), F.col("prediction").cast("int").alias("p"),
            vector_to_array("probability")[1].alias("anomaly_score"))
        hit, y = F.col("p") == F.col("label"), F.col("label")
        counts = scored.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hits"), F.count_if((y == 1) & hit).alias("tp"),
            F.count_if((y == 0) & hit).alias("tn"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
        predicted = F.col("tp") + F.col("n") - F.col("tn")
        auc = ranking_metrics(scored).select("roc_auc").scalar()
        row = counts.select(
            F.lit(split).alias("split"), "rows", rate(F.col("hits"), F.col("rows")).alias("accuracy"),
            ((rate(F.col("tp"), F.col("p")) + rate(F.col("tn"), F.col("n"))) / 2).alias("balanced_accuracy"),
            rate(2 * F.col("tp"), predicted + F.col("p")).alias("f1"), auc.alias("roc_auc"))
        out = row if out is None else out.unionByName(row)
    return out
