"""Reconstruction error on the leading principal components."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReconstructionModel:
    """Means and component loadings; both have the size of the feature list."""
    features: tuple[str, ...]
    means: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]


def fit_reconstruction(df: DataFrame, features: Sequence[str], k: int = 2) -> ReconstructionModel:
    features = list(features)
    packed = VectorAssembler(inputCols=features, outputCol="_packed").transform(df.select(*features))
    components = PCA(k=k, inputCol="_packed", outputCol="_components").fit(packed).pc.toArray()
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return ReconstructionModel(tuple(features), tuple(means), tuple(map(tuple, components.tolist())))


def score_reconstruction(df: DataFrame, model: ReconstructionModel, score: str = "anomaly_score") -> DataFrame:
    centred = [F.col(f) - F.lit(m) for f, m in zip(model.features, model.means)]
    d, k = len(centred), len(model.loadings[0])

    def total(terms):
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    df = df.withColumns({f"_z{j}": total([centred[i] * F.lit(model.loadings[i][j]) for i in range(d)])
                         for j in range(k)})
    errors = []
    for i in range(d):
        gap = centred[i] - total([F.col(f"_z{j}") * F.lit(model.loadings[i][j]) for j in range(k)])
        errors.append(gap * gap)
    return df.withColumn(score, total(errors) / d).drop(*[f"_z{j}" for j in range(k)])
