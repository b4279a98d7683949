"""Scoring of fresh observations with frozen artefacts."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.context import Reference, eligible, transform_desktop
from wavelark.operators.evaluation import _cut
from wavelark.operators.matrix import apply_scaler
from wavelark.schema import DESKTOP_FEATURES

# The reasons a verdict states.
REASONS = {
    "insufficient_history": "Histórico normal insuficiente para aplicar desktop_candidate_v1 a esta rede.",
    "high": "Observação acima do threshold de anomalia.",
    "low": "Observação dentro do comportamento esperado pelo modelo.",
}


def decide(obs: DataFrame, ref: Reference, scaler: DataFrame, scorer: Callable[[DataFrame], DataFrame],
           threshold: Column | float, features: Sequence[str] = tuple(DESKTOP_FEATURES),
           model_version: str | None = None) -> DataFrame:
    """Status, score, verdict and its reason per observation. Without enough history the verdict stays NULL.

    `scorer` adds `anomaly_score` from the scaled feature columns; `model_version` names the model in every row.
    """
    rows = transform_desktop(obs, ref)
    raw = {f: f"_raw_{f}" for f in features}
    scaled = apply_scaler(rows.withColumns({r: F.col(f) for f, r in raw.items()}), scaler, features)
    scored = scorer(scaled).withColumns({f: F.col(r) for f, r in raw.items()}).drop(*raw.values())
    ready = eligible()
    anomaly = F.col("anomaly_score") > _cut(threshold)
    return scored.withColumns({
        "status": F.when(ready, "ready").otherwise("insufficient_history"),
        "is_anomaly": F.when(ready, anomaly),
        "suspicion_level": F.when(~ready, "unavailable").when(anomaly, "high").otherwise("low"),
        "anomaly_score": F.when(ready, F.col("anomaly_score")),
        "threshold": F.when(ready, _cut(threshold)),
        "reason": F.when(~ready, REASONS["insufficient_history"]).when(anomaly, REASONS["high"]).otherwise(REASONS["low"]),
        "model_version": F.lit(model_version).cast("string"),
    })
