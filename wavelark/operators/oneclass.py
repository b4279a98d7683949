"""One-class detector with an RBF kernel: distributed fit, and scoring of kernel expansions."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.ordering import fold_values, running_counts
from wavelark.schema import SPLIT_SEED
from wavelark.session import stored

BINS = 64
SLICE = 4096
#: Packed rows of support vectors that are broadcast, at most: a few megabytes.
BROADCAST_SLICES = 32
SALTS = 64


def scale_gamma(df: DataFrame, features: Sequence[str], weight: str | None = None) -> float:
    """1 / (number of features * variance over all matrix cells)."""
    w = F.col(weight) if weight else F.lit(1)
    cells = [F.col(f).cast("double") for f in features]
    sums = df.agg(F.sum(w).alias("n"), F.sum(w * sum(cells[1:], cells[0])).alias("s"),
                  F.sum(w * sum([c * c for c in cells[1:]], cells[0] * cells[0])).alias("q")).first()
    total = sums["n"] * len(cells)
    variance = sums["q"] / total - (sums["s"] / total) ** 2
    return 1.0 / (len(cells) * variance) if variance > 0 else 1.0


def score_one_class(df: DataFrame, support: DataFrame, rho: Column | float, gamma: float,
                    features: Sequence[str], score: str = "anomaly_score") -> DataFrame:
    """rho - sum(alpha * exp(-gamma * |x - sv|^2)) for every row; NULL where a feature is.

    Each distinct vector is scored once and joined back. Equal support vectors are merged and packed into rows of about
    `SLICE` vectors; every vector meets every such row, and the partial sums are added up. The packed rows are
    broadcast if their number, which is counted, is at most `BROADCAST_SLICES`; else both sides are dealt out by
    slice and by a salt of the vectors. The plan does not depend on the number of support vectors.
    """
    features = list(features)
    merged = stored(support.groupBy(*features).agg(F.sum("alpha").alias("alpha")), "support")
    slices = max(-(-merged.count() // SLICE), 1)
    # Sorting fixes the order in which floating sums are taken.
    packed = merged.groupBy(F.pmod(F.xxhash64(*features), F.lit(slices)).alias("_slice")).agg(
        F.sort_array(F.collect_list(F.struct(*features, "alpha"))).alias("_support"))

    def kernel(v):
        distance = None
        for f in features:
            step = (F.col(f) - v[f]) * (F.col(f) - v[f])
            distance = step if distance is None else distance + step
        return v["alpha"] * F.exp(F.lit(-float(gamma)) * distance)

    vectors = stored(df.select(*features).dropna().distinct(), "vectors").withColumns({
        "_slice": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))),
        "_salt": F.pmod(F.xxhash64(*features), F.lit(SALTS))})
    if slices <= BROADCAST_SLICES:
        met = vectors.join(F.broadcast(packed), "_slice")
    else:
        met = vectors.join(packed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_slice", "_salt"])
    share = F.aggregate("_support", F.lit(0.0), lambda acc, v: acc + kernel(v))
    bias = rho if isinstance(rho, Column) else F.lit(float(rho))
    totals = met.groupBy(*features).agg(F.sum(share).alias("_total"))
    scores = stored(totals.select(*features, (bias - F.col("_total")).alias(score)), "vector-scores")
    kept = [c for c in df.columns if c != score]
    return df.select(*kept).join(scores, features, "left").select(*kept, score)


@dataclass(frozen=True)
class OneClassModel:
    """`terms` has one row per random feature (its size is chosen, not learned); `bias` one row."""
    terms: DataFrame
    bias: DataFrame
    features: tuple[str, ...]


def _expand(x: np.ndarray, omega: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(offset)) * np.cos(x @ omega.T + offset)


#: Tasks add their sums up in so many groups; the driver adds those.
GROUPS = 16


def _tail_sums(features, omega, offset, weights, low, width):
    """Per task one row: weight and feature sums of the rows in each score bin, as one block of numbers."""
    def sums(batches):
        block = np.zeros((BINS, 1 + len(offset)))
        for batch in batches:
            phi = _expand(batch[features].to_numpy(float), omega, offset)
            n = batch["n"].to_numpy(float)
            at = np.clip(((phi @ weights - low) / width).astype(int), 0, BINS - 1)
            block[:, 0] += np.bincount(at, n, BINS)
            np.add.at(block[:, 1:], at, phi * n[:, None])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % GROUPS], "block": [block.tobytes()]})
    return sums


def _added(blocks: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b) for b in blocks["block"])
    return pd.DataFrame({"part": blocks["part"].iloc[:1], "block": [total.tobytes()]})


def fit_one_class(df: DataFrame, features: Sequence[str], nu: float = 0.05, gamma: float | str = "scale",
                  rff: int = 256, iters: int = 40, seed: int = SPLIT_SEED) -> OneClassModel:
    """Fit on normal rows with random Fourier features.

    The weight vector is the mean feature vector of the lowest-scoring share `nu`, found by moving
    toward that mean with exact step lengths. Equal rows are folded once; each round is a single
    pass that returns sums for a fixed number of score bins, whatever the data size.
    """
    features = list(features)
    spark = df.sparkSession
    folded = stored(df.groupBy(*features).agg(F.count(F.lit(1)).alias("n")), "one-class")
    width = scale_gamma(folded, features, "n") if gamma == "scale" else float(gamma)
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, np.sqrt(2.0 * width), (rff, len(features)))
    offset = rng.uniform(0.0, 2.0 * np.pi, rff)
    weights, reach = np.zeros(rff), 1.0
    for step in range(iters + 1):
        low, span = -reach, 2.0 * reach / BINS
        kind = "part int, block binary"
        blocks = folded.mapInPandas(_tail_sums(features, omega, offset, weights, low, span), kind).groupBy("part").applyInPandas(_added, kind)
        total = sum((np.frombuffer(r["block"]) for r in blocks.collect()), np.zeros(BINS * (1 + rff))).reshape(BINS, 1 + rff)
        mass, sums = total[:, 0], total[:, 1:]
        share = np.clip(nu * mass.sum() - np.concatenate([[0.0], np.cumsum(mass)[:-1]]), 0.0, mass)
        portion = np.divide(share, mass, out=np.zeros(BINS), where=mass > 0)
        tail = portion @ sums / share.sum()
        gap = weights - tail
        length = 1.0 if step == 0 else float(np.clip(weights @ gap / max(gap @ gap, 1e-300), 0.0, 1.0))
        if step and length * np.sqrt(gap @ gap) < 1e-9:
            break
        weights = weights - length * gap
        reach = float(np.linalg.norm(weights)) * np.sqrt(2.0) + 1e-12
    terms = spark.createDataFrame(
        [(i, omega[i].tolist(), float(offset[i]), float(weights[i])) for i in range(rff)],
        "term long, omega array<double>, offset double, weight double")
    scores = _random_feature_scores(folded, features, omega, offset, weights, "raw")
    ranked = running_counts(fold_values(scores, "raw", counts={"n": F.col("n")}), "raw")
    rows = ranked.agg(F.sum("n").alias("t")).scalar()
    bias = ranked.where(F.col("cum_n") >= rows * nu).agg(F.min("raw").alias("rho"))
    return OneClassModel(terms, bias, tuple(features))


def _random_feature_scores(df, features, omega, offset, weights, name) -> DataFrame:
    @F.pandas_udf("double")
    def raw(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(_expand(x, omega, offset) @ weights)

    return df.withColumn(name, raw(*[F.col(f) for f in features]))


def score_random_features(df: DataFrame, model: OneClassModel, score: str = "anomaly_score") -> DataFrame:
    """Higher means more anomalous. The model's terms are few by construction and are shipped to the tasks."""
    terms = model.terms.orderBy("term").collect()
    omega = np.array([t["omega"] for t in terms])
    offset, weights = np.array([t["offset"] for t in terms]), np.array([t["weight"] for t in terms])
    raw = _random_feature_scores(df, list(model.features), omega, offset, weights, "_raw")
    return raw.withColumn(score, model.bias.select("rho").scalar() - F.col("_raw")).drop("_raw")
