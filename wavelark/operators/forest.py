"""Isolation forest: one small hashed sample per tree, trees grown in parallel."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.schema import SPLIT_SEED

NODES = "tree long, node long, feature long, cut double, size long, rows long"


def _grow(features, sample, seed):
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("_h")[features].to_numpy(float)
        out, todo = [], [(0, np.arange(len(x)), 0)]
        while todo:
            # Node i has children 2i+1 and 2i+2; feature -1 marks a leaf.
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_features):
                out.append((tree, node, -1, 0.0, len(rows), len(x)))
                continue
            f = int(rng.choice(open_features))
            # Staying below the highest value keeps both sides filled even when the range is one bit wide.
            cut = min(float(rng.uniform(low[f], high[f])), float(np.nextafter(high[f], low[f])))
            left = x[rows, f] <= cut
            out.append((tree, node, f, cut, len(rows), len(x)))
            todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size", "rows"])
    return grow


def fit_forest(df: DataFrame, features: Sequence[str], trees: int = 300, sample: int = 256,
               seed: int = SPLIT_SEED, row_key: str = "event_id") -> DataFrame:
    """Nodes of all trees. Their number is bounded by trees * 2 * sample, not by the data.

    A row offers itself to only as many trees as are needed to fill them about twice over, so
    candidates stay near 2 * trees * sample rows however many rows there are.
    """
    features = list(features)
    total = df.count()
    offers = min(trees, max(-(-2 * trees * sample // max(total, 1)), 1))
    keep = min(1.0, 2.0 * trees * sample / max(total * offers, 1))
    key = F.col(row_key).cast("string")

    def draw(*parts):
        return F.pmod(F.xxhash64(F.lit(seed), key, *parts), F.lit(1 << 40)) / float(1 << 40)

    first = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(trees))
    offered = df.select(*features, row_key, F.explode(F.sequence(F.lit(0), F.lit(offers - 1))).alias("_o"))
    candidates = offered.withColumn("tree", F.pmod(first + F.col("_o"), F.lit(trees))).withColumn(
        "_h", draw(F.col("tree"))).where(F.col("_h") < keep)
    order = Window.partitionBy("tree").orderBy("_h", row_key)
    picked = candidates.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= sample)
    return picked.select("tree", "_h", *features).groupBy("tree").applyInPandas(_grow(features, sample, seed), NODES)


def _path_share(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def score_forest(df: DataFrame, nodes: DataFrame, features: Sequence[str],
                 score: str = "anomaly_score") -> DataFrame:
    """2^(-mean depth / expected depth) - 0.5: positive values are anomalous."""
    features = list(features)
    table = nodes.toPandas()
    trees = np.sort(table["tree"].unique())
    width = int(table["node"].max()) + 1
    at = np.searchsorted(trees, table["tree"]), table["node"].to_numpy()
    feature = np.full((len(trees), width), -1, np.int16)
    cut, depth = np.zeros((len(trees), width)), np.zeros((len(trees), width))
    feature[at], cut[at] = table["feature"], table["cut"]
    level = np.floor(np.log2(table["node"].to_numpy() + 1))
    depth[at] = level + _path_share(table["size"].to_numpy())
    expected = float(_path_share(np.array([table["rows"].max()]))[0]) or 1.0
    shared = df.sparkSession.sparkContext.broadcast((feature, cut, depth))

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        feature, cut, depth = shared.value
        x = np.column_stack([c.to_numpy(float) for c in columns])
        unique, back = np.unique(x, axis=0, return_inverse=True)
        total = np.zeros(len(unique))
        for t in range(len(feature)):
            node = np.zeros(len(unique), int)
            while True:
                f = feature[t, node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                right = unique[inner, f[inner]] > cut[t, node[inner]]
                node[inner] = 2 * node[inner] + 1 + right
            total += depth[t, node]
        return pd.Series((2.0 ** (-total / len(feature) / expected) - 0.5)[np.ravel(back)])

    return df.withColumn(score, isolation(*[F.col(f) for f in features]))
