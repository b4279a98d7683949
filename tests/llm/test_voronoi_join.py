import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.llm import voronoi_join as V


def brute(rows, asks, k):
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(object)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if asks(q):
            scores = sorted((-int((v * w).sum()), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    return sorted(map(tuple, V.top_products(df, F.col("vec_id") % 5 == 0, k, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"per_pivot": 3, "query_block": 2, "data_block": 20}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]                       # a crowd of copies, queries among them
    rows += [(500, None), (501, [None] * 8), (505, [float("nan")] * 8), (510, [float("inf")] + [0.0] * 7), (515, []), (520, [1.0, 2.0]), (525, [0.5, 1.0])]
    rows += [(600 + i, np.round(rng.normal(size=8)).tolist()) for i in range(60)]  # ties
    assert run(spark, rows, **options) == brute(rows, lambda q: q % 5 == 0, 10)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [2.0, 2.0])]
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 10)
    assert run(spark, rows[:1]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_far_groups_get_little_data(spark):
    """Groups on distant axes: the bounds keep most vectors out of the other groups."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(4)[i % 4] * 20 + rng.normal(size=4) * 0.05).tolist()) for i in range(400)]
    assert run(spark, rows, per_pivot=20, data_block=50) == brute(rows, lambda q: q % 5 == 0, 10)


def test_large_components(spark):
    rows = [(i, [float(2**19 + i), float(-(2**18) - 3 * i)]) for i in range(30)]
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 10)
