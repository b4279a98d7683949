import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, query long, v string, block int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    use = sorted({(i, tuple(int(np.floor(256 * float(x))) for x in v), label) for i, v, label in rows
                  if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, av, al in use:
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in use if len(v) == len(av)]
        for p, i, _ in sorted(s for s in scored if s[2] == al and s[1] != a)[:positives]:
            hits = sorted(s for s in scored if s[2] != al and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(a, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(hits, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 10 == 0, **options).collect()))


@pytest.fixture
def rows():
    rng = np.random.default_rng(13)
    centres = rng.normal(0, 0.4, (6, 12))
    out = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.25, 12)], i % 5) for i in range(400)]
    # Copies of one vector under several labels, anchors among them, and ties on a coarse grid.
    out += [(400 + i, out[3][1], i % 3) for i in range(60)]
    out += [(460 + i, [float(x) for x in rng.integers(-1, 2, 12)], i % 2) for i in range(60)]
    out += [(520 + i, [0.5, -0.25, float(i)], i % 2) for i in range(30)]
    return out


@pytest.mark.parametrize("options", [{}, {"data_block": 37, "query_block": 5}])
def test_negatives_equal_brute_force(spark, rows, options):
    got = found(spark, rows, **options)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 500


def test_other_numbers_and_windows(spark, rows):
    options = {"positives": 2, "negatives": 30, "low": -50, "high": 100}
    assert found(spark, rows, data_block=64, **options) == brute(rows, lambda i: i % 10 == 0, **options)


def test_missing_values_and_repeated_rows(spark, rows):
    odd = [(None, [1.0] * 12, 1), (600, None, 1), (601, [], 1), (602, [1.0, None], 1), (603, [float("nan")] * 12, 1),
           (604, [float("inf")] + [0.0] * 11, 1), (605, [0.5] * 12, None), (610, [0.0] * 12, 1), (620, [-1.0] * 12, 9)]
    both = rows[:80] + odd + rows[20:40] + [(20, [0.3] * 12, 2)]
    assert found(spark, both) == brute(both, lambda i: i % 10 == 0)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0, 2.0], 3)]) == []


def test_boxes_bound_and_prune():
    """Bounds hold for every row of a box, and clustered vectors leave most leaves unopened."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (20, 8))
    vectors = (centres[np.arange(4000) % 20] + rng.integers(-5, 6, (4000, 8))).astype(np.int64)
    labels = np.arange(4000) % 20 % 7
    tree = H.PackedTree(vectors, labels, [[i] for i in range(4000)])
    queries = vectors[:10]
    lower, upper = tree.bounds(queries)
    for node in range(tree.leaves):
        own = queries @ tree.vectors[node * 64:(node + 1) * 64].T
        assert (own >= lower[:, [node]]).all() and (own <= upper[:, [node]]).all()
    opened, plain = [], tree.scores
    tree.scores = lambda q, at: opened.append(at) or plain(q, at)
    best = tree.best(queries[0], lower[0], upper[0], int(labels[0]), True, [(-2**63, 2**63 - 1)], 6)[0]
    exact = sorted((-int(s), i) for i, s in enumerate(vectors @ queries[0]) if labels[i] == labels[0])[:6]
    assert [(-s, i) for s, i in best] == exact and len(opened) < tree.leaves / 4
