import os

import numpy as np
import pytest

from wavelark.llm import weak_labels as L

SF = "/root/testdata/sf0.01"


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where((rng.random((len(truth), 5)) < right) == truth[:, None], L.GOOD, L.BAD)
    votes[rng.random(votes.shape) < 0.3] = L.NOTHING
    patterns, counts = np.unique(L._pattern(votes), return_counts=True)
    model = L.LabelModel(patterns, counts.astype(float), 5)
    assert np.allclose(model.vote[1, :, L.GOOD], right, atol=0.06) and np.allclose(model.vote[0, :, L.BAD], right, atol=0.06)
    assert abs(model.prior - 0.8) < 0.06
    assert ((model.posterior(L._pattern(votes)) >= 0.5) == truth).mean() > 0.9


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_agrees_with_labels(spark):
    rows = L.assess(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r._keep for r in good]) > 0.98 and np.mean([not r._keep for r in bad]) > 0.95


def test_odd_rows(docs, prose):
    junk = " ".join(f"{w} {w} {w} {w} {w}" for w in prose(1, 40).split())
    rows = [(i, prose(i, 60)) for i in range(30)] + [(50, junk), (51, None), (52, ""), (53, "  \n"), (54, prose(7, 60)), (54, prose(7, 60)),
                                                     (55, prose(9, 40_000)), (None, prose(8, 50))]
    df = docs(rows)
    got = L.assess(df).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r for r in got}
    assert [score[i]._score for i in (51, 52, 53)] == [0, 0, 0] and not score[51]._keep
    assert score[55]._keep and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.doc_id == 54}) == 1
    assert L.good_documents(df).columns == df.columns
    assert L.assess(df.withColumn("_keep", df.doc_id)).schema["_keep"].dataType.simpleString() == "boolean"


def test_empty_table(docs):
    assert L.assess(docs([])).collect() == []
