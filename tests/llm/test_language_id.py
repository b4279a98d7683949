import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.llm import language_id as L


def brute_path(scores, penalty):
    best, came = scores[0].copy(), []
    for s in scores[1:]:
        options = best[:, None] - penalty * (1 - np.eye(len(best)))
        came.append(options.argmax(0))
        best = options.max(0) + s
    path = [int(best.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1], float(best.max())


def value(scores, path, penalty):
    path = np.asarray(path)
    return scores[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(n, 3)) * 4 for n in [1, 2, 7, 50, 300, 3]] + [np.zeros((0, 3)), np.zeros((5, 3))]
    for penalty in (0.5, 4.0, 50.0):
        for scores, path in zip(texts, L.viterbi(texts, penalty)):
            assert len(path) == len(scores)
            if len(scores):
                assert np.isclose(value(scores, path, penalty), brute_path(scores, penalty)[1])
                stays = L._stays(scores, penalty)
                if stays >= 0:
                    assert np.isclose(value(scores, [stays] * len(scores), penalty), brute_path(scores, penalty)[1])


@pytest.fixture
def result(docs):
    greek, english, german = "και το νερό είναι καλό σήμερα", "and the water is good today with them", "und das wasser ist heute gut für alle"
    rows = [(i, f"{t} {t.upper()} {i}", lang) for i in range(20) for t, lang in ((greek, "el"), (english, "en"), (german, "de"))]
    asked = [(100, "the water and the good"), (101, "das wasser und gut"), (102, "νερό"), (103, None), (104, ""), (105, "12 34 ++"),
             (106, " ".join([english] * 5 + [german] * 4)), (107, "«!» — ¿¡"), (107, "«!» — ¿¡"), (None, "heute ist das wasser"), (108, "слово"),
             (109, "the water is good " * 20_000)]
    df = docs(rows + asked)
    return {r.doc_id: r for r in L.identify(df, df.where(F.col("doc_id") < 100)).collect()}


def test_predictions(result):
    assert [result[i].lang_pred for i in (100, 101, 102, None, 109)] == ["en", "de", "el", "de", "en"]
    assert [(result[i].lang_pred, result[i].score, result[i].spans) for i in (103, 104, 105, 107)] == [("und", 0.0, [])] * 4
    assert result[108].lang_pred in ("el", "en", "de") and all(0 <= r.score <= 1 for r in result.values())


def test_spans_of_mixed_text(result):
    spans = result[106].spans
    assert [s.lang for s in spans] == ["en", "de"] and result[106].lang_pred == "en"
    assert spans[0].start == 0 and abs(spans[1].start - 5 * 38) <= 10


def test_nothing_learnt_and_empty(docs):
    df = docs([(1, "some words"), (2, None)])
    assert [(r.lang_pred, r.score) for r in L.identify(df, df).collect()] == [("und", 0.0)] * 2
    assert L.identify(docs([]), df).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = L.identify(docs.where(held), docs.where(~held), keep=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_shortcut_agrees_with_the_path():
    """Two other languages share one penalty: A leads by 7 in the first half and B in the second, C in the sum."""
    halves = np.array([[0.0, -20.0, -7.0]] * 1 + [[-20.0, 0.0, -7.0]] * 1)
    assert L._stays(halves, 8.0) == -1
    assert L.viterbi([halves], 8.0)[0].tolist() == [0, 1]
    rng = np.random.default_rng(4)
    stays = 0
    for _ in range(2000):
        scores = rng.normal(size=(rng.integers(1, 8), 4)) * 2 + rng.normal(size=4) * 2
        alone = L._stays(scores, 8.0)
        stays += alone >= 0
        assert alone < 0 or (L.viterbi([scores], 8.0)[0] == alone).all()
    assert stays > 200


def test_bounds_and_clashes(docs):
    df = docs([(i, "some words here", f"l{i}") for i in range(5)])
    with pytest.raises(ValueError, match="more than 4 languages"):
        L.identify(df, df, most=4)
    with pytest.raises(ValueError, match="cannot be kept"):
        L.identify(df.withColumnRenamed("key", "score"), df, keep=("score",))
    assert len(L.identify(df, df, most=5).collect()) == 5 and L.identify(docs([]), df).collect() == []


def test_words_go_to_their_language(docs):
    """Words go to the language they were learnt from, however often they were seen."""
    few, many = docs([(1, "alpha beta", "x"), (2, "gamma delta", "y")]), docs([(1, "alpha beta " * 9, "x"), (2, "gamma delta", "y")])
    for learnt in (few, many):
        got = {r.doc_id: r.lang_pred for r in L.identify(docs([(5, "alpha"), (6, "delta gamma"), (7, "beta beta")]), learnt).collect()}
        assert got == {5: "x", 6: "y", 7: "x"}
