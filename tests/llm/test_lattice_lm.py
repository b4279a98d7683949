import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wavelark.llm import lattice_lm as M

LOWER = {c: c + 32 for c in range(65, 91)}


def spelled(pieces, stop, word):
    """Sum over all segmentations, by plain recursion."""
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        total[j] = sum(total[i] * pieces[word[i:j]] for i in range(j) if word[i:j] in pieces)
    return math.log(total[-1]) + stop


@pytest.fixture(scope="module")
def lattice():
    rng = np.random.default_rng(2)
    pieces = [bytes([b]) for b in range(256)] + [b" th", b"the", b" the", b"he", b"en", b"then", b" a", b"aaa", "é".encode(), b"aaaaaaaaaaaa"]
    scores = np.log(rng.dirichlet(np.ones(len(pieces)))) - 1
    return M.Lattice(pieces, scores, -0.7), dict(zip(pieces, np.exp(scores)))


def test_forward_recursion(lattice):
    model, pieces = lattice
    words = [b"the", b"then", b"a", b"aaaaa", "été".encode(), b"x" * 60, b"thethethe", b"a" * 40]
    assert np.allclose(model.score(words), [spelled(pieces, model.stop, b" " + w) for w in words])


def test_long_words_follow_the_same_recursion(lattice):
    model, pieces = lattice
    for word in (b"thenaaa" * 40, b"a" * 500, "é".encode() * 90):
        alpha = [0.0]
        for j in range(1, len(word) + 2):
            ways = [alpha[i] + math.log(pieces[(b" " + word)[i:j]]) for i in range(max(0, j - 12), j) if (b" " + word)[i:j] in pieces]
            alpha.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
        assert np.isclose(model.score([word])[0], alpha[-1] + model.stop)


def test_expected_uses(lattice):
    model, pieces = lattice
    uses = model.expected([b"then", b"the"])
    # Every byte of " then" and " the" lies in exactly one piece of each segmentation.
    assert np.isclose((uses * [len(p) for p in pieces]).sum(), 9)
    assert (uses >= 0).all()


def test_words_of_usual_length_take_no_logarithms(lattice, monkeypatch):
    model, pieces = lattice
    words = [b"the", b"then", b"a", b"aaaaa", "été".encode(), b"thethethe", b"x" * 20]
    assert model.plain > 20
    with monkeypatch.context() as m:
        m.setattr(model, "plain", 0)
        slow = model.expected(words)
        assert np.allclose(model.score(words), [spelled(pieces, model.stop, b" " + w) for w in words])
    monkeypatch.setattr(model, "_forward", None)
    assert np.allclose(model.expected(words), slow)
    assert np.allclose(model.score(words), [spelled(pieces, model.stop, b" " + w) for w in words])


def test_improbable_words_keep_their_score():
    """Bytes so rare that a double cannot hold the product: such words are walked in logarithms."""
    scores = np.full(256, -90.0)
    scores[ord("a")] = 0.0
    model = M.Lattice([bytes([b]) for b in range(256)], scores, 0.0)
    assert model.plain == 6
    assert np.allclose(model.score([b"xyz", b"x" * 6, b"x" * 30, b"a" * 30]), [-360, -630, -2790, -90])
    assert np.allclose(model.expected([b"x" * 30])[[ord(" "), ord("x")]], [1, 30])


def test_expected_uses_of_long_words(lattice, monkeypatch):
    """Words without a space for 96 bytes and more fit the pieces like all others."""
    model, pieces = lattice
    long = [b"thenaaa" * 40, b"a" * 500, "é".encode() * 90, b"x" * 96]
    assert np.isclose((model.expected(long) * [len(p) for p in pieces]).sum(), sum(len(w) + 1 for w in long))
    words = [b"thenaaa" * 9, b"a" * 50, "été".encode() * 5, b"then", b"athen" * 7, b"x" * 20]
    want = model.expected(words)
    for cells in (1 << 18, 200):
        monkeypatch.setattr(M, "_LONG", 20)
        monkeypatch.setattr(M, "_CELLS", cells)
        assert np.allclose(model.expected(words), want)


def test_base_scores_and_splits(docs, prose):
    rows = [(i, prose(i % 30, 80 + i)) for i in range(80)] + [(100, None), (101, ""), (102, "ONE one\x0btwo"), (103, "z" * 3000), (103, "z" * 3000)]
    rows += [(200 + i, f"Neu{i} wort") for i in range(20)]
    words = [[w for w in re.split(r"[ \t-\r]+", (t or "").translate(LOWER)) if w] + [None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for own, h in zip(words, held) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, h, len(own), sum(counts[w] > 0 for w in own), n,
                   round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6))
                  for (i, _), own, h in zip(rows, words, held))
    results = []
    for hot in (10**6, 20, 0):
        got = M.score_documents(docs(rows), hot=hot).collect()
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        results.append(sorted((r.doc_id, round(r.score, 6)) for r in got))
    assert results[0] == results[1] == results[2]  # wherever a word's count is looked up


def test_null_ids_and_empty_tables(docs):
    got = M.score_documents(docs([(None, "a b"), (1, "a c")])).collect()
    assert sorted((r.held_out, r.n_tokens) for r in got) == [(False, 3), (False, 3)]
    assert M.score_documents(docs([])).collect() == []


def test_probabilities_sum_to_at_most_one(docs):
    """All texts of up to two words over a small alphabet, scored by a model that was trained on a few."""
    letters = ["a", "b", "ab", "ba", "c"]
    texts = [""] + letters + [f"{x} {y}" for x in letters for y in letters]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = M.score_documents(docs(rows)).collect()
    assert sum(10 ** r.score for r in got) <= 1
