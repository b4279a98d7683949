import numpy as np
import pytest

from wavelark.llm import packing
from wavelark.llm.tokens import default_vocabulary, encoder


def fills(rows, capacity=1024):
    """Fill of each window; checks that windows are gapless from 0 and not overfull."""
    windows = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    out = [sum(n for _, n in w) for w in windows.values()]
    assert max(out, default=0) <= capacity
    return out


def test_pieces_cover_documents(docs, prose):
    texts = [(i, prose(i, n)) for i, n in enumerate([1, 5, 300, 2000, 40, 700] * 8)] + [(90, None), (91, ""), (92, "x"), (92, "x"), (None, "y z")]
    rows = packing.pack(docs(texts)).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, {})[r.start] = r.ids
    for doc, text in texts[:50]:
        ids = np.frombuffer(b"".join(whole[doc][s] for s in sorted(whole[doc])), "<u4")
        assert ids.tolist() == encoder(default_vocabulary()).encode(text).tolist() + [0]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.length) for r in rows if r.doc_id is None or r.doc_id >= 90) == [(-1, 3), (90, 1), (91, 1), (92, 2), (92, 2)]
    encode = encoder(default_vocabulary()).encode
    found = fills(rows)
    assert sum(found) == sum(len(encode(t)) + 1 for _, t in texts)
    assert sum(f < 1024 for f in found) <= 3  # one per partition


def test_empty_table_and_same_result_again(docs):
    assert packing.pack(docs([])).collect() == []
    df = docs([(i, "some words here " * i) for i in range(60)])
    assert sorted(map(tuple, packing.pack(df, capacity=64).collect())) == sorted(map(tuple, packing.pack(df, capacity=64).collect()))


def test_levels_follow_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.Packer(16, 10_000)
    for i in range(500):
        size = int(rng.integers(1, 16))
        counts = [len(x) for x in packer.open]

        def squares(level, size=size, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return sum(n * n for n in c)

        allowed = [h for h in range(16 - size + 1) if h == 0 or counts[h]]
        best = min(map(squares, allowed))
        assert packer.level_for(size) == max(h for h in allowed if squares(h) == best)
        list(packer.add(i, np.ones(size, np.uint32)))


@pytest.mark.parametrize("limit", [1, 7])
def test_open_windows_are_bounded(limit):
    packer, total = packing.Packer(100, limit), 0
    for i in range(400):
        for window in packer.add(i, np.zeros(60, np.uint32)):
            total += sum(len(p[2]) for p in window)
        assert sum(map(len, packer.open)) <= limit + 1
    assert total + sum(len(p[2]) for w in packer.finish() for p in w) == 400 * 60
