import hashlib
import os

import numpy as np
import pytest

from wavelark.llm import training_order as O
from wavelark.llm.tokens import default_vocabulary, encoder


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(total):
    slots = O.feistel(np.arange(total), total, "k")
    assert sorted(slots.tolist()) == list(range(total))
    if total > 50:
        assert (slots != O.feistel(np.arange(total), total, "other")).mean() > 0.9
        assert abs(np.corrcoef(np.arange(total), slots)[0, 1]) < 0.35


def test_shards_hold_the_sequences(spark, docs, prose, tmp_path):
    rows = [(i, prose(i, n)) for i, n in enumerate([3, 50, 400, 20, 90] * 6)] + [(90, None), (91, ""), (92, "x y"), (92, "x y"), (None, "z")]
    sequences = O.token_sequences(docs(rows), length=64)
    placed = O.materialise(sequences, f"file://{tmp_path}/shards", shard_slots=7, stride=128).collect()
    total = len(placed)
    assert sorted(r.slot for r in placed) == list(range(total)) and all(r.shard == r.slot // 7 for r in placed)
    files = sorted(f for f in os.listdir(tmp_path / "shards") if f.startswith("shard"))
    assert len(files) == -(-total // 7) and not any(f.startswith("_shard") for f in os.listdir(tmp_path / "shards"))
    read = {r.slot: np.frombuffer(r.ids, "<u2") for r in O.read_slots(spark, f"file://{tmp_path}/shards", run_slots=5).collect()}
    assert sorted(read) == list(range(total))
    got = []  # the parts end to end are the texts with their ends
    for part in sorted({r.part for r in placed}):
        own = sorted((r for r in placed if r.part == part), key=lambda r: r.number)
        assert [r.number for r in own] == list(range(len(own))) and all(r.filled == 64 for r in own[:-1])
        got += np.concatenate([read[r.slot][:r.filled] for r in own]).tolist()
    encode = encoder(default_vocabulary()).encode
    assert sorted(got) == sorted(x for _, t in rows for x in [*encode(t).tolist(), 0])
    assert {d for r in placed for d in r.doc_ids} == {d for d, _ in rows}
    some = O.read_slots(spark, f"{tmp_path}/shards", 5, 17).collect()
    assert [r.slot for r in some] == list(range(5, 17)) and all((np.frombuffer(r.ids, "<u2") == read[r.slot]).all() for r in some)


def test_same_order_again_and_replaced_files(spark, docs, tmp_path):
    df = docs([(i, f"text {i} " * 30) for i in range(20)])
    for _ in range(2):
        rows = O.materialise(O.token_sequences(df, length=32), str(tmp_path), shard_slots=10, stride=64).collect()
    assert len({r.slot for r in rows}) == len(rows)


def test_readers_see_complete_sets_only(spark, docs, tmp_path, monkeypatch):
    """A run that fails leaves the set before it readable; its own shards have other names."""
    old = [(i, f"text {i} " * 20) for i in range(12)]
    O.materialise(O.token_sequences(docs(old), length=32), str(tmp_path), shard_slots=10, stride=64)
    before = sorted((r.slot, bytes(r.ids)) for r in O.read_slots(spark, str(tmp_path)).collect())
    with monkeypatch.context() as m:
        m.setattr(O, "json", None)  # fails where the layout is written
        with pytest.raises(AttributeError):
            O.materialise(O.token_sequences(docs(old[:5]), length=32), str(tmp_path), shard_slots=10, stride=64)
    assert sorted((r.slot, bytes(r.ids)) for r in O.read_slots(spark, str(tmp_path)).collect()) == before


def test_permutation_equals_plain_numbers():
    """The network once more with Python's own numbers: six rounds on two halves, walked on until the number is in range."""
    big = (1 << 64) - 1

    def spread(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor & big
        return x ^ (x >> 31)

    def plain(x, total, key):
        half = 1
        while 1 << (2 * half) < total:
            half += 1
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for i in range(6):
                k = int.from_bytes(hashlib.blake2b(f"{key}/{i}".encode(), digest_size=8).digest(), "little")
                left, right = right, left ^ (spread(right ^ k) & ((1 << half) - 1))
            x = left << half | right
            if x < total:
                return x

    for total in (1, 7, 64, 65, 1000):
        assert O.feistel(np.arange(total), total, "k").tolist() == [plain(x, total, "k") for x in range(total)]


def test_empty_table(spark, docs, tmp_path):
    assert O.materialise(O.token_sequences(docs([])), str(tmp_path)).collect() == []
    assert O.read_slots(spark, str(tmp_path)).collect() == []


def test_ids_must_fit(docs):
    with pytest.raises(Exception, match="does not fit"):
        O.token_sequences(docs([(1, "hello world")]), id_type="u1").collect()
