import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavelark.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(rows, target, percent=5):
    """(id, features, weight, score, rank) of every row, from the definition."""
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t_ = Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = sum(s.values()), sum(t_.values())
    gain = [math.floor(1000 * math.log((t_[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out, able = [], []
    for i, text in rows:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= 20:
                able.append((-score, i))
        out.append((i, len(own), weight, score))
    drawn = {}
    for rank, (score, i) in enumerate(sorted(able)[:len(able) * percent // 100], 1):
        drawn.setdefault(i, []).append(rank)
    return out, drawn


def found(df, target, **options):
    rows = I.resample(df, target, **options).collect()
    ranks = {}
    for r in rows:
        if r["rank"] is not None:
            ranks.setdefault(r.doc_id, []).append(r["rank"])
    return sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in rows), key=str), {i: sorted(x) for i, x in ranks.items()}


@pytest.fixture
def rows(prose):
    rng = random.Random(4)
    out = [prose(i, rng.choice([3, 19, 20, 21, 80, 300])) for i in range(150)]
    out += [prose(900 + i % 3, 40) for i in range(40)]
    out += ["", None, "...", "one", "One two", "ÄÖ ünï 12 日本 x7", "A" * 5000, "\0x\0y", "w " * 30]
    return list(zip(range(100, 100 + len(out)), out))


@pytest.fixture
def target(prose):
    return [prose(5000 + i, 30) for i in range(8)] + [None, ""]


def check(docs, spark, rows, target, **options):
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got, ranks = found(docs(rows), items, **options)
    want, drawn = brute(rows, target, options.get("percent", 5))
    assert got == sorted(want, key=str)
    assert ranks == {i: sorted(x) for i, x in drawn.items()}


def test_draw_equals_brute_force(docs, spark, rows, target):
    check(docs, spark, rows, target)
    check(docs, spark, rows, target, percent=100)


def test_long_texts_go_through_in_parts(docs, spark, rows, target):
    """Runs over the border of two parts count once."""
    check(docs, spark, rows, target, part=40)


def test_repeated_and_missing_ids(docs, spark, prose, target):
    rows = [(None, prose(1, 50)), (None, prose(2, 50)), (7, prose(3, 50)), (7, prose(3, 50)), (7, prose(4, 50)), (8, None)] + [
        (20 + i, prose(30 + i, 25)) for i in range(30)]
    check(docs, spark, rows, target, percent=50)


def test_empty_tables(docs, spark, rows, target):
    check(docs, spark, [], target)
    check(docs, spark, rows[:30], [])


def test_joined_crc_equals_the_whole():
    rng = random.Random(2)
    pairs = [(bytes(rng.randrange(256) for _ in range(rng.randint(0, 40))), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300]))))
             for _ in range(200)]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = I._joined(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_slices_of_a_column_are_read_right(rows):
    """Kernels misread sliced arrays unless their texts are laid out anew."""
    column = pa.array([t for _, t in rows])
    gains = np.arange(10_000) - 5000
    for at in (0, 37, 150):
        own = column.slice(at, 20)
        assert I.Features(own, 10_000).sums(gains).tolist() == [
            sum(int(gains[bucket(f)]) for f in features(t)[1]) for t in own.to_pylist()]
