import random
import re

import pytest

from wavelark.llm import jaccard_join as J
from wavelark.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, size=4, percent=85):
    sets = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        take = min(size, len(words))
        sets[i] = {tuple(words[k:k + take]) for k in range(len(words) - take + 1)} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def found(df, **options):
    return sorted(map(tuple, J.similar_groups(df, **options).collect()))


def family(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def rows(prose):
    rng, out = random.Random(5), []
    passage = prose(999, 60)
    for f in range(14):
        base = prose(f, rng.choice([8, 40, 200, 700]))
        out += [base] + [family(rng, base, rng.randint(0, 9)) for _ in range(rng.randint(1, 9))] + [base.upper(), base + " end"]
    # A chain whose ends are not similar themselves, and documents that share a passage only.
    chain = prose(50, 400).split()
    for i in range(8):
        out.append(" ".join(chain[i * 14:i * 14 + 260]))
    out += [passage + " " + prose(100 + i, 60 + i) for i in range(30)]
    out += ["", None, " \n\t ", "one", "One", "one two three", "ONE  two\nthree", "a b c d", "a b c d a b c d a b c d"]
    ids = list(range(1000, 1000 + len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(docs, rows, size, percent):
    assert found(docs(rows), size=size, percent=percent) == brute(rows, size, percent)


def test_without_help_of_stars(docs, rows, monkeypatch):
    """The prefix tiles alone find every link."""
    monkeypatch.setattr(J, "_star_candidates", lambda sets, percent: sets.selectExpr("doc_id AS a", "doc_id AS b").where("false"))
    assert found(docs(rows)) == brute(rows)


def test_common_shingles_are_salted(docs, rows, monkeypatch):
    real = J.bucket_ranks
    monkeypatch.setattr(J, "bucket_ranks", lambda counts: (real(counts)[0], 0))
    assert found(docs(rows)) == brute(rows)


def test_large_family_of_copies(docs, prose):
    rng, base = random.Random(2), prose(3, 300)
    rows = [(i, family(rng, base, 3)) for i in range(120)] + [(200 + i, base) for i in range(80)] + [(500, prose(4, 300))]
    assert found(docs(rows)) == brute(rows)


def test_missing_and_repeated_rows(docs):
    df = docs([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None)])
    got = sorted(J.similar_groups(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 2, 0), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def texts(df, **options):
    return sorted(((r.doc_id, r.text) for r in J.one_of_each_group(df, **options).collect()), key=str)


def test_one_of_each_group_loses_no_text(docs, prose):
    """Rows are told by id and text: a text that shares an id with a copy stays."""
    a, b, c, d = (prose(i, 60) for i in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d)]
    assert texts(docs(rows)) == sorted([(1, a), (2, b), (3, c), (3, d)], key=str)
    got = J.similar_groups(docs(rows), size=5, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 3), (3, 3)]


def test_one_of_each_group_with_missing_and_repeated_rows(docs, prose):
    a, b = prose(1, 60), prose(2, 60)
    near = " ".join(a.split()[:58])
    rows = [(None, a), (None, a), (5, a), (5, a), (6, near), (6, None), (7, ""), (7, ""), (8, b), (8, b + " end"), (9, " ")]
    got = texts(docs(rows))
    eight = [r for r in got if r[0] == 8]
    assert len(eight) == 1 and eight[0][1].startswith(b)
    assert [r for r in got if r[0] != 8] == sorted([(None, a), (None, a), (5, a), (6, None), (7, ""), (7, ""), (9, " ")], key=str)
    df = docs(rows).withColumnsRenamed({"key": "_gone", "value": "_digest"})
    assert J.one_of_each_group(df).columns == df.columns and J.one_of_each_group(df).count() == len(got)
    assert J.one_of_each_group(docs([])).collect() == []


def candidates(df, monkeypatch, size=4):
    """Pairs that the prefix tiles hand on to the exact step."""
    seen, real = [], J._tile_candidates
    monkeypatch.setattr(J, "_tile_candidates", lambda *a: seen.append(real(*a)) or seen[0])
    result = found(df, size=size)
    return result, seen[0].count()


def test_similar_texts_below_the_threshold_meet_a_few_times(docs, prose, monkeypatch):
    """Texts that share most of their prefixes are not met once for every shared shingle, neither below nor above the threshold."""
    rng, base = random.Random(7), prose(3, 900)
    rows = [(i, family(rng, base, 30)) for i in range(24)] + [(100 + i, family(rng, base, 4)) for i in range(4)]
    seen, real = [], J._meetings
    monkeypatch.setattr(J, "_meetings", lambda *a: seen.append(real(*a)) or seen[0])
    monkeypatch.setattr(J, "_star_candidates", lambda sets, percent: sets.selectExpr("doc_id AS a", "doc_id AS b").where("false"))
    result = found(docs(rows))
    assert result == brute(rows) and len({r[2] for r in result}) > 20
    met = [(r.a, r.b) for r in seen[0].collect()]
    assert all((100 + i, 100 + j) in met or (100 + j, 100 + i) in met for i in range(4) for j in range(i))
    # Every pair shares far more than ten shingles of the prefixes; the six pairs of near copies may meet in all of theirs.
    assert len([p for p in met if min(p) < 100]) <= 10 * len(rows)


def test_shingle_spread_thinly_over_many_partitions(docs, prose, monkeypatch):
    """A passage that every document holds is common in the sum, though a task sees it once or twice."""
    passage = prose(999, 40)
    rows = [(i, passage + " " + prose(10 + i, 50)) for i in range(128)]
    result, pairs = candidates(docs(rows, parts=64), monkeypatch)
    assert result == brute(rows) and pairs == 0


def test_long_texts_that_share_boilerplate_only(docs, prose, monkeypatch):
    """Bitmaps grow with the sets, so long texts of one band do not all pass."""
    passage = prose(999, 150)
    rows = [(i, passage + " " + prose(10 + i, 2200)) for i in range(24)] + [(50, passage + " " + prose(10, 2200) + " end")]
    result, pairs = candidates(docs(rows), monkeypatch)
    assert result == brute(rows) and pairs <= 1


def test_bitmaps_of_different_lengths():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    for n, m in [(1000, 1100), (500, 520), (1200, 1020)]:
        x, y = np.unique(base[:n]), np.unique(base[-m:])
        bits = [J._signature(v)[2] for v in (x, y)]
        apart = len(np.setxor1d(x, y))
        assert J.differing_bits(*bits) <= apart and J.differing_bits(*bits[::-1]) == J.differing_bits(*bits)
        assert (apart - J.differing_bits(*bits)) % 2 == 0


def test_empty_table(docs):
    assert found(docs([])) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
