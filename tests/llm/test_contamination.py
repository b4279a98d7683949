import random
import re

from wavelark.llm import contamination


def brute(docs, items, size=5, percent=80):
    out = []
    for d, text, *_ in docs:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        for i, item in items:
            own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
            n = min(size, len(own))
            runs = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if n else set()
            held = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
            if runs and 100 * len(runs & held) >= percent * len(runs):
                out.append((d, i, len(runs), len(runs & held)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs, prose):
    rng = random.Random(4)
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([6, 12, 30, 45, 80, 5, 4, 2] * 3)] + [(90, ""), (91, None), (92, "Été à la"), (93, prose(1002, 30))]
    rows = []
    for i in range(60):
        words = prose(i, rng.choice([5, 200, 3000])).split()
        for _, item in rng.sample(items[:24], 2):
            piece = item.split()
            for _ in range(rng.randint(0, 2)):  # some edits: below and above the threshold
                piece[rng.randrange(len(piece))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = piece
        rows.append((i, "\n".join(words) if i % 2 else " ".join(words).upper()))
    rows += [(100, None), (101, ""), (102, "x: ÉTÉ, à la mer"), (103, rows[0][1]), (103, rows[0][1]), (None, rows[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (100, 4):
        got = contamination.contained_items(docs(rows), table, items_at_once=at_once).collect()
        assert sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got), key=str) == brute(rows, items)
    numbered = [(k, text) for k, (_, text) in enumerate(rows)]
    hit = {k for k, *_ in brute(numbered, items)}
    for options in ({}, {"items_at_once": 4}, {"bytes_at_once": 300}):
        kept = contamination.without_items(docs(rows), table, **options)
        assert kept.columns == docs(rows).columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for k, r in enumerate(rows) if k not in hit), key=str)


def test_rows_are_decided_by_their_own_text(spark, docs, prose):
    """A row without an id goes if it holds an item; a clean row that shares an id with a hit stays."""
    item = prose(5, 30)
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "so " + item), (None, prose(6, 40)), (7, item), (7, prose(7, 40)), (8, None), (8, "")]
    df = docs(rows).withColumnsRenamed({"key": "_hit", "value": "item"})
    kept = contamination.without_items(df, table)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert kept.columns == df.columns


def test_one_rule_of_lower_case(spark, docs):
    """A final sigma has two small forms; search and verification use the same one."""
    table = spark.createDataFrame([(1, "ΟΔΟΣ ΚΑΙ ΛΟΓΟΣ ΤΗΣ ΠΟΛΗΣ ΜΑΣ")], "item_id long, text string")
    got = contamination.contained_items(docs([(1, "x οδοσ και λογοσ τησ πολησ μασ y"), (2, "ΟΔΟΣ ΚΑΙ ΛΟΓΟΣ ΤΗΣ ΠΟΛΗΣ ΜΑΣ")]), table).collect()
    assert sorted((r.doc_id, r.item_shingles, r.shared) for r in got) == [(1, 2, 2), (2, 2, 2)]


def test_slices_are_bounded(spark, prose):
    """Equal items are one text; slices stay within rows and bytes, and lose nothing."""
    rows = [(i, prose(i % 20, 10 + i % 20)) for i in range(200)]
    texts = contamination._distinct_texts(spark.createDataFrame(rows, "item_id long, text string").select("text"))
    read = [f() for f in contamination._slices_of_items(texts, 3, 200)]
    assert sorted(t for own in read for _, t in own) == sorted({t for _, t in rows})
    assert all(len(own) <= 3 and (len(own) == 1 or sum(len(t.encode()) for _, t in own) <= 400) for own in read)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained_items(docs([(1, "a b c d e f")]), none).collect() == []
    assert contamination.contained_items(docs([]), spark.createDataFrame([(1, "a b")], none.schema)).collect() == []
