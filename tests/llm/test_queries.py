"""The registered queries at the smallest scale, and the pipeline against plain re-computations of its stages."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from tests.check_oracle import compare, duck
from tests.llm.test_contamination import brute as held_items
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_jaccard_join import family
from wavelark.llm.queries import ORACLES, QUERIES
from wavelark.llm.tokens import default_vocabulary, encoder

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op5_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_lattice_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_voronoi_join": {"query_id", "rank", "vec_id", "score"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op12_importance": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert CONTRACT.get(name, set()) <= set(df.columns)
    if name in ORACLES:
        problem, _ = compare(df, ORACLES[name], con)
        assert problem is None, problem
    else:
        rows = df.collect()
        assert rows
        if name in ("op3_quality", "op7_lattice_lm", "op9_language_id"):
            ids = con.execute("SELECT doc_id FROM documents").fetchall()
            assert sorted(r.doc_id for r in rows) == sorted(i for i, in ids)


def test_thirteen_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, prose, tmp_path):
    """Planted junk, near copies, benchmark items and keys; every stage is recomputed from what the one before kept."""
    rng = random.Random(8)
    items = [(i, prose(900 + i, 25)) for i in range(6)]
    texts = [prose(i, rng.choice([60, 150, 400])) for i in range(60)]
    texts += [family(rng, texts[i], 1) for i in range(12)] + [texts[3]] * 4
    texts += [prose(700 + i, 90) + " " + items[i][1] + " more words here" for i in range(6)]
    texts += [" ".join(w for w in prose(300 + i, 50).split() for _ in range(6)) for i in range(10)]
    texts += [prose(400 + i, 80) + f" password={rng.getrandbits(96):024x} " + prose(500 + i, 20) for i in range(8)]
    texts += ["", None]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(docs.collect())
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, unique, clean, redacted, packed = kept
    ids = {r.doc_id for r in quality}
    assert not ids & set(range(82, 92)) and len(ids & set(range(60))) >= 58
    names = {i: c for i, _, c in groups([(r.doc_id, r.text) for r in quality], P.SHINGLE_WORDS, P.SIMILAR_PERCENT)}
    assert sorted(r.doc_id for r in unique) == sorted(i for i, c in names.items() if i == c)
    hit = {d for d, *_ in held_items([(r.doc_id, r.text) for r in unique], items)}
    assert hit and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique if r.doc_id not in hit)
    before = {r.doc_id: r.text for r in clean}
    for r in redacted:
        assert r.text == re.sub(r"(?<=password=)[0-9a-f]{24}", "<SECRET>", before[r.doc_id]) and r.n_chars == len(r.text)
    encode = encoder(default_vocabulary()).encode
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {d: sum((p[s] for s in sorted(p)), []) for d, p in pieces.items()} == {
        r.doc_id: [*encode(r.text).tolist(), 0] for r in redacted}
    assert sorted(map(str, P.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect())) == sorted(
        str(r) for r in docs.select("doc_id", "start", "length").collect())
