import random

import pyarrow as pa
import pytest
import sentencepiece

from wavelark.llm import token_counts as C
from wavelark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    lib = sentencepiece.SentencePieceProcessor(model_file=C.default_vocabulary())
    return lambda texts: [len(ids) for ids in lib.encode(["" if t is None else t for t in texts], num_threads=1)]


@pytest.fixture(scope="module")
def pieces():
    return C.read_vocabulary(C.default_vocabulary())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["", None, " ", "   ", "a", " a", "▁▁x ▁ y", "<s></s><unk><0x0A><|endoftext|>", "\n\n\t x\r\n", "\0a\0", "日本語のテキスト", "😀😀x😀", "é",
           "x" * 3000, " " * 3000, "ab" * 4000, "aaa bbb" * 2000, "ก" * 500, "0123456789 3.14", "﷽ ﷽"]
    for alphabet in ("abcdefghijklmnop  rstuvwxyz\n\t.,ABC0123éß日本語😀▁", "theandingr", "ac", "0123456789abcdef"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 500))) for _ in range(150)]
    return out


def test_counts_equal_the_library(texts, pieces, library):
    assert C.counted(pa.array(texts), C.Transducer(pieces)).tolist() == library(texts)


@pytest.mark.parametrize("block,states", [(64, C.MAX_STATES), (997, 50), (1 << 20, 1)])
def test_blocks_and_forgotten_states(texts, pieces, library, block, states):
    """Texts that reach over blocks go on from the state in hand, also when all other states were dropped."""
    assert C.counted(pa.array(texts), C.Transducer(pieces, states), block=block).tolist() == library(texts)


def test_wrong_run_up_is_mended(texts, pieces, library, monkeypatch):
    """Without a run-up every chunk inside a word starts from a wrong guess."""
    monkeypatch.setattr(C, "RUN_UP", 0)
    assert C.counted(pa.array(texts), C.Transducer(pieces)).tolist() == library(texts)


def test_lone_characters_of_longer_pieces():
    """A character that only longer pieces hold is a symbol of its own and costs its bytes when nothing merges it."""
    machine = C.Transducer({"▁": -1.0, "a": -2.0, "aé": -3.0})
    assert C.counted(pa.array(["aé", "é", "éa", "aaé b"]), machine).tolist() == [2, 3, 4, 5]


def test_table(docs, library):
    rows = [(1, "hello  world"), (1, "hello  world"), (None, "x y"), (2, None), (3, ""), (4, "word " * 5000)]
    got = sorted(C.count_tokens(docs(rows)).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, library([t for _, t in rows]))), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert C.count_tokens(docs([])).collect() == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(C.default_vocabulary(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge models"):
        C.read_vocabulary(str(tmp_path / "m.model"))


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    counts = dict(zip(texts, library(list(texts.values()))))
    assert got == {i: (len((t or "").encode()), counts[i], counts[i] > 4096) for i, t in texts.items()}
