import functools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelark.llm import words as W
from wavelark.llm.tokens import default_vocabulary, encoder



@functools.cache
def library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(default_vocabulary())
    slow.encode_special_tokens = True
    return slow


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAb  \n\t\x0b.é日\x1c", max_size=60)), max_size=8)
LOWER = {c: c + 32 for c in range(65, 91)}


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    hashes, at = W.word_hashes(pa.array(texts, pa.string()))
    seen = {}
    for i, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        own = hashes[at[i]:at[i + 1]].tolist()
        assert len(own) == len(want)
        for word, h in zip(want, own):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_block_borders():
    long = "A" * (3 * W.BLOCK)
    texts = [long, "x " * W.BLOCK, "b " + long.lower() + " c", "y" * (W.BLOCK - 1) + " " + "y" * W.BLOCK]
    hashes, at = W.word_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [1, W.BLOCK, 3, 2]
    assert hashes[0] == hashes[at[2] + 1]
    assert len(set(hashes[at[1]:at[2]].tolist())) == 1


def test_shingles():
    words = np.arange(1, 8, dtype=np.uint64)
    assert len(W.shingles(words, 4)) == 4
    assert len(W.shingles(words[:3], 4)) == 1 and len(W.shingles(words[:0], 4)) == 0
    assert W.shingles(words, 4)[1] == W.shingles(words[1:5], 4)[0]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "text": ["x" * (i * 7) for i in range(50)]})
    parts = list(W.slices(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 100 for p in parts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab  \n's1.é日　\x1c<|>", max_size=80))
def test_ids_equal_those_of_the_tokenizer_library(text):
    assert encoder(default_vocabulary()).encode(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_ids_of_long_texts():
    for text in ("ab cd\n" * 60_000, "z" * 150_000 + " y", " " * 140_000, "one  two " * 30_000):
        assert encoder(default_vocabulary()).encode(text).tolist() == library().encode(text, add_special_tokens=False).ids
    assert encoder(default_vocabulary()).encode(None).tolist() == []
