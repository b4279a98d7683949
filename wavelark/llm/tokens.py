"""Token ids of texts by a public byte-level vocabulary, whose file is a parameter.

The file of the `tokenizers` library holds the vocabulary; its ids are computed with `tiktoken`,
which gives the same ids several times faster (a test compares both). Strings of special tokens
are ordinary text. Long texts are encoded in parts: the vocabulary's pre-tokenizer never joins
characters over a single space between two other characters, so a cut there changes nothing.
"""

import json
import os
import re

import numpy as np

PART = 1 << 16
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[str, "Encoder"] = {}

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _without_cut(self, text: str) -> list[int]:
        """A long text in which no safe cut was found; this library's merges stay linear on it."""
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text; a null text has none."""
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= PART:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        out, at = [], 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            out.append(np.array(self.fast.encode_ordinary(part) if len(part) <= 2 * PART else self._without_cut(part), np.uint32))
            at = end
        return np.concatenate(out)


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
