"""Words and word shingles of text columns as 64-bit hashes, computed on whole Arrow buffers.

A word is hashed by a polynomial over random byte values, so the hashes of all words of a block of
text come out of one cumulative sum. Blocks end at separators, which bounds memory for texts of
any length.
"""

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


class Alphabet:
    """Which bytes belong to words, and which bytes count as equal."""

    def __init__(self, separators: bytes, fold: bool = True):
        values = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.folding = bytes(b + 32 if fold and 65 <= b <= 90 else b for b in range(256))
        self.values = values[np.frombuffer(self.folding, np.uint8)]
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False


#: Words between ASCII white space, letters A-Z in lower case.
SPACED = Alphabet(b" \t\n\v\f\r")
#: Runs of ASCII letters, digits and all bytes beyond ASCII.
LETTERS = Alphabet(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset at which each text begins; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _return_memory() -> None:
    """Gives what a task has freed back to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most `limit` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = text_buffer(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
    _return_memory()


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet = SPACED,
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Begin, end and hash of all words, block by block; words never reach over the end of a text."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + BLOCK, end)
        word = alphabet.is_word[data[at:stop]]
        if stop < end:
            borders = offsets[np.searchsorted(offsets, at, side="right"):np.searchsorted(offsets, stop, side="right")]
            gaps = np.flatnonzero(~word)
            cut = max(int(gaps[-1]) + 1 if len(gaps) else 0, int(borders[-1]) - at if len(borders) else 0)
            if cut == 0:  # a word longer than a block
                limit = int(offsets[np.searchsorted(offsets, at, side="right")])
                stop = at
                while stop < limit:
                    gaps = np.flatnonzero(~alphabet.is_word[data[stop:min(stop + BLOCK, limit)]])
                    if len(gaps):
                        stop += int(gaps[0])
                        break
                    stop = min(stop + BLOCK, limit)
                yield np.array([at]), np.array([stop]), np.array([_long_word(data[at:stop], alphabet)], np.uint64)
                at = stop
                continue
            stop = at + cut
            word = word[:cut]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        heads = offsets[np.searchsorted(offsets, at, side="right"):np.searchsorted(offsets, stop, side="left")] - at
        first[heads] = word[heads]
        last[heads - 1] = word[heads - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(alphabet.values[data[at:stop]] * _POWERS[:stop - at], out=sums[1:])
        hashes = mix((sums[ends] - sums[begins]) * _INVERSES[begins])
        for i in np.flatnonzero(ends - begins >= BLOCK):
            hashes[i] = _long_word(data[at + begins[i]:at + ends[i]], alphabet)
        yield begins + at, ends + at, hashes
        at = stop


def _long_word(piece: np.ndarray, alphabet: Alphabet) -> int:
    digest = hashlib.blake2b(digest_size=8)
    for i in range(0, len(piece), BLOCK):
        digest.update(piece[i:i + BLOCK].tobytes().translate(alphabet.folding))
    return int.from_bytes(digest.digest(), "little")


def word_hashes(column: pa.Array, alphabet: Alphabet = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and for each text the place of its first word (one more at the end)."""
    data, offsets = text_buffer(column)
    begins, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b, _, h in word_spans(data, offsets, alphabet):
        begins.append(b)
        hashes.append(h)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets, side="left")


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order. A shorter text is one shingle, no word none."""
    if len(words) == 0:
        return words
    take = min(size, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        out = (out * np.uint64(0xD6E8FEB86659FD93)) ^ words[i:len(words) - take + 1 + i]
        out = mix(out)
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles in ascending order."""
    return np.unique(shingles(words, size))
