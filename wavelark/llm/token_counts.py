"""Token counts by a compiled finite-state tokenizer (operator 11).

A piece vocabulary with merge scores becomes a deterministic transducer over characters. After every character the
encoding of the text so far ends in one certain piece: the piece that fits behind the encoding before it. A state holds
the open beginnings of pieces (a node of the vocabulary's trie), the piece in front of each, and how many pieces
the text up to there has; its transitions carry the change of the count, which may be negative when pieces
collapse into one. States and transitions are compiled when a text first needs them and kept in a table of
bounded size.

Texts are cut into chunks, and all chunks of a block run in step on arrays. A chunk's state map is constant where
it begins with a space behind another character, as no piece reaches over that place. Elsewhere the map is evaluated at the state
that a short run-up predicts, and at the true one if that differs. Matching maps compose by a prefix scan, here sums.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.words import slices, text_buffer

LIMIT = 4096
CHUNK = 64
RUN_UP = 24
BLOCK = 1 << 19
MAX_STATES = 1 << 17
_SPACE = "▁"
_CODES = 0x110000


def default_vocabulary() -> str:
    """Path of the 32k piece model of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces that texts can contain, and their merge scores; other kinds of models are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, kinds = model.normalizer_spec, model.SentencePiece
    if (model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces
            or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
        raise ValueError(f"{path}: only merge models with byte fallback and without normalisation are compiled")
    pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
        raise ValueError(f"{path}: a piece holds a space behind another character")
    return pieces


class Transducer:
    def __init__(self, pieces: dict[str, float], max_states: int = MAX_STATES):
        self.scores, self.max_states = pieces, max_states
        letters = sorted({c for p in pieces for c in p} | {_SPACE})
        # Characters outside the vocabulary become their bytes; one class for each number of bytes.
        self.plain, self.classes = len(letters), len(letters) + 5
        of = np.full(_CODES, self.plain + 4, np.int16)
        of[:0x80], of[0x80:0x800], of[0x800:0x10000] = self.plain + 1, self.plain + 2, self.plain + 3
        for i, c in enumerate(letters):
            of[ord(c)] = i
        self.space = letters.index(_SPACE)
        of[ord(" ")] = self.space
        self.class_of = of
        self.children: list[dict[int, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        # A lone character is always a symbol, even if only longer pieces are in the vocabulary; then it costs its bytes.
        self.cost = [1 if c in pieces else len(c.encode()) for c in letters]
        for piece in (*letters, *(p for p in pieces if len(p) == 1 or self.merges(p, ""))):
            node = 0
            for c in piece:
                node = self.children[node].setdefault(int(of[ord(c)]), len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.piece_at.append(None)
            self.piece_at[node] = piece
        self.fits_memo: dict[tuple[str, str], bool] = {}
        self.forget()

    def merges(self, left: str, right: str) -> bool:
        """Whether merging the best neighbours first turns the characters into exactly these pieces."""
        parts, scores, want = list(left + right), self.scores, [p for p in (left, right) if p]
        while len(parts) > len(want):
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts == want and not (len(parts) == 2 and parts[0] + parts[1] in scores)

    def fits(self, left: str | None, right: str) -> bool:
        if left is None or (right[0] == _SPACE and left[-1] != _SPACE):
            return True
        key = (left, right)
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > 2 * self.max_states:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self.merges(left, right)
        return known

    def forget(self) -> None:
        """Drops all compiled states but the first, which is the empty text."""
        first = ((0, None, 0),)
        self.states, self.number = [first], {first: 0}
        self.keys = np.full(1 << 16, -1, np.int64)
        self.after, self.change = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.filled = 0

    def compile(self, state: int, c: int) -> tuple[int, int]:
        """The transition of a state under a class: next state and change of the number of pieces."""
        if c >= self.plain:
            return 0, c - self.plain
        entries, last, gain = [], None, 0
        for node, before, count in self.states[state]:
            child = self.children[node].get(c)
            if child is None:
                continue
            if c == self.space and node == 0 and before is not None and before[-1] != _SPACE:
                before = None
            entries.append((child, before, count))
            piece = self.piece_at[child]
            if last is None and piece is not None and self.fits(before, piece):
                last, gain = piece, count + (self.cost[c] if len(piece) == 1 else 1)
        new = (*((n, b, k - gain) for n, b, k in entries if self.children[n]), (0, last, 0))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        return at, gain

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the table, or the free place where it belongs."""
        mask, shift = len(self.keys) - 1, np.uint64(65 - len(self.keys).bit_length())
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        held = self.keys[at]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            held = self.keys[at[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return at

    def _add(self, keys: np.ndarray, after: np.ndarray, change: np.ndarray) -> None:
        while len(keys):
            at = self._slots(keys)
            place, first = np.unique(at, return_index=True)
            self.keys[place], self.after[place], self.change[place] = keys[first], after[first], change[first]
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, after, change = keys[rest], after[rest], change[rest]

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many runs at once."""
        keys = state * self.classes + c
        at = self._slots(keys)
        missing = np.unique(keys[self.keys[at] < 0])
        if len(missing):
            made = np.array([self.compile(int(k) // self.classes, int(k) % self.classes) for k in missing], np.int32)
            self.filled += len(missing)
            if 2 * self.filled > len(self.keys):
                used = np.flatnonzero(self.keys >= 0)
                old = self.keys[used], self.after[used], self.change[used]
                size = len(self.keys)
                while size < 4 * self.filled:
                    size *= 2
                self.keys, self.after, self.change = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
                self._add(*old)
            self._add(missing, made[:, 0], made[:, 1])
            at = self._slots(keys)
        return self.after[at].astype(np.int64), self.change[at]

    def run(self, c: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State maps of chunks at one entry state each: exit state and number of pieces gained."""
        order = np.argsort(-length, kind="stable")
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        begin, length = begin[order], length[order]
        active = len(order)
        for i in range(int(length[0]) if active else 0):
            active = int(np.searchsorted(-length[:active], -i, side="left"))
            state[:active], change = self.step(state[:active], c[begin[:active] + i])
            count[:active] += change
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def chunks(self, c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins of chunks, all text starts included, and whether the map of each chunk is constant."""
        rested = np.zeros(len(c), bool)
        rested[1:] = (c[1:] == self.space) & (c[:-1] != self.space)
        rested[starts] = False
        at = np.flatnonzero(rested)
        at = at[np.concatenate([[True], at[1:] // CHUNK != at[:-1] // CHUNK])] if len(at) else at
        cuts = np.unique(np.concatenate([starts, at]))
        gap = np.diff(np.append(cuts, len(c)))
        more = np.where(gap > 3 * CHUNK, gap // CHUNK - 1, 0)
        begin = np.repeat(cuts, more + 1)
        begin = begin + CHUNK * (np.arange(len(begin)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
        constant = rested[begin]
        constant[np.searchsorted(begin, starts)] = True
        return begin, constant

    def count(self, codes: np.ndarray, starts: np.ndarray, entry: int | None = None) -> tuple[np.ndarray, int]:
        """Pieces gained by each text of a block and the state behind the last one. Texts are not empty; the first
        goes on from `entry` if that is given."""
        c = self.class_of[codes].astype(np.int64)
        begin, known = self.chunks(c, starts)
        length = np.diff(np.append(begin, len(c)))
        first = np.searchsorted(begin, starts)
        fresh, extra = (int(x[0]) for x in self.step(np.array([0]), np.array([self.space])))
        states = np.zeros(len(begin), np.int64)
        states[first] = fresh
        if entry is not None:
            states[0] = entry
        guess = np.flatnonzero(~known)
        if len(guess):
            text = starts[np.searchsorted(starts, begin[guess], side="right") - 1]
            from_ = np.maximum(begin[guess] - RUN_UP, text)
            states[guess] = self.run(c, from_, begin[guess] - from_, np.zeros(len(guess), np.int64))[0]
        exits, counts = self.run(c, begin, length, states)
        while True:
            wrong = 1 + np.flatnonzero(~known[1:] & (exits[:-1] != states[1:]))
            if not len(wrong):
                break
            states[wrong] = exits[wrong - 1]
            exits[wrong], counts[wrong] = self.run(c, begin[wrong], length[wrong], states[wrong])
        scan = np.concatenate([[0], np.cumsum(counts)])
        totals = scan[np.append(first[1:], len(begin))] - scan[first] + extra
        if entry is not None:
            totals[0] -= extra
        return totals, int(exits[-1])


_COMPILED: dict[int, Transducer] = {}


def _transducer(pieces: dict[str, float], max_states: int) -> Transducer:
    """The transducer of this worker, kept from task to task."""
    key = hash((len(pieces), max_states, *list(pieces.items())[-64:]))
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(pieces, max_states)
    return _COMPILED[key]


def counted(column: pa.Array, machine: Transducer, block: int = BLOCK) -> np.ndarray:
    """Number of tokens of every text of a column."""
    data, offsets = text_buffer(column)
    totals, state = np.zeros(len(column), np.int64), None
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + block, end)
        while stop < end and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if len(machine.states) > machine.max_states:
            # Only the state in hand survives.
            held = machine.states[state] if state is not None else None
            machine.forget()
            if held is not None:
                state = machine.number.setdefault(held, len(machine.states))
                if state == len(machine.states):
                    machine.states.append(held)
        codes = np.frombuffer(data[at:stop].tobytes().decode().encode("utf-32-le"), np.uint32)
        # Texts with a byte in the block, and the first character of each.
        low = int(np.searchsorted(offsets, at, side="right")) - 1
        high = int(np.searchsorted(offsets, stop, side="left"))
        own = low + np.flatnonzero(np.diff(np.clip(offsets[low:high + 1], at, stop)) > 0)
        heads = np.cumsum(data[at:stop] & 0xC0 != 0x80) - 1
        starts = heads[np.maximum(offsets[own], at) - at]
        found, exit_ = machine.count(codes, starts, state)
        totals[own] += found
        state = exit_ if offsets[own[-1] + 1] > stop else None
        at = stop
    return totals


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
                 limit: int = LIMIT, max_states: int = MAX_STATES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, without begin, end or added special tokens.

    Counts are those of the vocabulary's own library for the whole text; the strings of its special tokens are plain
    text. Null and empty texts have no token; texts of any length go through in blocks; repeated rows are counted
    each; ids may be null; an empty table gives an empty result. Other columns are not read. `max_states` bounds the
    compiled states a worker keeps between blocks; beyond it they are compiled anew.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared.value, max_states)
        for batch in slices(batches, "text"):
            sizes = np.diff(text_buffer(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counted(batch.column(1), machine), pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
