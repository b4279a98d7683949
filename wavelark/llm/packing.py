"""Packing of token sequences into windows by the sum-of-squares rule (operator 1).

Each document is cut into full windows and one shorter rest. A rest of size s goes to the fill level
h (0: a new window) for which the sum over levels of (number of open windows)^2 grows least; the
numbers of open windows per level are kept in an array. A window leaves memory once it is full.
Windows that stay open at the end of a partition, or beyond `max_open`, are joined and cut anew, so
that a partition has at most one window with padding.

The work needs no shuffle: every scan partition packs its own stream of documents, and a retried task
reads the same rows in the same order and so repeats its sequence ids.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.tokens import default_vocabulary, encoder
from wavelark.llm.words import slices

_SEQUENCE_BITS = 40
_FLUSH_BYTES = 4 << 20
_NEVER = np.int64(1) << 60


class Packer:
    """Online packer of one stream. `add` and `finish` yield full windows as lists of pieces."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, np.int64)
        # Change of the sum of squares when a window leaves level h, and when one arrives there.
        self.leave = np.full(capacity + 1, _NEVER)
        self.leave[0] = 0
        self.arrive = np.ones(capacity + 1, np.int64)
        self.arrive[capacity] = 0
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def _change(self, level: int, by: int) -> None:
        if 0 < level < self.capacity:
            n = self.count[level] = self.count[level] + by
            self.leave[level] = 1 - 2 * n if n else _NEVER
            self.arrive[level] = 1 + 2 * n
            self.n_open += by

    def level_for(self, size: int) -> int:
        """The cheapest level; among equal ones the fullest."""
        cost = self.leave[:self.capacity - size + 1] + self.arrive[size:]
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        total, c = len(ids), self.capacity
        for at in range(0, total - total % c, c):
            yield [(doc, at, ids[at:at + c], total)]
        size = total % c
        if not size:
            return
        piece = (doc, total - size, ids[total - size:].copy(), total)
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self._change(level, -1)
        window.append(piece)
        if level + size == c:
            yield window
            return
        self.open[level + size].append(window)
        self._change(level + size, 1)
        if self.n_open > self.max_open:
            *full, rest = list(self.finish())
            yield from full
            level = sum(len(p[2]) for p in rest)
            if level == c:
                yield rest
            else:
                self.open[level].append(rest)
                self._change(level, 1)

    def finish(self) -> Iterator[list]:
        """Joins what is open, fullest windows first, and cuts it into windows; only the last has room left."""
        window, room = [], self.capacity
        for level in range(self.capacity - 1, 0, -1):
            for held in self.open[level]:
                for doc, start, ids, total in held:
                    while len(ids):
                        take = min(room, len(ids))
                        window.append((doc, start, ids[:take], total))
                        start, ids, room = start + take, ids[take:], room - take
                        if not room:
                            yield window
                            window, room = [], self.capacity
            self._change(level, -len(self.open[level]))
            self.open[level] = []
        if window:
            yield window


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024,
         vocabulary: str | None = None, end_id: int = 0, max_open: int = 4096) -> DataFrame:
    """Pieces of documents with their places in windows of `capacity` tokens.

    One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian unsigned
    32-bit, binary), doc_tokens (with the end id), sequence_id, offset. Null and empty texts are a piece of
    the end id alone; repeated rows are packed once per row; an empty table gives no row; other columns
    are not read. `max_open` bounds the open windows that a task holds.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS
        packer, kind = Packer(capacity, max_open), None
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal rows, held
            columns = list(zip(*rows)) if rows else []
            rows, held = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [kind, *kinds])], names=schema.names)

        def place(windows):
            nonlocal sequence, held
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                    offset += len(ids)
                held += 4 * offset
                sequence += 1

        end = np.array([end_id], np.uint32)
        for batch in slices(batches, "text"):
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                place(packer.add(doc, np.concatenate([encode(text.as_py()), end])))
                if held >= _FLUSH_BYTES:
                    yield flush()
        place(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
