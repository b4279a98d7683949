"""Importance resampling of documents towards a target text (operator 12).

Words are split by Arrow kernels (`ascii_lower`, `split_pattern_regex`, `list_flatten`) and numbered by
`dictionary_encode`. Shifted numbers side by side form the runs of two and three words; every distinct run of a slice gets
its CRC once, joined from the CRCs of its parts, and the rows take it from there. Bucket counts of corpus and target are
summed by Spark and give a gain per bucket; a document's weight is the sum of the gains over its segment of runs. The draw
without replacement takes the highest weights plus Gumbel noise from a hash of the id.
"""

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import stored
from wavelark.llm.words import slices, text_buffer
from wavelark.operators.ordering import numbered

BUCKETS = 10_000
PERCENT = 5
MIN_WORDS = 20
SEED = 42
#: Longer texts go through in parts of about so many bytes.
PART = 4 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


@lru_cache(maxsize=4096)
def _carry(length: int) -> np.ndarray:
    """A CRC register carried over `length` more bytes is linear in its bits: one table of 256 entries for each of its bytes."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    columns = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
    tables = np.zeros((4, 256), np.uint32)
    for i, column in enumerate(columns):
        tables[i // 8, (np.arange(256) >> i % 8 & 1).astype(bool)] ^= np.uint32(column)
    return tables


def _joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings whose second parts have the CRCs `right` and the given lengths."""
    sizes, which = np.unique(length, return_inverse=True)
    out = right.copy()
    for i, size in enumerate(sizes):
        at = np.flatnonzero(which == i)
        tables, own = _carry(int(size)), left[at]
        out[at] ^= (tables[0][own & 255] ^ tables[1][own >> 8 & 255] ^ tables[2][own >> 16 & 255] ^ tables[3][own >> 24])
    return out


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a column as one encoded array, and the place of each text's first word (one more at the end)."""
    data, at = text_buffer(texts)
    # The kernels misread the offsets of sliced arrays, so the texts are laid out from offset 0.
    whole = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at - at[0]), pa.py_buffer(data[at[0]:at[-1]])])
    lists = pc.split_pattern_regex(pc.ascii_lower(whole), _BETWEEN)
    owner, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    # A separator at either end of a text leaves an empty word there.
    real = pc.not_equal(flat, "")
    owner, flat = owner.filter(real).to_numpy(), flat.filter(real)
    return flat.dictionary_encode(), np.searchsorted(owner, np.arange(len(texts) + 1))


def _encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the number of each row's value among them."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


class Features:
    """Buckets of the runs of one to three words that end at each word of a column of texts."""

    def __init__(self, texts: pa.Array, buckets: int):
        encoded, self.at = split_words(texts)
        self.words = encoded
        word = encoded.indices.to_numpy().astype(np.int64)
        raw = [w.encode() for w in encoded.dictionary.to_pylist()]
        crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        spaced = np.array([zlib.crc32(b" ", int(c)) for c in crc], np.uint32)
        length, many = np.array([len(w) for w in raw], np.int64), max(1, len(raw))
        self.place = np.arange(len(word)) - np.repeat(self.at[:-1], np.diff(self.at))
        self.buckets = [np.zeros(len(word), np.int64) for _ in range(3)]
        self.buckets[0] = (crc % np.uint32(buckets)).astype(np.int64)[word] if len(word) else word
        if len(word) < 2:
            return
        pair, number = _encoded(word[:-1] * many + word[1:])
        first, second = pair // many, pair % many
        two = _joined(spaced[first], crc[second], length[second])
        self.buckets[1][1:] = (two % np.uint32(buckets)).astype(np.int64)[number]
        if len(word) < 3:
            return
        triple, again = _encoded(number[:-1] * many + word[2:])
        first, third = triple // many, triple % many
        one = np.full(len(first), zlib.crc32(b" "), np.uint32)
        three = _joined(_joined(two[first], one, np.ones(len(first), np.int64)), crc[third], length[third])
        self.buckets[2][2:] = (three % np.uint32(buckets)).astype(np.int64)[again]

    def counts(self, buckets: int, skip: int = 0) -> np.ndarray:
        """Features per bucket, without those that end within the first `skip` words of a text."""
        return sum(np.bincount(b[self.place >= max(n, skip)], minlength=buckets) for n, b in enumerate(self.buckets))

    def sums(self, gains: np.ndarray, skip: int = 0) -> np.ndarray:
        """Sum of the gains of each text's features."""
        total = sum(np.where(self.place >= max(n, skip), gains[b], 0) for n, b in enumerate(self.buckets))
        scan = np.concatenate([[0], np.cumsum(total)])
        return scan[self.at[1:]] - scan[self.at[:-1]]


def _parts(texts: pa.Array, part: int) -> Iterator[tuple[pa.Array, int]]:
    """The texts, and how many leading words of each were seen before: a long text comes in parts cut between
    words, and each further part repeats the two words before it."""
    if len(texts) != 1 or not texts[0].is_valid or len(texts[0].as_buffer() or b"") <= part:
        yield texts, 0
        return
    data, at, tail = bytes(texts[0].as_buffer()), 0, []
    while at < len(data):
        cut = _GAP.search(data, at + part)
        end = cut.start() if cut else len(data)
        own = pa.array([" ".join([*tail, data[at:end].decode()])], pa.large_string())
        yield own, len(tail)
        words = split_words(own)[0]
        tail = words[-2:].to_pylist()
        at = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, part: int = PART) -> DataFrame:
    """(bucket, n): features of all texts by bucket, summed within a task before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for own, skip in _parts(batch.column(0), part):
                total += Features(own, buckets).counts(buckets, skip)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of target to corpus) of every bucket."""
    s_all, t_all, many = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + many) / ((s + 1.0) * (t_all + many))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _counts(texts: DataFrame, buckets: int, part: int) -> np.ndarray:
    """At most `buckets` rows reach the driver."""
    out = np.zeros(buckets, np.int64)
    for r in bucket_counts(texts, buckets, part).collect():
        out[r["bucket"]] = r["n"]
    return out


def _weighed(docs: DataFrame, gains: np.ndarray, part: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in slices(batches, "text"):
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for own, skip in _parts(batch.column(1), part):
                features = Features(own, len(gains))
                words += np.diff(features.at) - skip
                weight += features.sums(gains, skip)
            count = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))], names=schema.names)

    return docs.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, part: int = PART) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; `rank` is 1, 2, 3 ... for the drawn rows, else null.

    Words are runs of ASCII digits, letters (A-Z in lower case) and characters beyond ASCII. Of the rows with at least
    `min_words` words and an id, `percent` in a hundred (rounded down) with the highest scores are drawn, ties by the
    smaller id. Null, empty and wordless texts have weight 0. A row without an id has a null score and is never drawn. Repeated rows are rows of
    their own: each counts and each can be drawn. Texts of any length are read whole, in parts. An empty table of documents gives
    no row; an empty target draws what is least like the corpus. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    gains = bucket_gains(_counts(docs, buckets, part), _counts(target.select(F.col(target_text).alias("text")), buckets, part))
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
             + F.lit(0.5)) / F.lit(4294967296.0)
    scored = stored(_weighed(docs, gains, part).withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(noise)))), "scored")
    takes_part = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    draw = scored.where(takes_part).count() * percent // 100
    # One global order in ranges. The row number ends the order, so that rows alike do not pile up in one range.
    ordered = scored.withColumns({"_out": ~takes_part, "_row": F.monotonically_increasing_id()})
    order = [F.col("_out"), F.desc("score"), F.col("doc_id"), F.col("_row")]
    placed = numbered(ordered.repartitionByRange(*order).sortWithinPartitions(*order), "rank", 1)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(~F.col("_out") & (F.col("rank") <= draw), F.col("rank")).cast("long").alias("rank"))
