"""Search for short benchmark items inside long documents (operator 6).

A document that holds at least `percent` of an item's n shingles holds one of any n - ceil(percent * n / 100) + 1
of them. An item's MinHash sketch is that many of its smallest hash values; the number follows from the
item's size, so items are partitioned by size and no match can be missed, however long the document.
Equal item texts are folded to one. The sketches of a slice of items, bounded in rows and bytes, travel to every task; the
documents are read once per slice and never shuffled. Candidates are verified on their words.
"""

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import sized, stored
from wavelark.llm.words import LETTERS, shingles, slices, word_hashes

#: Distinct items whose sketches and words are sent to the tasks at once, and their bytes of text (one longer item goes alone).
ITEMS_AT_ONCE, BYTES_AT_ONCE = 100_000, 32 << 20
_FILTER_BITS = 22
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _lowered(texts: pa.Array) -> pa.Array:
    """One rule of lower case for search and verification: character by character."""
    return pc.utf8_lower(texts)


def _runs(lowered: str, size: int) -> set[tuple]:
    words = _WORD.findall(lowered.encode())
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


class Sketches:
    """MinHash sketches of items, partitioned by the number of shingles that decides their size."""

    def __init__(self, items: list[tuple], size: int, percent: int):
        self.percent, self.runs = percent, []
        texts = _lowered(pa.array([text for _, text in items], pa.large_string()))
        words, at = word_hashes(texts, LETTERS)
        owners, values, self.lengths = [], [], set()
        by_size: dict[int, list[int]] = defaultdict(list)
        sets = {}
        for i, (item, _) in enumerate(items):
            own = words[at[i]:at[i + 1]]
            if not len(own):
                continue
            length = min(size, len(own))
            sets[i] = np.unique(shingles(own, length))
            by_size[len(sets[i])].append(i)
            self.lengths.add(length)
        for n, members in sorted(by_size.items()):
            take = n - (percent * n + 99) // 100 + 1
            for i in members:
                values.append(sets[i][:take])
                owners.append(np.full(take, len(self.runs)))
                length = min(size, int(at[i + 1] - at[i]))
                self.runs.append((items[i][0], length, _runs(texts[i].as_py(), length)))
        values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items with a sketch value among the shingles of a text."""
        found: set[int] = set()
        for length in self.lengths:
            if len(words) < length:
                continue
            own = shingles(words, length)
            own = own[self.filter[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
            low, high = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
            for a, b in zip(low[high > low], high[high > low]):
                found.update(self.owners[a:b].tolist())
        return found

    def matches(self, words: np.ndarray, lowered: str) -> list[tuple]:
        """(item, shingles, shared) of the items that the text contains, given in lower case."""
        out, runs = [], {}
        for i in sorted(self.candidates(words)):
            item, length, wanted = self.runs[i]
            if length not in runs:
                runs[length] = _runs(lowered, length)
            shared = len(wanted & runs[length])
            if 100 * shared >= self.percent * len(wanted):
                out.append((item, len(wanted), shared))
        return out


def _slices_of_items(items: DataFrame, rows: int, size: int) -> list[Callable[[], list[tuple]]]:
    """Readers of (item, text) slices of distinct texts, none above the bounds unless a single text is."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    # Cut in the order of a hash; the running sum over at most `parts` cells decides, and cells too large are cut on.
    parts = max(1, math.ceil(total["n"] / rows), math.ceil(2 * (total["bytes"] or 0) / size))
    if parts == 1:
        return [lambda: [(r["item"], r["text"]) for r in items.collect()]]
    cell = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(parts))
    numbered = stored(items.withColumn("cell", cell).withColumn("sum", F.sum("bytes").over(
        Window.partitionBy("cell").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "place", F.row_number().over(Window.partitionBy("cell").orderBy("item"))).withColumn(
        "run", F.greatest(F.floor((F.col("sum") - 1) / size), F.floor((F.col("place") - 1) / rows))), "item-slices")
    found = numbered.select("cell", "run").distinct().orderBy("cell", "run").collect()
    return [lambda c=r["cell"], n=r["run"]: [(x["item"], x["text"]) for x in numbered.where((F.col("cell") == c) & (F.col("run") == n)).collect()]
            for r in found]


def _distinct_texts(items: DataFrame) -> DataFrame:
    """(item, text, bytes): each different text once, numbered."""
    texts = items.select("text").distinct().withColumn("item", F.monotonically_increasing_id())
    return stored(texts.select("item", "text", F.octet_length("text").alias("bytes")), "item-texts")


def contained_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    item_column: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80,
                    items_at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every item held by a document.

    Words are runs of letters and digits in lower case; an item of fewer than `size` words is one shingle of all
    its words. Items and texts that are null or without words match nothing; an empty table of either gives no row. Equal items
    and repeated rows are reported each for itself; ids may be null. Texts of any length are read whole. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    items = stored(items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL"), "items")
    texts = _distinct_texts(items)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item", T.LongType()), T.StructField("item_shingles", T.LongType()),
                           T.StructField("shared", T.LongType()), T.StructField("containment", T.DoubleType())])
    found = None
    for read in _slices_of_items(texts, items_at_once, bytes_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(read())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches, kind = Sketches(shared.value, size, percent), None
            for batch in slices(batches, "text"):
                kind = batch.schema.field(0).type
                lowered = _lowered(batch.column(1))
                words, at = word_hashes(lowered, LETTERS)
                rows = []
                for i in range(batch.num_rows):
                    if own := sketches.matches(words[at[i]:at[i + 1]], lowered[i].as_py() or ""):
                        doc = batch.column(0)[i].as_py()
                        rows += [(doc, item, n, hits, hits / n) for item, n, hits in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows), [kind, pa.int64(), pa.int64(), pa.int64(), pa.float64()])], names=schema.names)

        one = docs.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    owners = items.join(texts.select("item", "text"), "text").select("item", "item_id")
    return found.join(sized(stored(owners, "item-owners")), "item").select("doc_id", "item_id", "item_shingles", "shared", "containment")


def without_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_text: str = "text",
                  size: int = 5, percent: int = 80, items_at_once: int = ITEMS_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """The documents that contain no item.

    Every row is decided by its own text, whatever its id: rows without an id or with a repeated one are no different. Texts
    that are null or without words stay. Columns are those of `docs`, whatever their names.
    """
    texts = _distinct_texts(items.select(F.col(item_text).alias("text")).where("text IS NOT NULL"))
    at_text = docs.columns.index(text_column)
    schema = docs.schema
    for read in _slices_of_items(texts, items_at_once, bytes_at_once):
        shared = docs.sparkSession.sparkContext.broadcast(read())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(shared.value, size, percent)
            for batch in slices(batches, text_column):
                lowered = _lowered(batch.column(at_text))
                words, at = word_hashes(lowered, LETTERS)
                keep = [not sketches.matches(words[at[i]:at[i + 1]], lowered[i].as_py() or "") for i in range(batch.num_rows)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
