"""Exact similarity join of documents on word shingles (operator 4).

1. One pass turns every text into its shingle set: size, digest, bin minima and a toggled bitmap whose length follows the
   size. Equal sets are folded to the row with the smallest id. The same pass counts shingles by hash bucket; the counts of all
   tasks are summed.
2. Stars: sets that share a bin minimum are compared with the most central set of that group only.
   This joins large families of near copies with a number of comparisons in proportion to their size.
3. Completeness: two sets above the threshold share shingles of their prefixes, the first few shingles in one
   global order (rare buckets before common ones), and the more the larger they are. Sets that meet in a prefix shingle are
   put into tiles of one size band each, as narrow rows with the bitmap folded to a few words. A meeting counts only if the
   shingle comes early enough in both sets: the shingles before it that are not shared are limited by the sizes of the pair, so
   sets that share most of their prefixes meet a few times instead of once for every shingle. Differing bits bound the overlap
   from above: first those of the folded bitmaps, which tell small sets apart, then, for pairs of different components that
   meet often enough, those of the whole ones.
4. Candidates of 2 and 3 are decided by intersecting the sorted shingles of the two texts.

No step lists all pairs of a group whose members are already known to be connected.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.components import components
from wavelark.llm.storage import sized, stored
from wavelark.llm.words import mix, shingle_set, slices, word_hashes

BINS = 8
MIN_BITS, MAX_BITS = 512, 1 << 20
SKETCH_WORDS = 4
_BUCKET_BITS = 20
_RANGE = 4096
_SALTS = 8
_SHARED = 64


def _digest(values: np.ndarray) -> bytes:
    mixed = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([values.sum(dtype=np.uint64), mixed.sum(dtype=np.uint64)], np.uint64).tobytes()


def _folded_bits(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap folded to fewer words of 64 bits; every toggle is kept, so differing bits still bound differing shingles."""
    return np.bitwise_xor.reduce(bits.reshape(-1, 8 * words), axis=0)


def _signature(values: np.ndarray) -> tuple[bytes, list, bytes, list]:
    """Digest, smallest value per bin, bitmap of at least as many bits as shingles in which every shingle toggles one, and
    the bitmap folded to `SKETCH_WORDS`."""
    mixed = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    bins = (mixed & np.uint64(BINS - 1)).astype(np.int64)
    minima = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(minima, bins, mixed)
    present = np.zeros(BINS, bool)
    present[bins] = True
    length = min(max(MIN_BITS, 1 << int(len(values) - 1).bit_length()), MAX_BITS)
    bits = np.bincount((mixed >> np.uint64(32)).astype(np.int64) & (length - 1), minlength=length) & 1
    packed = np.packbits(bits.astype(np.uint8))
    return (_digest(values), [int(m) if p else None for m, p in zip(minima.view(np.int64), present)],
            packed.tobytes(), _folded_bits(packed, SKETCH_WORDS).view(np.int64).tolist())


def differing_bits(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps; the longer one is folded to the length of the shorter, which keeps every toggle."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = _folded_bits(x, len(y) // 8)
    return int(np.bitwise_count(x ^ y).sum())


def shingle_table(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (doc_id, n, digest, minima, bits, sketch), and per task rows (range, counts): how many documents hold a
    shingle of each hash bucket, a range of buckets a row."""
    listed = T.ArrayType(T.LongType())
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("minima", listed), T.StructField("bits", T.BinaryType()), T.StructField("sketch", listed),
        T.StructField("range", T.LongType()), T.StructField("counts", listed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << _BUCKET_BITS, np.int64), pa.int64()
        many = pa.list_(pa.int64())

        def rows(ids, sizes, digests, minima, bits, sketches, ranges, held):
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, many),
                pa.array(bits, pa.binary()), pa.array(sketches, many), pa.array(ranges, pa.int64()), pa.array(held, many)], names=schema.names)

        for batch in slices(batches, "text"):
            kind = batch.schema.field(0).type
            words, at = word_hashes(batch.column(1))
            sizes, signatures = [], []
            for i in range(batch.num_rows):
                values = shingle_set(words[at[i]:at[i + 1]], size)
                sizes.append(len(values))
                signatures.append(_signature(values) if len(values) else (None,) * 4)
                np.add.at(counts, (values >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), 1)
            none = [None] * batch.num_rows
            yield rows(batch.column(0).to_pylist(), sizes, *map(list, zip(*signatures)), none, none)
        table = counts.reshape(-1, _RANGE)
        held = np.flatnonzero(table.any(axis=1))
        none = [None] * len(held)
        yield rows(none, none, none, none, none, none, held, [table[i].tolist() for i in held])

    return docs.mapInArrow(run, schema)


def bucket_counts(table: DataFrame) -> np.ndarray:
    """Documents per bucket over the whole table; the driver gets one number for each of the 2 ** 20 buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << _BUCKET_BITS) // _RANGE * _RANGE, np.int64).reshape(-1, _RANGE)
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy().reshape(-1, _RANGE)
                np.add.at(total, batch.column(0).to_numpy(), rows)
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([total[i].tobytes() for i in held], pa.binary())], names=["range", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(_RANGE, np.int64)
        for own in parts.column("sums").to_pylist():
            total += np.frombuffer(own, np.int64)
        return pa.table([parts.column("range").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["range", "sums"])

    kind = "range long, sums binary"
    sums = table.where("range IS NOT NULL").select("range", "counts").mapInArrow(run, kind).groupBy("range").applyInArrow(add, kind)
    out = np.zeros(1 << _BUCKET_BITS, np.int64)
    for r in sums.collect():
        out[r["range"] * _RANGE:(r["range"] + 1) * _RANGE] = np.frombuffer(r["sums"], np.int64)
    return out


def bucket_ranks(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of every bucket by its documents, in quarters of a power of two, and the rank from which buckets are common."""
    def rank(x):
        return np.floor(4 * np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.uint8)

    return rank(counts), int(rank(np.array([16 + 4 * counts.mean()]))[0])


def _prefixes(docs: DataFrame, size: int, percent: int, ranks: tuple[np.ndarray, int]) -> DataFrame:
    """(key, doc_id, content, common, at): the shingles of which similar sets of n or more share at least 1 + n // _SHARED, and their
    places in the order."""
    schema = T.StructType([
        T.StructField("key", T.LongType()), docs.schema["doc_id"], T.StructField("content", T.LongType()),
        T.StructField("common", T.BooleanType()), T.StructField("at", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, many = shared.value
        for batch in slices(batches, "text"):
            words, at = word_hashes(batch.column(1))
            keys, contents, lengths, common = [], [], [], []
            for i in range(batch.num_rows):
                values = shingle_set(words[at[i]:at[i + 1]], size)
                n = len(values)
                take = n - (percent * n + 99) // 100 + 1 + n // _SHARED if n else 0
                rank = ranks[(values >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)]
                # Sorted by value already, so a stable order by rank is the global order.
                first = np.argsort(rank, kind="stable")[:take]
                keys.append(values[first])
                common.append(rank[first] >= many)
                contents.append(mix(values.sum(dtype=np.uint64, keepdims=True))[0] if n else 0)
                lengths.append(take)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), lengths)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), ids,
                pa.array(np.repeat(np.array(contents, np.uint64), lengths).view(np.int64)), pa.array(np.concatenate(common)),
                pa.array(np.concatenate([np.arange(take, dtype=np.int32) for take in lengths]))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _shared_keys(rows: DataFrame) -> DataFrame:
    """Drops the keys that only one content has; reads rows grouped by key, one group in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def several(batch: pa.Table) -> pa.Table:
            key, content = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            keep = np.minimum.reduceat(content, first) != np.maximum.reduceat(content, first)
            return batch.filter(pa.array(np.repeat(keep, np.diff(np.append(first, len(key))))))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], side="left"))
            if held and last:
                ready = pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            elif held and held[-1].column(0)[0].as_py() != key[-1]:
                ready, held = pa.Table.from_batches(held), []
            else:
                ready = pa.Table.from_batches([batch.slice(0, last)]) if last else None
            held.append(batch.slice(last))
            if ready is not None and ready.num_rows:
                yield from several(ready).to_batches()
        if held:
            yield from several(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, rows.schema)


def _overlap_possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can reach the threshold: overlap is at most half of (sizes - differing bits)."""
    side = sets.select("doc_id", "n", "bits")
    rows = pairs.join(side.toDF("a", "n1", "bits1"), "a").join(side.toDF("b", "n2", "bits2"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([differing_bits(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = (100 + percent) * (n - apart) >= 2 * percent * n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    kind = sets.schema["doc_id"].dataType.simpleString()
    return rows.where(_sizes_fit(percent, "n1", "n2")).select("a", "b", "n1", "n2", "bits1", "bits2").mapInArrow(run, f"a {kind}, b {kind}")


def _sketches_allow(percent: int) -> Column:
    """The same bound from the folded bitmaps s1 and s2 of a row."""
    n = F.col("n1") + F.col("n2")
    apart = sum((F.bit_count(F.col("s1")[i].bitwiseXOR(F.col("s2")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return F.lit(100 + percent) * (n - apart) >= F.lit(2 * percent) * n


def _sizes_fit(percent: int, n1: str, n2: str) -> Column:
    return (F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2))


def _early(percent: int, n: str, at: str) -> Column:
    """Whether a shared shingle can be among the first 1 + min(n1, n2) // _SHARED shared ones of a similar pair.

    Before the k-th shared one stand k - 1 shared and at most n - overlap others, and the overlap is at least
    percent * (n1 + n2) / (100 + percent).
    """
    more = F.floor(F.least("n1", "n2") / _SHARED)
    return F.lit(percent) * (F.col("n1") + F.col("n2")) <= F.lit(100 + percent) * (F.col(n) + more - F.col(at))


def _star_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the most central set of its minimum groups."""
    minima = sets.select("doc_id", F.posexplode("minima").alias("bin", "value")).where("value IS NOT NULL")
    group = ["bin", "value"]
    crowded = minima.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = stored(minima.join(crowded, group), "minima")
    weight = rows.groupBy("doc_id").agg(F.sum(F.log2("size")).alias("weight"))
    leaders = rows.join(weight, "doc_id").groupBy(*group).agg(
        F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("best")).select(*group, (-F.col("best.id")).alias("b"))
    pairs = rows.join(leaders, group).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    return _overlap_possible(pairs, sets, percent)


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, n1, n2) for each early prefix key that two sets of different components share, if sizes and folded bitmaps allow it."""
    # Bands are a little wider than the ratio of sizes that can match, so a pair lies in one band or in neighbours.
    band = F.floor(F.log("n") / F.log(F.lit(100 / (percent - 1)))).cast("int")
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int")
    smaller = rows.select("key", band.alias("tile"), salt.alias("salt"), F.col("doc_id").alias("a"), F.col("n").alias("n1"),
                          F.col("component").alias("c1"), F.col("sketch").alias("s1"), F.col("at").alias("at1"))
    salts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    larger = rows.select("key", F.explode(F.array(band, band - 1)).alias("tile"), salts.alias("salts"), F.col("doc_id").alias("b"),
                         F.col("n").alias("n2"), F.col("component").alias("c2"), F.col("sketch").alias("s2"), F.col("at").alias("at2"))
    larger = larger.withColumn("salt", F.explode("salts")).drop("salts")
    ordered = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")))
    return smaller.hint("merge").join(larger, ["key", "tile", "salt"]).where(
        (F.col("c1") != F.col("c2")) & ordered & _sizes_fit(percent, "n1", "n2")
        & _early(percent, "n1", "at1") & _early(percent, "n2", "at2") & _sketches_allow(percent)).select("a", "b", "n1", "n2")


def _tile_candidates(prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share enough prefix keys and pass the bitmap bound."""
    rare = _shared_keys(prefixes.where(~F.col("common")))
    rows = stored(rare.unionByName(prefixes.where("common")).drop("content").join(
        sets.select("doc_id", "n", "component", "sketch"), "doc_id"), "prefixes")
    crossing = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    often = _meetings(rows.join(crossing, "key"), percent).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("n1").alias("n")).where(
        F.col("shared") >= 1 + F.floor(F.col("n") / _SHARED)).select("a", "b")
    return _overlap_possible(stored(often, "met"), sets, percent)


def _linked(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose shingle sets reach the threshold, by intersecting them."""
    pairs = stored(pairs, "pairs")
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    texts = stored(docs.join(sized(ends), "doc_id", "left_semi"), "texts")
    rows = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 2 << 20):
            words_a, at_a = word_hashes(batch.column(2))
            keep = []
            for i in range(batch.num_rows):
                words_b, _ = word_hashes(batch.column(3).slice(i, 1))
                x, y = shingle_set(words_a[at_a[i]:at_a[i + 1]], size), shingle_set(words_b, size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, schema).distinct()


def _with_digest(docs: DataFrame, size: int, text_column: str) -> DataFrame:
    """Adds `_digest` and `_n` of each row's shingle set; null and 0 for a text without words."""
    schema = T.StructType([*docs.schema, T.StructField("_digest", T.BinaryType()), T.StructField("_n", T.LongType())])
    at_text = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            words, at = word_hashes(batch.column(at_text))
            sets = [shingle_set(words[at[i]:at[i + 1]], size) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([_digest(v) if len(v) else None for v in sets], pa.binary()), pa.array([len(v) for v in sets], pa.int64())],
                names=schema.names)

    return docs.mapInArrow(run, schema)


def _nodes(sets: DataFrame, rows: DataFrame, docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Gives each set a number of its own: its smallest id, or a number below all ids where that id has several texts.

    Returns the sets with `first` (smallest id) and `doc_id` (the number), and the texts by that number.
    """
    text = F.struct("digest", "n")
    per_id = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y"))
    shared = stored(per_id.where("x <> y").select(F.col("doc_id").cast("long").alias("doc_id")), "shared")
    if shared.isEmpty():
        return sets.withColumn("first", F.col("doc_id")), docs
    lowest = sets.agg(F.min("doc_id")).first()[0]
    odd = stored(sets.join(sized(shared), "doc_id", "left_semi").withColumn("_at", F.monotonically_increasing_id()), "odd")
    odd = odd.withColumn("first", F.col("doc_id")).withColumn("doc_id", (F.lit(min(lowest, 0) - 1) - F.col("_at")).cast("long")).drop("_at")
    numbered = stored(sets.join(sized(shared), "doc_id", "left_anti").withColumn("first", F.col("doc_id")).unionByName(odd), "nodes")
    owner = odd.select(F.col("first"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), F.col("doc_id").alias("_node"))
    texts = _with_digest(docs.join(sized(shared), "doc_id", "left_semi"), size, "text").withColumnRenamed("doc_id", "first")
    moved = texts.join(owner, ["first", "_digest", "_n"]).select(F.col("_node").alias("doc_id"), "text")
    return numbered, docs.join(sized(shared), "doc_id", "left_anti").unionByName(moved)


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest) of the rows, and (digest, n, first, component_id, final) of the sets with words; `first` is the set's
    smallest id, `final` tells components apart, also those whose smallest ids are equal."""
    table = stored(shingle_table(docs, size), "shingles")
    rows = table.where("range IS NULL").drop("range", "counts")
    folded = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("digest", "n").agg(
        F.min_by(F.struct("minima", "bits", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("doc_id"))
    sets = stored(folded.select("digest", "n", F.col("doc_id").cast("long").alias("doc_id"), "s.minima", "s.bits", "s.sketch"), "sets")
    sets, texts = _nodes(sets, rows, docs.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long")), size)

    stars = stored(_linked(texts, _star_candidates(sets, percent), size, percent), "links")
    near = components(stars, "a", "b")
    labelled = stored(sets.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "digest", "n", "doc_id", "first", "bits", "sketch", F.coalesce("component", "doc_id").alias("component")), "labelled")
    prefixes = _prefixes(texts, size, percent, bucket_ranks(bucket_counts(table)))
    pairs = _tile_candidates(prefixes, labelled, percent)
    links = _linked(texts, pairs, size, percent).unionByName(
        labelled.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).where("a <> b"))
    last = components(links, "a", "b")
    named = labelled.join(last.withColumnRenamed("component", "final").withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "digest", "n", "first", F.coalesce("final", "doc_id").alias("final"))
    least = named.groupBy("final").agg(F.min("first").alias("component_id"))
    return rows, stored(named.join(least, "final").select("digest", "n", "first", "component_id", "final"), "named")


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4,
                   percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Sets are the distinct runs of `size` words between ASCII white space, A-Z in lower case; a shorter text is
    one run. Two sets are linked when 100 * intersection >= `percent` * union; a component is named by its
    smallest id. Texts without words (null, empty, blank) have no shingle and are their own component. Rows
    without an id link nothing and have a null component; rows that share an id but not a text are documents of
    their own. Texts of any length are read whole; an empty table gives no row. Ids are integers; other columns are not read.
    """
    rows, named = _grouped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), size, percent)
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    kind = docs.schema[id_column].dataType
    return rows.where(~alone).join(named, ["digest", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component_id").cast(kind)).unionByName(
        rows.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without those that are linked with another row that stays.

    Of each component the row with the smallest id stays; of several texts under that id, one; of repeated rows, one.
    A row is told by its id and text, so texts that share an id with a copy stay. Rows without an id and texts
    without words are linked with nothing and all stay. Columns are those of `docs`, whatever their names.
    """
    named = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns)))))
    own, ident, text = docs.toDF(*named.values()), named[id_column], named[text_column]
    rows, sets = _grouped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), size, percent)
    # The set that stays of each component: its smallest id, and of several sets under it the smallest digest.
    stays = stored(sets.groupBy("final").agg(F.min(F.struct("first", "digest", "n")).alias("s")).select("s.*"), "stays")
    words = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    kept = F.col("kept.first").isNotNull() & (F.col("kept.first") == F.col("doc_id"))
    marked = words.join(stays.alias("kept"), ["digest", "n"], "left").select("doc_id", "digest", kept.alias("keep"))
    per_id = stored(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("keep").alias("some")), "per-id")
    gone = sized(stored(per_id.where(~F.col("some")).select(F.col("doc_id").alias("_gone")), "gone"))
    several = stored(per_id.where("some AND rows > 1").select(F.col("doc_id").alias("_several")), "several")
    empty = rows.where((F.col("n") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_several"))
    # Ids with words that go entirely may still have rows without words, which stay.
    mixed = stored(empty.join(gone, F.col("_several") == F.col("_gone"), "left_semi").distinct(), "mixed")
    plain = own.join(gone, F.col(ident) == F.col("_gone"), "left_anti")
    if several.isEmpty() and mixed.isEmpty():
        return plain.toDF(*docs.columns)
    doubtful = sized(stored(several.unionByName(mixed).distinct(), "doubtful"))
    told = _with_digest(own.join(doubtful, F.col(ident) == F.col("_several"), "left_semi"), size, text)
    hit = told.where("_n > 0").join(stays, (F.col("_digest") == F.col("digest")) & (F.col("_n") == F.col("n")) & (F.col(ident) == F.col("first")), "left_semi")
    one = hit.dropDuplicates([ident, "_digest", "_n"]).unionByName(told.where("_n = 0")).drop("_digest", "_n")
    return plain.join(doubtful, F.col(ident) == F.col("_several"), "left_anti").unionByName(one).toDF(*docs.columns)
