"""Token sequences in training order, in shards of fixed stride (operator 2).

All texts become sequences of equal length, numbered without gaps. A keyed Feistel network permutes the numbers; values
beyond the last are permuted again until they fall inside (cycle walking), so every sequence gets one global slot and
no table of the order is kept. Slots are dealt out in ranges, one per shard; a task lays the sequences of its range
at their places, which takes the memory of one shard, and writes it in order. The
place of a slot follows from the slot alone, so that a reader can start or resume anywhere.
"""

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import qualified, shared_path, sized, stored
from wavelark.llm.tokens import default_vocabulary, encoder
from wavelark.llm.words import mix, slices

ROUNDS = 6
_LAYOUT = "_layout.json"


def feistel(numbers: np.ndarray, total: int, key: str) -> np.ndarray:
    """A permutation of range(total) that depends on the key."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{i}".encode(), digest_size=8).digest(), "little")) for i in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = (left << shift) | right
        walking = out >= np.uint64(total)
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int = 1024, id_column: str = "doc_id", text_column: str = "text",
                    vocabulary: str | None = None, end_id: int = 0, id_type: str = "<u2") -> DataFrame:
    """(part, number, filled, doc_ids, ids): the texts of each scan partition end to end, cut into equal sequences.

    Every text ends with `end_id`, which also fills up the last sequence of a part behind its `filled` ids. Null and
    empty texts are the end alone.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([*T.StructType.fromDDL("part long, number long, filled long").fields,
                           T.StructField("doc_ids", T.ArrayType(docs.schema[id_column].dataType)), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(path).encode, TaskContext.get().partitionId(), 0
        held, docs_held, size, kind = [], [], 0, pa.int64()
        rows: list[tuple] = []

        def flush():
            nonlocal rows
            done, rows = rows, []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

        def cut(last: bool):
            nonlocal held, docs_held, size, number
            ids, names = np.concatenate(held), docs_held
            owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
            whole = len(ids) if last else len(ids) - len(ids) % length
            for at in range(0, whole, length):
                piece = ids[at:at + length]
                own = [names[i] for i in range(owner[at], owner[at + len(piece) - 1] + 1)]
                full = np.full(length, end_id, id_type)
                full[:len(piece)] = piece
                rows.append((part, number, len(piece), own, full.tobytes()))
                number += 1
            held, docs_held = ([ids[whole:]], [names[-1]]) if whole < len(ids) else ([], [])
            size = len(ids) - whole

        end = np.array([end_id], np.uint32)
        for batch in slices(batches, "text"):
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                if len(ids) and ids.max() > np.iinfo(id_type).max:
                    raise ValueError(f"a token id does not fit into {id_type}")
                held.append(ids)
                docs_held.append(doc)
                size += len(ids)
                if size >= 64 * length:
                    cut(False)
                    if len(rows) >= 1024:
                        yield flush()
        if size:
            cut(True)
        if rows:
            yield flush()

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def _slot(index: Column, total: int, key: str) -> Column:
    @F.arrow_udf("long")
    def slot(numbers: pa.Array) -> pa.Array:
        return pa.array(feistel(numbers.to_numpy(zero_copy_only=False), total, key))

    return slot(index)


def materialise(sequences: DataFrame, path: str, key: str = "epoch-0", shard_slots: int = 16_384, stride: int = 2048) -> DataFrame:
    """Writes all sequences below `path` and returns (slot, shard, part, number, filled, doc_ids), one row each.

    `sequences` has part and number (gapless from 0 in its part) besides ids of `stride` bytes; equal rows are sequences of their
    own, and an empty table gives an empty set. Shard files hold `shard_slots` strides each and are moved into place when complete,
    so a repeated task replaces its own file. The layout that readers follow is written last: until then they see the set that was
    there before, if any, as the shards of every run have names of their own. A plain path belongs to Spark's default file system.
    """
    spark = sequences.sparkSession
    path, run = qualified(spark, path), uuid.uuid4().hex[:12]
    table = shared_path(spark, "sequences")
    sequences.write.option("compression", "zstd").parquet(table)
    rows = spark.read.schema(sequences.schema).parquet(table)
    # One row per part; an exclusive running sum gives the first number of each part.
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "first")
    first = sized(stored(first, "first"))
    total = rows.count()
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    shards = max(1, -(-total // shard_slots))
    placed = rows.join(first, "part").withColumn("slot", _slot(F.col("first") + F.col("number"), max(total, 1), key))
    schema = T.StructType([*T.StructType.fromDDL("slot long, shard long, part long, number long, filled long").fields, sequences.schema["doc_ids"]])
    details = ["slot", "part", "number", "filled", "doc_ids"]
    # One row per shard and batch: the sequences packed together, as they are rather large to be moved one by one.
    packed = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("packed", T.BinaryType()),
                           *(T.StructField(c, T.ArrayType(schema[c].dataType)) for c in details)])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("slot").to_numpy() // shard_slots
            order = np.argsort(shard, kind="stable")
            rows, shard = batch.take(pa.array(order)), shard[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            ends = np.append(first, len(shard)).astype(np.int32)
            ids = rows.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[first].astype(np.int32)), pa.array([pack(b"".join(ids[a:b])) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                *(pa.ListArray.from_arrays(pa.array(ends), rows.column(c)) for c in details)], names=packed.names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        held: dict[int, np.ndarray] = {}
        filled: dict[int, int] = {}
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                base = shard * shard_slots
                if shard not in held:
                    held[shard], filled[shard] = np.zeros((min(shard_slots, total - base), stride), np.uint8), 0
                slots = batch.column("slot")[i].values
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("packed")[i].as_py()), np.uint8)
                if len(data) != len(slots) * stride:
                    raise ValueError(f"sequences of another length than {stride} bytes")
                held[shard][slots.to_numpy() - base] = data.reshape(len(slots), stride)
                filled[shard] += len(slots)
                yield pa.RecordBatch.from_arrays([slots, pa.array(np.full(len(slots), shard)),
                                                  *(batch.column(c)[i].values for c in details[1:])], names=schema.names)
        for shard, data in held.items():
            if filled[shard] != len(data):
                raise ValueError(f"shard {shard} has {filled[shard]} of {len(data)} sequences")
            name = f"_shard-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            store.move(f"{root}/{name}", f"{root}/shard-{run}-{shard:08d}.bin")

    done = stored(placed.select(*details, "ids").mapInArrow(bundle, packed).repartitionById(shards, F.col("shard")).mapInArrow(write, schema), "placed")
    layout = f"{root}/_layout-{run}"
    with store.open_output_stream(layout) as out:
        out.write(json.dumps({"total": total, "stride": stride, "shard_slots": shard_slots, "key": key, "run": run}).encode())
    store.move(layout, f"{root}/{_LAYOUT}")
    return done


def read_slots(spark: SparkSession, path: str, begin: int = 0, end: int | None = None, run_slots: int = 4096) -> DataFrame:
    """(slot, ids) of a range of slots, read in order by seeking; a task reads up to `run_slots` of one shard."""
    path = qualified(spark, path)
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{_LAYOUT}") as f:
        layout = json.loads(f.read())
    stride, per_shard, run = layout["stride"], layout["shard_slots"], layout["run"]
    end = layout["total"] if end is None else min(end, layout["total"])
    begin = max(begin, 0)
    runs = max(1, -(-max(0, end - begin) // run_slots))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                at, stop = begin + number * run_slots, min(end, begin + (number + 1) * run_slots)
                while at < stop:
                    upto = min(stop, (at // per_shard + 1) * per_shard)
                    with store.open_input_file(f"{root}/shard-{run}-{at // per_shard:08d}.bin") as f:
                        f.seek(at % per_shard * stride)
                        for base in range(at, upto, 1024):
                            n = min(1024, upto - base)
                            data = f.read(n * stride)
                            yield pa.RecordBatch.from_arrays([pa.array(range(base, base + n)), pa.array(
                                [data[i * stride:(i + 1) * stride] for i in range(n)], pa.binary())], names=["slot", "ids"])
                    at = upto

    return spark.range(0, runs, 1, runs).mapInArrow(read, "slot long, ids binary")
