"""Exact nearest-neighbour join by integer inner product over Voronoi cells (operator 8).

Pivots drawn from the queries cut the space into cells. Queries form a group per cell; all vectors are assigned to
cells too. With a group's radius r around its pivot p, a vector x scores between p.x - r|x| and p.x + r|x| for each of
its queries, so the summaries of the lower bounds give a score that enough vectors reach, and only vectors whose upper
bound reaches it are sent to the group. Groups are solved locally in blocks, and the few best rows per block merged.

Equal vectors are folded to their smallest ids beforehand: of many copies no query can return more.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.storage import stored
from wavelark.llm.words import mix

MAX_PIVOTS = 256
QUERIES_PER_PIVOT = 64
QUERY_BLOCK = 1024
DATA_BLOCK = 32_768


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long integer lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while all sums stay below 2 ** 53, else in integers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, v) whose vectors have one length each."""
    for batch in batches:
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        for n in np.unique(lengths):
            yield batch.filter(pa.array(lengths == n))


def _folded(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each distinct vector with its `keep` smallest ids, combined per batch before anything moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches):
            table = _matrix(batch.column(1)).astype(np.int64)
            hashes = np.zeros(len(table), np.uint64)
            for i in range(table.shape[1]):
                hashes = mix(hashes * np.uint64(3) + table[:, i].view(np.uint64))
            ids = batch.column(0).to_numpy()
            order = np.lexsort((ids, hashes))
            first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
            groups = [ids[order][a:b][:keep].tolist() for a, b in zip(first, np.append(first[1:], len(order)))]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(order[first])), pa.array(groups, pa.list_(pa.int64()))], names=["v", "ids"])

    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")
    return (vectors.select("id", "v").mapInArrow(run, "v array<long>, ids array<long>")
            .groupBy("v", (F.spark_partition_id() % 64).alias("part")).agg(smallest).groupBy("v").agg(smallest))


def _assigned(rows: DataFrame, pivots: np.ndarray, others: str) -> DataFrame:
    """Adds the number of the nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (shared.value ** 2).sum(1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                cell = (squares - 2 * (x @ shared.value.T)).argmin(1)
                far = np.sqrt(((x - shared.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, f"v array<long>, {others}, cell long, far double")


def _one_length(rows: DataFrame, queries: DataFrame, k: int, sizes: tuple[int, int, int]) -> DataFrame:
    """(query, id, score) candidates of vectors of one length; `rows` is (v, ids), `queries` is (v, query)."""
    per_pivot, query_block, data_block = sizes
    count = queries.count()
    number = max(1, min(MAX_PIVOTS, math.ceil(count / per_pivot)))
    drawn = queries.orderBy(F.xxhash64("v"), "query").limit(number).select("v").collect()
    pivots = np.array([r["v"] for r in drawn], np.float64)
    grouped = stored(_assigned(queries, pivots, "query long"), "groups")
    cells = stored(_assigned(rows, pivots, "ids array<long>"), "cells")
    radius, many = np.zeros(number), np.zeros(number, np.int64)
    for r in grouped.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        # A little more than the distance, against its rounding.
        radius[r["cell"]], many[r["cell"]] = r["far"] * (1 + 1e-9) + 1e-6, r["n"]
    filled = np.zeros(number, np.int64)
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        filled[r["cell"]] = r["n"]
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((pivots, radius, many > 0))

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots, radius, used = shared.value
        middle, room = x @ pivots[used].T, np.sqrt((x ** 2).sum(1))[:, None] * radius[used]
        return middle - room - 1e-3, middle + room + 1e-3

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, used = None, np.flatnonzero(shared.value[2])
        for batch in batches:
            if batch.num_rows:
                low = np.repeat(bounds(_matrix(batch.column(0)))[0], np.diff(batch.column(1).offsets.to_numpy()), axis=0)
                best = low if best is None else np.concatenate([best, low])
                best = -np.sort(-best, axis=0)[:k + 1]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(used, len(best))), pa.array(best.ravel())], names=["cell", "low"])

    lows = cells.select("v", "ids").mapInArrow(summaries, "cell long, low double")
    ranked = lows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).where(F.col("r") == k + 1)
    floor = np.full(number, -np.inf)
    for r in ranked.collect():
        floor[r["cell"]] = r["low"]
    needs = context.broadcast(floor)
    query_blocks = np.maximum(1, -(-many // query_block))
    data_blocks = np.maximum(1, -(-filled // data_block))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(shared.value[2])
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at = np.nonzero(bounds(_matrix(batch.column(0)))[1] >= needs.value[used])
            times = query_blocks[used[at]]
            row, group = np.repeat(row, times), np.repeat(used[at], times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            rows = batch.take(pa.array(row))
            first = np.array([i[0].as_py() for i in batch.column(1)], np.int64).view(np.uint64)[row]
            cell = batch.column(2).to_numpy()[row]
            part = (mix(first) % data_blocks[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cell), pa.array(group), pa.array(block), pa.array(part)],
                                             names=["v", "ids", "cell", "home", "block", "part"])

    sent = cells.select("v", "ids", "cell").mapInArrow(
        replicate, "v array<long>, ids array<long>, cell long, home long, block long, part long")
    numbers = F.array(*[F.lit(int(b)) for b in query_blocks])
    everywhere = F.array(*[F.lit(int(c)).cast("long") for c in np.flatnonzero(filled)])
    parts = F.array(*[F.lit(int(b)).cast("long") for b in data_blocks])
    asking = grouped.select("v", "query", F.col("cell").alias("home"), F.explode(everywhere).alias("cell")).select(
        "v", "query", "home", F.pmod(F.xxhash64("query"), numbers[F.col("home").cast("int")]).cast("long").alias("block"), "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), parts[F.col("cell").cast("int")] - 1)).alias("part"))

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            scores = _product(_matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks()))
            ids = right.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            for query, own in zip(left.column("query").to_pylist(), scores):
                at = np.arange(len(own))
                if len(own) > k + 1:
                    at = np.flatnonzero(own >= np.partition(own, len(own) - k - 1)[len(own) - k - 1])
                    at = at[np.lexsort((first[at], -own[at]))][:k + 1]
                found = sorted((-int(own[i]), x) for i in at for x in ids[i])[:k + 1]
                out += [(query, x, -s) for s, x in found]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=["query", "id", "score"])

    key = ["home", "block", "cell", "part"]
    return asking.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "query long, id long, score long")


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
                 scale: int = 1024, per_pivot: int = QUERIES_PER_PIVOT, query_block: int = QUERY_BLOCK,
                 data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` highest inner products of every query with all rows but its own.

    Components become floor(scale * x); ties go to the smaller id; fewer rows than k give all. Rows that are null, lack
    an id, are empty, or hold null or non-finite components take no part; vectors are compared with those of their
    own length. Copies of a vector are rows like any other. Other columns are not read.
    """
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = stored(vectors.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & (F.size(vector_column) > 0)).where(finite).select(
        F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    asked = rows.where("asks")
    queries = stored(asked.groupBy("v").agg(F.min("id").alias("query")), "queries")
    folded = stored(_folded(rows, k + 1), "folded")
    found = None
    for r in queries.select(F.size("v").alias("n")).distinct().collect():
        own = F.size("v") == r["n"]
        part = _one_length(folded.where(own), queries.where(own), k, (per_pivot, query_block, data_block))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = [F.desc("score"), "id"]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    pairs = asked.join(queries, "v").select(F.col("id").alias("query_id"), "query").join(best, "query").where(F.col("query_id") != F.col("id"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
