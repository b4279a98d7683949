"""Hard negatives of vectors by integer inner product over STR-packed R-trees (operator 13).

Rows are dealt into blocks in the order of label and leading coordinates. In a task, a block becomes an R-tree packed by
sort-tile-recursive: sorted by label, then cut into slabs along the coordinates that vary most, then into leaves; boxes of
leaves are joined upwards. With a query, each coordinate of a box gives an interval of products, and their sums bound
the inner products in the box from both sides. A best-first queue opens boxes by their upper bounds and leaves out those that
hold no wanted label, lie outside the score windows, or lie strictly below the k-th score found.

The first search gives an anchor's positives, the second its negatives within the windows of the positives' scores.
Equal vectors of one label are folded to their smallest ids beforehand; equal anchors are searched once.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.storage import sized, stored
from wavelark.operators.ordering import numbered

POSITIVES, NEGATIVES = 5, 10
#: Negative scores reach from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
LEAF, FANOUT = 64, 16
DATA_BLOCK = 32_768
QUERY_BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long integer lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class PackedTree:
    """R-tree over rows (vectors, labels, ids); boxes are kept level by level in one array, leaves first."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]], leaf: int = LEAF, fanout: int = FANOUT):
        order = self._str_order(vectors, labels, leaf)
        self.vectors, self.labels, self.ids = vectors[order], labels[order], [ids[i] for i in order]
        self.first_id = np.array([i[0] for i in self.ids], np.int64)
        self.leaf = leaf
        edges = np.arange(0, len(order), leaf)
        low, high = np.minimum.reduceat(self.vectors, edges), np.maximum.reduceat(self.vectors, edges)
        least, most = np.minimum.reduceat(self.labels, edges), np.maximum.reduceat(self.labels, edges)
        self.leaves, levels, at = len(edges), [(low, high, least, most)], 0
        self.children: list[range] = [range(0)] * len(edges)
        while len(levels[-1][0]) > 1:
            low, high, least, most = levels[-1]
            edges = np.arange(0, len(low), fanout)
            self.children += [range(at + e, at + min(e + fanout, len(low))) for e in edges.tolist()]
            at += len(low)
            levels.append((np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges),
                           np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges)))
        self.low, self.high, self.least, self.most = (np.concatenate(x) for x in zip(*levels))
        self.root = len(self.low) - 1

    @staticmethod
    def _str_order(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
        """Rows label by label; within one, tiles along up to three coordinates of the largest variance."""
        axes = np.argsort(-vectors.astype(np.float64).var(0), kind="stable")[:3].tolist()

        def tile(rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
            rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
            if len(axes) == 1 or len(rows) <= leaf:
                return [rows]
            slabs = math.ceil((len(rows) / leaf) ** (1 / len(axes)))
            width = leaf * math.ceil(len(rows) / leaf / slabs)
            return [r for i in range(0, len(rows), width) for r in tile(rows[i:i + width], axes[1:])]

        return np.concatenate([r for label in np.unique(labels) for r in tile(np.flatnonzero(labels == label), axes)])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of every query with every box."""
        q, low, high = queries.astype(np.float64), self.low.astype(np.float64), self.high.astype(np.float64)
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        lower, upper = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
        # Sums below 2 ** 53 are exact in doubles; larger ones get room for rounding.
        room = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        room = np.where(room < 2**53, 0, room * 1e-9)
        return lower - room, upper + room

    def scores(self, query: np.ndarray, at: slice) -> np.ndarray:
        return self.vectors[at] @ query

    def best(self, query: np.ndarray, lower: np.ndarray, upper: np.ndarray, label: int, same: bool,
             windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores the `k` first (score, id) of the wanted labels, higher scores and smaller ids first."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        kth: list[float] = [-math.inf] * len(windows)
        wanted = ((self.least <= label) & (label <= self.most)) if same else ~((self.least == label) & (self.most == label))
        queue = [(-float(upper[self.root]), self.root)]
        while queue:
            top, node = heapq.heappop(queue)
            # Boxes come by falling upper bounds: below every window's k-th score nothing can follow.
            if all(-top < least for least in kth):
                break
            if not wanted[node] or not any(upper[node] >= max(a, least) and lower[node] <= b for (a, b), least in zip(windows, kth)):
                continue
            if node >= self.leaves:
                for child in self.children[node]:
                    if wanted[child]:
                        heapq.heappush(queue, (-float(upper[child]), child))
                continue
            at = slice(node * self.leaf, (node + 1) * self.leaf)
            scores, own = self.scores(query, at), self.labels[at] == label
            for w, (a, b) in enumerate(windows):
                hit = np.flatnonzero((own if same else ~own) & (scores >= max(a, kth[w])) & (scores <= b))
                if len(hit):
                    found[w] += [(-int(scores[i]), int(self.first_id[at][i]), at.start + int(i)) for i in hit]
                    found[w] = heapq.nsmallest(k, found[w])
                    if len(found[w]) == k:
                        kth[w] = -found[w][-1][0]
        return [[(-s, i) for s, i in sorted((score, i) for score, _, row in rows for i in self.ids[row])[:k]] for rows in found]


def _folded(rows: DataFrame, keep: int) -> DataFrame:
    """(v, label, ids): each distinct vector of a label with its `keep` smallest ids, combined per batch before anything moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for n in np.unique(lengths):
                own = batch.filter(pa.array(lengths == n))
                key = np.ascontiguousarray(np.column_stack([own.column(2).to_numpy(), _matrix(own.column(1))]))
                _, group = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_inverse=True)
                ids = own.column(0).to_numpy()
                order = np.lexsort((ids, group))
                first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))
                lists = [np.unique(ids[order[a:b]])[:keep].tolist() for a, b in zip(first, np.append(first[1:], len(order)))]
                heads = pa.array(order[first])
                yield pa.RecordBatch.from_arrays(
                    [own.column(1).take(heads), own.column(2).take(heads), pa.array(lists, pa.list_(pa.int64()))], names=["v", "label", "ids"])

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    return (rows.select("id", "v", "label").mapInArrow(run, "v array<long>, label long, ids array<long>")
            .groupBy("v", "label", (F.spark_partition_id() % 64).alias("part")).agg(smallest).groupBy("v", "label").agg(smallest))


def _blocks(folded: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their block, and one row per block: length, labels and bounding box."""
    total = folded.count()
    order = [F.size("v"), F.col("label"), F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.col("ids")[0]]
    dealt = folded.repartitionByRange(max(1, math.ceil(total / size)), *order).sortWithinPartitions(*order)
    # Blocks follow the whole order, however many ranges it was dealt into.
    rows = numbered(dealt, "at").select(F.size("v").alias("n"), F.floor(F.col("at") / size).alias("block"), "v", "label", "ids")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(n) != 0) | (np.diff(block) != 0)])) if len(n) else []
            for a, b in zip(cut, np.append(cut[1:], len(n))):
                v, label = _matrix(batch.column(2).slice(a, b - a)), batch.column(3).to_numpy()[a:b]
                listed = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(0), v.max(0))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 1), batch.column(1).slice(a, 1), *listed, pa.array([label.min()]), pa.array([label.max()])],
                    names=["n", "block", "low", "high", "least", "most"])

    parts = rows.select("n", "block", "v", "label").mapInArrow(
        sides, "n int, block long, low array<long>, high array<long>, least long, most long")
    edges = parts.select("n", "block", "least", "most", F.posexplode(F.arrays_zip("low", "high")).alias("i", "side")).groupBy("n", "block", "i").agg(
        F.min("side.low").alias("low"), F.max("side.high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
    boxes = edges.groupBy("n", "block").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("sides"))
    return rows, stored(boxes, "boxes")


def _search(queries: DataFrame, rows: DataFrame, boxes: DataFrame, same: bool, k: int, query_block: int) -> DataFrame:
    """(query, low, high, id, score) of `queries` (query, v, label, windows): the `k` first of each window of scores."""
    chunks = max(1, math.ceil(queries.count() / query_block))
    label_fits = ((F.col("least") <= F.col("label")) & (F.col("label") <= F.col("most"))) if same else ~(
        (F.col("least") == F.col("label")) & (F.col("most") == F.col("label")))

    def bound(pick) -> Column:
        return F.aggregate(F.zip_with("v", "sides", lambda x, s: pick(x.cast("double") * s["low"], x.cast("double") * s["high"])),
                           F.lit(0.0), lambda total, x: total + x)

    room = 1 + F.lit(1e-9) * F.greatest(F.abs("upper"), F.abs("lower"))
    asking = (
        queries.withColumn("n", F.size("v")).join(sized(boxes), "n").where(label_fits)
        .withColumns({"lower": bound(F.least), "upper": bound(F.greatest)})
        .where(F.exists("windows", lambda w: (F.col("upper") + room >= w["low"]) & (F.col("lower") - room <= w["high"])))
        .select("n", "block", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int").alias("chunk"), "query", "v", "label", "windows"))
    asking = stored(asking, "asking")
    wanted = asking.select("n", "block", "chunk").distinct()
    dealt = rows.join(sized(stored(wanted, "wanted")), ["n", "block"])

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            queries = _matrix(left.column("v").combine_chunks())
            tree = PackedTree(_matrix(right.column("v").combine_chunks()), right.column("label").to_numpy(), right.column("ids").to_pylist())
            lower, upper = tree.bounds(queries)
            for i, (query, label, windows) in enumerate(zip(*(left.column(c).to_pylist() for c in ("query", "label", "windows")))):
                spans = [(w["low"], w["high"]) for w in windows]
                for (a, b), hits in zip(spans, tree.best(queries[i], lower[i], upper[i], label, same, spans, k)):
                    out += [(query, a, b, x, s) for s, x in hits]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5,
                        names=["query", "low", "high", "id", "score"])

    key = ["n", "block", "chunk"]
    found = asking.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(solve, "query long, low long, high long, id long, score long")
    first = Window.partitionBy("query", "low", "high").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = 256,
         query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x). An anchor's positives are its `positives` first other rows of its label, by falling
    inner product, ties by the smaller id. For each, the `negatives` first rows of other labels with low * positive <= 100 * negative <=
    high * positive are returned, ranked from 1; fewer rows than asked for give all, no row gives none. Rows without an id, a label or a
    vector, and vectors that are empty or hold null or non-finite components take no part; vectors are compared with those of
    their own length. Copies of a vector are rows like any other; rows that share an id, a label and a vector are one row, and rows
    of an anchor's own id are not its positives. Scores are 64-bit integers. An empty table gives an empty result. Other columns are not read.
    """
    usable = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (F.size(vector_column) > 0)
                           & F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    rows = stored(usable.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.transform(vector_column, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")), "vectors")
    asked = rows.where("asks").select("id", "v", "label").distinct()
    queries = numbered(asked.select("v", "label").distinct(), "query")
    of_query = stored(asked.join(queries, ["v", "label"]).select(F.col("id").alias("anchor_id"), "query"), "anchors")
    blocks, boxes = _blocks(stored(_folded(rows, max(positives + 1, negatives)), "folded"), data_block)
    whole = F.array(F.struct(F.lit(-2**63).cast("long").alias("low"), F.lit(2**63 - 1).cast("long").alias("high"))).alias("windows")
    near = stored(_search(queries.select("query", "v", "label", whole), blocks, boxes, True, positives + 1, query_block), "near")
    pairs = of_query.join(near.select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "query").where(
        F.col("anchor_id") != F.col("positive_id"))
    order = Window.partitionBy("anchor_id", "query").orderBy(F.desc("positive_score"), "positive_id")
    pairs = stored(pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")

    def window(score: Column) -> tuple[Column, Column]:
        """Smallest and largest negative score in hundredths of the positive's, in whole numbers."""
        down = lambda x: x.cast("decimal(38,0)")
        a, b = down(F.lit(low)) * down(score), down(F.lit(high)) * down(score)
        return F.ceil(a / 100).cast("long"), F.floor(b / 100).cast("long")

    spans = pairs.select("query", *(c.alias(n) for c, n in zip(window(F.col("positive_score")), ("low", "high")))).where("low <= high").distinct()
    spans = spans.groupBy("query").agg(F.collect_list(F.struct("low", "high")).alias("windows"))
    far = stored(_search(stored(queries.join(spans, "query"), "windows"), blocks, boxes, False, negatives, query_block), "far")
    found = far.select("query", "low", "high", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    pairs = pairs.withColumns(dict(zip(("low", "high"), window(F.col("positive_score")))))
    return pairs.join(found, ["query", "low", "high"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
