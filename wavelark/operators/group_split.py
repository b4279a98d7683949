"""Greedy train/validation/test split of whole groups.

Groups go, largest first, to the split with the largest relative deficit. Between groups of one
size that is a merge of three falling deficit sequences, so the state before every *size* fixes
the split of every group of that size. Only the sizes are walked one after another - distinct
sizes are at most the square root of twice the row count. All groups are then placed at once: a binary search
over arrays finds each one's place in the merge, and where deficits tie, the up to three groups that share a tie
settle it by their hashes.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.operators.checks import require_columns
from wavelark.operators.ordering import with_position
from wavelark.schema import SPLIT_SEED
from wavelark.session import stored

SPLITS = ["train", "validation", "test"]
# Sources whose groups are networks; all others are grouped by session.
NETWORK_GROUPED_SOURCES = ["mendeley_rogue_ap"]


def _above(value: np.ndarray, inclusive: bool, size, held, target) -> np.ndarray:
    """How many terms of one falling deficit sequence lie above a value (or at it)."""
    floor = np.maximum(target, 1.0)

    def holds(j):
        score = (target - (held + j * size)) / floor
        return score >= value if inclusive else score > value

    # The division is off by at most a step or two; the terms themselves decide.
    j = np.maximum((target - held - value * floor) / size, 0).astype(np.int64)
    while (back := (j > 0) & ~holds(np.maximum(j - 1, 0))).any():
        j = j - back
    while (on := holds(j)).any():
        j = j + on
    return j


def merge_place(position: np.ndarray, size: np.ndarray, held: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: terms of the three sequences that come before its place in their merge, and which are tied at it.

    `held` and `targets` have a column per split. Rows are independent of each other, and all are solved at once.
    """
    size, columns = size.astype(np.float64), range(held.shape[1])
    best = None
    for i in columns:
        floor = np.maximum(targets[:, i], 1.0)
        low, high = np.zeros(len(position), np.int64), position.astype(np.int64).copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            value = (targets[:, i] - (held[:, i] + middle * size)) / floor
            enough = sum(_above(value, True, size, held[:, k], targets[:, k]) for k in columns) > position
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        value = (targets[:, i] - (held[:, i] + low * size)) / floor
        best = value if best is None else np.maximum(best, value)
    before = np.column_stack([_above(best, False, size, held[:, k], targets[:, k]) for k in columns])
    score = (targets - (held + before * size[:, None])) / np.maximum(targets, 1.0)
    return before, score == best[:, None]


def _tie_hash(seed, group, split):
    return hashlib.sha256(f"{seed}|{group}|{split}".encode()).hexdigest()[:16]


def _walk_sizes(ratios, seed):
    def walk(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        total = float((sizes["size"] * sizes["groups"]).sum())
        targets = np.array([[total * r for r in ratios]])
        held, out = np.zeros((1, 3)), []
        for size, groups, last, second in zip(sizes["size"], sizes["groups"], sizes["last_group"], sizes["second_last"]):
            out.append(held[0].tolist())
            counts, tied = merge_place(np.array([groups]), np.array([size]), held, targets)
            counts, open_ = counts[0].copy(), np.flatnonzero(tied[0]).tolist()
            # Groups of a tie that the next size goes on with.
            begun = int(groups - counts.sum())
            for group in ([second, last] if begun == 2 else [last])[:begun]:
                taken = min(open_, key=lambda i: _tie_hash(seed, group, SPLITS[i]))
                counts[taken] += 1
                open_.remove(taken)
            held = held + counts * float(size)
        states = np.array(out)
        return pd.DataFrame({
            "source_dataset": sizes["source_dataset"], "size": sizes["size"], "total": total,
            "held_0": states[:, 0], "held_1": states[:, 1], "held_2": states[:, 2]})
    return walk


def _place(ratios):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position, size, total = (batch.column(n).to_numpy() for n in ("position", "size", "total"))
            held = np.column_stack([batch.column(f"held_{i}").to_numpy() for i in range(3)])
            before, tied = merge_place(position, size, held, total[:, None] * np.array(ratios))
            turn = position - before.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_dataset"), batch.column("split_group_id"), batch.column("size"), pa.array(position - turn),
                 pa.array(turn.astype(np.int32)), *(pa.array(tied[:, i]) for i in range(3))],
                names=["source_dataset", "split_group_id", "size", "tie", "turn", "tied_0", "tied_1", "tied_2"])
    return place


def group_split(df: DataFrame, ratios: Sequence[float] = (0.70, 0.15, 0.15),
                seed: int = SPLIT_SEED) -> DataFrame:
    """Adds split, split_group_type and split_group_id. The rows are read twice; store those that are costly to compute."""
    require_columns(df, ["source_dataset", "session_id", "network_identity_id"], "group split")
    kind = F.when(F.col("source_dataset").isin(NETWORK_GROUPED_SOURCES), "network_identity_id").otherwise("session_id")
    group = F.when(kind == "network_identity_id", F.col("network_identity_id")).otherwise(F.col("session_id"))
    named = F.when(group.isNull(), F.raise_error(F.lit("group split: row without a group"))).otherwise(group)
    rows = df.withColumns({"split_group_type": kind, "split_group_id": named.cast("string")})
    sizes = rows.groupBy("source_dataset", "split_group_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes.withColumn("_hash", F.substring(
        F.sha2(F.concat(F.lit(f"{seed}|"), "split_group_id"), 256), 1, 16)), "group-sizes")
    keys, order = ["source_dataset", "size"], ["_hash", "split_group_id"]
    placed = stored(with_position(sizes, keys, [F.col(c) for c in order], F.substring("_hash", 1, 2), "position", "groups"), "group-order")
    at_end = F.col("groups") - F.col("position")
    last = placed.where(at_end <= 2).groupBy(*keys, "groups").agg(
        F.max(F.when(at_end == 1, F.col("split_group_id"))).alias("last_group"),
        F.max(F.when(at_end == 2, F.col("split_group_id"))).alias("second_last"))
    states = last.groupBy("source_dataset").applyInPandas(
        _walk_sizes(list(ratios), seed),
        "source_dataset string, size long, total double, held_0 double, held_1 double, held_2 double")
    merged = placed.join(states, keys).mapInArrow(
        _place(list(ratios)), "source_dataset string, split_group_id string, size long, tie long, turn int, tied_0 boolean, tied_1 boolean, tied_2 boolean")
    # The groups of one tie, at most one per split, choose in order among the tied splits that are left.
    open_splits = F.filter(F.array(*[F.when(F.col(f"tied_{i}"), F.struct(
        F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), "split_group_id", F.lit(f"|{name}")), 256), 1, 16).alias("hash"),
        F.lit(name).alias("split"))) for i, name in enumerate(SPLITS)]), lambda x: x.isNotNull())
    in_tie = Window.partitionBy(*keys, "tie").orderBy("turn")

    def without(*taken):
        return F.array_min(F.filter("_open", lambda x: ~F.array_contains(F.array(*taken), x["split"])))["split"]

    chosen = merged.withColumn("_open", open_splits).withColumn("_first", F.array_min("_open")["split"])
    chosen = chosen.withColumn("_head", F.first("_first").over(in_tie)).withColumn(
        "_second", F.when(F.col("turn") == 1, without("_head")))
    chosen = chosen.withColumn("_next", F.lag("_second").over(in_tie)).withColumn(
        "split", F.when(F.col("turn") == 0, F.col("_first")).when(F.col("turn") == 1, F.col("_second")).otherwise(without("_head", "_next")))
    return rows.join(chosen.select("source_dataset", "split_group_id", "split"), ["source_dataset", "split_group_id"]).select(
        *df.columns, "split", "split_group_type", "split_group_id")
