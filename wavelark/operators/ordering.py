"""Ordered positions, lags, ranks and quantiles that never need one task per group.

A plain window puts a whole group on one task. Here a group is cut into blocks that follow
the order; the per-block totals are tiny, so only they are processed group by group, and the
rows themselves are windowed inside single blocks.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.session import stored


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds never-NULL copies of the group keys, so joins on them can be plain equi-joins."""
    keys = [f"_key_{i}" for i in range(len(by))]
    return df.withColumns({
        k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, by)}), keys


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows written in ranges of (group, order) with equal shares of rows; `_block` numbers the range.

    Spark samples the borders, so that neither a crowded group nor a crowded stretch of the order ends up in one range as long as
    the order tells its rows apart. Blocks of this kind serve `with_position` and `with_previous`.
    """
    rows, keys = _keyed(df, by)
    ranges = rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()).drop(*keys)
    return stored(ranges, "dealt")


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[Column], block: Column,
                  position: str = "position", total: str = "total") -> DataFrame:
    """0-based position of each row in its group and the group's row count.

    `block` must be non-NULL and must not decrease along `order`.
    """
    rows, keys = _keyed(df.withColumn("_block", block), by)
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias(total),
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inner) - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(position, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop(*keys, "_block", "_rank", "_before")
    )


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column,
                  values: dict[str, str]) -> DataFrame:
    """Adds, per `values` entry (new name -> column), the value of the preceding row.

    The first row of a block takes the value from the last row of the block before. Those first
    rows meet in one window per group, which holds as many rows as the group has blocks.
    """
    inner = Window.partitionBy(*by, "_block").orderBy(*order)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_block", block).withColumns({
        "_rank": F.row_number().over(inner),
        **{f"_lag_{new}": F.lag(col).over(inner) for new, col in values.items()},
        **{f"_end_{new}": F.last(col).over(whole) for new, col in values.items()},
    })
    first = F.col("_rank") == 1
    across = Window.partitionBy(*by, first, F.when(~first, F.col("_block"))).orderBy("_block")
    return rows.withColumns({
        new: F.when(first, F.lag(f"_end_{new}").over(across)).otherwise(F.col(f"_lag_{new}")) for new in values
    }).drop("_block", "_rank", *[f"_{kind}_{new}" for new in values for kind in ("lag", "end")])


def fold_values(df: DataFrame, value: str, by: Sequence[str] = (),
                counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with their counts, written once so that ranking reads no raw row again.

    The rows are dealt out in ranges of group and value, and `_block` numbers the range. How many ranges there
    are follows from the data; they only balance the work of the running counts, which are exact for any of them.
    """
    counts = counts or {"n": F.lit(1)}
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(c).cast("long").alias(name) for name, c in counts.items()])
    return stored(folded.repartitionByRange(*by, value).withColumn("_block", F.spark_partition_id()), "values")


def running_counts(folded: DataFrame, value: str, counts: Sequence[str] = ("n",), by: Sequence[str] = ()) -> DataFrame:
    """Folded values with the running total `cum_*` of each count along the value.

    Sums per range are put in order per group, which is a row per range, and ranges are counted through one by one.
    """
    rows, keys = _keyed(folded, list(by))
    sums = rows.groupBy(*keys, "_block").agg(*[F.sum(n).alias(f"_s_{n}") for n in counts])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in counts])
    inner = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumns({f"_r_{n}": F.sum(n).over(inner) for n in counts})
        .join(offsets, [*keys, "_block"])
        .withColumns({f"cum_{n}": F.col(f"_b_{n}") + F.col(f"_r_{n}") for n in counts})
        .drop(*keys, "_block", *[f"_{kind}_{n}" for n in counts for kind in "rb"])
    )


def folded_quantiles(folded: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles of folded values, globally or per group, by one formula for inputs of any size."""
    by = list(by)
    rows, keys = _keyed(running_counts(folded, value, by=by), by)
    totals = rows.groupBy(*keys).agg(F.max("cum_n").alias("_total"))
    rows = rows.join(totals, keys) if keys else rows.withColumn("_total", totals.select("_total").scalar())
    picks = []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.min(F.when(F.col("cum_n") > low, F.col(value))).alias(f"_low_{name}"),
            F.min(F.when(F.col("cum_n") > high, F.col(value))).alias(f"_high_{name}"),
            F.first(at - low).alias(f"_part_{name}"),
        ]
    return rows.groupBy(*by).agg(*picks).select(*by, *[
        (F.col(f"_low_{n}") + F.col(f"_part_{n}") * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))).alias(n)
        for n in quantiles])


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    return folded_quantiles(fold_values(df, value, by), value, quantiles, by)


def numbered(df: DataFrame, column: str, first: int = 0) -> DataFrame:
    """Consecutive numbers in the order of the partitions and of the rows within them.

    The rows are written once, so that their order is fixed; only the row counts of the partitions are added up.
    """
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    offsets, before = [], first
    for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").toLocalIterator():
        offsets.append((r["p"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        column, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")
