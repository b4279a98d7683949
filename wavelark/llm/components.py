"""Connected components of a graph whose edges are rows, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.storage import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with an edge; a component is named by its smallest node.

    Each round links every node to the smallest node next to it. The edges stay rows throughout, their
    number never grows, and the rounds are about the logarithm of the largest component.
    """
    edges = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
            edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.where(F.col("x") > F.col("n")).join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
