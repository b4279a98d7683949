"""Registered queries of the operators, each over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.llm import (
    contamination,
    hard_negatives,
    importance,
    jaccard_join,
    language_id,
    lattice_lm,
    oracles,
    packing,
    secret_scan,
    token_counts,
    training_order,
    voronoi_join,
    warc,
    weak_labels,
)
from wavelark.llm.storage import shared_path, text_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op4_jaccard_join": oracles.JACCARD_JOIN,
    "op5_warc": oracles.WARC,
    "op6_contamination": oracles.CONTAMINATION,
    "op8_voronoi_join": oracles.VORONOI_JOIN,
    "op12_importance": oracles.IMPORTANCE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "shards")
    placed = training_order.materialise(training_order.token_sequences(table(spark, sf_dir, "documents")), path)
    read = training_order.read_slots(spark, path).select("slot", F.crc32("ids").alias("ids_crc32"))
    # Spark takes what is read from the shards for small, as it comes from a range of numbers.
    return placed.join(read.hint("merge"), "slot")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_keep").alias("keep"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = shared_path(spark, "archive")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    page = F.substring_index("record_id", ":", -1).cast("long").alias("page_id")
    responses = warc.read_archive(spark, path).where("record_type = 'response'").select(
        page, F.length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'").select(
        page, F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.substring_index("refers_to", ":", -1).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


@query
def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op8_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    return language_id.identify(docs, docs.where(~F.col("held_out")), keep=("held_out",)).drop("spans")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("content")


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)
