"""Training-corpus pipeline over `documents`: good documents, one of each group of near copies, no benchmark
items, no secrets, packed into windows.

Every stage works on what the stage before it kept and returns the columns of `documents`; the last returns pieces
of documents with their windows.
"""

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import contamination, jaccard_join, packing, secret_scan, weak_labels
from wavelark.llm.storage import stored, text_batches

#: Near copies: distinct runs of so many words, and the similarity in percent from which documents are linked.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    text_batches(spark)
    return weak_labels.good_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of linked documents."""
    text_batches(spark)
    return jaccard_join.one_of_each_group(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    text_batches(spark)
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; documents stay."""
    text_batches(spark)
    return secret_scan.redact(docs, secret_scan.find_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of the documents into windows."""
    text_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: Hashed models, set joins and tokenizers are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
