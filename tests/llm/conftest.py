import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Rows (id, text[, lang[, source]]) as a table with the columns of `documents` and two clashing extra ones."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        return df.selectExpr("*", "1 AS key", "'x' AS value")
    return make


@pytest.fixture
def prose():
    """Random sentences of invented words."""
    def make(seed, words):
        rng = random.Random(seed)
        syllables = ["ba", "ten", "or", "li", "shu", "ka", "mi", "on", "re", "du", "pa", "es"]
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out)
    return make
