"""Document quality from weak labels (operator 3).

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns estimates how each labeller votes on good and on bad documents, without any gold label.
The posterior labels of a bounded sample train a linear scorer on hashed words and word shapes, which decides.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import drawn, stored
from wavelark.llm.words import SPACED, mix, slices, text_buffer, word_spans

NOTHING, GOOD, BAD = 0, 1, 2
LABELLERS = 9
#: Documents of the sample that trains the scorer, in expectation.
SAMPLE = 8192
_WORD_BITS, _SHAPES = 16, 128
FEATURES = (1 << _WORD_BITS) + _SHAPES + _SHAPES * _SHAPES

# Byte classes: 0 letter or beyond ASCII, 1 capital, 2 digit, 3 sentence punctuation, 4 other sign, 5 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 4
_CLASS[list(b".,;:?'\"()-")] = 3
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b" \t\n\v\f\r")] = 5


class Profile:
    """Word shapes and per-document shares of a column of texts."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        n = len(offsets) - 1
        spans = list(word_spans(data, offsets, SPACED))
        begins, ends, self.hashes = (np.concatenate(x) for x in zip(*spans)) if spans else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        base = int(offsets[0])
        kinds = _CLASS[data[base:int(offsets[-1])]]
        self.first = np.searchsorted(begins, offsets, side="left")
        self.words = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.words)
        per_word, per_doc = {}, {}
        for kind in range(5):
            sums = np.zeros(len(kinds) + 1, np.int32)
            np.cumsum(kinds == kind, out=sums[1:])
            per_word[kind] = sums[ends - base] - sums[begins - base]
            per_doc[kind] = np.diff(sums[offsets - base]).astype(np.float64)
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.doc[1:] == self.doc[:-1])
        lone = per_word[0] + per_word[1] + per_word[2] == 0
        closed = kinds[ends - 1 - base] == 3
        self.shape = ((per_word[0] > 0).astype(np.int64) | (per_word[1] > 1) * 2 | (per_word[2] > 0) * 4 | closed * 8
                      | np.minimum(per_word[4], 3) * 16 | same * 64)
        count = np.maximum(self.words, 1)

        def share(mask):
            return np.bincount(self.doc, weights=mask, minlength=n) / count

        unique = np.unique(mix(self.hashes + self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        letters = np.maximum(per_doc[0] + per_doc[1], 1)
        size = np.maximum(np.diff(offsets), 1)
        lengths = np.bincount(self.doc, weights=ends - begins, minlength=n) / count
        self.same, self.lone, self.signed = share(same), share(lone), share(per_word[4] > 0)
        self.variety = np.bincount(self.doc[unique], minlength=n) / np.sqrt(count)
        self.capitals, self.signs = per_doc[1] / letters, per_doc[4] / size
        self.digits, self.length = per_doc[2] / size, lengths

    def votes(self) -> np.ndarray:
        """A row per document with the vote of each labeller."""
        some = self.words >= 3

        def labeller(value, good, bad, enough=some):
            vote = np.where(value <= good, GOOD, np.where(value >= bad, BAD, NOTHING)) if good < bad else (
                np.where(value >= good, GOOD, np.where(value <= bad, BAD, NOTHING)))
            return np.where(enough, vote, NOTHING)

        return np.stack([
            labeller(self.same, 0.02, 0.2),             # words repeated at once
            labeller(self.same, 0.05, 0.4),             # hardly any other words
            labeller(self.variety, 3.0, 1.5, self.words >= 40),  # few distinct words for the length
            labeller(self.capitals, 0.2, 0.5),          # shouting
            labeller(self.signs, 0.004, 0.03),          # signs among the characters
            labeller(self.signed, 0.02, 0.2),           # words with signs in them
            labeller(self.lone, 0.0, 0.08),             # words without letter or digit
            labeller(self.digits, 0.1, 0.4),            # mostly numbers
            labeller(np.abs(self.length - 6.5), 3.0, 12.0),  # implausible word lengths
        ], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature of each word occurrence in three kinds: word, shape, and shape after the previous shape."""
        before = np.zeros(len(self.shape), np.int64)
        before[1:] = np.where(self.doc[1:] == self.doc[:-1], self.shape[:-1], 0)
        words = (self.hashes >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
        base = 1 << _WORD_BITS
        return np.stack([words, base + self.shape, base + _SHAPES + before * _SHAPES + self.shape]), self.doc


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, documents): how often each combination of votes occurs; base-3 digits, first labeller first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in slices(batches, "text"):
            for p, n in zip(*np.unique(_pattern(Profile(batch.column(0)).votes()), return_counts=True)):
                counts[int(p)] = counts.get(int(p), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         names=["pattern", "documents"])

    return docs.select("text").mapInArrow(run, "pattern long, documents long").groupBy("pattern").agg(F.sum("documents").alias("documents"))


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


class LabelModel:
    """Accuracies of labellers that are independent given the class, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100):
        self.labellers = labellers
        votes = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
        good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
        # A start that trusts any bad vote more than a good one, as labellers look at different faults.
        belief = np.where(bad > 0, 0.1, np.where(good > 0, 0.95, 0.5))
        self.prior, self.vote = 0.5, np.ones((2, labellers, 3))
        for _ in range(rounds if len(patterns) else 0):
            for c, weight in enumerate((1 - belief, belief)):
                weight = weight * counts
                for v in (GOOD, BAD):  # among those that vote; an abstention says nothing
                    self.vote[c, :, v] = (weight @ (votes == v) + 0.5) / (weight @ (votes != NOTHING) + 1)
            self.prior = (counts @ belief + 1) / (counts.sum() + 2)
            belief = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are good."""
        votes = (patterns[:, None] // 3 ** np.arange(self.labellers)) % 3
        column = np.arange(self.labellers)
        odds = np.log(self.prior / (1 - self.prior)) + np.log(self.vote[1, column, votes] / self.vote[0, column, votes]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(docs: DataFrame) -> tuple[LabelModel, int]:
    """The label model and the number of documents; the driver reads at most 3 ** labellers counts."""
    found = vote_patterns(docs).toPandas()
    counts = found["documents"].to_numpy(np.float64)
    return LabelModel(found["pattern"].to_numpy(np.int64), counts, LABELLERS), int(counts.sum())


def fit_scorer(docs: DataFrame, model: LabelModel, rows: int, sample: int = SAMPLE, rounds: int = 150) -> np.ndarray:
    """Weights of the linear scorer, and its bias at the end, from about `sample` documents drawn by a hash of
    their text. Equal texts count once, so that a text with many copies neither fills the sample nor is missing from it."""
    share = min(1.0, sample / max(rows, 1))
    chosen = docs.select("text").where(drawn(share, "text")).distinct()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            profile = Profile(batch.column(0))
            kinds, target, at = profile.features()[0], model.posterior(_pattern(profile.votes())), profile.first
            used = [np.unique(kinds[:, at[i]:at[i + 1]], return_counts=True) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([
                pa.array([f for f, _ in used], pa.list_(pa.int64())),
                pa.array([c / max(1, profile.words[i]) for i, (_, c) in enumerate(used)], pa.list_(pa.float64())),
                pa.array(target)], names=["feature", "value", "target"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        weights = np.zeros(FEATURES + 1)
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            lists = table.column("feature").combine_chunks()
            feature, value = lists.flatten().to_numpy(), table.column("value").combine_chunks().flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            target = table.column("target").to_numpy()
            # Both classes weigh the same; rare classes would otherwise hardly move the scorer.
            weight = target / max(target.sum(), 1) + (1 - target) / max((1 - target).sum(), 1)
            speed = np.full(FEATURES + 1, 1e-8)
            for _ in range(rounds):
                odds = np.bincount(row, value * weights[feature], len(target)) + weights[-1]
                error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - target) * weight
                slope = np.bincount(feature, value * error[row], FEATURES + 1) + 1e-6 * weights
                slope[-1] = error.sum()
                speed += slope * slope
                weights -= 0.5 * slope / np.sqrt(speed)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["feature", "weight"])

    found = stored(chosen.mapInArrow(examples, "feature array<long>, value array<double>, target double"), "examples")
    found = found.repartition(1).sortWithinPartitions("target", F.xxhash64("feature")).mapInArrow(fit, "feature long, weight double").toPandas()
    weights = np.zeros(FEATURES + 1)
    weights[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy()
    return weights


def assess(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of `docs` with `_posterior` (label model), `_score` (scorer, 0 to 1) and `_keep`.

    A document is kept if its score is at least 0.5. Null texts and texts without words score 0 and are not kept.
    Repeated rows get equal scores; texts of any length count whole; an empty table gives no row. Columns of the
    input that have one of these three names are replaced.
    """
    texts = docs.select(F.col(text_column).alias("text"))
    model, rows = fit_labels(texts)
    weights = fit_scorer(texts, model, rows, sample)
    added = ["_posterior", "_score", "_keep"]
    plain = docs.drop(*added)
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL("_posterior double, _score double, _keep boolean").fields])
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in slices(batches, text_column):
            profile = Profile(batch.column(text_column))
            kinds, doc = profile.features()
            total = np.bincount(doc, weights[kinds].sum(0), batch.num_rows)
            odds = total / np.maximum(profile.words, 1) + weights[-1]
            score = np.where(profile.words > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.0)
            belief = np.where(profile.words > 0, model.posterior(_pattern(profile.votes())), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(belief), pa.array(score), pa.array(score >= 0.5)],
                                             names=schema.names)

    return plain.mapInArrow(run, schema)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    return assess(docs, **options).where("_keep").select(*docs.columns)
