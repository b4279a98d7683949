"""Document likelihood under a unigram model of subword pieces, summed over all segmentations (operator 7).

The pieces and their first scores come from an existing vocabulary; expectation-maximisation over the distinct
words of the training documents fits the scores to the corpus. A word is a lattice of all pieces that match inside it,
and a forward recursion, in log space for long words, gives its marginal probability. A word of the training documents is one more arc of
its lattice, from begin to end: its count less a discount, and the discounts of all words are the weight of spelling
a word out of pieces. Pieces never cross a word's begin, so the probability of a document is the product over its
words and its end, and the probabilities of all texts sum up to no more than 1.

Within a document the words adapt: with m earlier words, of which j were the same, a word of model probability p has
(j + PRIOR * p) / (m + PRIOR), a Dirichlet prior of the lattice model. A document keeps to one language and repeats its
words, which counts over the corpus cannot tell.

Counts of all words stay in a table. Words above a count that at most `HOT` words reach travel to every task; the
rest, whose counts are bounded, meet the table in one join.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import stored
from wavelark.llm.words import SPACED, mix, slices, text_buffer, word_spans

#: Words whose counts and scores are sent to every task, at most.
HOT = 400_000
SMOOTHING = 0.1
#: Weight of the lattice model against the words of the document so far, in words.
PRIOR = 1000.0
_AT_ONCE = 4096
_TEXT_AT_ONCE = 2 << 20
_LONG = 96
#: Bytes of long words whose lattices are walked side by side.
_CELLS = 1 << 18
_FILTER_BITS = 20
#: Natural logarithm of one over the least probability that is walked as it is; words that may be less probable are walked in logarithms.
_DEPTH = 600.0
_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_UP = np.array([pow(_STEP, i, 1 << 64) for i in range(_LONG + 1)], np.uint64)
_DOWN = np.array([pow(pow(_STEP, -1, 1 << 64), i, 1 << 64) for i in range(_LONG + 1)], np.uint64)


def default_vocabulary() -> str:
    """Path of the 32k piece vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space marking the begin of a word, and their first log probabilities.

    A vocabulary of ranks instead of log probabilities is taken as Zipf distributed. All single bytes are
    pieces, so that every word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    raw = [model.id_to_piece(i).replace("▁", " ").encode() for i in usual]
    scores = np.array([model.get_score(i) for i in usual])
    if np.all(scores == np.round(scores)):
        scores = -np.log(1.0 - scores)
    known: dict[bytes, float] = {}
    for piece, score in zip(raw, scores):
        if len(piece) <= _LONG and b" " not in piece[1:]:
            known.setdefault(piece, float(score))
    rare = min(known.values(), default=0.0)
    for b in range(256):
        known.setdefault(bytes([b]), rare)
    scores = np.array(list(known.values()))
    return list(known), scores - np.log(np.exp(scores).sum())


class Lattice:
    """Pieces by hash, for all substrings of many words at once."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, stop: float):
        self.scores, self.stop = scores, stop
        self.chances = np.append(np.exp(scores), 0.0)
        # Up to this length no word is less probable than a double can hold: single bytes are pieces, so it has a spelling of them.
        self.plain = int(_DEPTH / max(1e-9, -scores.min()))
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(np.frombuffer(p, np.uint8)) for p in pieces], np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        slots = (self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        self.filter[slots] = True
        # Keys of a slot lie side by side: the first place of each slot, and the keys of the fullest one.
        self.first = np.searchsorted(slots, np.arange(1 << _FILTER_BITS)).astype(np.int32)
        self.depth = int(np.bincount(slots).max())

    @staticmethod
    def _hash(piece: np.ndarray) -> int:
        return int(mix((_VALUES[piece] * _UP[:len(piece)]).sum(dtype=np.uint64, keepdims=True))[0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where a substring is no piece."""
        out = np.full(hashes.shape, -1, np.int32)
        slots = (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        maybe = self.filter[slots]
        wanted, first = hashes[maybe], self.first[slots[maybe]]
        pieces = np.full(wanted.shape, -1, np.int32)
        for step in range(self.depth):
            at = np.minimum(first + step, len(self.keys) - 1)
            pieces = np.where(self.keys[at] == wanted, self.order[at], pieces)
        out[maybe] = pieces
        return out

    def _matches(self, words: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: the pieces of k bytes at every place of equally long words."""
        sums = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
        np.cumsum(_VALUES[words] * _UP[:words.shape[1]], axis=1, out=sums[:, 1:])
        return [self._find(mix((sums[:, k:] - sums[:, :-k]) * _DOWN[:words.shape[1] - k + 1]))
                for k in range(1, min(self.longest, words.shape[1]) + 1)]

    def _forward(self, found: list[np.ndarray], rows: int, length: int) -> np.ndarray:
        alpha = np.full((rows, length + 1), -np.inf)
        alpha[:, 0] = 0
        padded = np.append(self.scores, -np.inf)
        for j in range(1, length + 1):
            ways = np.stack([alpha[:, j - k] + padded[found[k - 1][:, j - k]] for k in range(1, min(j, len(found)) + 1)])
            top = ways.max(0)
            alpha[:, j] = top + np.log(np.exp(ways - top).sum(0))
        return alpha

    def _weights(self, found: list[np.ndarray]) -> list[np.ndarray | None]:
        """Probabilities of the pieces as [place, word] for k = 1, 2, ...; None where no word has a piece of that length."""
        return [self.chances.take(np.ascontiguousarray(m.T)) if (m >= 0).any() else None for m in found]

    def _chances(self, weights: list[np.ndarray | None], rows: int, length: int) -> np.ndarray:
        """The forward recursion without logarithms, as [place, word], for words of at most `plain` bytes."""
        alpha = np.zeros((length + 1, rows))
        alpha[0] = 1
        for j in range(1, length + 1):
            for k in range(1, min(j, len(weights)) + 1):
                if weights[k - 1] is not None:
                    alpha[j] += alpha[j - k] * weights[k - 1][j - k]
        return alpha

    def _expect_plain(self, found: list[np.ndarray], rows: int, length: int, total: np.ndarray) -> None:
        """Adds the expected uses in words of at most `plain` bytes."""
        weights = self._weights(found)
        alpha = self._chances(weights, rows, length)
        beta = np.zeros((length + 1, rows))
        # A spelling's share of its word: the last place starts with one over the word's probability.
        beta[length] = 1 / alpha[length]
        for j in range(length - 1, -1, -1):
            for k in range(1, min(length - j, len(weights)) + 1):
                if weights[k - 1] is not None:
                    beta[j] += beta[j + k] * weights[k - 1][j]
        for k, (m, w) in enumerate(zip(found, weights), 1):
            if w is not None:
                place, row = np.nonzero(m.T >= 0)
                share = alpha[place, row] * w[place, row] * beta[place + k, row]
                total += np.bincount(m[row, place], share, len(total))

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for length in np.unique(lengths[lengths <= _LONG]):
            members = np.flatnonzero(lengths == length)
            for i in range(0, len(members), _AT_ONCE):
                part = members[i:i + _AT_ONCE]
                yield part, np.frombuffer(b" " + b" ".join([words[m] for m in part]), np.uint8).reshape(len(part), length)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability of being spelled out of pieces."""
        out = np.zeros(len(words))
        for part, block in self._by_length(words):
            found = self._matches(block)
            if block.shape[1] <= self.plain:
                out[part] = np.log(self._chances(self._weights(found), *block.shape)[-1]) + self.stop
            else:
                out[part] = self._forward(found, *block.shape)[:, -1] + self.stop
        for i, word in enumerate(words):
            if len(word) >= _LONG:
                out[i] = self._score_long(b" " + word) + self.stop
        return out

    def _score_long(self, word: bytes) -> float:
        """The same recursion for one word of any length, in windows whose matches are looked up at once."""
        recent, step = [0.0], self.longest
        for at in range(0, len(word), _LONG // 2):
            window = np.frombuffer(word[max(0, at - step):at + _LONG // 2], np.uint8)
            shift = min(at, step)
            found = {}
            for begin in range(0, len(window), _LONG // 2):
                piece = window[begin:begin + _LONG]
                for k, m in enumerate(self._matches(piece[None, :]), 1):
                    for i in np.flatnonzero(m[0] >= 0):
                        found[(begin + int(i), k)] = float(self.scores[m[0][i]])
            for j in range(shift + 1, len(window) + 1):
                ways = np.array([recent[-k] + found[(j - k, k)] for k in range(1, min(len(recent), step) + 1) if (j - k, k) in found])
                recent.append(float(ways.max() + np.log(np.exp(ways - ways.max()).sum())))
                recent = recent[-step:]
        return recent[-1]

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words (forward and backward)."""
        total = np.zeros(len(self.scores) + 1)
        padded = np.append(self.scores, -np.inf)
        for part, block in self._by_length(words):
            found, (rows, length) = self._matches(block), block.shape
            if length <= self.plain:
                self._expect_plain(found, rows, length, total)
                continue
            alpha = self._forward(found, rows, length)
            beta = np.full((rows, length + 1), -np.inf)
            beta[:, length] = 0
            for j in range(length - 1, -1, -1):
                ways = np.stack([beta[:, j + k] + padded[found[k - 1][:, j]] for k in range(1, min(length - j, len(found)) + 1)])
                top = np.maximum(ways.max(0), -1e300)
                beta[:, j] = top + np.log(np.maximum(np.exp(ways - top).sum(0), 1e-300))
            for k, m in enumerate(found, 1):
                share = np.exp(alpha[:, :-k] + padded[m] + beta[:, k:] - alpha[:, -1:])
                total += np.bincount(np.where(m < 0, len(total) - 1, m).ravel(), share.ravel(), len(total))
        group: list[bytes] = []
        for word in sorted((w for w in words if len(w) >= _LONG), key=len):
            if group and (len(group) + 1) * len(word) > _CELLS:
                self._expect_long(group, total)
                group = []
            group.append(b" " + word)
        if group:
            self._expect_long(group, total)
        return total[:-1]

    def _expect_long(self, words: list[bytes], total: np.ndarray) -> None:
        """The same for words of any length, ascending: forward and backward over whole words, pieces looked up stretch by stretch."""
        lengths = np.array([len(w) for w in words])
        rows, length, most = len(words), int(lengths[-1]), self.longest
        text = np.zeros((rows, length + _LONG), np.uint8)
        for i, word in enumerate(words):
            text[i, :len(word)] = np.frombuffer(word, np.uint8)
        padded = np.append(self.scores, -np.inf)
        stretch, step = max(most, _CELLS // 8 // rows), max(1, _LONG - most + 1)

        def arcs(at: int, end: int) -> np.ndarray:
            """Pieces of k bytes that begin at the places `at` to `end`, as [k - 1, word, place]."""
            out = np.full((most, rows, end - at), -1, np.int32)
            for begin in range(at, end, step):
                stop = min(begin + step, end)
                for k, m in enumerate(self._matches(text[:, begin:begin + _LONG])):
                    part = m[:, :stop - begin]
                    out[k, :, begin - at:begin - at + part.shape[1]] = part
            for k in range(1, most + 1):
                out[k - 1][np.arange(at, end) + k > lengths[:, None]] = -1
            return out

        def summed(ways: np.ndarray) -> np.ndarray:
            top = np.maximum(ways.max(0), -1e300)
            return top + np.log(np.maximum(np.exp(ways - top).sum(0), 1e-300))

        alpha, beta = np.full((rows, length + 1), -np.inf), np.full((rows, length + 1 + most), -np.inf)
        alpha[:, 0] = 0
        for at in range(0, length, stretch):
            end, low = min(at + stretch, length), max(0, at + 1 - most)
            weights = padded[arcs(low, end)]
            for j in range(at + 1, end + 1):
                k = np.arange(1, min(j, most) + 1)
                alpha[:, j] = summed(alpha[:, j - k].T + weights[k - 1, :, j - k - low])
        whole = alpha[np.arange(rows), lengths]
        beta[np.arange(rows), lengths] = 0
        k = np.arange(1, most + 1)
        for at in reversed(range(0, length, stretch)):
            end = min(at + stretch, length)
            found = arcs(at, end)
            weights = padded[found]
            for j in range(end - 1, at - 1, -1):
                beta[:, j] = np.where(j < lengths, summed(beta[:, j + k].T + weights[:, :, j - at]), beta[:, j])
            for n, m in enumerate(found, 1):
                share = np.exp(alpha[:, at:end] + weights[n - 1] + beta[:, at + n:end + n] - whole[:, None])
                total += np.bincount(np.where(m < 0, len(total) - 1, m).ravel(), share.ravel(), len(total))


def _distinct(column: pa.Array) -> tuple:
    """Distinct words of the texts of a column: hash, first begin and end, number; and text and word of each occurrence."""
    data, offsets = text_buffer(column)
    spans = list(word_spans(data, offsets, SPACED))
    begins, ends, hashes = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    doc = np.searchsorted(offsets, begins, side="right") - 1
    unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return data, unique, begins[first], ends[first], doc, which


def _decoded(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[b:e].tobytes().translate(SPACED.folding) for b, e in zip(begins, ends)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, word, n) of all words of the column `text`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _TEXT_AT_ONCE):
            data, unique, begins, ends, _, which = _distinct(batch.column(0))
            yield pa.RecordBatch.from_arrays([
                pa.array(unique.view(np.int64)), pa.array(_decoded(data, begins, ends), pa.binary()),
                pa.array(np.bincount(which, minlength=len(unique)))], names=["hash", "word", "n"])

    return texts.select("text").mapInArrow(run, "hash long, word binary, n long").groupBy("hash").agg(
        F.min("word").alias("word"), F.sum("n").alias("n"))


def _normalised(pieces: list[bytes], uses: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Log probabilities: of the pieces that begin a word, and of those that go on or the stop."""
    begins = np.array([p[:1] == b" " for p in pieces])
    first, later = uses[begins].sum(), uses[~begins].sum() + words
    return np.log(uses) - np.log(np.where(begins, first, later)), float(np.log(words / later))


def fit(counts: DataFrame, words: int, vocabulary: str | None = None, rounds: int = 3) -> Lattice:
    """Piece scores fitted to the distinct words; the driver reads one number per piece and round."""
    pieces, scores = read_vocabulary(vocabulary or default_vocabulary())
    lattice = Lattice(pieces, *_normalised(pieces, np.exp(scores), 0.3))
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.scores))
            for batch in batches:
                total += shared.value.expected(batch.column(0).to_pylist())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "uses"])

        found = counts.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(len(pieces), 0.01)
        uses[found["piece"].to_numpy(np.int64)] += found["uses"].to_numpy()
        lattice = Lattice(pieces, *_normalised(pieces, uses, words + 0.01))
    return lattice


def _frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Words above the smallest count that at most `limit` words reach."""
    grades = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    total, least = 0, None
    for row in grades:
        total += row["words"]
        if total > limit:
            break
        least = row["n"]
    return counts.where(F.lit(False)) if least is None else counts.where(F.col("n") >= least)


def _history(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a run of texts: how many words of its text precede it, and how many of them are the same."""
    place = np.arange(len(doc))
    before = place - np.searchsorted(doc, doc, side="left")
    order = np.lexsort((word, doc))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    seen = np.empty(len(doc), np.int64)
    seen[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return before, seen


def _adapted(score: np.ndarray, seen: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of a word's probability given the words of the text before it, from its log10 by the model."""
    return np.where(seen == 0, score + np.log10(PRIOR), np.log10(seen + PRIOR * 10.0 ** score)) - np.log10(before + PRIOR)


def _log_of_either(n: Column, spell: Column, discount: float, spelled: float, tokens: int) -> Column:
    """log10 of a word's own arc and its spelling together; without an arc, straight from the logarithm."""
    own = (n - F.lit(discount)) / F.lit(float(tokens + 1))
    alone = spell + F.lit(float(np.log10(spelled)))
    return F.when(n > 0, F.log10(own + F.lit(float(spelled)) * F.pow(F.lit(10.0), spell))).otherwise(alone)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
                    hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows whose crc32 of the id as text leaves a remainder by 10 that is not 0. Tokens are words between
    ASCII white space, A-Z in lower case, and one end per document; `base_score` is the smoothed unigram log10
    probability of the tokens and `score` that of the lattice model. Null and empty texts are the end alone; a null
    id counts as training; repeated rows count and are scored each; other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"),
                       F.coalesce(F.crc32(F.col(id_column).cast("string")) % 10 == 0, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = stored(word_counts(training), "words")
    documents = training.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words"),
                      F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    tokens = sums["tokens"] + documents
    discount = min(0.95, max(0.05, sums["once"] / max(1, sums["once"] + 2 * sums["twice"])))
    spelled = (discount * sums["words"] + 1) / (tokens + 1)  # weight of spelling
    # The end is a token of its own; it is unknown only if nothing was learnt.
    scale = tokens + SMOOTHING * (sums["words"] + (documents > 0) + 1)
    lattice = fit(counts, sums["words"], vocabulary)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(lattice)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shared.value.score(batch.column(1).to_pylist()))],
                                             names=["hash", "n", "score"])

    top = _frequent(counts, hot).select("hash", "word", "n").mapInArrow(score_words, "hash long, n long, score double").toPandas()
    order = np.argsort(top["hash"].to_numpy(np.int64).view(np.uint64))
    known = context.broadcast((top["hash"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.float64)[order],
                               top["score"].to_numpy(np.float64)[order]))
    del top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, (keys, numbers, scores) = shared.value, known.value
        for batch in slices(batches, "text", _TEXT_AT_ONCE):
            rows = batch.num_rows
            data, unique, begins, ends, doc, which = _distinct(batch.column("text"))
            at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
            hot = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
            base, score, spell = np.zeros(len(unique)), np.zeros(len(unique)), np.zeros(len(unique))
            base[hot] = np.log10((numbers[at[hot]] + SMOOTHING) / scale)
            score[hot] = np.log10((numbers[at[hot]] - discount) / (tokens + 1) + spelled * np.exp(scores[at[hot]]))
            spell[~hot] = lattice.score(_decoded(data, begins[~hot], ends[~hot])) / np.log(10)
            before, seen = _history(doc, which)
            rare = ~hot[which]
            own = _adapted(score[which], seen, before)
            starts = np.searchsorted(doc[rare], np.arange(rows + 1)).astype(np.int32)
            n = np.bincount(doc, minlength=rows)
            end = np.log10(max(documents, 0.5) / (tokens + 1)) + np.log10(PRIOR / (n + PRIOR))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1),
                pa.array(np.bincount(doc, hot[which], rows).astype(np.int64) + (documents > 0)),
                pa.array(np.bincount(doc, base[which], rows) + np.log10((documents + SMOOTHING) / scale)),
                pa.array(np.bincount(doc, np.where(rare, 0.0, own), rows) + end),
                *(pa.ListArray.from_arrays(pa.array(starts), pa.array(x[rare])) for x in (
                    unique.view(np.int64)[which], spell[which], seen, before))], names=schema.names)

    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["doc_id"], *T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, base_score double, score double, hashes array<long>, spells array<double>, seen array<long>, before array<long>").fields])
    scored = stored(docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "held_out", "text").mapInArrow(run, schema), "scored")
    rare = scored.select("key", F.explode(F.arrays_zip("hashes", "spells", "seen", "before")).alias("w")).select(
        "key", F.col("w.hashes").alias("hash"), F.col("w.spells").alias("spell"), F.col("w.seen").alias("seen"), F.col("w.before").alias("before"))
    n = F.coalesce("n", F.lit(0))
    plain = _log_of_either(n, F.col("spell"), discount, spelled, tokens)
    prior = F.lit(PRIOR)
    adapted = F.when(F.col("seen") == 0, plain + F.log10(prior / (F.col("before") + prior))).otherwise(
        F.log10((F.col("seen") + prior * F.pow(F.lit(10.0), plain)) / (F.col("before") + prior)))
    rest = rare.join(counts.select("hash", "n"), "hash", "left").groupBy("key").agg(
        F.sum(F.log10((n + SMOOTHING) / F.lit(scale))).alias("more"), F.sum(adapted).alias("more_score"),
        F.count_if(n > 0).alias("known"))
    return scored.drop("hashes", "spells", "seen", "before").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
