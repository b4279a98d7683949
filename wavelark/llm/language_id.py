"""Language of documents and of spans of mixed-language texts (operator 9).

The script of a word's letters narrows the languages it can have. Byte trigrams, four-grams and the word itself, counted
per language over all training texts, score the word in each of them. A Viterbi path over the words of a document, with a
penalty for every change of language, labels spans; the language of most letters is the document's.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.words import Alphabet, slices, text_buffer, word_spans

LETTERS_ONLY = Alphabet(bytes(b for b in range(128) if not chr(b).isalpha()))
PENALTY = 8.0
#: The table has 196 608 scores of four bytes a language.
MOST_LANGUAGES = 400
UNKNOWN = "und"
_BITS = 16
_KINDS = 3
_SIZE = _KINDS << _BITS
_NO_SCRIPT = 50.0  # what a language loses on a word of a script it is not written in

# First and last code point of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x587),),
    "hebrew": ((0x5D0, 0x5EA),),
    "arabic": ((0x620, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
}


def _script_table() -> np.ndarray:
    """Script bit of a character by its first byte and the low six bits of its second."""
    table = np.zeros((256, 64), np.uint32)
    for bit, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            for point in range(low, high + 1):
                code = chr(point).encode()
                table[code[0], (code[1] & 63) if len(code) > 1 else slice(None)] |= 1 << bit
    return table


_SCRIPT = _script_table()


class Words:
    """Words of a column with their features and scripts."""

    def __init__(self, column: pa.Array):
        data, self.offsets = text_buffer(column)
        base, end = int(self.offsets[0]), int(self.offsets[-1])
        spans = list(word_spans(data, self.offsets, LETTERS_ONLY))
        self.begins, self.ends, hashes = (np.concatenate(x) for x in zip(*spans)) if spans else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.first = np.searchsorted(self.begins, self.offsets, side="left")
        raw = np.concatenate([[32], data[base:end], [32, 32, 32]]).astype(np.uint8)
        is_word = LETTERS_ONLY.is_word[raw]
        a = np.where(is_word, np.frombuffer(LETTERS_ONLY.folding, np.uint8)[raw], 32).astype(np.uint32)
        # The byte at place p of the text is a[p - base + 1].
        three = (a[:-3] * np.uint32(0x9E3779B1)) ^ (a[1:-2] * np.uint32(0x85EBCA77)) ^ (a[2:-1] * np.uint32(0xC2B2AE3D))
        four = (three * np.uint32(0x27D4EB2F)) ^ (a[3:] * np.uint32(0x165667B1))
        shift = np.uint32(32 - _BITS)
        self.three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift).astype(np.int64)
        self.four = ((four ^ (four >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift).astype(np.int64) + (1 << _BITS)
        self.word = (hashes >> np.uint64(64 - _BITS)).astype(np.int64) + (2 << _BITS)
        self.at, self.size = self.begins - base, self.ends - self.begins
        letters = _SCRIPT[raw[1:-2], raw[2:-1] & 63]
        cuts = np.stack([self.at, self.ends - base], axis=1).ravel()
        self.script = np.bitwise_or.reduceat(letters, cuts)[::2] if len(cuts) else np.zeros(0, np.uint32)
        self.data = data

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each byte of each word, and the word it belongs to."""
        total = int(self.size.sum())
        which = np.repeat(np.arange(len(self.size)), self.size)
        begin = np.repeat(self.at - np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(self.size) else self.at, self.size)
        return np.arange(total) + begin, which


def train(texts: DataFrame, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, score table (feature, language) and script bits of each language from rows (text, lang).

    The driver reads at most one count per hashed feature and language; more than `most` languages are refused.
    """
    scripts = len(SCRIPTS)
    if texts.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages to learn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            languages = batch.column(1).to_pylist()
            words = Words(batch.column(0))
            place, which = words.inside()
            doc = np.searchsorted(words.first, np.arange(len(words.size)), side="right") - 1
            names = sorted(set(languages))
            number = np.array([names.index(x) for x in languages])
            of_word = number[doc] if len(doc) else np.zeros(0, np.int64)
            of_byte = of_word[which]
            for n, name in enumerate(names):
                total = counts.setdefault(name, np.zeros(_SIZE + scripts, np.int64))
                own = place[of_byte == n]
                total[:_SIZE] += np.bincount(words.three[own], minlength=_SIZE) + np.bincount(words.four[own], minlength=_SIZE)
                total[:_SIZE] += np.bincount(words.word[of_word == n], minlength=_SIZE)
                for s in range(scripts):
                    total[_SIZE + s] += np.count_nonzero(words.script[of_word == n] & np.uint32(1 << s))
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "feature", "n"])

    found = texts.select("text", "lang").mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(
        F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((_SIZE + scripts, len(languages)))
    counts[found["feature"].to_numpy(np.int64), [languages.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    table = np.zeros((_SIZE, len(languages)), np.float32)
    for kind, weight in enumerate((0.5, 0.5, 1.0)):
        part = counts[kind << _BITS:(kind + 1) << _BITS] + 0.1
        table[kind << _BITS:(kind + 1) << _BITS] = weight * np.log(part / part.sum(0))
    seen = counts[_SIZE:] >= 0.01 * np.maximum(counts[_SIZE:].sum(0), 1)
    bits = (seen * (1 << np.arange(scripts))[:, None]).sum(0).astype(np.uint32)
    return languages, table, bits


def word_scores(words: Words, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A row of language scores per word; languages of other scripts lose, words without letters score 0."""
    if not len(words.size):
        return np.zeros((0, table.shape[1]))
    place, _ = words.inside()
    heads = np.concatenate([[0], np.cumsum(words.size)[:-1]])
    scores = np.add.reduceat(table[words.three[place]] + table[words.four[place]], heads, axis=0).astype(np.float64)
    scores += table[words.word]
    fits = (words.script[:, None] & bits[None, :]) > 0
    fits |= ~fits.any(1, keepdims=True)
    scores = np.where(fits, scores, scores.max(1, keepdims=True) - _NO_SCRIPT)
    return np.where(words.script[:, None] > 0, scores, 0.0)


def _stays(scores: np.ndarray, penalty: float) -> int:
    """The one language that is best for the whole text, if no path can be better; else -1.

    A path of n runs in other languages pays n - 1 penalties at least. One run gains nothing, and n runs that each gain less
    than half a penalty gain less than they pay.
    """
    best = int(scores.sum(0).argmax())
    sums = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, [best]], axis=0, out=sums[1:])
    return best if (sums - np.minimum.accumulate(sums, axis=0)).max() < penalty / 2 else -1


def viterbi(texts: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best language per word for several texts at once, longest first in every step."""
    out = [np.zeros(len(s), np.int64) for s in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return out
    flat = np.concatenate([texts[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    came = np.zeros(flat.shape, np.int16)
    active = int((lengths > 0).sum())
    state = flat[begin[:active]].copy()
    last = np.zeros(len(lengths), np.int64)
    same = np.arange(flat.shape[1])
    done = len(lengths)
    for t in range(1, lengths[0] + 1):
        now = int(np.searchsorted(-lengths, -t, side="left"))  # texts of more than t words
        last[now:min(done, len(state))] = state[now:].argmax(1)
        done, state = now, state[:now]
        if not now:
            break
        top = state.argmax(1)
        moved = state[np.arange(now), top] - penalty
        at = begin[:now] + t
        stay = state >= moved[:, None]
        came[at] = np.where(stay, same, top[:, None])
        state = np.where(stay, state, moved[:, None]) + flat[at]
    path = np.zeros(len(flat), np.int64)
    current = last.copy()
    for t in range(lengths[0] - 1, -1, -1):
        now = int(np.searchsorted(-lengths, -t, side="left"))
        at = begin[:now] + t
        path[at] = current[:now]
        if t:
            current[:now] = came[at, current[:now]]
    for n, i in enumerate(order):
        out[i] = path[begin[n]:begin[n] + lengths[n]]
    return out


def identify(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             penalty: float = PENALTY, keep: tuple[str, ...] = (), most: int = MOST_LANGUAGES) -> DataFrame:
    """(doc_id, *keep, lang_pred, score, spans) of every row, learnt from the rows (text, lang) of `training`.

    `spans` lists (start, end, lang) in characters; `score` is the share of the letters that lie in spans of
    the predicted language, 0 to 1. Null texts and texts without letters are `und` with score 0 and no span, as is
    everything if nothing was learnt. Equal scores go to the language that sorts first, and so do letters of scripts beyond the
    table. Repeated rows get equal results; an empty table gives no row; texts of any length are read whole; ids may be null; only the named columns are read, and `keep`
    may not name a result. The table of scores travels to every task: more than `most` languages are refused.
    """
    if clash := {"doc_id", "lang_pred", "score", "spans"} & set(keep):
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    languages, table, bits = train(training.where("text IS NOT NULL AND lang IS NOT NULL"), most)
    # A slice holds a number per word and language.
    at_once = max(1 << 14, (1 << 20) * 16 // max(16, len(languages)))
    schema = T.StructType([docs.schema[id_column], *(docs.schema[c] for c in keep), *T.StructType.fromDDL(
        "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>").fields])
    schema.fields[0] = T.StructField("doc_id", schema.fields[0].dataType)
    shared = docs.sparkSession.sparkContext.broadcast((languages, table, bits))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, bits = shared.value
        for batch in slices(batches, "text", at_once):
            words = Words(batch.column("text"))
            scores = word_scores(words, table, bits) if languages else np.zeros((len(words.size), 1))
            parts = [scores[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
            alone = [_stays(s, penalty) if len(s) else 0 for s in parts]
            mixed = [i for i, a in enumerate(alone) if a < 0]
            paths = dict(zip(mixed, viterbi([parts[i] for i in mixed], penalty)))
            places = np.concatenate([[0], np.cumsum((words.data[words.offsets[0]:words.offsets[-1]] & 0xC0) != 0x80)])
            names, shares, spans = [], [], []
            for i in range(batch.num_rows):
                a, b = words.first[i], words.first[i + 1]
                has = bool((words.script[a:b] > 0).any()) or (a < b and any(c.isalpha() for c in batch.column("text")[i].as_py()))
                if not languages or not has:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                path = paths.get(i)
                path = np.full(b - a, alone[i]) if path is None else path
                weight = np.bincount(path, words.size[a:b], len(languages))
                best = int(weight.argmax())
                names.append(languages[best])
                shares.append(float(weight[best] / weight.sum()))
                turn = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a]])
                zero, base = places[words.offsets[i] - words.offsets[0]], words.offsets[0]
                spans.append([{"start": int(places[words.begins[a + x] - base] - zero), "end": int(places[words.ends[a + y - 1] - base] - zero),
                               "lang": languages[path[x]]} for x, y in zip(turn[:-1], turn[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(1 + len(keep))] + [
                pa.array(names), pa.array(shares), pa.array(spans, span)], names=schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), *keep, F.col(text_column).alias("text")).mapInArrow(run, schema)
