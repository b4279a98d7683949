"""Secrets in texts, with false positives removed by a random forest (operator 10).

Candidates are runs of value characters in words that could hold keys: a word is cut at quotes, brackets, commas, `&`, `;`,
`=`, `:` and letters beyond ASCII. Runs of at least 8 characters are candidates of their own if they have a digit, stand behind a
keyword, an assignment or a quote, change their case inside, have at least 20 characters, or have transitions that are rare in the
corpus. Only the rest, words of usual letters in plain prose, is left out. Each candidate gets features of its length, characters, character transitions
(a bigram model of the corpus), dictionary coverage (frequent words of the corpus), path and neighbouring words.
A random forest trained from labelled findings decides. Where no labelled findings are given, formats that leave
no doubt label a part of the candidates: issued key ids and keyword assignments of hexadecimal values are secrets;
addresses, links and plain words are not.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.llm.storage import drawn, sized, stored
from wavelark.llm.words import BLOCK, SPACED, slices, text_buffer, word_spans

#: Labelled findings that train the forest, in expectation.
SAMPLE = 20_000
DICTIONARY = 4096

# Words that announce a secret, that announce a placeholder, and that mark test files in paths.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential",
            "private_key", "key")
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx", "your", "test", "fake")
TEST_PATHS = ("test", "example", "sample", "mock", "fixture", "doc")

FEATURES = ("length", "digits", "capitals", "lower", "signs", "entropy", "transition", "worst_transition", "coverage", "switches",
            "keyword", "assigned", "quoted", "placeholder", "test_path", "address_signs", "prose_neighbours")

#: Bytes of the shortest value, and of the text around a value that names it.
_LEAST = 8
_AROUND = 256
_ROWS_AT_ONCE = 8192
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.@%-")] = True
_HEX_DIGIT = np.zeros(256, bool)
_HEX_DIGIT[list(b"0123456789abcdefABCDEF")] = True

#: Letters alone are no word of prose from this length on.
_LONG = 20
_KEYWORD = re.compile("|".join(sorted(KEYWORDS, key=len)).encode())
_OPENS = np.zeros(256, bool)
_OPENS[list(b"=:\"'`")] = True

_KEY = re.compile(r"""([A-Za-z][\w\-.]*)["'`\])]*(?:=>|[:=])+["'`(\[{<]*$""")
_NAMES = re.compile(r"""["'`\])]*[:=](?!//)""")
_SCHEME = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{0,6}:$")
_PADDING = re.compile(r"={1,2}(?![\w+/=.@%\-])")
_USER = re.compile(r"://[^\s/@:]*:$")
_ISSUED_INSIDE = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])")
_LINK_INSIDE = re.compile(_ISSUED_INSIDE.pattern + r"|(?<=://)[^/@]{8,}(?=@)|(?<=[^/]/)[\w\-]{16,}(?=/|$)")
_ISSUED = re.compile(r"AKIA[A-Z0-9]{16}")
_HEX = re.compile(r"(?=\d*[a-f])[0-9a-f]{16,}")
_NUMBER = re.compile(r"[\d.,:/+%\-]+")
_ADDRESS = re.compile(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+\.?|(https?:|www\.).*")


def corpus_model(docs: DataFrame) -> tuple[np.ndarray, frozenset[str]]:
    """Log probabilities of byte transitions inside words, and the frequent words of the corpus.

    Transitions and words are counted over all texts, and words are cut to the most frequent after the sum only; the driver
    reads 65 536 counts and `DICTIONARY` words at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(65536, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = text_buffer(batch.column(0))
            lower = SPACED_LOWER[data[int(offsets[0]):int(offsets[-1])]]
            both = (lower[1:] > 0) & (lower[:-1] > 0)
            pairs += np.bincount(lower[:-1][both].astype(np.int64) * 256 + lower[1:][both], minlength=65536)
            spans = list(word_spans(data, offsets, SPACED))
            if not spans:
                continue
            begins, ends, hashes = (np.concatenate(x) for x in zip(*spans))
            _, at, count = np.unique(hashes, return_index=True, return_counts=True)
            words, counts = [], []
            for begin, end, n in zip(begins[at].tolist(), ends[at].tolist(), count.tolist()):
                word = data[begin:end].tobytes().decode().strip(".,;:!?\"'").lower()
                if len(word) >= 3 and word.isalpha():
                    words.append(word)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.nulls(len(words), pa.int64()), pa.array(counts, pa.int64())],
                                             names=["word", "pair", "n"])
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.array(seen), pa.array(pairs[seen])],
                                         names=["word", "pair", "n"])

    counts = stored(docs.select("text").mapInArrow(run, "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")), "counts")
    found = counts.where("pair IS NOT NULL").toPandas()
    table = np.full(65536, 0.05)
    table[found["pair"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    table = table.reshape(256, 256)
    words = counts.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    return np.log(table / table.sum(1, keepdims=True)), frozenset(r["word"] for r in words)


SPACED_LOWER = np.frombuffer(SPACED.folding, np.uint8).copy()
SPACED_LOWER[~SPACED.is_word] = 0


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of characters that lie in dictionary words, taking the longest word at each place."""
    value, at, covered = value.lower(), 0, 0
    while at < len(value):
        for size in range(min(12, len(value) - at), 2, -1):
            if value[at:at + size] in dictionary:
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / max(1, len(value))


def describe(value: str, key: str | None, quoted: bool, before: list[str], after: list[str], path: str | None,
             transitions: np.ndarray, dictionary: frozenset[str]) -> list[float]:
    """The features of one candidate, in the order of FEATURES."""
    n = len(value)
    count = Counter(value)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in value]
    codes = SPACED_LOWER[np.frombuffer(value.encode(), np.uint8)].astype(np.int64)
    steps = transitions[codes[:-1], codes[1:]]
    near = [w.lower() for w in ([key] if key else []) + before]
    around = " ".join([value.lower(), *near, *(w.lower() for w in after)])
    prose = [w.strip(".,;:!?\"'").lower() for w in before + after]
    return [
        float(n), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        -sum(c / n * math.log2(c / n) for c in count.values()),
        float(steps.mean()), float(np.sort(steps)[:max(1, len(steps) // 4)].mean()), coverage(value, dictionary),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(any(k in w for w in near for k in KEYWORDS)), float(key is not None or (before[-1:] in (["="], [":"]))), float(quoted),
        float(any(p in around for p in PLACEHOLDERS)), float(any(p in (path or "").lower() for p in TEST_PATHS)),
        float(sum(value.count(c) for c in "@/.:")), sum(w.isalpha() for w in prose) / max(1, len(prose)),
    ]


def value_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of all runs of at least `_LEAST` value bytes; runs never reach over the end of a text."""
    base = int(offsets[0])
    raw = data[base:int(offsets[-1])]
    run = _RUN[raw]
    # A colon between pairs of hexadecimal digits belongs to a fingerprint.
    colons = np.flatnonzero(raw == 58)
    colons = colons[(colons >= 2) & (colons < len(raw) - 2)]
    before, after = np.maximum(colons - 3, 0), np.minimum(colons + 3, len(raw) - 1)
    pairs = _HEX_DIGIT[raw[colons - 2]] & _HEX_DIGIT[raw[colons - 1]] & _HEX_DIGIT[raw[colons + 1]] & _HEX_DIGIT[raw[colons + 2]]
    pairs &= ((before == colons - 2) | ~run[before]) & ((after == colons + 2) | ~run[after])
    run[colons[pairs]] = True
    first, last = run.copy(), run.copy()
    first[1:] &= ~run[:-1]
    last[:-1] &= ~run[1:]
    heads = offsets[(offsets > base) & (offsets < base + len(raw))] - base
    first[heads] = run[heads]
    last[heads - 1] = run[heads - 1]
    begins, ends = np.flatnonzero(first) + base, np.flatnonzero(last) + base + 1
    long = ends - begins >= _LEAST
    return begins[long], ends[long]


def rare_transition(transitions: np.ndarray) -> float:
    """Mean log probability half-way between random letters and words of the corpus."""
    letters = transitions[97:123, 97:123]
    steps = np.exp(letters) / np.exp(letters).sum(1, keepdims=True)
    share = np.full(26, 1 / 26)
    for _ in range(50):
        share = share @ steps
    return float((letters.mean() + (share[:, None] * steps * letters).sum()) / 2)


def _sums_before(raw: np.ndarray, each: Callable[[np.ndarray], np.ndarray], places: np.ndarray) -> np.ndarray:
    """Sums of one number per byte (or per pair of bytes) before each of the ascending places, block by block."""
    out, total = np.zeros(len(places)), 0.0
    for at in range(0, len(raw), BLOCK):
        sums = total + np.concatenate([[0], np.cumsum(each(raw[at:at + BLOCK + 1])[:BLOCK])])
        low, high = np.searchsorted(places, (at, at + BLOCK))
        out[low:high] = sums[places[low:high] - at]
        total = sums[-1]
    out[np.searchsorted(places, len(raw)):] = total
    return out


def values(run: str, prefix: str, suffix: str, odd: bool = False) -> list[tuple[int, str, str | None, bool]]:
    """(place in the run, value, key, quoted) of every value of a run, from the text of its word before and behind it.

    A link keeps its scheme, so a place can be negative; its user, its password and long parts of its path are values of their
    own, as are issued key ids inside longer runs. Names of other values are none, unless they are `odd`: letters and digits in an
    unusual order.
    """
    scheme = _SCHEME.search(prefix) if run.startswith("//") else None
    shift = len(scheme[0]) if scheme else 0
    run, prefix = (scheme[0] + run, prefix[:-shift]) if scheme else (run, prefix)
    key, quoted = _KEY.search(prefix), prefix[-1:] in ("\"", "'", "`")
    cuts = [(m.start(), m.end()) for m in (_LINK_INSIDE if scheme else _ISSUED_INSIDE).finditer(run)]
    if not scheme and "@" in run and _USER.search(prefix):
        at = run.rindex("@")
        cuts = [(0, at), *((m.start(), m.end()) for m in _LINK_INSIDE.finditer(run, at))]
    edges = [0, *(x for cut in cuts for x in cut), len(run)]
    out = []
    for begin, end in zip(edges, edges[1:]):
        value = run[begin:end]
        if begin and (begin, end) not in cuts:
            value = value.lstrip("/@._-+%:")
            begin = end - len(value)
        padding = _PADDING.match(suffix) if end == len(run) else None
        if padding and (len(value) + len(padding[0])) % 4 == 0 and (quoted or suffix[padding.end():][:1] not in ("\"", "'", "`")):
            value += padding[0]
        elif end == len(run) and sum(c.isdigit() for c in value) < 2 and not (scheme or odd and value.isalnum()) and _NAMES.match(suffix):
            continue
        value = value.rstrip(".:,")
        if len(value) >= _LEAST:
            out.append((begin - shift, value, key and key[1], quoted and not begin))
    return out


def _rule_label(value: str, key: str | None, before: list[str]) -> int | None:
    named = [w.lower() for w in ([key] if key else []) + before[-2:]]
    announced = any(k in w for w in named for k in KEYWORDS)
    if _ISSUED.fullmatch(value) or (_HEX.fullmatch(value) and announced):
        return 1
    if _ADDRESS.fullmatch(value) or (not announced and (value.isalpha() or _NUMBER.fullmatch(value))):
        return 0
    return None


def candidates(docs: DataFrame, model: tuple[np.ndarray, frozenset[str]]) -> DataFrame:
    """(doc_id, content, start, length, features, rule) of every value that could be a key; offsets in characters."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "content string, start long, length long, features array<double>, rule int").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def table(batch: pa.RecordBatch, rows: list[tuple], which: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(which)), batch.column("content").take(pa.array(which)),
            *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32()]))],
            names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, dictionary = shared.value
        rare = rare_transition(transitions)
        codes = np.arange(256)
        digit, capital, small = ((codes >= low) & (codes <= high) for low, high in ((48, 57), (65, 90), (97, 122)))
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            spans = list(word_spans(data, offsets, SPACED))
            if not spans:
                continue
            begins, ends, _ = (np.concatenate(x) for x in zip(*spans))
            base = int(offsets[0])
            raw = data[base:int(offsets[-1])]
            run_begins, run_ends = value_runs(data, offsets)
            word = np.searchsorted(begins, run_begins, side="right") - 1
            doc = np.searchsorted(offsets, run_begins, side="right") - 1
            first = np.searchsorted(begins, offsets, side="left")

            def total(each, until):
                """Sums of one number per byte, from the begin of each run to `until` before its end."""
                return _sums_before(raw, each, run_ends - base - until) - _sums_before(raw, each, run_begins - base)

            odd = total(lambda x: transitions[SPACED_LOWER[x[:-1]], SPACED_LOWER[x[1:]]], 1) / (run_ends - run_begins - 1) < rare
            turns = total(lambda x: small[x[:-1]] & capital[x[1:]], 1)
            announces = np.zeros(len(begins), bool)
            places = np.fromiter((m.start() for m in _KEYWORD.finditer(raw.tobytes().lower())), np.int64) + base
            announces[np.searchsorted(begins, places, side="right") - 1] = True
            announced = announces[word]
            for back in (1, 2, 3):
                announced |= (word - back >= first[doc]) & announces[np.maximum(word - back, 0)]
            opened = (run_begins > begins[word]) & _OPENS[data[run_begins - 1]]
            opened |= (word > first[doc]) & _OPENS[data[ends[word - 1] - 1]]
            chosen = np.flatnonzero((total(lambda x: digit[x], 0) > 0) | announced | opened | (turns > 0) | odd | (run_ends - run_begins >= _LONG))
            if not len(chosen):
                continue
            signs = lambda x: (x & 0xC0) != 0x80
            chars = (_sums_before(raw, signs, run_begins - base) - _sums_before(raw, signs, offsets - base)[doc]).astype(np.int64)
            rows, which = [], []

            def text(begin, end):
                return data[begin:end].tobytes().decode(errors="ignore")

            for r in chosen:
                i, d, begin, end = int(word[r]), int(doc[r]), int(run_begins[r]), int(run_ends[r])
                found = values(text(begin, end), text(max(begins[i], begin - _AROUND), begin), text(end, min(ends[i], end + _AROUND)), bool(odd[r]))
                if not found:
                    continue
                before = [text(max(begins[j], ends[j] - _AROUND), ends[j]) for j in range(max(first[d], i - 3), i)]
                after = [text(begins[j], min(ends[j], begins[j] + _AROUND)) for j in range(i + 1, min(first[d + 1], i + 3))]
                path = batch.column("path")[d].as_py()
                start = int(chars[r])
                for place, value, key, quoted in found:
                    rows.append((start + place, len(value), describe(value, key, quoted, before, after, path, transitions, dictionary),
                                 _rule_label(value, key, before)))
                    which.append(d)
                if len(rows) >= _ROWS_AT_ONCE:
                    yield table(batch, rows, which)
                    rows, which = [], []
            if rows:
                yield table(batch, rows, which)

    return docs.mapInArrow(run, schema)


def train(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11):
    """A forest from rows (features, label); None unless both labels occur."""
    rows = stored(labelled.select("features", F.col("label").cast("double")).repartition(1).sortWithinPartitions("label", "features"), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    rows = rows.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(rows)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source",
                 labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, content, start, length, probability, secret) of every candidate.

    `content` is the digest of the text, which ties findings to rows without an id; `start` counts characters.
    `labelled` has rows (features, label) from reviewed findings; without it, or with one label only, undoubted
    formats label. Null and empty texts have no candidate; a null path is an empty one; repeated rows are reported
    each for itself; texts of any length are read whole. Other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(path_column).alias("path"),
                       F.md5(text_column).alias("content"))
    found = stored(candidates(docs, corpus_model(docs)), "candidates")
    if labelled is None:
        ruled = found.where("rule IS NOT NULL")
        share = min(1.0, sample / max(1, ruled.count()))
        # The candidates of one text are told apart by their place; copies of it count once.
        chosen = ruled.where(drawn(share, "content", "start")).dropDuplicates(["content", "start"])
        labelled = chosen.select("features", F.col("rule").alias("label"))
    forest = train(labelled)
    if forest is None:
        scored = found.withColumn("probability", F.coalesce(F.col("rule"), F.lit(0)).cast("double"))
    else:
        scored = forest.transform(found.withColumn("features", array_to_vector("features"))).withColumn(
            "probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "content", "start", "length", F.col("probability"), (F.col("probability") >= 0.5).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, text_column: str = "text", mark: str = "<SECRET>",
           length_column: str = "n_chars") -> DataFrame:
    """All rows and columns of `docs` with every secret replaced by `mark`; the text length is updated where it is kept."""
    spans = stored(findings.where("secret").select("content", "start", "length").distinct().groupBy("content").agg(
        F.sort_array(F.collect_list(F.struct("start", "length")), asc=False).alias("_spans")), "spans")
    hit = sized(stored(spans.select(F.col("content").alias("_content")), "hit"))
    keyed = docs.withColumn("_content", F.md5(text_column))
    clean = keyed.join(hit, "_content", "left_anti")
    cut = F.aggregate("_spans", F.col(text_column), lambda text, s: F.concat(
        F.substring(text, F.lit(1), s["start"].cast("int")), F.lit(mark),
        F.substring(text, (s["start"] + s["length"] + 1).cast("int"), F.length(text))))
    dirty = keyed.join(hit, "_content", "left_semi").join(
        spans.withColumnRenamed("content", "_content"), "_content").withColumn(text_column, cut)
    if length_column in docs.columns:
        dirty = dirty.withColumn(length_column, F.length(text_column).cast(docs.schema[length_column].dataType))
    return clean.select(*docs.columns).unionByName(dirty.select(*docs.columns))
