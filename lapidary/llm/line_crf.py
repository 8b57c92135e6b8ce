"""Quality rules by line sequence labelling: a linear-chain conditional random field over the lines of a text.

Each line with a word gets a vector of surface features; Viterbi decoding marks the lines as content or boilerplate;
the share of a text's words that stand in content lines decides whether it is kept. Plain rules come first: too few
words, or too many words in repeated windows.

The field is fitted on labelled documents: at most ``sample`` of each quality by seeded hash, of at most ``lines``
lines each (documented bounds). Labels are per document, so fitting has two rounds: line weights alone with every
line labelled as its document; then the whole chain, where lines of bad documents that the first round takes for
content with over 90 % are content. Judging covers every text whole; features are numpy operations on its bytes.

Defined results: null, empty and blank texts have no words and fail the plain rules; lines without a word take no part.
Very long texts are judged whole; words are compared as such, however long. Repeated rows are judged alike, one by one;
ties of the decoding go to content. An empty table gives an empty result. The row stands in a struct, so names of other
columns cannot clash. Without labels of both qualities every line is content. Line numbers of
boilerplate are kept in ``boilerplate`` as the real output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from lapidary.llm.common import first_by
from lapidary.llm.wordhash import IS_BLANK, word_starts

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_CONTENT = 0.5
SAMPLE, LINES, SEED, ROUNDS = 600, 200, 3, 300
SYMBOLS = b"#*$%&|<>"

#: Kinds of bytes; bytes after the first of a character are kind 0.
REST, LETTER, CAPITAL, DIGIT, SYMBOL, SHOUT, POINT, OTHER, BLANK = range(9)
_KIND = np.full(256, OTHER)
_KIND[[*range(97, 123), *range(0xC0, 256)]] = LETTER
_KIND[0x80:0xC0] = REST
_KIND[65:91] = CAPITAL
_KIND[48:58] = DIGIT
_KIND[list(b".,;:?")] = POINT
_KIND[list(SYMBOLS)] = SYMBOL
_KIND[33] = SHOUT
_KIND[IS_BLANK] = BLANK
FEATURES = 12


class _Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def in_repeated_windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Which of some words stand in a run of ``width`` words that is found twice or more; words are numbers, compared as such.

    Runs of 2, 4, 8 ... words are numbered by the pair of runs they consist of, so equal numbers are equal words.
    """
    runs, size = ids, 1
    while size < width and len(ids) >= width:
        step = min(size, width - size)
        pairs = runs[: len(runs) - step] * (int(runs.max()) + 1) + runs[step:]
        _, runs, times = np.unique(pairs, return_inverse=True, return_counts=True)
        size += step
    inside = np.zeros(len(ids) + 1, np.int64)
    if size == width and len(ids) >= width:
        first = np.flatnonzero(times[runs] > 1)
        np.add.at(inside, first, 1)
        np.add.at(inside, first + width, -1)
    return np.cumsum(inside[:-1]) > 0


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); per line with a word: number, words, features."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = word_starts(data)
    if not len(starts):
        return (0, 0, int(np.isin(data, list(SYMBOLS)).sum()), 0, 0), np.zeros(0, int), np.zeros(0, int), np.zeros((0, FEATURES))
    line_of = np.cumsum(data == 10)
    n_lines = int(line_of[-1]) + 1
    kinds = np.bincount(line_of * 9 + _KIND[data], minlength=9 * n_lines).reshape(n_lines, 9)
    word_line = line_of[starts]
    words = np.bincount(word_line, minlength=n_lines)

    seen: set[str] = set()
    again = np.zeros(n_lines)
    for i, line in enumerate(text.split("\n")):
        if i < n_lines and words[i]:
            again[i] = line in seen
            seen.add(line)

    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, data.tobytes().split()), np.int64, len(starts))
    repeated = in_repeated_windows(ids, WINDOW)
    twins = np.zeros(len(starts))
    twins[1:] = (ids[1:] == ids[:-1]) & (word_line[1:] == word_line[:-1])

    visible = kinds[:, 1:8].sum(axis=1)
    rows = np.flatnonzero(words)
    w, v, k = words[rows], visible[rows], kinds[rows]
    # the last byte that is no blank, of each line with a word
    places = np.flatnonzero(_KIND[data] != BLANK)
    last = np.full(n_lines, -1)
    last[line_of[places]] = places
    per_word = lambda x: np.bincount(word_line, weights=x, minlength=n_lines)[rows] / w
    features = np.column_stack([
        np.ones(len(rows)), np.log1p(w) / 3, k[:, SYMBOL] / v, k[:, CAPITAL] / v, k[:, DIGIT] / v, k[:, SHOUT] / v,
        per_word(twins), per_word(repeated), again[rows], np.isin(data[last[rows]], list(b".!?")),
        np.minimum(np.abs(v / w - 5) / 5, 3), w < 3,
    ])
    base = (len(starts), int(visible.sum()), int(kinds[:, SYMBOL].sum()), int(again.sum()), int(repeated.sum()))
    return base, rows, w, features


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> dict | None:
    """Weights of ``documents``: (line features, quality). None unless both qualities are there."""
    documents = [d for d in documents if len(d[0])]
    if {q for _, q in documents} != {0, 1}:
        return None
    longest = max(len(x) for x, _ in documents)
    x = np.zeros((len(documents), longest, FEATURES))
    there = np.zeros((len(documents), longest), bool)
    for i, (lines, _) in enumerate(documents):
        x[i, : len(lines)], there[i, : len(lines)] = lines, True
    quality = np.array([q for _, q in documents])
    y = np.where(there, quality[:, None], 0)
    # each document and each quality has the same say
    say = there / there.sum(axis=1, keepdims=True) / np.where(quality == 1, (quality == 1).sum(), (quality == 0).sum())[:, None]

    weights = np.zeros(FEATURES)
    step = _Adam(weights.shape)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weights))
        weights = weights + step(np.einsum("dt,dtf->f", say * (y - p), x) - 1e-4 * weights)
    p = 1 / (1 + np.exp(-x @ weights))
    y = np.where(there & ((quality[:, None] == 1) | (p > 0.9)), 1, 0)

    chain, steps = np.zeros((2, 2)), (_Adam(weights.shape), _Adam((2, 2)))
    pairs = there[:, 1:]
    per_doc = say.sum(axis=1) / there.sum(axis=1)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:, :-1][pairs], y[:, 1:][pairs]), np.broadcast_to(per_doc[:, None], pairs.shape)[pairs])
    for _ in range(rounds // 2):
        lines, moves = _expected(x @ weights, there, chain, per_doc)
        weights = weights + steps[0](np.einsum("dt,dtf->f", say * (y - lines), x) - 1e-4 * weights)
        chain = chain + steps[1](gold - moves - 1e-2 * chain)
    return {"weights": np.round(weights, 9), "chain": np.round(chain, 9)}


class _Adam:
    def __init__(self, shape):
        self.mean, self.square, self.n = np.zeros(shape), np.zeros(shape), 0

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.99 * self.square + 0.01 * gradient**2
        return 0.1 * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-9)


def _expected(scores: np.ndarray, there: np.ndarray, chain: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(content) per line, and the expected moves between labels, weighted per document."""
    n, length = scores.shape
    local = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead, back = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    ahead[:, 0] = local[:, 0]
    for t in range(1, length):
        ahead[:, t] = local[:, t] + _log_sum(ahead[:, t - 1, :, None] + chain, 1)
    for t in range(length - 2, -1, -1):
        following = _log_sum(chain + (local[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(there[:, t + 1, None], following, 0)
    end = there.sum(axis=1) - 1
    total = _log_sum(ahead[np.arange(n), end], 1)
    lines = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]) * there
    both = ahead[:, :-1, :, None] + chain + (local + back)[:, 1:, None, :] - total[:, None, None, None]
    moves = np.where(there[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0) * per_doc[:, None, None, None]
    return lines, moves.sum(axis=(0, 1))


def viterbi(scores: np.ndarray, chain: np.ndarray) -> list[int]:
    """The best labels of a line sequence: 1 content, 0 boilerplate; ties go to content."""
    (c00, c01), (c10, c11) = chain.tolist()
    zero, one, from_zero, from_one = 0.0, 0.0, [], []
    for i, score in enumerate(scores.tolist()):
        if i:
            a, b, c, d = zero + c00, one + c10, zero + c01, one + c11
            from_zero.append(b >= a)
            from_one.append(d >= c)
            zero, one = max(a, b), max(c, d)
        one += score
    label = int(one >= zero)
    labels = [label]
    for to_zero, to_one in zip(reversed(from_zero), reversed(from_one)):
        label = int(to_one if label else to_zero)
        labels.append(label)
    return labels[::-1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, seed: int = SEED) -> dict | None:
    """The field of ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``)."""
    order = F.xxhash64(F.lit(seed), "named")
    known = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("named"), "quality").distinct()
    drawn = [first_by(known.filter(F.col("quality") == q), order, sample).drop("order") for q in (0, 1)]
    # Bounded: at most twice `sample` ids.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("named"))

    def run(batches):
        for batch in batches:
            for text, quality in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist()):
                features = measure(text)[3]
                if 0 < len(features) <= lines:
                    columns = [pa.array([quality], pa.int32()), pa.array([features.ravel().tolist()], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["quality", "features"])

    # Bounded: at most twice `sample` rows of at most `lines` lines.
    rows = chosen.select("text", F.col("quality").cast("int")).mapInArrow(run, "quality int, features array<double>").collect()
    ordered = sorted((r.quality, len(r.features), r.features) for r in rows)
    return fit([(np.array(f).reshape(-1, FEATURES), q) for q, _, f in ordered])


def judge(docs: DataFrame, model: dict | None, keep: list[str] | None = None, min_content: float = MIN_CONTENT) -> DataFrame:
    """``row`` (the columns ``keep``, else all) with the counts, ``base_failed``, ``content_share``, ``boilerplate``, ``kept``."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                base, numbers, words, features = measure(text)
                content = np.ones(len(numbers), int)
                if model and len(numbers):
                    content = np.array(viterbi(features @ model["weights"], model["chain"]))
                share = float((words * content).sum() / base[0]) if base[0] else 0.0
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                found.append((*base, failed, share, numbers[content == 0].tolist(), not failed and share >= min_content))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.bool_()]
            columns = [pa.array(x, k) for x, k in zip(zip(*found) if found else [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], out.names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    out = StructType([rows.schema["row"]])
    for name in counts:
        out = out.add(name, "long")
    out = out.add("base_failed", "boolean").add("content_share", "double").add("boilerplate", ArrayType(LongType())).add("kept", "boolean")
    return rows.mapInArrow(run, out)
