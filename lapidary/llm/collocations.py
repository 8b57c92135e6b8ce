"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and each piece is parsed at content triggers: a window of ``OVERLAP`` words
whose hash is a multiple of ``TRIGGER`` ends one chunk and begins the next. Equal passages are cut alike wherever they
stand, so the dictionary of distinct chunks with their parse frequencies is what the texts say once, copies apart. All
n-grams are counted inside the distinct chunks, weighted by frequency. Chunks overlap by as many words as a longest
phrase has after its first; an n-gram belongs to the chunk in which it starts before the overlap, so each is counted once.

The dictionary is read twice. First the 64-bit hashes of word pairs are counted as numbers; pairs below the support
cannot be part of a candidate. The others are marked in a bit table, and only n-grams whose pairs are all marked are
counted by text, beside all words. Two pairs on one mark only cost a row: the last counts are exact and by text.

Bounds: a parsing task keeps at most ``ENTRIES`` chunks beside those of one text, a counting task ``WORDS`` words and
one batch. The marks have about 64 bits for each frequent pair, at most 2 ** ``MARK_BITS``; beyond that they sieve
less and the result stays the same.

Defined results: null texts and texts without words have no phrases; a null language is ``und``, like the language of
that name. Repeated rows count as often as they stand there. Ties go by count, then by phrase in UTF-8 order. A very long
piece is cut at its triggers, or after ``LONGEST`` words without one. An empty table gives an empty result. Only ``text``
and ``lang`` are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import written

SUPPORT, LENGTH, TOP, INSIDE_PERCENT = 30, 4, 2000, 80
OVERLAP, TRIGGER, LONGEST = LENGTH - 1, 16, 256
ENTRIES, WORDS, BYTES_OF_WORD, MARK_BITS = 300_000, 1_000_000, 6, 26

#: Bytes of a text: A-Z as a-z, the characters between pieces as a point. A word holds neither point nor "!".
_PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Ends a chunk of the dictionary whose last ``OVERLAP`` words are the first ones of the next chunk.
GOES_ON = b" ."
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    """Hash of each word; forgets all beyond ``ENTRIES`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) if word != b"." else 0
        return value


def chunks_of(text: str | None, hashes: dict[bytes, int]) -> tuple[list[bytes], int]:
    """The chunks of a text, in order, and the number of its words."""
    words = (text or "").encode().translate(_PIECE_BYTES).replace(b".", b" . ").split()
    words.append(b".")
    size = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, size)
    stop = h == 0
    window = (h * _A)[:-2] + (h * _B)[1:-1] + (h * _C)[2:] if size > 2 else np.zeros(0, np.uint64)
    window ^= window >> np.uint64(32)
    inside = ~(stop[:-2] | stop[1:-1] | stop[2:])
    begins = np.zeros(size + 1, bool)
    begins[: len(window)] = inside & (window % np.uint64(TRIGGER) == 0)
    begins[0] = True
    begins[1:] |= stop
    begins[:-1] &= ~stop
    ends = np.flatnonzero(stop)
    first = np.flatnonzero(begins[:size])
    last = ends[np.searchsorted(ends, first)]  # the end of its piece
    following = np.minimum(np.append(first[1:], size), last)
    found = []
    for a, b, end in zip(first.tolist(), following.tolist(), last.tolist()):
        while b - a > LONGEST and end - a > LONGEST + OVERLAP:
            found.append(b" ".join(words[a : a + LONGEST + OVERLAP]) + GOES_ON)
            a += LONGEST
        found.append(b" ".join(words[a:end]) if b == end else b" ".join(words[a : b + OVERLAP]) + GOES_ON)
    return found, size - len(ends)


def _parsed(batches):
    """Partial dictionary: lang, chunk, how often it was parsed, words it stands for."""
    hashes = _Hashes()
    counts: dict[str, Counter] = {}
    words: Counter = Counter()
    entries = 0

    def rows():
        for lang, chunks in counts.items():
            size = len(chunks)
            columns = [
                pa.array([lang] * size, pa.string()),
                pa.array(list(chunks), pa.binary()).cast(pa.string()),
                pa.array(list(chunks.values()), pa.int64()),
                pa.array([words[lang], *[0] * (size - 1)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "times", "words"])

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            found, n = chunks_of(text, hashes)
            if not n:
                continue
            chunks = counts.setdefault(lang, Counter())
            before = len(chunks)
            chunks.update(found)
            words[lang] += n
            entries += len(chunks) - before
            if entries > ENTRIES:
                yield from rows()
                counts, entries = {}, 0
                words.clear()
    yield from rows()


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, times, words: each distinct chunk of a language; ``words`` sums up to the words of the language."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    partial = texts.mapInArrow(_parsed, "lang string, chunk string, times long, words long")
    return partial.groupBy("lang", "chunk").agg(F.sum("times").alias("times"), F.sum("words").alias("words"))


def _portions(batches):
    """(lang, texts of chunks as an Arrow array, times) of about ``WORDS`` words, each of one language."""
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    size = 0

    def portions():
        for lang, parts in held.items():
            yield lang, pa.concat_arrays([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    for batch in batches:
        langs, chunks, times = (batch.column(c) for c in ("lang", "chunk", "times"))
        for lang in pc.unique(langs).to_pylist():
            mine = pc.equal(langs, lang)
            part = chunks.filter(mine)
            held.setdefault(lang, []).append((part, times.filter(mine).to_numpy()))
            size += int(pc.sum(pc.binary_length(part)).as_py())
        if size > WORDS * BYTES_OF_WORD:
            yield from portions()
            held, size = {}, 0
    yield from portions()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Words:
    """The words of some chunks as numbers: which may begin an n-gram, of which chunk, and hashes of pairs."""

    def __init__(self, lang: str, chunks: pa.Array, times: np.ndarray):
        whole = pc.binary_join(pa.LargeListArray.from_arrays([0, len(chunks)], chunks.cast(pa.large_binary())), pa.scalar(b" ! ", pa.large_binary()))
        data = whole[0].as_py().split(b" ")
        numbers = _Numbers({b"!": 0, b".": 1})
        self.ids = np.fromiter(map(numbers.__getitem__, data), np.int64, len(data))
        self.names = list(numbers)
        word = self.ids > 1
        goes_on = self.ids == 1
        begin = word.copy()
        for i in range(1, OVERLAP + 1):
            begin[:-i] &= ~goes_on[i:]
        self.begin = begin
        self.weight = times[np.cumsum(self.ids == 0)]
        self.pair = word[:-1] & word[1:]
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.names), np.uint64, len(self.names))[self.ids]
        keys = (h[:-1] ^ salt) * _A + h[1:] * _B
        keys ^= keys >> np.uint64(29)
        self.keys = (keys * _C).view(np.int64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the sums of their weights."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, int)
    return ordered[first], order[first], np.add.reduceat(weights[order], first) if len(keys) else np.zeros(0, np.int64)


def _pair_hashes(batches):
    for portion in _portions(batches):
        words = _Words(*portion)
        at = np.flatnonzero(words.pair & words.begin[:-1])
        keys, _, sums = _summed(words.keys[at], words.weight[at])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["key", "n"])


def marks(chunks: DataFrame, support: int = SUPPORT, most: int = MARK_BITS) -> np.ndarray:
    """Bits of the hashes of word pairs that stand at least ``support`` times; the number of bits is a power of two."""
    pairs = chunks.select("lang", "chunk", "times").mapInArrow(_pair_hashes, "key long, n long")
    frequent = written(pairs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= support).select("key"), "pairs")
    bits = min(most, max(10, int(64 * frequent.count() - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    cells = place.bitwiseAND(F.lit(63)).cast("int")
    table = frequent.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cells)).alias("mask"))
    # Bounded: at most 2 ** (most - 6) rows of two numbers.
    found = table.toArrow()
    made = np.zeros(1 << (bits - 6), np.int64)
    made[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return made


def _phrases(marked: np.ndarray):
    shift = np.uint64(64 - (len(marked).bit_length() - 1 + 6))

    def known(keys: np.ndarray) -> np.ndarray:
        place = (keys.view(np.uint64) >> shift).astype(np.int64)
        return marked[place >> 6] >> (place & 63) & 1 == 1

    def run(batches):
        for lang, chunks, times in _portions(batches):
            words = _Words(lang, chunks, times)
            ids, size, base = words.ids, len(words.ids), len(words.names)
            good = np.zeros(size, bool)
            good[:-1][words.pair] = known(words.keys[words.pair])
            ok, codes, spots = good, ids, np.flatnonzero(words.begin)
            for n in range(1, LENGTH + 1):
                if n > 2:
                    # ok: the pairs from here on, one less than the words, are all frequent.
                    ok = ok[:-1] & good[n - 2 :]
                if n > 1:
                    spots = np.flatnonzero(ok & words.begin[: len(ok)])
                    codes = ids[spots] * base + ids[spots + 1]
                    for i in range(2, n):
                        _, codes = np.unique(codes, return_inverse=True)
                        codes = codes * base + ids[spots + i]
                _, places, sums = _summed(codes if n > 1 else ids[spots], words.weight[spots])
                places = spots[places]
                parts = [map(words.names.__getitem__, ids[places + i].tolist()) for i in range(n)]
                texts = [b" ".join(p) for p in zip(*parts)]
                columns = [pa.array([lang] * len(texts), pa.string()), pa.array([n] * len(texts), pa.int32())]
                columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

    return run


def frequent_phrases(chunks: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, size, phrase, f: the phrases of 1 to ``LENGTH`` words that stand at least ``support`` times."""
    found = chunks.select("lang", "chunk", "times").mapInArrow(_phrases(marks(chunks, support)), "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate at its weakest cut."""
    candidates = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", "size", F.col("f").alias("a"), cut)
    first = F.array_join(F.slice("words", 1, F.col("k")), " ")
    rest = F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longest: for phrases that stand inside longer candidates, the count of the most frequent of these."""
    longer = phrases.filter("size > 2").withColumn("words", F.split("phrase", " "))
    spans = F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))"))
    return longer.select("lang", "f", spans.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def mine(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    chunks = written(dictionary(docs), "chunks")
    phrases = written(frequent_phrases(chunks, support), "phrases")
    totals = chunks.groupBy("lang").agg(F.sum("words").alias("n"))
    alone = scored(phrases).join(inside_longer(phrases), ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < INSIDE_PERCENT * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
