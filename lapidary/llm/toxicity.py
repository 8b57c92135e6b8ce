"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words (a stated list, and terms learnt from labelled rows), their
nearness to words of the second person, the densest window of words, capitals, punctuation and obfuscation. Words are
compared after accents stay and look-alike signs are undone (``1d10t``, ``i.d.i.o.t``, ``stuuupid``). Learnt terms are whole words
and beginnings of words, so that inflected and compound forms of a stem count as well.

Learning: at most ``sample`` rows of each label, drawn by seeded hash from the labelled rows that are not held out
(``crc32(doc_id) mod 5 <> 0``); each row weighs as many as it stands for. The rows are cut in two halves by hash. Terms
learnt from one half give the features of the other, and trees of one half score the other, so neither trees nor the
calibration ever see a row whose own label made its features. The final terms and trees come from all drawn rows; the
calibration is the isotonic fit of the out-of-half scores. Texts are counted and measured on the executors; the driver
holds at most ``TERMS`` terms and the drawn rows' features. Labels, lang, source and doc_id are no inputs.

Bounds: a scoring task keeps at most ``WORDS`` known words beside one batch of texts.

Defined results: null, empty and blank texts have all features zero and get the score of these features. Repeated rows
score alike. A doc_id with both labels is not learnt from, nor are null ids; a null id is not held out. Without drawn
rows of both labels every score is the share of label 1 among them, or 0 without any. An empty table gives an empty
result. The row stands in a struct, so names of other columns cannot clash. Equal terms go by text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapidary.llm.common import first_by, written

SAMPLE, SEED, FOLDS = 3000, 13, 5
TERMS, LEAST_TEXTS, LEAST_SHARE = 2000, 3, 0.6
SHORTEST, LONGEST = 3, 9
WORDS, WINDOW, NEAR = 400_000, 40, 5
#: Weights of terms are whole parts of this in the codes of tokens.
WEIGHT = 1 << 20
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHRINK = 80, 3, 0.15, 32, 8.0, 2.0

#: Plain insults of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash scum loser losers pathetic worthless disgusting clown clowns fool jerk "
    "garbage filth vermin bastard bitch asshole shit fuck fucking crap retard retarded imbecile coward parasite pig "
    "idiotisch dumm dummkopf blöd blödmann trottel arschloch scheiße abschaum versager widerlich erbärmlich wertlos "
    "idiote imbécile crétin stupide abruti connard salaud ordure merde minable dégoûtant débile bouffon "
    "idiota imbécil estúpido estúpida tonto basura escoria perdedor patético asqueroso inútil mierda cabrón payaso".split()
)
#: Words of the second person.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
#: Signs that stand for letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_LONG = re.compile(r"(.)\1{2,}")
_LOOKS = str.maketrans(LOOK_ALIKE)
_RUN = re.compile(r"[!?]{2,}")
FEATURES = 20


def plain(token: str) -> tuple[str, bool]:
    """(word, obfuscated) of a token: its edges cut off, signs for letters, inner signs and drawn-out letters undone."""
    bare = token.lower().strip(_SIGNS)
    if not bare.isalpha():
        bare = _EDGE.sub("", bare)
    if bare.isalpha() and not _LONG.search(bare):
        return bare, False
    if not any(c.isalpha() for c in bare):
        return "", False
    undone = bare
    if any(c in LOOK_ALIKE for c in bare[1:-1]) or bare[0] in LOOK_ALIKE:
        undone = bare.translate(_LOOKS)
    undone = _LONG.sub(r"\1", _INNER.sub("", undone))
    letters = sum(c.isalpha() for c in bare)
    return undone, 3 * letters >= len(bare) and undone != bare and len(undone) > 2


def terms_of(word: str) -> list[str]:
    """The word, and with a star its beginnings."""
    return [word, *[word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]]


class _Known(dict):
    """Codes of tokens: weight of the best learnt term above six flags; forgets all beyond ``WORDS`` tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.stems = {t.rstrip("*")[:SHORTEST] for t in lexicon}

    def __missing__(self, token: str) -> int:
        if len(self) > WORDS:
            self.clear()
        word, hidden = plain(token)
        weight = max(self.lexicon.get(t, 0.0) for t in terms_of(word)) if word[:SHORTEST] in self.stems else 0.0
        insult = word in INSULTS
        capitals = len(token) > 1 and token.isupper()
        flags = insult | (word in SECOND_PERSON) << 1 | hidden << 2 | capitals << 3 | (hidden and (insult or weight > 0)) << 4 | bool(word) << 5
        value = self[token] = round(weight * WEIGHT) << 6 | flags
        return value


def features(text: str | None, known: _Known) -> np.ndarray:
    text = text or ""
    out = np.zeros(FEATURES)
    tokens = text.split()
    n = len(tokens)
    if not n:
        return out
    codes = np.fromiter(map(known.__getitem__, tokens), np.int64, n)
    weight = (codes >> 6) / WEIGHT
    insult, second, hidden, capitals, hidden_hit, is_word = (codes >> i & 1 for i in range(6))
    hit = (weight > 0) | (insult > 0)
    places, persons = np.flatnonzero(hit), np.flatnonzero(second)
    out[0] = np.log1p(n)
    out[1], out[2] = insult.sum() / n, np.log1p(insult.sum())
    out[3], out[4] = weight.sum() / n, np.log1p((weight > 0).sum())
    out[5] = weight.max()
    out[6] = np.log1p(len({tokens[i] for i in places.tolist()}))
    out[7] = second.sum() / n
    if len(places) and len(persons):
        at = np.searchsorted(persons, places)
        gaps = np.minimum(
            np.abs(places - persons[np.minimum(at, len(persons) - 1)]), np.abs(places - persons[np.maximum(at - 1, 0)])
        )
        out[8], out[9] = (gaps <= NEAR).sum() / n, 1 / (1 + gaps.min())
    sums = np.concatenate([[0], np.cumsum(np.maximum(weight, insult))])
    out[10] = (sums[min(WINDOW, n) :] - sums[: n + 1 - min(WINDOW, n)]).max() / WINDOW
    out[11] = capitals.sum() / n
    out[12], out[13] = text.count("!") / n, text.count("?") / n
    out[14] = len(_RUN.findall(text)) / n if out[12] or out[13] else 0
    out[15] = hidden.sum() / n
    out[16] = hidden_hit.sum() / n
    out[17] = 1 - is_word.sum() / n
    out[18] = sum(map(text.count, "#*$%&|<>@")) / n
    out[19] = hit.sum() / n
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def drawn_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, list[float]]:
    """(text, toxic, half) of the drawn rows, and the rows that one row of label 0 and 1 stands for."""
    named = labels.select(F.col("doc_id").alias("named"), "toxic").filter("named is not null and toxic in (0, 1)")
    known = named.filter(~held_out(F.col("named"))).groupBy("named").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = known.filter("toxic = other").select("named", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(seed), "named")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [first_by(known.filter(F.col("toxic") == y), order, sample).drop("order") for y in (0, 1)]
    # Bounded: at most twice `sample` ids.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "named"), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("named")).select("text", "toxic", half.alias("half"))
    return written(rows, "drawn"), [max(1.0, counts.get(y, 0) / sample) for y in (0, 1)]


def _term_counts(batches):
    """Partial counts of texts by term, label and half."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])

    def rows():
        columns = [pa.array(list(counts), pa.string())]
        columns += [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, ["term", "c00", "c10", "c01", "c11"])

    for batch in batches:
        for text, toxic, half in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "half")]):
            words = {plain(t)[0] for t in set((text or "").split())}
            for term in {t for w in words if w for t in terms_of(w)}:
                counts[term][2 * toxic + half] += 1
            if len(counts) > WORDS:
                yield rows()
                counts.clear()
    yield rows()


def learnt(drawn: DataFrame, weights: list[float], most: int = TERMS) -> list[dict[str, float]]:
    """Terms and weights learnt from half 0, half 1 and all rows: the least share of toxic texts that is likely."""
    names = ["c00", "c10", "c01", "c11"]
    partial = drawn.select("text", "toxic", "half").mapInArrow(_term_counts, "term string, c00 long, c10 long, c01 long, c11 long")
    sums = written(partial.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).filter(F.col("c01") + F.col("c11") >= 2), "counts")
    found = []
    for zero, one in (("c00", "c01"), ("c10", "c11"), ("c00 + c10", "c01 + c11")):
        bad, good = F.expr(one) * weights[1], F.expr(zero) * weights[0]
        # Lower limit of the share by the Wilson score of the texts seen.
        share, n = bad / (bad + good), F.expr(f"{one} + {zero}")
        low = (share + 0.5 / n - F.sqrt(share * (1 - share) / n + 0.25 / (n * n))) / (1 + 1 / n)
        kept = sums.filter(F.expr(one) >= LEAST_TEXTS).select("term", low.alias("weight")).filter(F.col("weight") >= LEAST_SHARE)
        # Bounded: at most `most` terms.
        found.append({r.term: r.weight for r in kept.orderBy(F.desc("weight"), "term").limit(most).collect()})
    return found


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES) -> dict:
    """Gradient boosting of the logistic loss with trees of depth ``DEPTH`` over binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Rare features are zero in most rows: their other values get cuts of their own.
    cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9)])) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    rate = float((w * y).sum() / w.sum())
    start = float(np.log(rate / (1 - rate)))
    score, made = np.full(len(y), start), []
    columns = np.arange(x.shape[1])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        splits = []
        for level in range(DEPTH):
            nodes = 1 << level
            flat = ((node[:, None] * x.shape[1] + columns) * width + binned).ravel()
            shape = (nodes, x.shape[1], width)
            size = nodes * x.shape[1] * width

            def summed(v):
                return np.bincount(flat, np.repeat(v, x.shape[1]), size).reshape(shape).cumsum(2)

            g, h, c = summed(gradient), summed(curve), summed(w)
            whole = [v[:, :, -1:] for v in (g, h, c)]
            gain = g**2 / (h + SHRINK) + (whole[0] - g) ** 2 / (whole[1] - h + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK)
            gain[(c < LEAST_LEAF) | (whole[2] - c < LEAST_LEAF)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            column, place = best // width, best % width
            value = np.array([cuts[f][b] if gain[i, f, b] > 1e-9 and b < len(cuts[f]) else np.inf for i, (f, b) in enumerate(zip(column, place))])
            splits.append((column, value))
            node = 2 * node + (x[np.arange(len(y)), column[node]] > value[node])
        leaves = 1 << DEPTH
        step = RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, curve, leaves) + SHRINK)
        score = score + step[node]
        made.append((splits, step))
    return {"start": start, "trees": made}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for splits, step in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for column, value in splits:
            node = 2 * node + (x[rows, column[node]] > value[node])
        score += step[node]
    return score


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, shares) of the best rising step function, by pooling neighbours that fall; equal scores are one point."""
    points, which = np.unique(score, return_inverse=True)
    weights, sums = np.bincount(which, w), np.bincount(which, w * y)
    blocks: list[list[float]] = []  # weight, sum, first score, last score
    for block in zip(weights.tolist(), sums.tolist(), points.tolist(), points.tolist()):
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            weight, total, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + weight, blocks[-1][1] + total, blocks[-1][2], last]
    ends = [(b[i], b[1] / b[0]) for b in blocks for i in (2, 3)]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def fit(x: list[np.ndarray], y: np.ndarray, half: np.ndarray, w: np.ndarray) -> dict:
    """Trees of all rows, calibrated by what trees of one half say about the other; x: by terms of half 0, 1 and all."""
    rate = float((w * y).sum() / w.sum()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return {"rate": rate}
    out = np.full(len(y), np.nan)
    across = np.where((half == 0)[:, None], x[1], x[0])
    for side in (0, 1):
        mine = half == side
        if len(set(y[mine].tolist())) == 2:
            out[~mine] = margin(boost(across[mine], y[mine], w[mine]), across[~mine])
    model = boost(across, y, w)
    seen = ~np.isnan(out)
    curve = isotonic(out[seen], y[seen], w[seen]) if seen.any() else None
    return {"rate": rate, "model": model, "curve": curve}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> dict:
    """The lexicon, trees and calibration of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    drawn, weights = drawn_rows(docs, labels, sample, seed)
    lexicons = learnt(drawn, weights)

    def run(batches):
        known = [_Known(x) for x in lexicons[:2]]
        for batch in batches:
            rows = [[features(text, k) for k in known] for text in batch.column("text").to_pylist()]
            columns = [batch.column("toxic"), batch.column("half")]
            columns += [pa.array([r[i].tolist() for r in rows], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "half", "x0", "x1"])

    # Bounded: twice `sample` ids (an id that stands in several rows counts with each), FEATURES numbers each.
    rows = drawn.select("text", "toxic", "half").mapInArrow(run, "toxic int, half int, x0 array<double>, x1 array<double>").collect()
    rows = sorted((r.toxic, r.half, r.x0, r.x1) for r in rows)
    y, half = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], int)
    x = [np.array([r[i] for r in rows]).reshape(-1, FEATURES) for i in (2, 3)]
    return fit(x, y, half, np.where(y == 1, weights[1], weights[0])) | {"lexicon": lexicons[2]}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "model" not in model:
        return np.full(len(x), model["rate"])
    found = margin(model["model"], x)
    if model["curve"] is None:
        return 1 / (1 + np.exp(-found))
    return np.interp(found, *model["curve"])


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, else all), ``score`` and ``predicted``."""

    def run(batches):
        known = _Known(model["lexicon"])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scores(model, np.array([features(t, known) for t in texts]).reshape(-1, FEATURES))
            columns = [batch.column("row"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "text")
    out = StructType([rows.schema["row"]]).add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, out)
