"""Text quality by Naive Bayes support vectors.

Features are indicators of n-grams, hashed: of words (1 and 2), of bytes (3), and of word shapes (1
to 3): letter case, digits, how the word ends, and whether it repeats the word before. An n-gram of
shapes counts at four levels of its share in the text (any, 1/32, 1/8, 1/2), so that one odd
token in a long clean text doesn't look like a page full of them. Indicators are scaled by the
classes' log-count ratios, and a linear hinge-loss model is fitted by dual coordinate descent; a
logistic curve over the margins turns them into scores.

The model is fitted on at most ``max_labelled`` labelled rows with at most ``MAX_IDS`` feature ids in
all (4 bytes each, so that bounds what reaches the driver), taken in the order of a hash of the id;
the weights (``2**BITS`` floats) go to the workers.

Defined results: null and empty texts have no features and get the intercept's score; very long texts
are taken whole. Labels that are null are ignored; of several labels of an id the mean counts, 1/2
as 1; of several texts of a labelled id the first by a hash of the text is learnt. Without labels, or
with one class, the score is the smoothed share of label 1. Rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_python, save
from .words import U64, chunks, give_back, hashes, mix, split

#: ids below 2**SHAPES are shapes', those above words' and bytes'
SHAPES, BITS = 17, 18
WORDS, BYTES = (1, 2), 3
MAX_LABELLED, MAX_IDS = 8000, 1 << 22
LEVELS = (0.0, 1 / 32, 1 / 8, 1 / 2)
ORDERS = (1, 2, 3)
CUTOFF = 0.7

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[0xC2:0xF5] = True
_DIGIT[48:58] = True
_TAIL = np.full(256, 6, np.int64)
_TAIL[65:91] = _TAIL[97:123] = _TAIL[128:] = _TAIL[48:58] = 0
_TAIL[[46]], _TAIL[[44]], _TAIL[[33, 63]], _TAIL[list(b"#*$%&")], _TAIL[[124]] = 1, 2, 3, 4, 5


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, word_hashes: np.ndarray) -> np.ndarray:
    """A small code for each word."""
    if not len(start):
        return np.zeros(0, np.int64)
    # U+00C0 to U+00DE are capitals: xC3 and a byte up to x9E
    capital = np.zeros(len(data) + 1, bool)
    capital[: len(data)] = _UPPER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] < 0x9F))
    capital[latin] = True
    small = _LOWER[data]
    small[latin] = False

    def count(marks):
        total = np.concatenate([[0], np.cumsum(marks[: len(data)], dtype=np.int64)])
        return total[end] - total[start]

    ups, lows, digits = count(capital), count(small), count(_DIGIT[data])
    case = np.where(ups + lows == 0, 0, np.where(lows == 0, np.where(ups > 1, 3, 2), np.where(ups == 0, 1, np.where(capital[start] & (ups == 1), 2, 4))))
    same = np.zeros(len(start), np.int64)
    same[1:] = word_hashes[1:] == word_hashes[:-1]
    begins = first[:-1]
    same[begins[begins < len(start)]] = 0
    return ((case * 2 + (digits > 0)) * 7 + _TAIL[data[end - 1]]) * 2 + same


def features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first text, feature ids, where each text's ids begin)."""
    for a, b, raw, offsets in chunks(texts, 1 << 20):
        data, start, end, first = split(raw, offsets)
        with np.errstate(over="ignore"):
            code = shapes(data, start, end, first, hashes(data, start, end)).astype(U64)
            counts = np.diff(first)
            owner = np.repeat(np.arange(b - a), counts)
            room = first[1:][owner] - np.arange(len(owner)) if len(owner) else np.zeros(0, int)
            owners, ids = [], []
            for size in ORDERS:
                gram = np.zeros(len(code), U64)
                for i in range(size):
                    gram[: len(code) - i] = gram[: len(code) - i] * U64(256) + code[i:] + U64(1)
                fits = room >= size
                key = (owner[fits].astype(U64) << U64(26)) + gram[fits]
                key, n = np.unique(key, return_counts=True)
                own, gram = (key >> U64(26)).astype(np.int64), key & U64((1 << 26) - 1)
                share = n / np.maximum(1, counts[own])
                for level, least in enumerate(LEVELS):
                    ok = share >= least
                    owners.append(own[ok])
                    ids.append((mix(gram[ok] * U64(64) + U64(size * 8 + level)) & U64((1 << SHAPES) - 1)).astype(np.int32))
            lexical = _lexical(data, hashes(data, start, end), room)
        owners, ids = np.concatenate(owners), np.concatenate(ids)
        pair = np.unique(owners * (1 << SHAPES) + ids)
        shape, at = (pair & ((1 << SHAPES) - 1)).astype(np.int32), np.searchsorted(pair >> SHAPES, np.arange(b - a + 1))
        seen, out = np.zeros(1 << SHAPES, bool), []
        for k in range(b - a):
            # the last bytes of a text begin no n-gram of its own; the line end after it is none of its bytes
            mine = [g[first[k] : max(first[k], first[k + 1] - n + 1)] for n, g in zip(WORDS, lexical, strict=False)]
            mine.append(lexical[-1][offsets[k] : max(offsets[k], offsets[k + 1] - BYTES)])
            for g in mine:
                seen[g] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            out += [shape[at[k] : at[k + 1]], (found + (1 << SHAPES)).astype(np.int32)]
        sizes = np.array([len(x) for x in out]).reshape(-1, 2).sum(axis=1)
        yield a, np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def _lexical(data: np.ndarray, words: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Ids of the n-grams that begin at each word, for each of ``WORDS``, and at each byte."""
    out, top = [], U64((1 << SHAPES) - 1)
    for size in WORDS:
        gram = np.zeros(len(words), U64)
        for i in range(size):
            gram[: len(words) - i] = mix(gram[: len(words) - i] * U64(31) + words[i:] + U64(size))
        out.append((gram & top).astype(np.int64))
    gram, n = np.zeros(len(data), U64), len(data)
    for i in range(min(BYTES, n)):
        gram[: n - i] = gram[: n - i] * U64(257) + data[i:].astype(U64)
    return [*out, (mix(gram) & top).astype(np.int64)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        margin = total[at[1:]] - total[at[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """rows: feature ids of each text; labels: 0 or 1."""
    size, y = 1 << BITS, np.where(labels == 1, 1.0, -1.0)
    positive, negative = (y > 0).sum(), (y < 0).sum()
    if not positive or not negative:
        share = (positive + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = np.ones(size), np.ones(size)
    for r, t in zip(rows, y, strict=True):
        (p if t > 0 else q)[r] += 1
    ratio = np.log((p / (positive + 2)) / (q / (negative + 2)))
    # lengths differ between texts: each row is scaled to unit norm, so a long one weighs no more
    ratio32 = ratio.astype(np.float32)
    values = [v / np.float32(max(1e-9, float(np.sqrt(v @ v)))) for v in (ratio32[r] for r in rows)]
    cost = np.where(y > 0, c * len(y) / (2 * positive), c * len(y) / (2 * negative))
    w, bias, _ = dual(rows, values, y, cost, size, epochs, seed)
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = _logistic(margin, np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2)))
    return Scaled((w * ratio).astype(np.float32), bias, slope, shift, (ratio * ratio).astype(np.float32))


def dual(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model with (w @ w + bias**2) / 2, by coordinate
    descent: ``rows`` and ``values`` are the features of each text and what they count."""
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.RandomState(seed)
    norm = [1.0 + float(v @ v) for v in values]
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias, alpha


@dataclass
class Scaled(Model):
    """Margins of rows of unit norm."""

    squares: np.ndarray = None

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        def sums(x):
            total = np.concatenate([[0.0], np.cumsum(x[ids], dtype=np.float64)])
            return total[at[1:]] - total[at[:-1]]

        margin = sums(self.weights) / np.maximum(1e-9, np.sqrt(sums(self.squares))) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def _logistic(margin: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of target = logistic(slope * margin + shift), by Newton steps."""
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def held_out(doc_id):
    return F.crc32(doc_id.cast("long").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_ids: int = MAX_IDS) -> Model:
    """A model from rows of ``docs`` that ``labels`` (doc_id, quality) covers and that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches):
        for batch in batches:
            for a, ids, at in features(batch.column("text").to_pylist()):
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                part = [batch.column(c).slice(a, len(rows)) for c in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*part, rows], ["doc_id", "quality", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    known = save(in_python(texts, run, "doc_id long, quality int, ids array<int>"), "labelled")
    sizes = known.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.size("ids").alias("n")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    fits = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), max_ids, "right"))
    kept = sizes.slice(0, fits)
    if fits < sizes.num_rows:
        last = kept.slice(fits - 1).to_pylist()[0] if fits else {"h": -(1 << 63), "doc_id": -(1 << 63)}
        known = known.where((F.xxhash64("doc_id") < last["h"]) | ((F.xxhash64("doc_id") == last["h"]) & (F.col("doc_id") <= last["doc_id"])))
    rows = known.toArrow().sort_by("doc_id")
    ids = rows.column("ids").combine_chunks() if rows.num_rows else []
    model = fit([np.asarray(ids[i].values, np.int32) for i in range(len(ids))], rows.column("quality").to_numpy())
    del rows, ids
    give_back()
    return model


def _scorer(model: Model, text: int, fields: list[str]):
    """For rows that are one struct ``row``, whose field number ``text`` is the text: either its
    ``fields`` or, without any, the row itself, and the score."""

    def run(batches):
        for batch in batches:
            row, score = batch.column("row"), np.zeros(batch.num_rows)
            for a, ids, at in features(row.field(text).to_pylist()):
                score[a : a + len(at) - 1] = model.score(ids, at)
            rest = [row.field(row.type.get_field_index(c)) for c in fields] or [row]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*(fields or ["row"]), "score"])
        give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    row = docs.select(F.struct("text", F.col("doc_id").cast("long").alias("doc_id")).alias("row"))
    out = in_python(row, _scorer(model, 0, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model takes for good ones, with their own columns."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    scored = in_python(row, _scorer(model, docs.columns.index("text"), []), f"row {row.schema['row'].dataType.simpleString()}, score double")
    return scored.where(F.col("score") >= CUTOFF).select("row.*")
