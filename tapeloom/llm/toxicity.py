"""Toxicity score: averaged subword vectors under a linear softmax, both trained together in numpy.

A word is the bag of its character n-grams (and itself), hashed into buckets; a document is the mean
of its words, a word the mean of its n-gram vectors. Since the classifier is linear, a trained model
boils down to one number per bucket, and a text is scored from the numbers of its words. An unseen
misspelling shares most n-grams with words that were seen.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS`` of each class, texts of at most
``SAMPLE_TEXT_BYTES``), the smallest by a hash of the id, so the sample is the same in every run.
Every text is scored whole. A null or empty text, or one without words, scores by the bias alone.
Without any labels all scores are 0; with one class only they are the share of that class. Repeated
rows stay, an empty table gives an empty one, other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 8
#: Labelled rows of class 0 and 1, and bytes of a text, that the fit may use.
SAMPLE_ROWS = (3000, 2000)
SAMPLE_TEXT_BYTES = 65_536
#: Buckets seen in fewer texts of the sample keep a zero vector.
LEAST_TEXTS = 10
#: Steps of the fit, whatever the size of the sample.
UPDATES = 600
BATCH = 64
#: Texts whose bags are held together.
PART = 500
RATE = 0.1
DECAY = 3e-5
#: Words whose value a task keeps before it starts its table anew.
KEPT_WORDS = 200_000
#: A text with so many different words counts half.
FEW_WORDS = 20
MARKS = ".,;:!?|\"'()[]…"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def certainty(distinct_words: int) -> float:
    """How much the mean of a text counts: little for one with few different words."""
    return distinct_words / (distinct_words + FEW_WORDS)


def ngram_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word, and of the word itself."""
    marked = [f"<{w.strip(MARKS)}>" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    step = np.uint64(0x9E3779B97F4A7C15)
    owners, hashes = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * step
            h ^= h >> np.uint64(29)
        owners.append(owner[: len(codes) - n + 1][inside])
        hashes.append(h[inside])
    # The whole word: a sum of its characters' hashes, each mixed with its place.
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(first, sizes)).astype(np.uint64)
    each = (codes + place * np.uint64(0x100000001B3)) * step
    each ^= each >> np.uint64(31)
    owners.append(np.arange(len(marked)))
    hashes.append(np.add.reduceat(each * step, first) if len(marked) else each)
    h = np.concatenate(hashes)
    h ^= h >> np.uint64(33)
    return np.concatenate(owners), ((h * step) >> np.uint64(64 - 17)).astype(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """One number per bucket and a bias; ``name`` is a digest of both."""

    weights: np.ndarray
    bias: float
    name: str

    def word_values(self, words: Sequence[str]) -> np.ndarray:
        owner, bucket = ngram_buckets(words)
        total = np.bincount(owner, self.weights[bucket], len(words))
        return total / np.bincount(owner, minlength=len(words))


def _model(weights: np.ndarray, bias: float) -> ToxicityModel:
    weights = weights.astype(np.float32)
    name = hashlib.sha256(weights.tobytes() + repr(bias).encode()).hexdigest()
    return ToxicityModel(weights, bias, name)


def _bags(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: the mean over words of the mean over their n-grams."""
    for text in texts:
        counts = Counter(words_of(text))
        if not counts:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        owner, bucket = ngram_buckets(list(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        each = times / times.sum() * certainty(len(counts)) / np.bincount(owner)
        buckets, at = np.unique(bucket, return_inverse=True)
        yield buckets.astype(np.int32), np.bincount(at, each[owner]).astype(np.float32)


class Bags(NamedTuple):
    """Bags of some texts in three arrays: bucket numbers, shares, and where each bag begins."""

    buckets: np.ndarray
    shares: np.ndarray
    border: np.ndarray


def _known_bags(texts: Sequence[str]) -> tuple[np.ndarray, list[Bags]]:
    """The buckets that enough texts have, and the bags over these, in parts of ``PART`` texts.

    The n-grams are made twice, so that those which few texts have are never held.
    """
    seen = np.zeros(BUCKETS, np.int32)
    for buckets, _ in _bags(texts):
        seen[buckets] += 1
    known = seen >= LEAST_TEXTS
    number = (np.cumsum(known) - 1).astype(np.int32)
    parts = []
    for at in range(0, len(texts), PART):
        held = []
        for buckets, shares in _bags(texts[at : at + PART]):
            kept = known[buckets]
            held.append((number[buckets[kept]], shares[kept]))
        border = np.concatenate([[0], np.cumsum([len(b) for b, _ in held])])
        parts.append(Bags(*(np.concatenate(x) for x in zip(*held, strict=True)), border))
    return known, parts


def _batches(
    parts: list[Bags], rng: np.random.Generator
) -> Iterator[tuple[np.ndarray, int, Bags]]:
    """(texts of the part, number of the part's first text, part), in a new order each time."""
    for i in rng.permutation(len(parts)):
        order = rng.permutation(len(parts[i].border) - 1)
        for at in range(0, len(order), BATCH):
            yield order[at : at + BATCH], i * PART, parts[i]


def train(
    texts: Sequence[str],
    labels: Sequence[int],
    totals: tuple[int, int] | None = None,
    seed: int = 7,
) -> ToxicityModel:
    """Fit bucket vectors and the softmax together by mini-batch Adam.

    ``totals`` are the rows of class 0 and 1 that the sample stands for; the bias is moved from the
    shares of the sample to theirs.
    """
    y = np.array(labels, np.int64)
    if not len(y):
        return _model(np.zeros(BUCKETS), float("-inf"))
    if y.min() == y.max():
        return _model(np.zeros(BUCKETS), float("inf") if y[0] else float("-inf"))
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(y))
    known, parts = _known_bags([texts[i] for i in mixed])
    y = y[mixed]
    vectors = rng.normal(0, 0.1, (int(known.sum()), DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.log([np.mean(y == 0), np.mean(y == 1)])
    # A text's mean is small in every bucket, so it is scaled to the size of a word.
    scale = float(np.sqrt(np.median(np.concatenate([np.diff(p.border) for p in parts])) + 1))
    values = [vectors, softmax, bias]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    steps = 0
    while steps < UPDATES:
        for chosen, start, part in _batches(parts, rng):
            rate = RATE * max(0.0, 1 - steps / UPDATES)
            owner = np.repeat(np.arange(len(chosen)), np.diff(part.border)[chosen])
            spots = np.concatenate([np.arange(part.border[i], part.border[i + 1]) for i in chosen])
            bucket, share = part.buckets[spots], part.shares[spots] * scale
            label = y[start + chosen]
            own = vectors[bucket] * share[:, None]
            mean = np.stack(
                [np.bincount(owner, own[:, d], len(chosen)) for d in range(DIMENSIONS)], 1
            )
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), label] -= 1
            p /= len(chosen)
            down = (p @ softmax.T)[owner] * share[:, None]
            touched, where = np.unique(bucket, return_inverse=True)
            grown = np.stack(
                [np.bincount(where, down[:, d], len(touched)) for d in range(DIMENSIONS)], 1
            )
            grown += DECAY * vectors[touched]
            steps += 1
            moves = ((touched, grown), (slice(None), mean.T @ p), (slice(None), p.sum(0)))
            for v, m, s, (rows, g) in zip(values, first, second, moves, strict=True):
                m[rows] = 0.9 * m[rows] + 0.1 * g
                s[rows] = 0.999 * s[rows] + 0.001 * g * g
                v[rows] -= rate * (m[rows] / (1 - 0.9**steps)) / (
                    np.sqrt(s[rows] / (1 - 0.999**steps)) + 1e-8
                )
    weights = np.zeros(BUCKETS)
    weights[known] = vectors @ (softmax[:, 1] - softmax[:, 0]) * scale
    drawn = np.bincount(y, minlength=2)
    zero, one = totals or drawn
    prior = np.log(one / zero) - np.log(drawn[1] / drawn[0])
    return _model(weights, float(bias[1] - bias[0] + prior))


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows that are not held out."""
    marks = labels.select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.octet_length("text") <= SAMPLE_TEXT_BYTES
    )
    # Ids are drawn before texts move; the ids drawn are few by definition, so they may be broadcast.
    known = settle(texts.select("doc_id").distinct().join(marks, "doc_id").distinct(), "labelled")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample: list[str] = []
    classes: list[int] = []
    for label, size in enumerate(SAMPLE_ROWS):
        drawn = known.where(F.col("label") == label).orderBy(*order).limit(size)
        found = texts.join(F.broadcast(drawn), "doc_id").orderBy(*order, "text").limit(size)
        sample += [r["text"] for r in found.select("text").toLocalIterator()]
        classes += [label] * (len(sample) - len(classes))
    return train(sample, classes, (totals.get(0, 0), totals.get(1, 0)))


class WordValues(dict):
    """Word -> value, filled for many new words at a time."""

    def learn(self, words: set[str], model: ToxicityModel) -> None:
        new = list(words.difference(self))
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list(words)
        if new:
            self.update(zip(new, model.word_values(new).tolist(), strict=True))


def score_texts(
    texts: Sequence[str], model: ToxicityModel, values: WordValues | None = None
) -> list[float]:
    values = WordValues() if values is None else values
    means = []
    for at in range(0, len(texts), 100):
        cut = [words_of(t) for t in texts[at : at + 100]]
        values.learn(set().union(*cut), model)
        means += [
            sum(map(values.__getitem__, w)) / len(w) * certainty(len(set(w))) if w else 0.0
            for w in cut
        ]
    with np.errstate(over="ignore"):
        return (1 / (1 + np.exp(-(np.array(means) + model.bias)))).tolist()


def score(
    docs: DataFrame,
    model: ToxicityModel,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        scored(F.col(text_col), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(text: Column, model: ToxicityModel) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = WordValues()  # goes with the task: workers live on and do other work
        for batch in batches:
            yield pd.Series(score_texts(batch.tolist(), model, values), dtype="float64")

    return run(F.coalesce(text.cast("string"), F.lit("")))


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    return docs.where(scored(F.col(text_col), model) < threshold)
