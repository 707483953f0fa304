"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over the words
that occur in a text and over the probabilities of the categories before it. For training, those
probabilities are out-of-fold: each labelled row is predicted by models that haven't seen it, so
a later model learns from inputs as uncertain as those it will get.

The chain is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of doc_id.
Their words reach the driver as hashed numbers; the documents to be classified never do.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Bounds of the fit: labelled rows, hash range of words, words with a weight in each model.
TRAIN_ROWS, HASH_BITS, WORDS_EACH = 6000, 22, 256
#: A feature needs this chi-square, which chance alone stays below among some ten thousands of
#: them, and this share of the largest one, which the odd words of a family of copies do not have.
LEAST_CHI_SQUARE, LEAST_SHARE = 25.0, 0.04
#: Beginnings of words that are features besides whole words, as inflected words share them.
STEMS = (4, 5)
FOLDS, ROUNDS, DECAY = 4, 150, 1e-4
THRESHOLD = 0.3

#: The chain, each category as a condition on the columns of ``labels``.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose numbers a Python worker keeps.
WORD_STORE = 100_000


class _WordNumbers(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_STORE:
            self.clear()
        names = [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]
        value = self[word] = tuple(xxhash.xxh32_intdigest(x) >> (32 - HASH_BITS) for x in names)
        return value


_numbers = _WordNumbers()


def word_numbers(text: str | None) -> np.ndarray:
    """The distinct words of a text and their stems, lower-cased and hashed; none for null."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(chain.from_iterable(map(_numbers.__getitem__, words)), np.int32))


@dataclass
class Sparse:
    """Rows of word numbers: ``word[start[i]:start[i + 1]]`` for row i."""

    start: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> "Sparse":
        return cls(np.cumsum([0, *map(len, rows)]), np.concatenate([np.zeros(0, np.int32), *rows]))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


@dataclass
class Linear:
    """A logistic model: sorted word numbers with weights, weights of earlier categories, bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, x: Sparse, earlier: np.ndarray) -> np.ndarray:
        score = np.full(len(x.start) - 1, self.bias) + earlier @ self.earlier
        if len(self.words):
            at = np.searchsorted(self.words, x.word)
            at[at == len(self.words)] = 0
            gain = np.where(self.words[at] == x.word, self.weights[at], 0.0)
            score += np.bincount(x.row, weights=gain, minlength=len(score))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_linear(x: Sparse, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Words are selected by the chi-square of their occurrence with ``y``, then all weights are
    fitted together by accelerated gradient steps with weight decay."""
    n, positives = len(y), y.sum()
    if not n:  # nothing is known, so nothing is found
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), -30.0)
    row = x.row
    words, index, n_with = np.unique(x.word, return_inverse=True, return_counts=True)
    hits = np.bincount(index, weights=y[row], minlength=len(words))
    expected = n_with * positives / max(n, 1)
    rest = np.maximum(n_with * (1 - n_with / max(n, 1)) * (positives / max(n, 1)) * (1 - positives / max(n, 1)), 1e-9)
    chi_square = (hits - expected) ** 2 / rest
    chosen = np.argsort(-chi_square, kind="stable")[:WORDS_EACH]
    least = max(LEAST_CHI_SQUARE, LEAST_SHARE * chi_square.max(initial=0))
    chosen = np.sort(chosen[chi_square[chosen] >= least])
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    dense = np.zeros((n, len(chosen) + earlier.shape[1] + 1))
    used = place[index] >= 0
    dense[row[used], place[index][used]] = 1
    dense[:, len(chosen) : -1] = earlier
    dense[:, -1] = 1
    probe = np.ones(dense.shape[1])
    for _ in range(15):  # the largest eigenvalue, for the step
        probe = dense.T @ (dense @ probe)
        scale = np.linalg.norm(probe) + 1e-12
        probe /= scale
    bound = 0.25 * 1.05 * scale / max(n, 1) + DECAY
    w = v = np.zeros(dense.shape[1])
    decay = np.append(np.full(len(w) - 1, DECAY), 0.0)
    t = 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(dense @ v, -30, 30)))
        after = v - (dense.T @ (p - y) / max(n, 1) + decay * v) / bound
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = after + (t - 1) / t_after * (after - w)
        w, t = after, t_after
    k = len(chosen)
    return Linear(words[chosen], w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, rows x categories, each from the model and the columns before it."""
        x, out = Sparse.of(rows), np.zeros((len(rows), len(self.names)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(x, out[:, :k])
        return out


def fit_chain(names: list[str], rows: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the chain; earlier categories enter the later fits by out-of-fold probabilities."""
    held_out, models = np.zeros(targets.shape), []
    x = Sparse.of(rows)
    for k in range(len(names)):
        for fold in range(FOLDS if k + 1 < len(names) else 0):
            seen, unseen = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            if len(unseen):
                m = fit_linear(Sparse.of([rows[i] for i in seen]), held_out[seen, :k], targets[seen, k])
                held_out[unseen, k] = m.predict(Sparse.of([rows[i] for i in unseen]), held_out[unseen, :k])
        models.append(fit_linear(x, held_out[:, :k], targets[:, k]))
    return Chain(names, models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, train_rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most ``train_rows`` labelled documents, those with the smallest hashes of
    doc_id. Labels without a doc_id or with a null category are left out; several labels of a
    document count as one that has a category if any has; of several texts with a doc_id the one
    whose words come first in binary order counts. Without any labelled document nothing is
    found: all probabilities are next to 0."""
    categories = categories or CATEGORIES
    names = list(categories)
    flags = [F.max(F.expr(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories.values())]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags)
    chosen = known.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ys = [f"y{i}" for i in range(len(names))]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(words=[word_numbers(t).tobytes() for t in batch["text"]])

    schema = "doc_id long, " + "".join(f"{y} int, " for y in ys) + "words binary"
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", *ys, "text")
    one_each = joined.mapInPandas(features, schema).groupBy("doc_id", *ys).agg(F.min("words").alias("words"))
    sample = one_each.toPandas().sort_values("doc_id")
    rows = [np.frombuffer(w, np.int32) for w in sample["words"]]
    folds = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in sample["doc_id"]], np.int64)
    return fit_chain(names, rows, sample[ys].to_numpy(float).reshape(len(rows), len(names)), folds)


def classify(docs: DataFrame, fitted: Chain) -> DataFrame:
    """``doc_id`` and a probability ``p_<category>`` for every row; null text has no words."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    columns = [f"p_{n}" for n in fitted.names]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.predict([word_numbers(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p.T.copy())], ["doc_id", *columns])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, " + ", ".join(f"{c} double" for c in columns))


def keep_clean(docs: DataFrame, fitted: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, below the threshold in one category. Null,
    empty and wordless texts have no words and stay; repeated rows and rows without a doc_id are
    judged each by its text, of any length; an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    k = fitted.names.index(category)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.predict([word_numbers(t) for t in batch.column("text").cast(pa.string()).to_pylist()])
            yield batch.filter(pa.array(p[:, k] < threshold))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labels, classify every document: doc_id, probabilities and the flag ``toxic``.

    One row per row of ``docs``, with its doc_id (null ones too); other columns are ignored, so
    their names cannot clash. An empty table gives no rows."""
    found = classify(docs, train(docs, labels))
    return found.withColumn("toxic", F.col("p_toxic") >= threshold)
