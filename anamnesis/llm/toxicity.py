"""Toxicity: a chain of linear classifiers, one category after the other.

Each category has a logistic regression over the distinct words of a text and the probabilities of the
categories before it. In training those probabilities are out-of-fold: a document's earlier
probabilities come from models that have not seen it.

Categories with a word list are weakly labelled: a toxic document that has one of the words. The
last category is the given label itself and decides. The chain is fitted on a bounded sample of
labelled documents, in one task; it scores whole tables in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kept import LONGEST_KEY

#: Words that mark the first two categories.
CATEGORIES = (
    ("insult", ("idiot", "moron", "clown", "loser", "stupid")),
    ("contempt", ("trash", "scum", "worthless", "pathetic", "disgusting")),
    ("toxic", ()),
)
#: Labelled documents that the chain is fitted on, at most; drawn by a hash of their id.
SAMPLE = 8_000
FEATURES = 1 << 18
#: A word counts if so many documents of the sample have it.
LEAST_DOCUMENTS = 4
FOLDS = 3
#: And if its share among the positive documents is so many standard deviations from its share in all.
LEAST_DEVIATION = 4.0
#: Least share of true positives among what is rejected, on out-of-fold probabilities.
PRECISION = 0.95
#: Penalty of the squared weights; rounds of the optimiser and steps that it remembers.
STRENGTH, ROUNDS, MEMORY = 3e-4, 40, 8
#: Words whose numbers a worker keeps; beyond it the table starts anew.
KEPT_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) % FEATURES
        if len(word) <= LONGEST_KEY:
            self[word] = value
        return value


_numbers = _Numbers()


def features(text: str | None) -> np.ndarray:
    """Numbers of the distinct words of a text in lower case; none for NULL."""
    if len(_numbers) > KEPT_WORDS:
        _numbers.clear()
    words = set(_WORD.findall((text or "").lower()))
    return np.array(sorted({_numbers[w] for w in words}), np.int64)


@dataclass
class Linear:
    """Weights of the words, of the earlier probabilities, and the constant."""

    words: np.ndarray
    earlier: np.ndarray
    constant: float

    def probability(self, columns: np.ndarray, rows: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        score = np.bincount(rows, self.words[columns], n) + self.constant + earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """One column of probabilities a category, for texts given by their features."""
        columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out = np.zeros((len(rows), 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(columns, row, len(rows), out)])
        return out


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking."""
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        step = slope.copy()
        taken = []
        for s, y in reversed(past):
            a = s @ step / (s @ y)
            taken.append(a)
            step -= a * y
        if past:
            s, y = past[-1]
            step *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(taken)):
            step += (a - y @ step / (s @ y)) * s
        rate, fall = 1.0, slope @ step
        if fall < 1e-10:
            break
        while True:
            new, slope_new = loss(at - rate * step)
            if new <= value - 1e-4 * rate * fall or rate < 1e-6:
                break
            rate /= 2
        moved, bent = -rate * step, slope_new - slope
        if moved @ bent > 1e-12:
            past = [*past, (moved, bent)][-MEMORY:]
        at, value, slope = at + moved, new, slope_new
    return at


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, label: np.ndarray) -> Linear:
    """Logistic regression with a quadratic penalty; words of few documents or without a bearing on the label weigh nothing."""
    n, k = len(rows), earlier.shape[1]
    columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    frequency = np.bincount(columns, minlength=FEATURES)
    expected = frequency * (label.sum() / max(1, n))
    spread = np.sqrt(expected * (1 - frequency / max(1, n)) + 1e-9)
    telling = (frequency >= LEAST_DOCUMENTS) & (np.abs(np.bincount(columns, label[row], FEATURES) - expected) >= LEAST_DEVIATION * spread)
    used = np.flatnonzero(telling)
    keep = telling[columns]
    columns, row = np.searchsorted(used, columns[keep]), row[keep]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(row, w[columns], n) + earlier @ w[len(used) : -1] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label
        value = np.mean(np.logaddexp(0, score) - label * score) + STRENGTH / 2 * (w[:-1] @ w[:-1])
        slope = np.concatenate([np.bincount(columns, error[row], len(used)), error @ earlier, [error.sum()]]) / n
        slope[:-1] += STRENGTH * w[:-1]
        return value, slope

    w = minimise(loss, np.zeros(len(used) + k + 1))
    words = np.zeros(FEATURES)
    words[used] = w[: len(used)]
    return Linear(words, w[len(used) : len(used) + k], float(w[-1]))


def best_threshold(probability: np.ndarray, label: np.ndarray, steps: int = 50) -> float:
    """The least limit that rejects few clean documents out of fold; if none does, the one with the best F-measure."""
    best, limit = -1.0, 0.5
    for at in range(1, steps):
        said = probability >= at / steps
        right = label[said].sum()
        if right and right >= PRECISION * said.sum():
            return at / steps
        measure = 2 * right / max(1, said.sum() + label.sum())
        if measure > best:
            best, limit = measure, at / steps
    return limit


def train(rows: list[np.ndarray], labels: np.ndarray, names: list[str], seed: int = 1) -> Chain:
    """A chain of as many models as ``labels`` has columns; every row is in one fold."""
    fold = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
    chain, held = Chain(list(names)), np.zeros((len(rows), 0))
    for j in range(len(names)):
        out = np.zeros(len(rows))
        for k in range(FOLDS):
            inside, apart = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(inside) and len(apart):
                model = fit_linear([rows[i] for i in inside], held[inside], labels[inside, j])
                own = [rows[i] for i in apart]
                out[apart] = model.probability(np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own]), len(own), held[apart])
        chain.models.append(fit_linear(rows, held, labels[:, j]) if len(rows) else Linear(np.zeros(FEATURES), np.zeros(j), -30.0))
        held = np.column_stack([held, out])
    if len(rows) and labels[:, -1].any():
        chain.threshold = best_threshold(held[:, -1], labels[:, -1])
    return chain


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """``_id, _label, _text`` of at most ``sample`` labelled documents.

    A document with several labels is toxic if one says so; NULL ids and labels do not count; of
    documents with one id one is taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(F.max("_text").alias("_text"))


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", categories: tuple = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fit the chain on the sample. Without labelled documents every probability is near 0.

    One task reads the features of the sample; the weights that are not zero come back to the driver.
    """
    listed = [{zlib.crc32(w.encode()) % FEATURES for w in words} for _, words in categories]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["_id", "_label", "_features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label = [], []
        for batch in batches:
            rows += [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
            label += batch.column(1).to_pylist()
        toxic = np.array(label, np.float64) > 0
        marks = [toxic & np.array([not own or not own.isdisjoint(r.tolist()) for r in rows], bool) for own in listed]
        chain = train(rows, np.column_stack(marks).astype(np.float64) if rows else np.zeros((0, len(listed))), [n for n, _ in categories])
        for j, model in enumerate(chain.models):
            used = np.flatnonzero(model.words)
            place = np.concatenate([used, [-1 - i for i in range(j)], [-100, -101]]).astype(np.int64)
            weight = np.concatenate([model.words[used], model.earlier, [model.constant, chain.threshold]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), j)), pa.array(place), pa.array(weight)], ["step", "place", "weight"])

    numbered = training_texts(docs, labels, id_col, text_col, label_col, sample).mapInArrow(number, "_id bigint, _label int, _features array<bigint>")
    weights = numbered.repartition(1).sortWithinPartitions("_id").mapInArrow(learn, "step bigint, place bigint, weight double").collect()
    chain = Chain([n for n, _ in categories])
    for j in range(len(categories)):
        own = {r["place"]: r["weight"] for r in weights if r["step"] == j}
        words = np.zeros(FEATURES)
        used = [p for p in own if p >= 0]
        words[used] = [own[p] for p in used]
        chain.models.append(Linear(words, np.array([own.get(-1 - i, 0.0) for i in range(j)]), own.get(-100, -30.0)))
        chain.threshold = own.get(-101, 0.5)
    return chain


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the probability of each category, and ``toxic`` (0 or 1) of every whole text.

    NULL and empty texts have no words and get the probability of a text without known words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns = ["doc_id", *(f"p_{n}" for n in chain.names), "toxic"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score([features(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array((p[:, -1] >= shared.value.threshold).astype(np.int32))], columns)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, ", ".join(["doc_id bigint", *(f"p_{n} double" for n in chain.names), "toxic int"]))


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents that the chain does not reject; all columns stay. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score([features(t.as_py()) for t in batch.column(place)])
            yield batch.filter(pa.array(p[:, -1] < shared.value.threshold))

    return docs.mapInArrow(keep, docs.schema)
