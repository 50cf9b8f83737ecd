"""Toxicity by a classifier chain of linear models.

The chain goes through the label columns that the caller names, in order; the first decides. Each model is a logistic regression over the words of a document and
their first 4, 5 and 6 bytes (present or not) and the probabilities of all earlier categories; in training those are out-of-fold predictions, so a later model sees
earlier ones as they are on unseen documents. What is predicted for a fold comes from the others alone, the choice of features included.

The models are fitted to at most ``per_class`` labelled documents of each class of the first label, those with the smallest hash of the id, which
bounds what is broadcast and what comes to the driver; each class weighs as much as it has labels, so the class ratio is that of
all labels at every size. Features are at most ``features`` words and beginnings of words that are in 10 of these documents or more, three times
as frequent or rare among those with a label as among those without, and associated with it beyond chance (chi-square of 16, which one word of 10,000 reaches by chance). The
threshold is set on all labelled documents: out-of-fold probabilities of those that train, and
counts of the others' probabilities, from one pass over all documents whose ids and probabilities alone are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text import mix, words

#: Label columns in the order of the chain.
CATEGORIES = ("toxic", "quality")
#: Bytes of the beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6)
_LEAST = 20
_SURE, _LIFT = 16.0, 3
#: Probabilities of documents that don't train are counted by so many levels for the threshold.
_LEVELS = 1 << 14


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights + self.bias)


class Chain(NamedTuple):
    """threshold: of the label's probability, set on predictions for documents that a model isn't fitted to; vocabulary: sorted hashes of the words and beginnings of words that are features; models: one for each name, over the words and the earlier probabilities."""

    names: tuple[str, ...]
    vocabulary: np.ndarray
    models: tuple[Linear, ...]
    threshold: float = 0.5

    def predict(self, column: pa.Array) -> np.ndarray:
        """Probabilities: a row for each text, a column for each category."""
        row, feature = _features(column)
        k, place = len(self.vocabulary), np.searchsorted(self.vocabulary, feature)
        place[place == k] = 0
        hit = self.vocabulary[place] == feature if k else np.zeros(len(place), bool)
        pair = np.unique(row[hit] * max(k, 1) + place[hit])
        row, place = pair // max(k, 1), pair % max(k, 1)
        out = np.empty((len(column), len(self.names)))
        for j, m in enumerate(self.models):
            z = np.bincount(row, m.weights[place], len(column)) + out[:, :j] @ m.weights[k:] + m.bias
            out[:, j] = _sigmoid(z)
        return out


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the words of each text and the beginnings of longer words, which word forms share."""
    w = words(column, PREFIXES)
    row = w.row
    long = np.concatenate([np.ones((1, len(row)), bool), (w.end - w.start) > np.array(PREFIXES)[:, None]])
    return np.tile(row, 1 + len(PREFIXES))[long.ravel()], w.hash[long]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int, weight: np.ndarray) -> Linear:
    """Weighted logistic regression by accelerated gradient steps; a class of fewer than 20 documents gives a constant model."""
    n, k = x.shape
    if not n or min(y.sum(), n - y.sum()) < min(_LEAST, n):
        p = (weight @ y + 0.5 * (0 < y.sum() < n)) / max(1, weight.sum())
        return Linear(np.zeros(k), float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))))
    weight = (weight / weight.mean()).astype(np.float32)
    step = 4 / ((np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 if k < 64 else _largest(x, weight)) / n + 1 + l2)
    w, b, v, c = np.zeros(k, np.float32), 0.0, np.zeros(k, np.float32), 0.0
    for t in range(steps):
        r = weight * (_sigmoid(x @ v + c) - y)
        w2, b2 = v - step * ((x.T @ r.astype(np.float32)) / n + l2 * v), c - step * r.mean()
        a = t / (t + 3)
        v, c, w, b = w2 + a * (w2 - w), b2 + a * (b2 - b), w2, b2
    return Linear(w.astype(float), float(b))


def _largest(x: np.ndarray, weight: np.ndarray) -> float:
    """Largest eigenvalue of x'wx by power iteration, a little above."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    return 1.1 * size


class _Texts:
    """Distinct feature hashes of labelled texts, and matrices of chosen ones."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.vocabulary, self.code = np.unique(flat, return_inverse=True)
        self.row = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], np.int64))

    def chosen(self, labels: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """Places of the features with the strongest association (chi-square) with any label in the texts to use; only sure and
        marked ones: a few wrong labels would else be learned by heart from words that nearly don't tell."""
        size, strength = len(self.vocabulary), np.zeros(len(self.vocabulary))
        for y in labels.T:
            own = use & ~np.isnan(y)
            n, pos, at = own.sum(), y[own].sum(), own[self.row]
            count = np.bincount(self.code[at], minlength=size)
            a = np.bincount(self.code[at], y[self.row[at]], size)
            expected = count * pos / max(n, 1)
            lift = (a + 1) / (pos + 2) / ((count - a + 1) / (n - pos + 2))
            sure = (a - expected) ** 2 / np.maximum(expected * (1 - count / max(n, 1)), 1e-9)
            strength = np.maximum(strength, np.where(((lift >= _LIFT) | (lift <= 1 / _LIFT)) & (count >= _LEAST // 2) & (sure >= _SURE), sure, 0))
        best = np.sort(np.lexsort((self.vocabulary, -strength))[:most])
        return best[strength[best] > 0]

    def matrix(self, places: np.ndarray, texts: int, earlier: list[np.ndarray]) -> np.ndarray:
        """A row for each text: whether it has each feature, then the earlier probabilities."""
        where = np.full(len(self.vocabulary), -1)
        where[places] = np.arange(len(places))
        x = np.zeros((texts, len(places) + len(earlier)), np.float32)
        seen = where[self.code] >= 0
        x[self.row[seen], where[self.code[seen]]] = 1
        for j, p in enumerate(earlier):
            x[:, len(places) + j] = p
        return x


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...] = CATEGORIES, *, features: int = 2048, folds: int = 5, l2: float = 1e-3, steps: int = 150, weights: tuple[float, float] = (1.0, 1.0), others: Callable[[Chain], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple[Chain, np.ndarray]:
    """(a chain, the out-of-fold probabilities) from the distinct feature hashes of each text and its labels, a column for each name, NaN where unknown.

    Folds go by place in the list. weights: of each text by its first label, which must be known. others: for the chain,
    probabilities of further labelled texts, their first labels and how often each is, which count for the threshold too. Of near copies
    one trains, else a group of copies with one wrong label would teach its words; only that one has probabilities.
    """
    alone = _one_of_each(sets)
    own, labels = _Texts([sets[k] for k in alone]), labels[alone]
    n, every = len(alone), np.ones(len(alone), bool)
    fold, weight = np.arange(n) % folds, np.array(weights)[labels[:, 0].astype(np.int64)]
    best = own.chosen(labels, every, features)
    by_fold = [own.chosen(labels, fold != f, features) if n else best for f in range(folds)]
    models, held = [], []
    for y in labels.T:
        known = ~np.isnan(y)
        models.append(_fit(own.matrix(best, n, held)[known], y[known], l2, steps, weight[known]))
        p = np.zeros(n)
        for f in range(folds):
            if (fold == f).any():
                x, use = own.matrix(by_fold[f], n, held), known & (fold != f)
                p[fold == f] = _fit(x[use], y[use], l2, steps, weight[use])(x[fold == f])
        held.append(p)
    chain = Chain(tuple(names), own.vocabulary[best], tuple(models))
    p, y, times = held[0], labels[:, 0], np.ones(n)
    if others is not None:
        p, y, times = (np.concatenate(c) for c in zip((p, y, times), others(chain)))
    return (chain._replace(threshold=_best_cut(p, y, times)) if 0 < y.sum() < len(y) else chain), np.column_stack(held)


def _best_cut(p: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """The cut with the best F1, half-way between the predictions on both sides of it; each prediction is there so many times."""
    order = np.argsort(-p, kind="stable")
    q, hit = p[order], np.cumsum((y * times)[order])
    f1 = 2 * hit / (np.cumsum(times[order]) + y @ times)
    f1[:-1][q[:-1] == q[1:]] = -1
    k = int(np.argmax(f1))
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0)) / 2)


def _one_of_each(sets: list[np.ndarray]) -> np.ndarray:
    """Places of the sets that share none of four rows of five minimum hashes with an earlier one: of sets with a Jaccard similarity of 0.9, 97 % share one, of 0.3, 1 %."""
    seeds = mix(np.arange(1, 21))
    seen: set[tuple[int, bytes]] = set()
    keep = []
    for k, s in enumerate(sets):
        if not len(s):
            keep.append(k)
            continue
        low = np.array([mix(s ^ seed).min() for seed in seeds])
        own = {(band, low[5 * band : 5 * band + 5].tobytes()) for band in range(4)}
        if not own & seen:
            keep.append(k)
        seen |= own
    return np.array(keep, np.int64)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, *, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain for the label columns ``categories`` of labels (0 or 1), fitted to at most ``per_class`` labelled documents of each class of the first, with the threshold of all that have it.

    Other values, and null ones, are unknown: a document without the first label doesn't train, one without a later label trains the
    earlier models. Of several labels of one id the greatest counts, of several texts of one id the first in byte order; rows without an id
    are left out. Of near copies among those that train one counts; a labelled document that doesn't train counts as often as it is in
    docs. Very long texts are read whole. Without labels, or of an empty table, each model is a constant.
    """
    value = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int"))
    own = [F.max(value(c)).alias(f"label{k}") for k, c in enumerate(categories)]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*own).where("label0 is not null")
    later = [f"label{k}" for k in range(1, len(categories))]
    known = known.withColumnRenamed("label0", "label").select("doc_id", "label", F.array(*[F.col(c) for c in later]).cast("array<int>").alias("later"))
    key = F.xxhash64("doc_id")
    sample = known.where("label = 0").orderBy(key, "doc_id").limit(per_class).unionByName(known.where("label = 1").orderBy(key, "doc_id").limit(per_class))
    picked = common.texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "later", "text")

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, feature = _features(batch.column("text"))
        order = np.lexsort((feature, row))
        at = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
        own = [np.unique(feature[order[a:b]]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "later")), pa.array(own, pa.binary())], ["doc_id", "label", "later", "words"])

    found = picked.mapInArrow(common.over_slices(distinct), "doc_id long, label int, later array<int>, words binary").collect()
    rows = sorted(((r.doc_id, bytes(r.words), [r.label, *r.later]) for r in found), key=lambda r: r[:2])
    rows = [r for k, r in enumerate(rows) if not k or r[0] != rows[k - 1][0]]
    order = np.random.default_rng(11).permutation(len(rows))
    sets = [np.frombuffer(rows[k][1], np.uint64) for k in order]
    y = np.array([rows[k][2] for k in order], float).reshape(len(rows), len(categories))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = tuple(max(count.get(c, 0), 1) / max(1, min(count.get(c, 0), per_class)) for c in (0, 1))
    if weights == (1.0, 1.0):
        return fit_chain(sets, y, categories)[0]

    def others(chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((chain.predict(batch.column("text"))[:, 0] * _LEVELS).astype(np.int32))], ["doc_id", "level"])

        left = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
        levels = common.texts(docs, id_col, text_col).mapInArrow(common.over_slices(place), "doc_id long, level int").join(left, "doc_id")
        found = levels.groupBy("level", "label").agg(F.count("*").alias("n")).collect()
        level, label, n = (np.array([r[k] for r in found], float) for k in range(3))
        return (level + 0.5) / _LEVELS, label, n

    return fit_chain(sets, y, categories, weights=weights, others=others)[0]


def scores(docs: DataFrame, chain: Chain, *, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability p_<category> for each category, and is_toxic: that of the first is at least the threshold, by default the chain's.

    A row for each row of docs with an id, repeated rows too; null and empty texts get the probabilities of a text without
    words, which the models' constants give; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    names = [f"p_{c}" for c in chain.names]
    threshold = chain.threshold if threshold is None else threshold

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = chain.predict(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in p.T], pa.array(p[:, 0] >= threshold)], ["doc_id", *names, "is_toxic"])

    schema = "doc_id long, " + "".join(f"{c} double, " for c in names) + "is_toxic boolean"
    return common.texts(docs, id_col, text_col).mapInArrow(common.over_slices(score), schema)


def accepted(docs: DataFrame, chain: Chain, *, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is toxic, in the columns of docs.

    Null and empty texts, rows without an id and rows that repeat are judged like others; a probability equal to the threshold is
    toxic; very long texts are read whole; an empty table gives no rows; other columns, whatever their names, are passed on.
    """
    t, threshold = docs.columns.index(text_col), chain.threshold if threshold is None else threshold

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, t):
                yield part.filter(pa.array(chain.predict(part.column(t))[:, 0] < threshold))

    return docs.mapInArrow(keep, docs.schema)
