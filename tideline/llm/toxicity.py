"""Toxicity by a classifier chain.

The chain predicts its categories one after the other.  Each is a logistic regression on
hashed words (present or not) and on the log-odds of the categories before it; while
training, those come from models of other folds (out-of-fold), so that a later model
learns from predictions as good as it will get.  Words enter a model only if they differ
between the classes of the sample (chi-squared), which keeps long texts, with their many
neutral words, comparable to short ones.  The ridge of a category, and the log-odds from
which a text counts as one of it, are those of the best F1 over the out-of-fold log-odds
among the cuts of enough precision; near copies lie in one fold, so that no model is
judged on a text it knows.

The fit uses at most ``sample`` labelled rows, in the order of a hash of their ids.  Words are
counted by class and fold in one aggregation, and only those that some model of the chain
will keep go to the driver, so long texts of neutral words cost it nothing.  Every
document is scored by one pass over its whole text.

Edge cases: a null or empty text has no words and gets the chain's base rate; a
category without positive labels is never predicted; rows that repeat are scored each;
labels of unknown ids are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, hash_sample
from tideline.llm.textops import Block, blocks, mix

DIMS = 1 << 18
FOLDS = 5
#: ridges to choose from, the strongest first
RIDGES = (2e-3, 1e-4)
#: a cut whose out-of-fold precision is lower is not taken
LEAST_PRECISION = 0.95
#: a word differs between classes from this statistic on, and if at least so many texts hold it
LEAST_CHI2, LEAST_TEXTS = 12.0, 3
#: least shingle hashes by which near copies among the labelled texts are found
MARKS = 8


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, word bucket), each pair once."""
    bucket = (block.word_hashes(fold_case=True) % np.uint64(DIMS)).astype(np.int64)
    pairs = np.unique(block.doc_of_word * DIMS + bucket)
    return pairs // DIMS, pairs % DIMS


def _marks(block: Block) -> list[np.ndarray]:
    """For each text, the least hash of its five-word shingles under each of ``MARKS`` orders; none for shorter texts."""
    h, at = block.windows(block.word_hashes(fold_case=True), 5)
    doc = block.doc_of_word[at]
    some, begins = np.unique(doc, return_index=True)
    found = [np.zeros(0, dtype=np.int64)] * block.n
    if len(some):
        least = [np.minimum.reduceat(mix(h ^ mix(np.array([k + 1], dtype=np.uint64))), begins) for k in range(MARKS)]
        for i, row in zip(some, np.stack(least, axis=1).view(np.int64)):
            found[i] = row
    return found


def folds(marks: Sequence[Sequence[int]]) -> np.ndarray:
    """The fold of each text: texts tied by equal marks share one, and the largest groups are dealt first."""
    parent = list(range(len(marks)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    owner: dict[tuple[int, int], int] = {}
    for i, row in enumerate(marks):
        for mark in enumerate(row):
            parent[find(i)] = find(owner.setdefault(mark, i))
    _, group, size = np.unique([find(i) for i in range(len(marks))], return_inverse=True, return_counts=True)
    fold, held = np.zeros(len(size), dtype=np.int64), np.zeros(FOLDS)
    for j in np.argsort(-size, kind="stable"):
        fold[j] = held.argmin()
        held[fold[j]] += size[j]
    return fold[group]


def best_cut(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(F1, log-odds) of the cut of the best F1 among those of enough precision; (0, 0) if there is none."""
    order = np.argsort(-odds, kind="stable")
    odds, hits = odds[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(odds[1:] != odds[:-1], False))  # a cut lies between different odds
    n = last + 1
    last = last[hits[last] >= LEAST_PRECISION * n]
    if not len(last) or not hits[last].any():
        return 0.0, 0.0
    f1 = 2 * hits[last] / (last + 1 + y.sum())
    at = last[f1.argmax()]
    return float(f1.max()), float((odds[at] + odds[at + 1]) / 2)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), letters_only=True):
            doc, bucket = features(block)
            cut = np.searchsorted(doc, np.arange(block.n + 1))
            lists = [bucket[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
            marks = _marks(block)
            rest = [batch.column(i).slice(block.first, block.n) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, type=pa.list_(pa.int32())), pa.array(marks, type=pa.list_(pa.int64())), *rest], ["words", "marks", *batch.schema.names[1:]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(rows: np.ndarray, cols: np.ndarray, n_cols: int, dense: np.ndarray, y: np.ndarray, ridge: float, steps: int = 150):
    """Weights (of columns, of dense features, bias) by Adam on the ridge-penalised log-loss."""
    w = np.zeros(n_cols + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    extended = np.hstack([dense, np.ones((len(y), 1))])
    for t in range(1, steps + 1):
        score = np.bincount(rows, weights=w[cols], minlength=len(y)) + extended @ w[n_cols:]
        error = (_sigmoid(score) - y) / len(y)
        grad = np.concatenate([np.bincount(cols, weights=error[rows], minlength=n_cols), error @ extended]) + ridge * w
        grad[-1] -= ridge * w[-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


class Model:
    """One category: kept words, their weights, weights of earlier log-odds, bias, and the log-odds ``cut``."""

    def __init__(self, rows, cols, earlier, y, ridge: float, cut: float = 0.0) -> None:
        self.cut = cut
        if not y.any():  # nothing to learn from: never predicted
            self.words, self.weights = np.zeros(0, dtype=np.int64), np.zeros(0)
            self.rest = np.append(np.zeros(earlier.shape[1]), -20.0)
            return
        pos = np.bincount(cols[y[rows] == 1], minlength=DIMS)
        all_ = np.bincount(cols, minlength=DIMS)
        n, p = max(1, len(y)), y.sum()
        q = n - p
        with np.errstate(divide="ignore", invalid="ignore"):
            chi2 = n * (pos * (q - (all_ - pos)) - (all_ - pos) * (p - pos)) ** 2.0 / (p * q * all_ * (n - all_.astype(float)))
        self.words = np.flatnonzero((np.nan_to_num(chi2) >= LEAST_CHI2) & (all_ >= LEAST_TEXTS))
        at = np.searchsorted(self.words, cols)
        hit = (at < len(self.words)) & (self.words[np.minimum(at, max(0, len(self.words) - 1))] == cols) if len(self.words) else np.zeros(len(cols), bool)
        w = _logistic(rows[hit], at[hit], len(self.words), earlier, y, ridge)
        self.weights, self.rest = w[: len(self.words)], w[len(self.words) :]

    def odds(self, rows: np.ndarray, cols: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        table = np.zeros(DIMS)
        table[self.words] = self.weights
        score = np.bincount(rows, weights=table[cols], minlength=len(earlier))
        return np.clip(score + earlier @ self.rest[:-1] + self.rest[-1], -20, 20)


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Model]:
    """The models of a chain over the columns of ``labels`` (nan: no label)."""
    chain, earlier = [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]

        def part(mask: np.ndarray, ridge: float, cut: float = 0.0, columns=earlier, y=y) -> Model:
            index = np.cumsum(mask) - 1
            use = mask[rows]
            return Model(index[rows[use]], cols[use], columns[mask], y[mask], ridge, cut)

        known = ~np.isnan(y)
        best = None
        for ridge in RIDGES:
            out = np.zeros(len(labels))
            for f in range(FOLDS):
                held = part(known & (fold != f), ridge).odds(rows, cols, earlier)
                out[fold == f] = held[fold == f]
            f1, cut = best_cut(out[known], y[known])
            if best is None or f1 > best[0]:
                best = f1, cut, ridge, out
        _, cut, ridge, out = best
        chain.append(part(known, ridge, cut))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def _score(chain: list[Model], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), letters_only=True):
                rows, cols = features(block)
                earlier = np.zeros((block.n, 0))
                for model in chain:
                    earlier = np.hstack([earlier, model.odds(rows, cols, earlier)[:, None]])
                p = _sigmoid(earlier)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), *(pa.array(p[:, i]) for i in range(len(names)))],
                    ["doc_id", *(f"p_{n}" for n in names)],
                )

    return run


def telling_words(words: DataFrame, categories: Sequence[str], labels: np.ndarray, fold: np.ndarray) -> DataFrame:
    """Column word: each that differs between the classes of some category in all folds, or in all but one.

    ``words`` has a row for each word of a text (word, fold, and the ``categories``);
    ``labels`` and ``fold`` are those of the texts.
    """
    held = range(FOLDS)
    counts = []
    for c in categories:
        counts += [F.count_if(F.col(c).isNotNull() & (F.col("fold") == f)).alias(f"{c}_all_{f}") for f in held]
        counts += [F.count_if((F.col(c) == 1) & (F.col("fold") == f)).alias(f"{c}_pos_{f}") for f in held]
    differs = F.lit(False)
    for i, c in enumerate(categories):
        for left_out in (None, *held):
            y = labels[~np.isnan(labels[:, i]) & (fold != (-1 if left_out is None else left_out)), i]
            n, p = float(len(y)), float(y.sum())
            if not 0 < p < n:
                continue
            total = lambda kind: sum((F.col(f"{c}_{kind}_{f}") for f in held if f != left_out), F.lit(0.0))
            every, pos = total("all"), total("pos")
            gap = pos * (F.lit(n - p) - (every - pos)) - (every - pos) * (F.lit(p) - pos)
            # The models apply the same limit again; the slack is for rounding.
            enough = F.lit(n) * gap * gap >= (LEAST_CHI2 * (1 - 1e-9) * p * (n - p)) * every * (F.lit(n) - every)
            differs = differs | ((every >= LEAST_TEXTS) & enough)
    return words.groupBy("word").agg(*counts).where(differs).select("word")


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = 6_000, seed: int = 5) -> list[Model]:
    """A chain over ``categories``, columns of ``labels`` (doc_id, 0 or 1 each), from at most ``sample`` labelled documents."""
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in categories))
    chosen = hash_sample(known, "doc_id", sample, seed)
    # At most ``sample`` documents; of rows that repeat an id the least text counts.
    rows = docs.select("text", "doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in ("o", *categories)))
    schema = f"words array<int>, marks array<long>, doc_id {kind}, o long, " + ", ".join(f"{c} double" for c in categories)
    rows = checkpoint(rows.select("text", "doc_id", "o", *categories).mapInArrow(_feature_rows, schema))
    found = rows.drop("words").orderBy("o", "doc_id").toArrow()
    n = found.num_rows
    if not n:
        return fit_chain(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(categories))), np.zeros(0, dtype=np.int64))
    y = np.stack([found.column(c).to_numpy() for c in categories], axis=1).astype(float)
    fold = folds(found.column("marks").to_pylist())
    dealt = docs.sparkSession.createDataFrame(pa.table({"doc_id": found.column("doc_id"), "at": pa.array(np.arange(n)), "fold": pa.array(fold)}))
    words = rows.join(F.broadcast(dealt), "doc_id").select("at", "fold", *categories, F.explode("words").alias("word"))  # a row a text is broadcast
    telling = telling_words(words, categories, y, fold)
    pairs = words.join(F.broadcast(telling), "word").select("at", "word").orderBy("at", "word").toArrow()  # at most DIMS words are broadcast
    return fit_chain(pairs.column("at").to_numpy(), pairs.column("word").to_numpy().astype(np.int64), y, fold)


def score(docs: DataFrame, chain: list[Model], categories: Sequence[str]) -> DataFrame:
    """doc_id and the probability p_<category> of each category, for every row."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in categories)
    return docs.select("doc_id", "text").mapInArrow(_score(chain, categories), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic: a chain from low quality to toxicity.

    Without a ``threshold`` of the probability, the cut that was chosen while training holds.
    """
    categories = ("low_quality", "toxic")
    named = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
    chain = train(docs, named, categories)
    found = score(docs, chain, categories)
    threshold = float(_sigmoid(np.array(chain[-1].cut))) if threshold is None else threshold
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
