"""Toxicity by a classifier chain.

The categories are predicted one after another; each link is a logistic model
over words and the earlier links' log-odds.  In training the earlier links'
predictions are out of fold, so a later link learns to trust them as much as
they deserve on unseen texts.  The last link is the label ``toxic``; the
categories before it have no labels of their own and are weakly labelled:
toxic, and holding one of the category's seed words.

Training reads at most ``max_train`` labelled rows, the ones with the smallest
seeded draws; its word counts are a Spark aggregation, what reaches the driver
is at most ``n_features`` words and a row of indices per training row.  Scoring
is one pass over all texts with the weights in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches, draw, row_of
from sellerdesk.session import stage

SEEDS = {  # weak labels of the categories before the last
    "insult": "idiot moron loser clown fool jerk imbecile stupid dumb".split(),
    "contempt": "scum trash worthless pathetic disgusting vermin garbage filth".split(),
}
CATEGORIES = (*SEEDS, "toxic")
FOLDS = 3
_PUNCTUATION = bytes.maketrans(
    rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", b" " * 32
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words, ASCII punctuation taken as white space."""
    return (text or b"").lower().translate(_PUNCTUATION).split()


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 15) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps with a ridge on the others."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_links(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """One weight vector per column of ``labels``, in chain order."""
    links, seen = [], x
    for y in labels.T:
        out = np.full(len(y), y.mean() if len(y) else 0.0)
        for fold in range(FOLDS):
            rest, own = folds != fold, folds == fold
            if own.any() and rest.any():
                out[own] = predict(seen[own], fit_logistic(seen[rest], y[rest]))
        links.append(fit_logistic(seen, y) if len(y) else np.zeros(seen.shape[1] + 1))
        seen = np.hstack([seen, log_odds(out)[:, None]])
    return links


@dataclass(frozen=True)
class Chain:
    vocabulary: dict[bytes, int]
    links: list[np.ndarray]
    threshold: float

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """A column per category for each text."""
        n = len(self.vocabulary)
        x = np.zeros((len(texts), n + len(self.links)))
        known = self.vocabulary.keys()
        for i, t in enumerate(texts):
            x[i, [self.vocabulary[w] for w in known & set(words_of(t))]] = 1
        for k, w in enumerate(self.links):
            x[:, n + k] = predict(x[:, : n + k], w)
            if k + 1 < len(self.links):
                p = x[:, n + k].copy()
                x[:, n + k] = log_odds(p)
        out = x[:, n:]
        out[:, :-1] = sigmoid(out[:, :-1])
        return out


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int = 8192,
    n_features: int = 256,
    threshold: float = 0.5,
    seed: int = 3,
) -> Chain:
    """Fit the chain on at most ``max_train`` labelled rows of ``docs``.

    Labels that are null count as none; several labels of one document as the
    largest.  Without labelled rows every probability is one half at most and
    nothing is rejected; a category without positives stays near zero.
    """
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", draw(seed, F.col("doc_id")))
        .orderBy("draw", "doc_id")
        .limit(max_train)
        .select(F.col("doc_id").alias("l_id"), (F.col("toxic") > 0).alias("toxic"), "draw")
    )
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen),  # at most max_train rows
        F.col("doc_id") == F.col("l_id"),
    )
    sample = stage(sample.select("l_id", "draw", "toxic", "text"), "toxic-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [sorted(set(words_of(t))) for t in part.column(1).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = pa.array([w for f in found for w in f], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [flat, part.column(0).take(take)], names=["word", "toxic"]
                )

    counted = sample.select("toxic", "text").mapInArrow(words, "word binary, toxic boolean")
    n, n1 = sample.agg(F.count("*"), F.count_if("toxic")).first()
    hit = F.count_if("toxic")
    counts = counted.groupBy("word").agg(F.count("*").alias("df"), hit.alias("df1"))
    lift = F.col("df1") / F.lit(max(n1, 1)) - (F.col("df") - F.col("df1")) / F.lit(max(n - n1, 1))
    spread = F.col("df") / F.lit(max(n, 1)) * (1 - F.col("df") / F.lit(n + 1))
    best = (
        counts.where("df >= 3")
        .withColumn("score", lift * F.abs(lift) / spread)
        .orderBy(F.desc("score"), "word")
        .limit(n_features)
    )
    vocabulary = {bytes(r.word): i for i, r in enumerate(best.select("word").collect())}

    seeds = {c: {w.encode() for w in ws} for c, ws in SEEDS.items()}
    schema = "draw long, toxic boolean, found array<int>, marks array<boolean>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set(words_of(t)) for t in batch.column(2).to_pylist()]
            found = [sorted(vocabulary[w] for w in s & vocabulary.keys()) for s in sets]
            marks = [[not s.isdisjoint(seeds[c]) for c in SEEDS] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(marks, pa.list_(pa.bool_())),
                ],
                names=["draw", "toxic", "found", "marks"],
            )

    # one short row per training row (repeated documents are bounded by the label's limit)
    rows = sample.select("draw", "toxic", "text").mapInArrow(features, schema)
    rows = rows.orderBy("draw", "found").limit(2 * max_train).collect()
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, r.found] = 1
    y = np.array([[r.toxic and m for m in r.marks] + [r.toxic] for r in rows], float)
    y = y.reshape(len(rows), len(CATEGORIES))
    folds = np.array([r.draw % FOLDS for r in rows], int)
    return Chain(vocabulary, fit_links(x, y, folds), threshold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability per category (p_<category>) and the verdict ``toxic``.

    A null or empty text has no words and gets the models' base rates.  Rows are
    scored one by one: repeated rows and null ids stay; an empty table gives no
    rows.  Other columns are not read.
    """
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column(1).to_pylist())
            verdict = pa.array(p[:, -1] > chain.threshold, pa.bool_())
            columns = [pa.array(c, pa.float64()) for c in p.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, verdict], names=names)

    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names[1:-1]), "toxic boolean"])
    return narrow.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns (of any names), that the chain does not call toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column(1).to_pylist())[:, -1]
            yield batch.filter(pa.array(~(p > chain.threshold), pa.bool_())).select(["row"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(row_of(docs).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
