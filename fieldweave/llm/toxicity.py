"""Toxicity by a classifier chain.

Categories are predicted one after the other. The model of a category sees the
words of a text and the log odds of all earlier categories; while training,
those come from models that did not see the text (out-of-fold predictions), so
that later models meet inputs as uncertain as they will be.

The models are fitted on a bounded sample of labelled texts, those of the
smallest hashes of ids; scoring reads all texts.

Defined results: a null text has no words and gets the odds of the
intercepts; a null label leaves a text out for its category; labels without a
text and texts without a label are allowed; without any labels of both kinds
nothing is toxic. Of labels that repeat an id, the largest counts. Null ids
stay null; repeated rows get equal results; an empty table gives an empty
result. Other columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, slices, small_batches, table, utf8
from .linear import WordScorer, WordTable, folds, logistic, meaning_features, sigmoid, words_of

#: At most so many labelled texts are fitted on.
SAMPLE = 4000
FOLDS = 4
THRESHOLD = 0.4
#: The column of a batch's texts as bytes.
BYTES = "text as bytes"
#: Log odds that later models see are cut at this size.
LIMIT = 8.0
#: Categories in the order of the chain, each a condition on a row of labels.
CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1"}


@dataclass
class Chain:
    """Per category: its selected features, and weights of them, of the earlier log odds, and the intercept."""

    categories: list[str]
    selected: list[np.ndarray]
    weights: list[np.ndarray]

    def features(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.selected, np.zeros(0, np.int64)])).astype(np.int64)

    def log_odds(self, values: np.ndarray, every: np.ndarray) -> np.ndarray:
        """From the values of the features ``every``, all categories in turn."""
        out = np.zeros((len(values), len(self.categories)))
        for k, (own, w) in enumerate(zip(self.selected, self.weights, strict=True)):
            x = np.column_stack([values[:, np.searchsorted(every, own)], np.clip(out[:, :k], -LIMIT, LIMIT)])
            out[:, k] = x @ w[:-1] + w[-1]
        return out


def fit_chain(ids: np.ndarray, texts: list[bytes], labels: dict[str, np.ndarray], n_folds: int = FOLDS) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold log odds of each text. ``labels``: 1, 0 or NaN for each text."""
    words = WordTable(texts, meaning_features, share=False)
    fold = folds(ids, n_folds)
    chain, before = Chain([], [], []), np.zeros((len(texts), 0))
    for name, y in labels.items():
        known = ~np.isnan(y)
        target = np.where(known, y, 0)
        earlier = np.clip(before, -LIMIT, LIMIT)

        def model(rows: np.ndarray, target=target, earlier=earlier):
            positive = int(target[rows].sum())
            if not positive or positive == rows.sum():
                return np.zeros(0, np.int64), np.append(np.zeros(earlier.shape[1]), LIMIT if positive else -LIMIT)
            chosen = words.select(target, rows)
            x = np.column_stack([words.matrix(chosen), earlier])
            return chosen, logistic(x[rows], target[rows], np.ones(int(rows.sum())))

        odds = np.zeros(len(texts))
        for k in range(n_folds):
            chosen, w = model(known & (fold != k))
            x = np.column_stack([words.matrix(chosen), earlier])
            odds = np.where(fold == k, x @ w[:-1] + w[-1], odds)
        chosen, w = model(known)
        chain.categories.append(name)
        chain.selected.append(chosen)
        chain.weights.append(w)
        before = np.column_stack([before, odds])
    return chain, before


def labelled(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], most: int) -> DataFrame:
    """Texts with labels: the ``most`` of smallest hashes of ids, so few enough to be broadcast; of rows that repeat an id, the least text."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.expr(c).cast("int")).cast("double").alias(name) for name, c in conditions.items()])
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(name).alias(name) for name in conditions])


def train(docs: DataFrame, labels: DataFrame, *, conditions: dict[str, str] = CATEGORIES, most: int = SAMPLE) -> tuple[Chain, np.ndarray, dict[str, np.ndarray]]:
    rows = labelled(docs, labels, conditions, most).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    marks = {name: np.array([np.nan if r[name] is None else r[name] for r in rows], float) for name in conditions}
    chain, odds = fit_chain(np.array([r["doc_id"] for r in rows], np.int64), [bytes(r["text"]) for r in rows], marks)
    return chain, odds, marks


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``docs`` and ``p``, an array of the probabilities of the categories in order."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        every = model.features()
        scorer = WordScorer(every, meaning_features, share=False)
        for batch in batches:
            names = batch.schema.names
            own = batch.append_column(BYTES, batch.column(names.index("text")).cast(pa.binary()).fill_null(b""))
            for part, texts in slices(own, BYTES):
                p = sigmoid(model.log_odds(scorer.values([words_of(t) for t in texts]), every))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(p), pa.list_(pa.float64()))], [*names, "p"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))


def without_toxic(docs: DataFrame, chain: Chain, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the chain does not find toxic, with all their columns; a column may be named as the score is."""
    plain = apart(docs, "text")
    return score(plain, chain).where(F.col("p")[chain.categories.index("toxic")] < threshold).drop("p").toDF(*docs.columns)


def judged(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, a probability for each category, and ``toxic``."""
    chain, _, _ = train(docs, labels)
    found = score(docs.select("doc_id", "text"), chain).drop("text")
    each = [F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)]
    return found.select("doc_id", *each).withColumn("toxic", F.col("p_toxic") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_junk", F.col("p_toxic").alias("score"), "toxic")
