"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct lower-cased words, hashed to BUCKETS. The score is the logistic of
bias + sum of weights + sum over pairs of the inner product of their factors, so that an insult together
with a group mention can weigh more, or less, than the two apart. The pair sum takes time linear in the
number of terms. Weights are fitted by AdaGrad on a bounded sample of labelled rows; terms of too few
sample documents keep zero weight. Terms whose own label rate does not stand out learn more slowly, so that
they do not learn single documents by heart, but may count through their pairs.

Cases: null, empty and wordless texts get the bias alone; rows without a label teach nothing; a row
labelled twice counts twice, and so does a repeated row; null ids are scored and not held out, and labels of null ids
teach nothing; a text of any length is scored whole; without any labels every score is 0. Other columns are passed on;
a column toxicity of the caller's is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import Memo, arrow_udf, bound, draw, table

BUCKETS = 1 << 18
FACTORS = 6
#: About so many labelled documents are learned from.
SAMPLE_DOCS = 20_000
MIN_DOCS, MIN_DEVIATIONS = 5, 3.0
#: What AdaGrad starts from: a term whose own label rate does not stand out learns in smaller steps, but learns.
QUICK, SLOW = 1e-6, 1.0
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.1, 2e-4
CACHE = 150_000
WORDS = re.compile(r"[^\W\d_]+")


class Terms:
    """Hashed terms of texts; tokens that come again are taken from a bounded cache."""

    def __init__(self):
        self.memo = Memo(self._token, CACHE)

    @staticmethod
    def _token(token: str) -> tuple[int, ...]:
        return tuple(crc32(w.encode()) % BUCKETS for w in WORDS.findall(token))

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct buckets of a text's words."""
        memo = self.memo
        found = {b for t in set((text or "").lower().split()) for b in (memo[t] if len(t) <= 64 else self._token(t))}
        return np.array(sorted(found), np.int64)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slots: np.ndarray  # the row of each bucket; the last row is zero and serves all buckets without weight

    def score(self, terms: np.ndarray) -> float:
        rows = self.slots[terms]
        v = self.factors[rows]
        margin = self.bias + self.weights[rows].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def train(docs: list[tuple[np.ndarray, int]]) -> Machine:
    """Fit on (terms, label) pairs."""
    empty = Machine(-30.0, np.zeros(1), np.zeros((1, FACTORS)), np.zeros(BUCKETS, np.int64))
    if not docs:
        return empty
    labels = np.array([y for _, y in docs], float)
    rate = labels.mean()
    n = np.zeros(BUCKETS)
    hits = np.zeros(BUCKETS)
    for terms, y in docs:
        n[terms] += 1
        hits[terms] += y
    spread = np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    chosen = np.flatnonzero(n >= MIN_DOCS)
    slots = np.full(BUCKETS, len(chosen), np.int64)
    slots[chosen] = np.arange(len(chosen))
    rows = [r[r < len(chosen)] for r in (slots[terms] for terms, _ in docs)]
    draw = np.random.default_rng(7)
    w, v = np.zeros(len(chosen) + 1), draw.normal(0, 0.01, (len(chosen) + 1, FACTORS))
    v[-1] = 0
    bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    stands_out = np.abs(hits - n * rate) >= MIN_DEVIATIONS * spread
    w_sum = np.append(np.where(stands_out[chosen], QUICK, SLOW), QUICK)
    v_sum, b_sum = np.repeat(w_sum[:, None], FACTORS, axis=1), QUICK
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            size = np.array([len(rows[i]) + 1 for i in pick])
            flat = np.concatenate([np.append(rows[i], len(chosen)) for i in pick])  # the zero row: no document is empty
            starts = np.cumsum(size) - size
            f = v[flat]
            sums = np.add.reduceat(f, starts, axis=0)
            margin = bias + np.add.reduceat(w[flat], starts) + 0.5 * (sums**2 - np.add.reduceat(f**2, starts, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(error, size)
            gw, gv = DECAY * w / len(rows) * BATCH, DECAY * v / len(rows) * BATCH
            np.add.at(gw, flat, each)
            np.add.at(gv, flat, each[:, None] * (np.repeat(sums, size, axis=0) - f))
            gb = error.sum()
            w_sum += gw**2
            v_sum += gv**2
            b_sum += gb**2
            w -= RATE * gw / np.sqrt(w_sum)
            v -= RATE * gv / np.sqrt(v_sum)
            bias -= RATE * gb / np.sqrt(b_sum)
            w[-1], v[-1] = 0, 0
    return Machine(bias, w, v, slots.astype(np.int32))


def scorer(spark: SparkSession, machine: Machine):
    """A function of a text column to its score."""
    shared = spark.sparkContext.broadcast(machine)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, fitted = Terms(), shared.value
        for batch in batches:
            yield pa.array([round(fitted.score(terms.of(t)), 6) for t in batch.to_pylist()], pa.float64())

    return score


def hasher():
    """A function of a text column to its hashed terms."""

    @arrow_udf("array<int>")
    def hashed_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms()
        for batch in batches:
            yield pa.array([terms.of(t).tolist() for t in batch.to_pylist()], pa.list_(pa.int32()))

    return hashed_terms


def held_out(doc_id: Column) -> Column:
    """Documents whose labels nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Learn from labelled documents that are not held out: about sample_docs of them, drawn by a hash of the id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.count()
    if not n:
        return train([])
    taken = draw("doc_id", F.lit("toxicity")) <= bound(sample_docs / n)
    rows = docs.where(taken).select("doc_id", hasher()(F.col("text")).alias("terms")).join(usable.where(taken), "doc_id").orderBy("doc_id", "toxic", F.hash("terms"))
    return train([(np.array(r["terms"], np.int64), r["toxic"]) for r in rows.select("terms", "toxic").toLocalIterator()])


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with a column toxicity (0 to 1) added."""
    return docs.withColumn("toxicity", scorer(docs.sparkSession, machine)(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
