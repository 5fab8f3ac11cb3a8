"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed features of the distinct words of a text:
each word and its first bytes.  It is trained in numpy from confirmed toxic
examples and from unlabelled text alone.  Of the unlabelled risk, the part that
toxic texts among it account for (class prior times the positives' risk as
negatives) is subtracted; where that estimate of the negatives' risk would fall
below zero it is driven back up instead of further down, which keeps the model
from memorising the positives.  Features are valued by how much likelier they are in
positives than in unlabelled texts, only those that are likelier take part, and an
L1 step brings weights that don't help to zero: evidence only adds, and a long
text isn't scored by its length.

Only the samples bounded by ``POSITIVES``, ``UNLABELLED`` and ``SAMPLE_SLOTS`` reach
the driver, as hashed features of whole texts; the class prior is the toxic share of all labels of the training
folds, the one number for which labels of clean rows are used.  Scoring takes every whole text, with nonzero weights broadcast (at most
one per feature slot).

Edge cases: null or empty text has no words and scores as the bias alone; an id
with several labels counts as each; without any toxic label, or with no rows,
every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm import words as w
from lodestone.llm.sampling import bounded, fold, taken
from lodestone.llm.tables import Owned, materialize, plain

#: Labels of this fold of crc32(doc_id) are held out.
FOLDS, HELD_OUT = 5, 0
#: Most documents of either kind that the model is fitted on.
POSITIVES, UNLABELLED = 2000, 8000
#: Most distinct features of the documents of either kind together (4 bytes each on the driver).
SAMPLE_SLOTS = 5_000_000
#: Feature slots (a power of two), and the lengths in bytes of word beginnings.
SLOT_BITS, BEGINNINGS = 20, (4, 5)
#: A feature takes part if it is so much likelier in positives (log ratio), smoothed by this share of documents at least.
LEAST_RATIO, LEAST_SHARE = 1.0, 0.002
STEPS, RATE, L1 = 500, 0.03, 0.1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every feature of every word, with repeats."""
    starts, ends, first = w.words(data, offsets, w.ALNUM)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    slots, docs = [w.span_hash(data, starts, ends, fold=True)], [doc]
    for k, n in enumerate(BEGINNINGS):
        long = ends - starts >= n
        slots.append(w.mix(w.span_hash(data, starts[long], starts[long] + n, fold=True) + np.uint64(k + 1)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Rows:
    """Distinct features of documents: slots of document i are slots[ends[i - 1]:ends[i]]."""

    slots: np.ndarray
    ends: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values[self.slots])])[np.concatenate([[0], self.ends])]
        return np.diff(total)

    def spread(self, per_row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.slots, np.repeat(per_row, np.diff(self.ends, prepend=0)), n)


def _rows(lists: list[np.ndarray]) -> Rows:
    return Rows(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.cumsum([len(x) for x in lists], dtype=np.int64))


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text, one after another, and where each text's start."""
    doc, slot = features(data, offsets)
    key = np.unique(doc << SLOT_BITS | slot)
    return (key & (1 << SLOT_BITS) - 1).astype(np.uint32), np.searchsorted(key >> SLOT_BITS, np.arange(len(offsets)))


def sampled_features(docs: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """The distinct slots of each sampled document, in the order of a hash each that fits into what is left of ``SAMPLE_SLOTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                slots, cut = distinct(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = [slots[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["_k"].slice(i, j - i), pa.array(np.diff(cut), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "k", "n", "slots"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi").withColumn("_k", F.xxhash64("doc_id", "text"))
    with Owned():
        made = materialize(chosen.mapInArrow(run, "doc_id long, k long, n long, slots binary"), "slots")
        return [np.frombuffer(x["slots"], np.uint32) for x in taken(made, "n", SAMPLE_SLOTS, most)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def ratios(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int) -> np.ndarray:
    """How much likelier each feature is in a positive than in an unlabelled document, as a smoothed log ratio."""
    shares = []
    for lists in (positive, unlabelled):
        counts = np.zeros(n)
        for slots in lists:
            counts[slots] += 1
        shares.append(counts / len(lists))
    smooth = max(LEAST_SHARE, 3 / len(positive))
    return np.log((shares[0] + smooth) / (shares[1] + smooth))


def risk_gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives, by the score of each positive and each unlabelled document, of what a step goes down.

    The risk is prior * E+[l(s)] + N with N = Eu[l(-s)] - prior * E+[l(-s)] and l(s) = log(1 + exp(-s)).
    Where the estimate N of the negatives' risk is below zero, a step goes down -N alone.
    """
    gp, gu = _sigmoid(positive), _sigmoid(unlabelled)
    negatives = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    by_positive, by_unlabelled = -prior * gp / len(gp), gu / len(gu)
    if negatives < 0:
        return -by_positive, -by_unlabelled
    return by_positive + prior * (gp - 1) / len(gp), by_unlabelled


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of all slots and the bias, by Adam on the non-negative risk with logistic loss.

    A feature's value is its log ratio, so those that tell nothing take no part
    and those that tell much move the score most.
    """
    n = 1 << SLOT_BITS
    if not positive or not unlabelled:
        return np.zeros(n), -np.inf
    value = ratios(positive, unlabelled, n)
    used = np.flatnonzero(value >= LEAST_RATIO)
    place = np.full(n, -1)
    place[used] = np.arange(len(used))
    keep = lambda lists: _rows([x[x >= 0] for x in (place[s] for s in lists)])
    p, u, value = keep(positive), keep(unlabelled), value[used]
    weight, bias = np.full(len(used), 0.5), float(np.log(prior / (1 - prior))) - 1.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        dp, du = risk_gradient(p.sums(weight * value) + bias, u.sums(weight * value) + bias, prior)
        g = np.append((p.spread(dp, len(used)) + u.spread(du, len(used))) * value, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        weight = np.maximum(weight - move[:-1] - RATE * L1, 0)
        bias -= move[-1]
    out = np.zeros(n)
    out[used] = weight * value
    return out, bias


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias; labels of the held-out fold aren't read."""
    known = labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    n, toxic = known.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic:
        return np.empty(0, np.int64), np.empty(0), -np.inf
    prior = min(max(toxic / n, 1e-4), 0.9)
    positive = sampled_features(docs, bounded(known.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")), POSITIVES, "positive"), POSITIVES)
    rest = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("doc_id"))
    weights, bias = train(positive, sampled_features(docs, bounded(rest, UNLABELLED, "unlabelled"), UNLABELLED), prior)
    slots = np.flatnonzero(weights)
    return slots, weights[slots], bias


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (the chance that the text is toxic) and predicted."""
    return _scored(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of docs and their score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = shared.value
        dense = np.zeros(1 << SLOT_BITS)
        dense[slots] = weights
        for batch in batches:
            data, offsets = w.text_bytes(batch.column(at))
            for i, j in w.slices(offsets):
                doc, slot = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                live = dense[slot] != 0
                key = np.unique(doc[live] << SLOT_BITS | slot[live])
                total = np.bincount(key >> SLOT_BITS, dense[key & (1 << SLOT_BITS) - 1], j - i) + bias
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(total))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, without those predicted toxic; columns may have any names besides doc_id and text."""
    rows = plain(docs, ("doc_id", "text"))
    return _scored(rows, fit(rows, labels)).filter("score < 0.5").drop("score").toDF(*docs.columns)
