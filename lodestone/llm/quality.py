"""Quality by a linear-chain conditional random field over the lines of a text.

Every line is good or bad.  A line's features are shares and counts of its bytes
and words, cut at thresholds, of itself and of the lines before and after it; the
chain adds a weight for each pair of neighbouring labels.  Forward-backward gives
each line's chance of being good.  Averaged with the lines' lengths as weights
these chances are the text's quality, and two numbers fitted on the training
labels turn quality into a probability.

Labels are of documents, not lines.  Training therefore starts with each line
labelled as its document, and twice relabels the lines of bad documents by the
field just fitted (the worst of them stays bad): the good lines around a bad
passage then count as good.  The field is fitted in numpy by Adam on its exact
gradient, from the bounded sample of whole documents that ``SAMPLE`` and
``SAMPLE_LINES`` name; only line features of those documents reach the driver.

Scoring takes every whole text.  Features are made for ``STEP_LINES`` lines at a
time and kept as one number a line; chains are cut in segments of ``SEGMENT``
lines that advance together, each starting from what the segments before and
after it pass on, so a text of millions of lines takes some tens of bytes a line
and no step for each line.

Edge cases: null or empty text is one empty line; a text of one line has no
neighbours; an id with several labels counts as each; without labels of both
kinds every score is the share of good labels (0.5 if there are none); an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as w
from lodestone.llm.sampling import bounded, fold, taken
from lodestone.llm.tables import materialize

#: Labels of this fold of crc32(doc_id) are held out.
FOLDS, HELD_OUT = 3, 1
#: Most documents of either label that the field is fitted on, and most lines of all of them together: in the order
#: of the sample each whole document that still fits is taken.
SAMPLE, SAMPLE_LINES = 1500, 100_000
#: Lines whose features are held at once, and lines of a segment of a chain.
STEP_LINES, SEGMENT = 1 << 15, 512
ROUNDS, STEPS, RATE, L2 = 3, 120, 0.1, 1e-3
#: Thresholds at which shares are cut.
CUTS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)

_SPACES = w._table([0x20, *range(0x09, 0x0E)])
_KINDS = {
    "upper": w._table(range(0x41, 0x5B)),
    "lower": w._table(range(0x61, 0x7B)),
    "digit": w._table(range(0x30, 0x3A)),
    "space": _SPACES,
    "comma": w._table([0x2C, 0x2E]),
    "mark": w._table([0x21, 0x3F]),
    "other": w._table([*range(0x22, 0x2C), 0x2D, 0x2F, 0x3A, 0x3B, 0x3C, 0x3D, 0x3E, 0x40, *range(0x5B, 0x61), *range(0x7B, 0x80)]),
    "beyond": w._table(range(0x80, 0x100)),
}
#: Features of a line: shares at each cut, word lengths, words, first and last line.
WIDTH = 15 * len(CUTS) + 18
_END = ~w.ALNUM & ~_SPACES & ~w._table([0x2C, 0x2E])


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each text's first line; a text has one line more than newlines."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    per = _counts(data == 0x0A, offsets[:-1], offsets[1:]) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One row of 0s and 1s for each line, without its neighbours'. head, last: whether it is its text's first or last line."""
    size = np.maximum(ends - starts, 1)
    word_start, word_end, word_of = w.words(data, np.append(starts, len(data)), w.NOT_SPACE)
    n = np.diff(word_of)
    many = np.maximum(n, 1)
    hashes = w.span_hash(data, word_start, word_end, fold=True)
    line = np.repeat(np.arange(len(starts)), n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], new, len(starts))
    length = word_end - word_start
    odd_end = _END[data[np.maximum(word_end - 1, 0)]] if len(word_end) else np.zeros(0, bool)
    per_word = lambda flags: np.bincount(line, flags, len(starts)) / many
    shares = [_counts(member[data], starts, ends) / size for member in _KINDS.values()]
    letters = np.maximum((shares[0] + shares[1]) * size, 1)
    shares.append(shares[0] * size / letters)
    shares += [per_word(same), 1 - distinct / many, per_word(odd_end), per_word(length == 1), per_word(length <= 3), per_word(length >= 9)]
    cut = [np.stack(shares, 1) > c for c in CUTS]
    mean = np.bincount(line, length, len(starts)) / many
    scale = [mean[:, None] > np.array([2, 3, 4, 5, 6, 8, 10, 14]), n[:, None] > np.array([0, 3, 8, 16, 32, 64, 128, 256])]
    return np.concatenate([np.concatenate(cut, 1), *scale, head[:, None], last[:, None]], 1)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The features of all lines, ``STEP_LINES`` at a time, each with its first line's number."""
    for a in range(0, len(starts), STEP_LINES):
        b = min(a + STEP_LINES, len(starts))
        at = np.arange(a, b)
        text = np.searchsorted(first, at, "right")
        lo, hi = int(starts[a]), int(ends[b - 1])
        yield a, line_features(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo, first[text - 1] == at, first[text] == at + 1)


def placed(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's score from the scores (n x 3) that its features give to itself, to the line after and to the line before."""
    out = scores[:, 0].copy()
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    out[at] += scores[at - 1, 1]
    out[at - 1] += scores[at, 2]
    return out


def spread(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The transpose of ``placed``: what each line's own, next and previous neighbour's value is (n x 3)."""
    out = np.zeros((len(values), 3))
    out[:, 0] = values
    inner = np.ones(len(values), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    out[at - 1, 1] = values[at]
    out[at, 2] = values[at - 1]
    return out


@dataclass
class Field:
    """Weights of the label "good" (a line's features for itself, for the line after and the line before), a constant,
    and the gain of each pair of neighbouring labels (0 bad, 1 good)."""

    weights: np.ndarray
    constant: float
    pairs: np.ndarray
    scale: float = 1.0
    shift: float = 0.0


def forward_backward(unary: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance of being good, and the expected number of each pair of labels.

    unary: the score of "good" for each line ("bad" has 0).  All segments of all
    texts advance together.  A segment that is not its text's only one is first
    reduced to a 2 x 2 matrix; the products of these from either end of the text
    are what the segment starts from.
    """
    sizes = np.diff(first)
    per = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), per)
    index = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = first[:-1][text] + index * SEGMENT
    size = np.minimum(SEGMENT, first[1:][text] - start)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    start, size, opening = start[order], size[order], index[order] == 0
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    step = np.exp(pairs - pairs.max())
    emit = lambda u: np.stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))], 1)
    before, after = np.full((len(start), 2), 0.5), np.full((len(start), 2), 0.5)
    if (per > 1).any():
        product = np.broadcast_to(np.eye(2), (len(start), 2, 2)).copy()
        for t, k in enumerate(active):
            product[:k] = (np.where(opening[:k, None, None], product[:k], product[:k] @ step) if t == 0 else product[:k] @ step) * emit(unary[start[:k] + t])[:, None, :]
            product[:k] /= product[:k].max(axis=(1, 2), keepdims=True)
        ends = np.cumsum(per)
        for end, n in zip(ends[per > 1].tolist(), per[per > 1].tolist(), strict=True):
            own = place[end - n : end]
            v = np.ones(2)
            for a, b in zip(own[:-1], own[1:], strict=True):
                v = v @ product[a]
                before[b] = v = v / v.sum()
            v = np.ones(2)
            for a, b in zip(own[-2::-1], own[:0:-1], strict=True):
                v = product[b] @ v
                after[a] = v = v / v.sum()
    ahead, good = np.empty(len(unary)), np.empty(len(unary))
    for t, k in enumerate(active):
        at = start[:k] + t
        p = before[:k] if t == 0 else np.stack([1 - ahead[at - 1], ahead[at - 1]], 1)
        r = (np.where(opening[:k, None], 1.0, p @ step) if t == 0 else p @ step) * emit(unary[at])
        ahead[at] = r[:, 1] / r.sum(axis=1)
    both = np.zeros((2, 2))
    q = np.empty((len(start), 2))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at, fresh = start[:k] + t, active[t + 1] if t + 1 < len(active) else 0
        q[fresh:k] = after[fresh:k]
        one, none = ahead[at] * q[:k, 1], (1 - ahead[at]) * q[:k, 0]
        good[at] = one / (one + none)
        z = q[:k] * emit(unary[at])
        if t:
            p = np.stack([1 - ahead[at - 1], ahead[at - 1]], 1)
        else:
            p = before[:k]
        joint = p[:, :, None] * step * z[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        both += (joint if t else joint[~opening[:k]]).sum(axis=0)
        z = z @ step.T
        q[:k] = z / z.sum(axis=1, keepdims=True)
    return good, both


def train(own: list[np.ndarray], sizes: list[np.ndarray], good: np.ndarray) -> Field:
    """A field from the line features of documents, their lines' lengths and the documents' labels."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    x = np.concatenate(own).astype(np.float32)
    doc = np.repeat(np.arange(len(own)), np.diff(first))
    length = np.concatenate(sizes) + 1.0
    label = good[doc].astype(float)
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    a = np.flatnonzero(inner)
    width = x.shape[1] * 3
    beta = np.zeros(width + 5)
    parts = lambda b: (b[:width].reshape(-1, 3), b[width], b[-4:].reshape(2, 2))
    for turn in range(ROUNDS):
        seen = np.array([[((label[a] == i) & (label[a + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
        m, v = np.zeros(len(beta)), np.zeros(len(beta))
        for step in range(1, STEPS + 1):
            weight, constant, pairs = parts(beta)
            chance, both = forward_backward(placed(x @ weight.astype(np.float32), first) + constant, first, pairs)
            g = np.concatenate([(x.T @ spread(chance - label, first).astype(np.float32)).ravel(), [(chance - label).sum()], (both - seen).ravel()]) / len(x) + L2 * beta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            beta = beta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, constant, pairs = parts(beta)
        chance, _ = forward_backward(placed(x @ weight.astype(np.float32), first) + constant, first, pairs)
        if turn < ROUNDS - 1:
            label = np.where(good[doc] == 1, 1.0, (chance >= 0.5).astype(float))
            worst = np.lexsort((chance, doc))[first[:-1]]
            label[worst[good == 0]] = 0.0
    field = Field(weight, constant, pairs)
    field.scale, field.shift = _calibrated(_logit(quality(chance, length, first)), good)
    return field


def quality(chance: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's mean chance, lines weighted by length."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(doc, chance * length, len(first) - 1) / np.bincount(doc, length, len(first) - 1)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through (x, y), both labels weighing alike, by Newton steps with a small ridge."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(design @ beta)
        grad = design.T @ (weight * (p - y)) + 1e-3 * (beta - [1.0, 0.0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(beta[0]), 0.01), float(beta[1])


def _sampled(docs: DataFrame, ids: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Line features and lengths of the sampled documents: in the order of a hash each that fits into what is left of ``SAMPLE_LINES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = lines(part, at)
                fits = np.diff(first) <= SAMPLE_LINES
                packed = np.concatenate([np.packbits(x, axis=1) for _, x in features(part, starts, ends, first)]) if fits.any() else None
                rows = [(packed[a:b].tobytes(), (ends - starts)[a:b].tobytes()) if ok else (None, None) for a, b, ok in zip(first[:-1], first[1:], fits, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["_k"].slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], names=["doc_id", "k", "n", "own", "size"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi").withColumn("_k", F.xxhash64("doc_id", "text"))
    made = materialize(chosen.mapInArrow(run, "doc_id long, k long, n long, own binary, size binary").filter("own is not null"), "lines")
    out = []
    for x in taken(made, "n", SAMPLE_LINES, SAMPLE):
        size = np.frombuffer(x["size"], np.int64)
        out.append((np.unpackbits(np.frombuffer(x["own"], np.uint8).reshape(len(size), -1), axis=1, count=WIDTH).astype(bool), size))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Field | float:
    """The field; or the share of good labels where only one kind is known. Labels of the held-out fold aren't read."""
    known = labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    parts = [(label, bounded(known.filter(F.col("quality") == label).select("doc_id"), SAMPLE, f"quality-{label}")) for label in (0, 1)]
    own, sizes, good = [], [], []
    for label, ids in parts:
        for x, size in _sampled(docs, ids):
            own.append(x)
            sizes.append(size)
            good.append(label)
    if len(set(good)) < 2:
        return float(np.mean(good)) if good else 0.5
    return train(own, sizes, np.array(good))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (the chance that the text is good), predicted, n_lines and n_good lines."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        weights = None if isinstance(field, float) else field.weights.astype(np.float32)
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = lines(part, at)
                if isinstance(field, float):
                    result, good = np.full(j - i, field), np.full(len(starts), field)
                else:
                    scores = np.concatenate([own @ weights for _, own in features(part, starts, ends, first)])
                    good, _ = forward_backward(placed(scores, first) + field.constant, first, field.pairs)
                    result = _sigmoid(field.scale * _logit(quality(good, ends - starts + 1.0, first)) + field.shift)
                n_good = np.diff(np.concatenate([[0], np.cumsum(good >= 0.5)])[first])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(result), pa.array(np.diff(first), pa.int64()), pa.array(n_good, pa.int64())], names=["doc_id", "score", "n_lines", "n_good"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_lines long, n_good long")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good")
