"""Substring dedup by seed and extend on winnowed anchors.

Seeds.  Of the runs of ``SEED`` words in a window of ``WINDOW`` words, the one
with the least hash is the window's anchor, the leftmost where hashes are equal.
The choice looks at the window's words alone, so two equal windows share their
anchor, at the same offset; neighbouring windows mostly share theirs too, which
leaves about one anchor for seven words.

Extension.  An anchor is extended both ways as far as the windows that chose it
reach.  Documents are joined on anchors: where all extensions of an anchor are
equal they are one class, and all windows of all but the class's first document
stand earlier too.  Where an anchor has several classes, their extensions agree
in part only, and the windows of each class's first document are compared one by
one.  So a passage in a third of all documents is one class, and costs what its
anchors cost; nothing is compared in pairs and no group is gathered.

Maximal repeats.  The repeated windows of a document are merged to spans, which
no repeat over the threshold extends; each word in them is removed.  Repeats
within one document are found in the same task, by its windows' hashes.

A document names each class once, as two hashes.  Classes are reduced by grouped
minima, combined before the shuffle, and joined back by joins that adaptive
execution can split.  Anchors are computed again where they are needed instead of
being stored.

Edge cases: null text has no words; fewer words than a window are never removed;
equal words are words with equal 64-bit hashes, and extensions are equal if two
such hashes are; rows that share an id are each judged against smaller ids and
against themselves; rows without an id are documents of their own, below all ids
and in the order of a hash of their text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as w
from lodestone.llm.tables import materialize

WINDOW, SEED = 20, 5


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, position of the anchor, first and last start of the windows that chose it) for all anchors of the texts.

    first: where each text's words start among ``hashes``.
    """
    fits = w.within(first, window)
    starts = np.flatnonzero(fits)
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = w.gram_hash(hashes, seed, 0x9E3779B97F4A7C15)
    span = window - seed + 1
    # the leftmost least gram of each window, by doubling: best[i] is that of a run of `width` grams from i
    best, width = np.arange(len(grams)), 1
    while width * 2 <= span:
        left, right = best[:-width], best[width:]
        best = np.where(grams[right] < grams[left], right, left)
        width *= 2
    left, right = best[starts], best[starts + span - width]
    chosen = np.where(grams[right] < grams[left], right, left)
    # windows of one run that chose one anchor come one after another
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    last = starts[np.append(at[1:], len(starts)) - 1]
    return grams[chosen[at]], chosen[at], starts[at], last


@dataclass
class Windows:
    """The windows of several texts: their start among all words, text and hash, and the anchor that each chose."""

    first: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    digest: np.ndarray
    anchor: np.ndarray
    seed: np.ndarray
    extent: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[Windows, np.ndarray, np.ndarray]:
    """The windows of all texts (seed and extent: of each anchor), and where words start and end."""
    starts, ends, first = w.words(data, offsets, w.NOT_SPACE)
    hashes = w.span_hash(data, starts, ends, fold=False)
    seed, chosen, a, b = anchors(hashes, first, window, min(SEED, window))
    reach = b - a + window
    base = 0xD6E8FEB86659FD93
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * w.powers(base, len(hashes)), out=total[1:])
    # the words of the extension, and where in it the anchor stands
    extent = w.mix((total[a + reach] - total[a]) * w.powers(base, len(hashes) + 1, inverse=True)[a] ^ w.mix((reach * 4096 + (chosen - a)).astype(np.uint64)))
    n = b - a + 1
    anchor = np.repeat(np.arange(len(a)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)
    digest = w.gram_hash(hashes, window, 0xA24BAED4963EE407)
    return Windows(first, start, np.searchsorted(first, start, "right") - 1, digest[start].view(np.int64) if len(start) else np.empty(0, np.int64), anchor, seed.view(np.int64), extent.view(np.int64)), starts, ends


def _once(*keys: np.ndarray) -> np.ndarray:
    """Where each distinct row of the keys stands first."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order[new]


def _listed(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of all values of the lists i to j, sorted; a null list is empty."""
    lists = column.slice(i, j - i)
    counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values, doc = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(j - i), counts)
    order = np.lexsort((values, doc))
    return doc[order], values[order]


def _among(doc: np.ndarray, value: np.ndarray, in_doc: np.ndarray, in_value: np.ndarray) -> np.ndarray:
    """Which (doc, value) are among (in_doc, in_value)."""
    if not len(in_doc):
        return np.zeros(len(doc), bool)
    both = np.concatenate([in_value, value])
    _, code = np.unique(both, return_inverse=True)
    width = int(code.max()) + 1
    return np.isin(doc * width + code[len(in_value) :], in_doc * width + code[: len(in_value)])


def _classes(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, seed, extent) of each class that a document has, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                found, _, _ = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                doc = found.doc[np.searchsorted(found.anchor, np.arange(len(found.seed)))] if len(found.seed) else np.empty(0, np.int64)
                at = _once(doc, found.extent, found.seed)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc[at] + i)), pa.array(found.seed[at]), pa.array(found.extent[at])], names=["doc_id", "seed", "extent"])

    return docs.mapInArrow(run, "doc_id long, seed long, extent long")


def _compared(docs: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """(doc_id, seed, digest) of the windows of the classes in heads (doc_id, extent), once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                found, _, _ = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                at = np.flatnonzero(_among(found.doc, found.extent[found.anchor], *_listed(batch["extents"], i, j)))
                at = at[_once(found.doc[at], found.digest[at])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(found.doc[at] + i)), pa.array(found.seed[found.anchor[at]]), pa.array(found.digest[at])], names=["doc_id", "seed", "digest"])

    listed = heads.groupBy("doc_id").agg(F.collect_set("extent").alias("extents"))
    return docs.join(listed, "doc_id").select("doc_id", "text", "extents").mapInArrow(run, "doc_id long, seed long, digest long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text); a row without an id goes by a number of its text instead, below all ids."""
    own = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("text"), 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text")


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, extent) and (doc_id, digest) of classes and of windows that stand in a document with a smaller id too."""
    rows = _keyed(docs)
    classes = _classes(rows, window)
    seeds = classes.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"), (F.min("extent") != F.max("extent")).alias("several")).filter("n > 1")
    shared = classes.join(materialize(seeds.drop("n"), "seeds"), "seed").filter("several or doc_id > head")
    shared = materialize(shared, "shared")
    several = shared.filter("several").select("doc_id", "seed", "extent")
    heads = materialize(several.groupBy("seed", "extent").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    whole = shared.filter("not several").select("doc_id", "extent").unionByName(several.join(heads.filter("n > 1"), ["seed", "extent"]).filter("doc_id > head").select("doc_id", "extent"))
    single = materialize(_compared(rows, heads.select(F.col("head").alias("doc_id"), "extent"), window), "windows")
    least = single.groupBy("seed", "digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    return whole, single.join(least, ["seed", "digest"]).filter("doc_id > head").select("doc_id", "digest")


_REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and the removed spans of words (end exclusive); kept_text on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found, starts, ends = windows(part, at, window)
                again = np.ones(len(found.start), bool)
                again[_once(found.doc, found.digest)] = False
                again |= _among(found.doc, found.extent[found.anchor], *_listed(batch["extents"], i, j))
                again |= _among(found.doc, found.digest, *_listed(batch["digests"], i, j))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, found.start[again], 1)
                np.add.at(edge, found.start[again] + window, -1)
                removed = np.cumsum(edge[:-1]) > 0
                raw, out = part.tobytes(), []
                for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
                    gone = removed[a:b]
                    kept = np.flatnonzero(~gone) + a
                    text = b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])
                    change = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)]
                    out.append((b - a, int(gone.sum()), hashlib.sha256(text).hexdigest(), spans, text.decode() if with_text else None))
                n, gone, digest, spans, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
                )

    whole, single = repeated(docs, window)
    found = whole.select("doc_id", "extent", F.lit(None).cast("long").alias("digest")).unionByName(single.select("doc_id", F.lit(None).cast("long").alias("extent"), "digest"))
    lists = found.groupBy("doc_id").agg(F.collect_set("extent").alias("extents"), F.collect_set("digest").alias("digests")).withColumnRenamed("doc_id", "_d")
    rows = _keyed(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "_d").withColumn("doc_id", F.when(F.col("_d") >= -(1 << 62), F.col("_d")))
    out = rows.join(lists, "_d", "left").select("doc_id", "text", "extents", "digests").mapInArrow(run, _REPORT)
    return out if with_text else out.drop("kept_text")
