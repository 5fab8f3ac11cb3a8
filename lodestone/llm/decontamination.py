"""Benchmark decontamination with an FM-index of each training shard.

A shard is a few megabytes of whole documents.  Its words that no test phrase
uses, and runs of words shorter than the shortest phrase, can't be part of a
match and become separators; what is left is a sequence of symbols.  Its
suffixes are sorted by prefix doubling, its Burrows-Wheeler transform is kept in
a wavelet matrix, and all phrases of 10 words are searched backwards at once,
each step two ranks.  Rows found are located by walking to sampled suffix
positions, and the spans of a document are merged.

Documents are neither shuffled nor split.  The texts of the benchmark are broadcast
in blocks; more than ``BENCHMARK_BYTES`` of them are refused with an error.  Each
shard meets every block, and a worker holds the windows of at most
``BLOCKS_HELD`` blocks at a time.

Edge cases: null text has no words; an item with fewer than 10 words is one
phrase, one without words none; equal item_ids count once, a null item_id as the
empty string; words are equal if their 64-bit hashes are.
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
from lodestone.llm.tables import plain

WINDOW = 10
#: Bytes of item texts that are broadcast at once, and bytes of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Most bytes of item texts and ids in all, and blocks whose windows a worker holds at once (about 20 bytes for each byte of text).
BENCHMARK_BYTES, BLOCKS_HELD = 128 << 20, 2
#: One suffix position in so many is stored.
SAMPLE = 8


# --- the index ---------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of s, by doubling the length compared."""
    n = len(s)
    rank = s.astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (max(n, int(rank.max()) + 1) + 1) + second + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in prefixes, one bit of the symbols a level, all queries at once."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length())
        self.ones: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            s = np.concatenate([s[~bit], s[bit]])

    def ranks(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol c[i] stands before position at[i]."""
        start = np.zeros(len(c), np.int64)
        for k, ones in enumerate(self.ones):
            bit = c >> (self.bits - 1 - k) & 1 == 1
            zeros = len(ones) - 1 - int(ones[-1])
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros(len(at), np.int64)
        for ones in self.ones:
            bit = ones[at + 1] - ones[at]
            zeros = len(ones) - 1 - int(ones[-1])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
            out = out << 1 | bit
        return out


class FMIndex:
    """Counts and locates phrases in s; symbol 0 is kept for the end of s."""

    def __init__(self, s: np.ndarray):
        s = np.append(s, 0)
        order = suffix_array(s)
        self.tree = WaveletMatrix(s[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.marked = np.concatenate([[0], np.cumsum(order % SAMPLE == 0)])
        self.sampled = order[order % SAMPLE == 0]
        self.n = len(s)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that start with each phrase, as half-open ranges.  phrases: right-aligned symbols, one phrase a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = live[(low[live] < high[live]) & (lengths[live] >= phrases.shape[1] - j)]
            c = phrases[live, j]
            known = c + 1 < len(self.before)
            high[live[~known]] = 0
            live, c = live[known], c[known]
            if not len(live):
                break
            low[live], high[live] = self.before[c] + self.tree.ranks(c, low[live]), self.before[c] + self.tree.ranks(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in s of each row's suffix: steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            hit = self.marked[r + 1] > self.marked[r]
            out[live[hit]] = self.sampled[self.marked[r[hit]]] + steps
            live, r = live[~hit], r[~hit]
            c = self.tree.access(r)
            rows = rows.copy()
            rows[live] = self.before[c] + self.tree.ranks(c, r)
            steps += 1
        return out


# --- phrases -----------------------------------------------------------------


@dataclass
class Phrases:
    """A block of test items: the distinct windows, and which items each comes from."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    pairs: np.ndarray  # (window, item)
    items: list[str]


def phrases_of(items: list[tuple[str, str]]) -> Phrases | None:
    """Windows of the (item_id, text) pairs; None if no text has words."""
    data, offsets = w.text_bytes(pa.array([t or "" for _, t in items], pa.string()))
    starts, ends, first = w.words(data, offsets, w.ALNUM)
    if not len(starts):
        return None
    vocabulary, ids = np.unique(w.span_hash(data, starts, ends, fold=True), return_inverse=True)
    ids = ids + 2
    names = sorted({i for i, _ in items})
    place = {name: k for k, name in enumerate(names)}
    owner = np.array([place[name] for name, _ in items])
    size = np.diff(first)
    at = np.flatnonzero(w.within(first, WINDOW))
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    rows = np.zeros((len(at) + len(short), WINDOW), np.int64)
    if len(at):
        rows[: len(at)] = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    for k, item in enumerate(short, len(at)):
        rows[k, WINDOW - size[item] :] = ids[first[item] : first[item + 1]]
    owners = owner[np.append(np.searchsorted(first, at, "right") - 1, short)]
    symbols, inverse = np.unique(rows, axis=0, return_inverse=True)
    return Phrases(vocabulary, symbols, (symbols > 0).sum(axis=1), np.unique(np.stack([inverse.ravel(), owners], 1), axis=0), names)


def broadcast_items(benchmark: DataFrame) -> list:
    """All (item_id, text) pairs, as broadcast blocks of at most BLOCK_BYTES of text (or one longer item); their sum is checked first."""
    items = benchmark.selectExpr("coalesce(cast(item_id as string), '') as item", "coalesce(text, '') as text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("item") + F.octet_length("text")), F.lit(0))).first()[0]
    if total > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {total} bytes; at most {BENCHMARK_BYTES} are broadcast: check its parts one by one")
    context, blocks, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_BYTES:
            blocks.append(context.broadcast(block))
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    return [*blocks, context.broadcast(block)] if block else blocks


_held: list[tuple[list, Phrases | None]] = []


def _phrases(block) -> Phrases | None:
    """The windows of a broadcast block, made once where few blocks are in use."""
    items = block.value
    for own, phrases in _held:
        if own is items:
            return phrases
    del _held[: max(0, len(_held) - BLOCKS_HELD + 1)]
    _held.append((items, phrases_of(items)))
    return _held[-1][1]


# --- scanning ----------------------------------------------------------------


@dataclass
class Shard:
    """Words of a shard's documents, which of them are hit, and the (document, item) pairs found."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hit: np.ndarray
    items: list[set[str]]


def scan(data: np.ndarray, offsets: np.ndarray, blocks: list) -> Shard:
    starts, ends, first = w.words(data, offsets, w.ALNUM)
    hashes = w.span_hash(data, starts, ends, fold=True)
    n, docs = len(starts), len(offsets) - 1
    hit, items = np.zeros(n, bool), [set() for _ in range(docs)]
    for block in blocks:
        phrases = _phrases(block)
        if phrases is None or not n:
            continue
        at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
        known = phrases.vocabulary[at] == hashes
        # runs of known words within a document, long enough to hold a phrase
        change = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        opens, closes = change[:-1] == 1, change[1:] == -1
        cut = first[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        opens[cut], closes[cut - 1] = known[cut], known[cut - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = b - a >= phrases.lengths.min()
        a, b = a[long], b[long]
        if not len(a):
            continue
        # each run and a separator (symbol 1) after it; word[i] is the word at position i
        sizes = b - a + 1
        ends_at = np.cumsum(sizes)
        word = np.arange(ends_at[-1]) - np.repeat(ends_at - sizes - a, sizes)
        symbols = at[np.minimum(word, n - 1)] + 2
        symbols[ends_at - 1] = 1
        index = FMIndex(symbols)
        low, high = index.search(phrases.symbols, phrases.lengths)
        found = high - low
        window = np.repeat(np.arange(len(found)), found)
        if not len(window):
            continue
        rows = np.arange(len(window)) - np.repeat(np.cumsum(found) - found - low, found)
        begin = word[index.locate(rows)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + phrases.lengths[window], -1)
        hit |= np.cumsum(edge[:-1]) > 0
        doc = np.searchsorted(first, begin, "right") - 1
        left = np.searchsorted(phrases.pairs[:, 0], np.arange(len(found) + 1))
        for d, x in np.unique(np.stack([doc, window], 1), axis=0):
            items[d].update(phrases.items[i] for i in phrases.pairs[left[x] : left[x + 1], 1])
    return Shard(starts, ends, first, hit, items)


def removal_spans(shard: Shard, doc: int) -> list[tuple[int, int]]:
    """Merged byte ranges of the shard's text from the first to the last of adjacent hit words of a document."""
    a, b = int(shard.first[doc]), int(shard.first[doc + 1])
    change = np.diff(np.concatenate([[0], shard.hit[a:b].view(np.int8), [0]]))
    return [(int(shard.starts[a + s]), int(shard.ends[a + e - 1])) for s, e in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True)]


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = w.text_bytes(batch["text"])
    for i, j in w.slices(offsets, SHARD_BYTES):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: bigint, end: bigint>>"


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found and the spans to remove, as byte ranges of its UTF-8 text."""
    blocks = broadcast_items(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _shards(batch):
                shard = scan(data, offsets, blocks)
                hits = np.concatenate([[0], np.cumsum(shard.hit)])[shard.first]
                spans = [[{"start": s - int(offsets[d]), "end": e - int(offsets[d])} for s, e in removal_spans(shard, d)] if shard.items[d] else [] for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(np.diff(shard.first), pa.int64()), pa.array(np.diff(hits), pa.int64()), pa.array([len(x) for x in shard.items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in shard.items]), pa.array(np.diff(hits) > 0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _REPORT)


def clean_text(raw: bytes, blocks: list) -> bytes:
    """The text without its removal spans, again while words brought together form another phrase."""
    while True:
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        shard = scan(data, offsets, blocks)
        spans = removal_spans(shard, 0)
        if not spans:
            return raw
        edges = [0, *(x for span in spans for x in span), len(raw)]
        raw = b" ".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns of any names, with the spans of test phrases cut from ``text``; ``n_chars`` follows where present.

    A document of which no word is left is dropped; one that had none stays.
    """
    blocks, rows = broadcast_items(benchmark), plain(docs, ("doc_id", "text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _shards(batch):
                shard, part = scan(data, offsets, blocks), batch.slice(i, j - i)
                found = [d for d in range(j - i) if shard.items[d]]
                keep = np.ones(j - i, bool)
                if found:
                    texts, at = part["text"].to_pylist(), part.schema.get_field_index("text")
                    for d in found:
                        left = clean_text(data[offsets[d] : offsets[d + 1]].tobytes(), blocks)
                        texts[d], keep[d] = left.decode(), w.ALNUM[np.frombuffer(left, np.uint8)].any()
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                    if (k := part.schema.get_field_index("n_chars")) >= 0:
                        counts = part["n_chars"].to_pylist()
                        for d in found:
                            counts[d] = len(texts[d])
                        part = part.set_column(k, part.schema.field(k), pa.array(counts, part.schema.field(k).type))
                yield part if keep.all() else part.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
