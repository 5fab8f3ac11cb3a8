"""Near-duplicates by circulant MinHash, banding and exact verification.

A document is its set of 5-word shingles.  One permutation sends each shingle to
a slot of a ring; the second numbers the slots, and signature coordinate k is the
least number among the document's slots after the ring is turned by k.  Turning
means reading the next entry of one table, so all coordinates of a shingle are
one contiguous slice.

Rows with equal sets are one class, known by the number of one of its rows.  A
class's signature is cut in bands; classes that share a band share a bucket.  No
bucket is expanded into its pairs, and signatures stay where they were made: what
is shuffled is a bucket's key and a class's number.

1. Each bucket's members are paired with its least and its greatest member.  Of
   these pairs sizes and a bitmap of each set (bit parity of 512 hashed counts,
   an exact bound on how much two sets differ) rule out most; the others are
   compared on full sets.  Links join classes into components.
2. A bucket is open while members besides those two are of several components.
   The classes of open buckets are joined on prefixes: shingles in one order,
   first those that only one component holds, then rarest first.  Two sets at
   the threshold share a shingle that stands, in both, before the place from
   which the rest is too short to reach it; so only these places are joined, and
   a family of texts on one template, whose common part stands last, joins
   nothing.  The pairs found are bounded and compared as before.

So every pair that shares a band is compared, or ruled out by an exact bound, or
already in one component.  With 32 bands of 6 coordinates a pair at similarity
0.85 shares none with probability 2.6e-7.

Edge cases: fewer than 5 words are one shingle; no words, or null text: the
empty set, linked with nothing; rows with one id and other texts are compared as
documents of their own; a null id is linked with nothing and kept; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as w
from lodestone.llm.graph import components
from lodestone.llm.tables import Owned, column, materialize

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Smaller sets are linked with equal ones alone: one shingle of difference is too much.
LEAST = -(-PERCENT // (100 - PERCENT))
#: Bits of a slot: the ring has 2**21 of them.
SLOT_BITS = 21
#: 64-bit words of a set's bitmap.
BITMAP = 8
_STEP = 4096
_BITS = [f"p{i}" for i in range(BITMAP)]


@cache
def _ring() -> np.ndarray:
    """Row s: the numbers of the slots s, s + 1, ... of the ring, one for each coordinate."""
    numbers = np.random.default_rng(8).permutation(1 << SLOT_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[:COORDINATES]]), COORDINATES)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    starts, ends, first = w.words(data, offsets, w.NOT_SPACE)
    hashes = w.span_hash(data, starts, ends, fold=True)
    grams = w.gram_hash(hashes, SHINGLE)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        else:
            yield w.mix(w.gram_hash(hashes[a:b], int(b - a)) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set."""
    slots = w.mix(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - SLOT_BITS)
    ring = _ring()
    out = ring[slots[:_STEP]].min(axis=0)
    for i in range(_STEP, len(slots), _STEP):
        out = np.minimum(out, ring[slots[i : i + _STEP]].min(axis=0))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature one hash of each band, of the band's coordinates and its number."""
    coordinates = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), coordinates.shape[:2])
    for k in range(ROWS):
        key = w.mix(key * np.uint64(0x9E3779B97F4A7C15) + coordinates[:, :, k])
    return key.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 512 hashed places: two sets differ by at least as many shingles as bits."""
    places = w.mix(shingles ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(55)
    return np.packbits(np.bincount(places, minlength=64 * BITMAP) & 1 == 1).view("<i8")


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, th): doc_id, th, n_shingles, a digest of the set, band keys and bitmap (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                counts, digests, signed, bits, at = [], [], [], [], []
                for k, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s) >= LEAST:
                        at.append(k)
                        signed.append(signature(s))
                        bits.append(bitmap(s))
                sizes = np.zeros(j - i + 1, np.int32)
                sizes[np.array(at, int) + 1] = BANDS
                keys = band_keys(np.array(signed)).ravel() if at else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(keys, pa.int64()))
                maps = np.zeros((j - i, BITMAP), np.int64)
                if at:
                    maps[at] = bits
                own = [batch["doc_id"].slice(i, j - i), batch["th"].slice(i, j - i), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(maps[:, k]) for k in range(BITMAP))], names=["doc_id", "th", "n_shingles", "digest", "bands", *_BITS])

    columns = ", ".join(f"{b} long" for b in _BITS)
    return docs.select("doc_id", "text", "th").mapInArrow(run, f"doc_id long, th long, n_shingles long, digest binary, bands array<bigint>, {columns}")


def _sets(docs: DataFrame) -> DataFrame:
    """Per class (docs: node, text): node and its sorted shingle hashes. Repeated rows that follow each other give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            node = batch["node"].to_numpy()
            fresh = np.append(True, node[1:] != node[:-1])
            fresh[0] = before is None or node[0] != before
            before = node[-1]
            batch = batch.filter(pa.array(fresh))
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                sets = list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(i, j - i), lists], names=["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node long, hashes array<bigint>")


def _fits(a: str, b: str) -> Column:
    """Whether two sets' sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _bounded(left: list[str], right: list[str], na: str, nb: str) -> Column:
    """Whether two sets' bitmaps allow a link.

    A link needs a union of at most 100/85 of the common part, so the sets may differ by 15/185 of both sizes together.
    """
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(left, right, strict=True)))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(na) + F.col(nb))


def _possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that sizes and bitmaps don't rule out."""
    left = facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), *(F.col(p).alias(f"a{p}") for p in _BITS))
    right = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), *(F.col(p).alias(f"b{p}") for p in _BITS))
    bound = _bounded([f"a{p}" for p in _BITS], [f"b{p}" for p in _BITS], "na", "nb")
    return pairs.join(right, "b").join(left, "a").filter(_fits("na", "nb") & bound).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right, left = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _buckets(classes: DataFrame) -> DataFrame:
    """Written rows (key, node, lo, hi): the members of each band that several classes share, its least and greatest one."""
    bands = classes.select("node", F.explode("bands").alias("key"))
    shared = materialize(bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"), "buckets")
    return materialize(bands.join(shared, "key"), "members")


def _with_ends(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each member with its bucket's least and greatest one."""
    both = F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))
    return members.select(F.explode(both).alias("p")).select("p.a", "p.b").filter("a < b").distinct()


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Distinct (node, c): the classes, and their components, of buckets in which members besides the ends are of several components."""
    inner = members.filter("node > lo and node < hi").select("key", "node")
    labelled = materialize(inner.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "labelled")
    apart = materialize(labelled.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("key"), "open")
    return labelled.join(apart, "key").select("node", "c").distinct()


def _prefixes(open_: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Written rows (token, node, c, n, pos, bitmap) for the shingles, held by several components, that a link of the class could start with."""
    tokens = open_.join(facts.select("node", F.col("n_shingles").alias("n")), "node").join(sets, "node").select("node", "c", "n", F.explode("hashes").alias("token"))
    held = materialize(tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("token", "df"), "held")
    own = materialize(tokens.join(held, "token").select("node", "c", "n", "token", "df"), "shared")
    ranked = own.groupBy("node").agg(F.any_value("c").alias("c"), F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    placed = ranked.select("node", "c", "n", F.size("own").alias("m"), F.posexplode("own").alias("k", "x")).select(F.col("x.token").alias("token"), "node", "c", "n", (F.col("n") - F.col("m") + F.col("k")).alias("pos"))
    early = placed.filter(100 * (F.col("n") - F.col("pos")) >= PERCENT * F.col("n"))
    return materialize(early.join(facts.select("node", *_BITS), "node"), "prefixes")


def _joined_on_prefixes(prefixes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a shingle early enough in both sets and that their bitmaps don't rule out.

    Places and bitmaps are conditions of the join: a pair that they rule out is never written.
    """
    one = prefixes.select("token", *(F.col(x).alias(f"{x}a") for x in ("node", "c", "n", "pos", *_BITS)))
    two = prefixes.select("token", *(F.col(x).alias(f"{x}b") for x in ("node", "c", "n", "pos", *_BITS)))
    left = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    enough = (100 + PERCENT) * left >= PERCENT * (F.col("na") + F.col("nb"))
    near = _bounded([f"{p}a" for p in _BITS], [f"{p}b" for p in _BITS], "na", "nb")
    found = one.join(two, "token").filter((F.col("nodea") < F.col("nodeb")) & (F.col("ca") != F.col("cb")) & _fits("na", "nb") & enough & near)
    return found.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of all classes that are linked with another."""
    facts = classes.select("node", "n_shingles", *_BITS)
    members = _buckets(classes)
    pairs = materialize(_possible(_with_ends(members), facts), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.filter("node > lo and node < hi").select("node")).distinct()
    named = classes.select("node", "doc_id", "th").join(asked, "node", "left_semi")
    sets = materialize(_sets(docs.join(named, ["doc_id", "th"])), "sets")
    joined = components(_similar(pairs, sets))
    prefixes = _prefixes(_open(members, joined), facts, sets)
    more = materialize(_possible(_joined_on_prefixes(prefixes), facts), "pairs")
    edges = _similar(more, sets).unionByName(joined.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(edges)


def _placed(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, th (a hash of the text), n_shingles, group (null if linked with nothing by definition) and component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    with Owned() as owned:
        sketch = materialize(sketches(rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
        found = sketch.filter("digest is not null and doc_id is not null")
        classes = materialize(found.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "classes")
        banded = materialize(found.filter(F.size("bands") > 0).join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "banded")
        linked = materialize(classes.join(_links(rows, banded), "node").select("digest", "rep", "component"), "linked")
        least = materialize(linked.groupBy("component").agg(F.min("rep").alias("least")), "least")
        of_class = linked.join(least, "component").select("digest", "component", "least")
        named = materialize(classes.join(of_class, "digest", "left").select("digest", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("component_id")), "named")
        owned.keep(sketch, named)
    own = sketch.filter("digest is null or doc_id is null").select("doc_id", "th", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "th", "n_shingles", "digest").join(named, "digest").select("doc_id", "th", "n_shingles", "group", "component_id").unionByName(own)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _placed(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each group stays: the one with the smallest id.

    Of rows that share that id within one group, the one with the least hash of
    its text stays; of rows equal in id and text one.  Rows without an id all stay.
    """
    names = docs.columns
    with Owned() as owned:
        placed = materialize(_placed(docs).filter("doc_id = component_id").select("doc_id", "th", "group"), "kept")
        owned.keep(placed)
    first = placed.filter("group is not null").groupBy("group", "doc_id").agg(F.min("th").alias("th")).select("doc_id", "th")
    stay = first.unionByName(placed.filter("group is null").select("doc_id", "th")).distinct().select(F.col("doc_id").alias("_lodestone_id"), F.col("th").alias("_lodestone_th"))
    keyed = docs.filter("doc_id is not null").withColumns({"_lodestone_id": F.col("doc_id").cast("long"), "_lodestone_th": F.xxhash64("text")})
    one = keyed.dropDuplicates(["_lodestone_id", "_lodestone_th"]).join(stay, ["_lodestone_id", "_lodestone_th"], "left_semi")
    return docs.filter("doc_id is null").unionByName(one.select(*map(column, names)))
