"""Temperature mixing of sources, realised as budgeted block permutations, with DataFrame functions only.

A source's weight is its token share to the power of an exponent between 0 (all
sources alike) and 1 (in proportion), normalised.  The exponent is bisected: the
least one at which the mixture's entropy is no more than a target share of the
greatest possible, and no source is repeated more than a limit.

Budgets follow the weights.  Unless told otherwise the total is the least at
which no source loses a document: the one that is most over its weight is read
once, others are repeated.  A source is read in epochs, each a seeded
permutation of its own, until its budget is used; the last document may run over.
The sequence is cut in blocks that hold every source in proportion to its budget,
and each block is a seeded permutation of its rows.

Prefix sums come without gathering a source in one task: hash ranges split each
epoch of a source into buckets, sums of buckets give each its first token, and
only the rows of a bucket are sorted together.  The driver gets sums over
sources, never a row per source.

Edge cases: a document counts its words and one end mark, so none is free; a
null source is one of its own; null text has no words; rows with equal ids, or
without one, are spread and ordered by size and text; rows equal in id and text lie in
one bucket of their epoch; one source gets exponent 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.tables import materialize, plain, shuffle_width

#: Of the greatest entropy; and how often a source is read at most.
TARGET_ENTROPY, MAX_REPETITION = 0.9, 4.0
SEED = "mixing-1"
#: Tokens of all sources together in a block.
BLOCK_TOKENS = 1 << 18
#: The exponent is a multiple of one over this; each job takes six steps of bisection.
GRID, STEPS = 1 << 18, 6
_WORD = r"[^\x20\x09-\x0D]+"
_NAMES = ("doc_id", "source", "n_tokens", "epoch", "block", "position", "weight")


def tokens(text: Column) -> Column:
    """Words and an end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)) + 1).cast("long")


def _checksum(text: Column) -> Column:
    """Tells the texts of rows apart that have one id, or none."""
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)


@dataclass(frozen=True)
class Mixture:
    exponent: float
    entropy: float
    repetition: float
    total: int


def bisect_exponent(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION) -> Mixture:
    """The least exponent that meets both limits, of totals (_src, _total)."""
    n, total, most, least = totals.agg(F.count("*"), F.sum("_total"), F.max("_total"), F.min("_total")).first()
    if not n:
        return Mixture(1.0, 0.0, 1.0, 0)
    share = F.col("_total") / F.lit(float(total))
    low, high, seen = 0, GRID, {}
    repetition = lambda k: (most / least) ** (1 - k / GRID)

    def fits(k: int) -> bool:
        return seen[k] <= target_entropy * math.log(n) + 1e-12 and repetition(k) <= max_repetition + 1e-12

    while True:
        # all midpoints that the next steps can reach, evaluated together
        spans, middles = [(low, high)], set()
        for _ in range(STEPS):
            cuts = [((a + b) // 2, a, b) for a, b in spans if a < b]
            middles |= {m for m, _, _ in cuts}
            spans = [x for m, a, b in cuts for x in ((a, m), (m + 1, b))]
        asked = sorted(middles | {low, high})
        powers = [F.pow(share, F.lit(k / GRID)) for k in asked]
        row = totals.agg(*(F.sum(p) for p in powers), *(F.sum(p * F.log(share)) for p in powers)).first()
        seen |= {k: math.log(row[i]) - k / GRID * row[len(asked) + i] / row[i] for i, k in enumerate(asked)}
        for _ in range(STEPS):
            if low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if fits(middle) else (middle + 1, high)
        if low >= high:
            k = low
            if k not in seen:
                continue
            return Mixture(k / GRID, seen[k], repetition(k), total)


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))


def _budgets(totals: DataFrame, found: Mixture, budget: int | None) -> DataFrame:
    """Adds _weight, _budget (tokens) and _epochs to (_src, _total)."""
    sums = totals.agg(F.sum(F.pow(F.col("_total") / F.lit(float(max(found.total, 1))), F.lit(found.exponent))), F.max("_total")).first()
    weight = F.pow(F.col("_total") / F.lit(float(max(found.total, 1))), F.lit(found.exponent)) / F.lit(sums[0] or 1.0)
    if budget is None:
        share = F.lit(float(sums[1] or 1)) * F.pow(F.col("_total") / F.lit(float(sums[1] or 1)), F.lit(found.exponent))
    else:
        share = F.lit(float(budget)) * weight
    out = totals.withColumn("_weight", weight).withColumn("_budget", F.floor(share + 0.5).cast("long"))
    return out.withColumn("_epochs", F.ceil(F.col("_budget") / F.col("_total")).cast("int"))


def _spread(rows: DataFrame, buckets: int, seed: str) -> DataFrame:
    """A row for each epoch, with its place in that epoch's permutation and the hash range it lies in."""
    epoch = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1))) if "_epochs" in rows.columns else rows
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_tokens").cast("string"), F.col("_hash")))
    return epoch.withColumn("_key", key).withColumn("_bucket", F.expr(f"cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * {buckets}L div 4294967296L"))


def sequence(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: int | None = None, seed: str = SEED, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The mixed sequence: doc_id, source, n_tokens, epoch, block, position in the block and weight; needs doc_id, text, source.

    The columns named in ``keep`` come along, one copy for each time a row is read;
    those named like one of these (but doc_id and source themselves) get an
    underscore before.
    """
    spark = docs.sparkSession
    named, taken = {}, set(_NAMES)
    for k, c in enumerate(x for x in keep if x not in ("doc_id", "source")):
        name = c
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        named[f"_kept{k}"] = (c, name)
    rows = plain(docs, ("doc_id", "source", "text"))
    place = dict(zip(docs.columns, rows.columns, strict=True))
    base = rows.select("doc_id", "source", *(F.col(place[c]).alias(x) for x, (c, _) in named.items()), _source(rows).alias("_src"), tokens(F.col("text")).alias("_tokens"), _checksum(F.col("text")).alias("_hash"))
    sizes = materialize(base.select("doc_id", "source", "_src", "_tokens", "_hash"), "sizes")
    totals = materialize(sizes.groupBy("_src").agg(F.sum("_tokens").alias("_total"), F.count("*").alias("_rows")), "totals")
    found = bisect_exponent(totals, target_entropy, max_repetition)
    plan = materialize(_budgets(totals, found, budget).filter("_budget > 0"), "budgets")
    whole, reads = plan.agg(F.sum("_budget"), F.sum(F.col("_rows") * F.col("_epochs"))).first()
    buckets = max(16 * shuffle_width(spark), -(-(reads or 0) // 100_000))
    blocks = max(1, -(-(whole or 0) // BLOCK_TOKENS))
    share = plan.select("_src", "_total", "_budget", "_epochs", "_weight")
    sums = _spread(sizes.join(share, "_src"), buckets, seed).groupBy("_src", "_epoch", "_bucket").agg(F.sum("_tokens").alias("_n"))
    starts = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("_src").orderBy("_epoch", "_bucket")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_src", "_epoch", "_bucket").orderBy("_key", "_tokens", "_hash")
    read = _spread((base if named else sizes).join(share, "_src"), buckets, seed)
    placed = read.withColumn("_at", F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_tokens")).join(starts, ["_src", "_epoch", "_bucket"])
    used = placed.withColumn("_at", F.col("_at") + F.col("_before")).filter("_at < _budget")
    block = used.withColumn("block", F.expr(f"cast(_at * {blocks}L div _budget as long)"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("block"), F.col("block").cast("string"), F.col("_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    position = F.row_number().over(Window.partitionBy("block").orderBy("_order", "_epoch", "_tokens", "_hash")) - 1
    return block.withColumn("_order", order).select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), "block", position.cast("long").alias("position"), F.round("_weight", 6).alias("weight"), *(F.col(x).alias(name) for x, (_, name) in named.items()))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, their own columns of any names, as often as the sequence reads them."""
    rows = plain(docs, ("doc_id", "source", "text"))
    return sequence(rows, keep=rows.columns, **options).select(*rows.columns).toDF(*docs.columns)


ORACLE_SQL = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE 's:' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) + 1 AS n_tokens, substr(md5(coalesce(text, '')), 1, 16) AS hash FROM documents
), totals AS (
  SELECT src, sum(n_tokens) AS total FROM sizes GROUP BY src
), lists AS (
  SELECT list(CAST(total AS DOUBLE) / (SELECT sum(total) FROM totals)) AS p, max(total) AS most, min(total) AS least, count(*) AS n FROM totals
), search(lo, hi) AS (
  SELECT 0, {GRID}
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT lo, hi, mid,
               ln(z) - a * list_sum(list_transform(p, lambda x: pow(x, a) * ln(x))) / z <= {TARGET_ENTROPY}::DOUBLE * ln(n) + 1e-12
               AND pow(CAST(most AS DOUBLE) / least, 1 - a) <= {MAX_REPETITION}::DOUBLE + 1e-12 AS fits
        FROM (SELECT *, list_sum(list_transform(p, lambda x: pow(x, a))) AS z
              FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, CAST((lo + hi) // 2 AS DOUBLE) / {GRID} AS a, p, most, least, n FROM search, lists WHERE lo < hi)))
), chosen AS (
  SELECT CAST(lo AS DOUBLE) / {GRID} AS a FROM search WHERE lo >= hi
), plan AS (
  SELECT src, total, pow(CAST(total AS DOUBLE) / (SELECT sum(total) FROM totals), a) AS q,
         CAST(floor(CAST((SELECT most FROM lists) AS DOUBLE) * pow(CAST(total AS DOUBLE) / (SELECT most FROM lists), a) + 0.5) AS BIGINT) AS budget
  FROM totals, chosen
), epochs AS (
  SELECT sizes.*, total, budget, q / (SELECT sum(q) FROM plan) AS w, unnest(range(CAST(ceil(CAST(budget AS DOUBLE) / total) AS BIGINT))) AS epoch
  FROM sizes JOIN plan USING (src)
), placed AS (
  SELECT *, epoch * total + sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || n_tokens || ':' || hash)) - n_tokens AS head
  FROM epochs
), blocks AS (
  SELECT *, CAST(head * (SELECT greatest(1, CAST(ceil(sum(budget) / {BLOCK_TOKENS}.0) AS BIGINT)) FROM plan) // budget AS BIGINT) AS block FROM placed WHERE head < budget
)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('{SEED}:block:' || block || ':' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), epoch, n_tokens, hash) - 1 AS position,
       round(w, 6) AS weight
FROM blocks
"""
