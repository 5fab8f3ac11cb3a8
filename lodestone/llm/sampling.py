"""Bounded samples of rows and of labels, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """At most ``most`` distinct ids (doc_id) in the order of a salted hash, the same ones however the rows are dealt.

    A threshold on the hash first brings the rows near the bound, so the last
    sort is over little more than the bound, whatever the input.
    """
    total = ids.count()
    key = F.xxhash64(F.lit(salt), F.col("doc_id"))
    share = min(1.0, 1.5 * most / max(total, 1) + 1000 / max(total, 1))
    near = ids.filter(F.col("doc_id").isNotNull()).select("doc_id", key.alias("_k")).filter(F.pmod("_k", F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.distinct().orderBy("_k", "doc_id").limit(most).select("doc_id")


def taken(made: DataFrame, size: str, budget: int, most: int) -> list[Row]:
    """Rows of made (k, doc_id, and a number ``size``) in the order of k and doc_id, each that fits into what is left of the budget.

    Sizes of at most ``most`` rows come to the driver first, then the rows chosen: no more than the budget.
    Rows equal in k and doc_id count once.
    """
    left, keys = budget, []
    for x in made.select("k", "doc_id", size).distinct().orderBy("k", "doc_id").limit(most).collect():
        if x[size] <= left:
            left -= x[size]
            keys.append((x["k"], x["doc_id"]))
    chosen = made.sparkSession.createDataFrame(keys, "k long, doc_id long")
    return sorted(made.join(F.broadcast(chosen), ["k", "doc_id"]).dropDuplicates(["k", "doc_id"]).collect(), key=lambda x: (x["k"], x["doc_id"]))
