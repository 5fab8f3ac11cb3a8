"""Neighbours of chunks, context packs under a budget, and reordering by an outside judge."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as t

#: How many of the best rows a judge may reorder.
RERANKED = 20


def placed(chunks: DataFrame) -> DataFrame:
    """Adds ``rn``, the chunk's place in its file."""
    return chunks.withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id")))


def neighbors(chunks: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """For each target (chunk_id): the chunks of its file from ``before`` places before to ``after`` places after, and the hop.

    Places are counted in the targets' files alone and without the texts, which are joined to what was found.
    """
    wanted = targets.select("chunk_id").distinct()
    keys = chunks.select("chunk_id", "file_path", "start_line")
    files = keys.join(wanted, "chunk_id", "left_semi").select("file_path").distinct()
    rows = placed(keys.join(files, "file_path", "left_semi"))
    at = rows.join(wanted, "chunk_id", "left_semi").select("file_path", F.col("chunk_id").alias("target"), F.col("rn").alias("_at"))
    spread = at.withColumn("rn", F.explode(F.sequence(F.col("_at") - before, F.col("_at") + after)))
    near = rows.join(spread, ["file_path", "rn"]).select("chunk_id", "rn", "target", (F.col("rn") - F.col("_at")).cast("long").alias("hop"))
    return chunks.join(near, "chunk_id")


def pack(chunks: DataFrame, hits: DataFrame, max_files: int, max_chars: int, hops: int, keep: str = "middle") -> DataFrame:
    """Excerpts around ranked hits (chunk_id, file_path, rank): at most so many files and characters.

    A file counts from its first hit on.  Each hit is followed by its neighbours,
    before and after; a chunk that comes twice counts once.  An excerpt is given
    while the texts before it are shorter than the budget, and cut to what is left.
    """
    first = hits.groupBy("file_path").agg(F.min("rank").alias("_first"))
    files = first.withColumn("_n", F.row_number().over(Window.orderBy("_first"))).filter(F.col("_n") <= max_files).select("file_path")
    primaries = hits.join(files, "file_path", "left_semi").select(F.col("chunk_id").alias("target"), "rank")
    around = neighbors(chunks, primaries.withColumnRenamed("target", "chunk_id"), hops, hops).join(primaries, "target")
    side = F.when(F.col("hop") == 0, 0).when(F.col("hop") < 0, 1).otherwise(2)
    once = around.withColumn("_side", side).withColumn("_k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank", "_side", "rn"))).filter("_k = 1")
    # at most max_files files and the hits' neighbours are left here
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy("rank", "_side", "rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = once.withColumn("_room", F.lit(max_chars) - before).filter("_room > 0")
    return fit.select("file_path", "start_line", "chunk_id", "rank", _cut("text", "_room", keep).alias("excerpt"), (F.length("text") > F.col("_room")).alias("cut"))


def _cut(text: str, room: str, keep: str):
    """The same cut as of a fixed length, with the length in a column."""
    x, n = F.col(text), F.col(room).cast("int")
    right = lambda k: F.when(k > 0, F.substring(x, -k, k)).otherwise("")
    if keep == "head":
        short = F.concat(F.substring(x, F.lit(1), n), F.lit(" …"))
    elif keep == "tail":
        short = F.concat(F.lit("… "), right(n))
    else:
        spare = n - 3
        head, tail = F.floor((spare + 1) / 2).cast("int"), F.floor(spare / 2).cast("int")
        short = F.when(spare <= 0, F.substring(x, F.lit(1), n)).otherwise(F.concat(F.substring(x, F.lit(1), head), F.lit("\n…\n"), right(tail)))
    return F.when(F.length(x) <= n, x).otherwise(short)


def parse_order(reply: str, n: int) -> list[int]:
    """The distinct numbers from 1 to n in the first bracketed list of a judge's reply."""
    found = re.search(r"\[([^\]]*)\]", reply)
    numbers = [int(x) for x in re.findall(r"\d+", found[1])] if found else []
    return list(dict.fromkeys(x for x in numbers if 1 <= x <= n))


def rerank(rows: DataFrame, order: list[int]) -> DataFrame:
    """Ranked rows with ``reranked``: those listed first, then the rest, then what lies beyond the judged rows."""
    place = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(order, 1))):
        place = F.when(F.col("rank") == k, i).otherwise(place)
    keys = (F.when(F.col("rank") > RERANKED, 1).otherwise(0), F.asc_nulls_last("_p"), F.col("rank"))
    return rows.withColumn("_p", place).withColumn("reranked", F.row_number().over(Window.orderBy(*keys)).cast("long")).drop("_p")


def view(chunks: DataFrame, fields: list[str], max_chars: int = 0) -> DataFrame:
    """The named columns that there are, the text cut to max_chars (0: whole)."""
    rows = chunks.withColumn("text", t.truncate(F.col("text"), max_chars)) if max_chars else chunks
    return rows.select([c for c in fields if c in rows.columns])
