"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are put in a seeded random order; the row of rank r among n has
the fractional rank (r - u) / n, where u in [0, 1) is drawn from the source's
name.  All rows sorted by fractional rank are cut into equal runs.  Any run then
holds each source in proportion to its size, within one row at either end.

Ranks come without gathering a source (or the corpus) in one task: a hash range
splits each source into buckets, counts of buckets give each its first rank, and
only the rows of a bucket are sorted together.

Edge cases: a null source is a stratum of its own; a null text has size 1 and
the checksum of no bytes; rows with equal ids are ordered by checksum and size;
rows equal in all three are interchangeable and
lie in one bucket of their source; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.tables import column, materialize, shuffle_width

SHARDS, SEED = 16, "mixture-1"
#: Rows that a bucket should hold at most, where the corpus is large.
BUCKET_ROWS = 100_000


def _unit(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("long")


def _keyed(docs: DataFrame, buckets: int, seed: str) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_crc").cast("string")))
    src = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    return docs.withColumns({"_key": key, "_src": src}).withColumns({"_u": _unit(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_src")), 1, 8)) / F.lit(float(1 << 32)), "_bucket": F.expr(f"cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * {buckets}L div 4294967296L")})


def _fractions(docs: DataFrame, buckets: int, runs: int, seed: str, order: list[str]) -> DataFrame:
    """Adds _f, the fractional rank within the source, and _run, which range of fractions it lies in."""
    rows = _keyed(docs, buckets, seed)
    counts = _keyed(docs.select("doc_id", "source", "_crc"), buckets, seed).groupBy("_src", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_bucket")
    starts = counts.select("_src", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy("_src")).alias("_total"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_src", "_bucket").orderBy("_key", *order)))
    placed = ranked.join(starts, ["_src", "_bucket"]).withColumn("_f", (F.col("_start") + F.col("_rank") - F.col("_u")) / F.col("_total"))
    return placed.withColumn("_run", F.least(F.floor(F.col("_f") * runs), F.lit(runs - 1))).drop("_start", "_total", "_rank")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Each row's shard and slot; needs doc_id, text, source.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and the
    columns named in ``keep``, those that are named like one of these with an
    underscore before.  Shards' row counts differ by one at most; slots of a
    shard run from 0 without gaps in order of fractional rank.
    """
    spark = docs.sparkSession
    named, taken = {}, {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for k, c in enumerate(x for x in keep or [] if x != "doc_id"):
        name = c
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        named[f"_kept{k}"] = (c, name)
    total = docs.count()
    buckets = runs = max(16 * shuffle_width(spark), -(-total // BUCKET_ROWS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", *(column(c).alias(k) for k, (c, _) in named.items()), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"))
    ranked = materialize(_fractions(rows, buckets, runs, seed, ["_crc", "_size"]), "fractions")
    per_run = ranked.groupBy("_run").agg(F.count("*").alias("_n"))
    starts = per_run.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_run").orderBy("_f", "_src", "_key", "_crc", "_size")
    placed = ranked.withColumn("_rank", F.row_number().over(inside))
    place = placed.join(starts, "_run").withColumn("_p", F.col("_start") + F.col("_rank") - 1)
    n = max(total, 1)
    shard = F.expr(f"_p * {shards}L div {n}L")
    return place.withColumn("_shard", shard).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_p - (_shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(F.col(k).alias(name) for k, (_, name) in named.items()),
    )


#: CRC-32 of the text's bytes, by a table built from the reflected polynomial 0xEDB88320.
CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
), sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                 lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM documents, crc_table
)"""

ORACLE_SQL = f"""
WITH {CRC_SQL}, keyed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE 's:' || source END AS src,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32) AS k, strlen(coalesce(text, '')) + 1 AS size, text_crc32
  FROM documents JOIN sums USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY k) AS r, count(*) OVER (PARTITION BY src) AS n,
         CAST(CAST('0x' || substr(md5('{SEED}:' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (CAST(r AS DOUBLE) - u) / n, src, k) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * {SHARDS} // total AS INTEGER) AS shard,
       CAST(p - ((p * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
