"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

A scan of each whole text gives candidates: the base kinds (assignments, access
keys, long hex runs) and generic tokens of letters and digits.  The hash of each
candidate's value is counted over the corpus by distinct repositories and
distinct owners.  A value that many owners hold, or that is spread over many
repositories of few, is a widely copied example; one that few hold, and that
looks like a credential, is live.

Base spans are always reported.  The method adds generic tokens, but only live
ones: without the counts a long identifier and a leaked key look alike.

Texts are scanned once and never shuffled.  Hashes are first reduced to distinct
(hash, owner, repository), then to one row per (hash, owner), then per hash, each
step combined before its shuffle, so a value in a third of all rows is no single
task.  The counts are written, and joined back on the hash by a join that adaptive
execution can split.

Edge cases: null text is empty; a null owner or repository counts as one of its
own; rows with one id are scanned each for itself; an empty table gives no rows.
Spans are in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.tables import materialize

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token"))
# The kinds of the contract, in the order in which equal starts are listed, then the method's own.
KINDS = {
    "assign": rf"""({_ANY_CASE}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "generic": r"[A-Za-z0-9_-]{20,}",
}
BASE = ("assign", "access", "hex")
#: An assignment's value has so many characters at least.
ASSIGN_LENGTH = 6
#: A generic token holds three digits and two letters at least, in any places.
GENERIC = r"^(?:[^0-9]*[0-9]){3}", r"^(?:[^A-Za-z]*[A-Za-z]){2}"
#: A value that so many owners, or so many repositories of any owners, hold is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 25
#: Marks of placeholders, in lower-cased values.
PLACEHOLDER = "example|changeme|placeholder|xxxx|your_|dummy"
_ROW = "_row"


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches, and the lengths of what lies before each of them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return matches, F.when(F.size(matches) > 0, F.slice(gaps, 1, F.size(matches)))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Written table of one row per document: _row, doc_id, owner, repository and the matches of each kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias(_ROW), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), body.alias("_text"))
    for kind, pattern in KINDS.items():
        matches, gaps = _found(F.col("_text"), pattern)
        out = out.withColumns({f"{kind}_m": matches, f"{kind}_g": gaps})
    return materialize(out.drop("_text"), "secrets")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per span: _row, owner, repository, kind, start, end, value, hash."""
    parts = []
    for kind in KINDS:
        rows = scanned.filter(F.size(f"{kind}_m") > 0).select(_ROW, "owner", "repository", F.lit(kind).alias("kind"), F.posexplode(F.arrays_zip(F.col(f"{kind}_m").alias("m"), F.col(f"{kind}_g").alias("g"))).alias("_i", "_x"))
        parts.append(rows.select(_ROW, "owner", "repository", "kind", "_i", F.col("_x.m").alias("match"), F.col("_x.g").alias("gap")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    upto = Window.partitionBy(_ROW, "kind").orderBy("_i")
    placed = rows.withColumn("end", F.sum(F.length("match") + F.col("gap")).over(upto)).withColumn("start", F.col("end") - F.length("match"))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", KINDS["assign"], 2)).otherwise(F.col("match"))
    placed = placed.withColumn("value", value).filter((F.col("kind") != "assign") | (F.length("value") >= ASSIGN_LENGTH))
    fits = (F.col("kind") != "generic") | (F.col("value").rlike(GENERIC[0]) & F.col("value").rlike(GENERIC[1]))
    placed = placed.filter(fits)
    # a generic token that meets a base span adds nothing: the furthest base end before it and the next base start tell
    base = F.col("kind") != "generic"
    running = (Window.unboundedPreceding, -1)
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy(_ROW).orderBy("start", "end", "kind").rowsBetween(*running))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy(_ROW).orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(*running))
    clear = placed.withColumn("_before", before).withColumn("_after", after).filter(base | ((F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))))
    return clear.select(_ROW, "owner", "repository", "kind", "start", "end", "value", F.sha2("value", 256).alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: in how many distinct repositories and owners it occurs, and whether it is live."""
    held = found.select("hash", "owner", "repository", "value").groupBy("hash", "owner", "repository").agg(F.first("value").alias("value"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    counts = owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.first("value").alias("value"))
    lower = F.lower("value")
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES) & ~lower.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split("value", ""))) > ASSIGN_LENGTH)
    return counts.select("hash", "n_repositories", "n_owners", live.alias("live"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per document: counts and digest of base spans, all spans, and how many are live or widely copied examples."""
    scanned = scan(docs, text, owner, repository)
    found = materialize(candidates(scanned), "candidates")
    judged = found.select(_ROW, "kind", "start", "end", "hash").join(materialize(ownership(found), "ownership"), "hash").filter((F.col("kind") != "generic") | F.col("live"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "live", "n_repositories")
    spans = judged.groupBy(_ROW).agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    rows = scanned.select(_ROW, "doc_id").join(spans, _ROW, "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string,live:boolean,n_repositories:bigint>>")))
    count = lambda test: F.size(F.filter("_spans", test)).cast("long")
    return rows.select(
        "doc_id",
        *(count(_of_kind(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.filter("_spans", lambda s: s["kind"] != "generic")), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        F.coalesce(F.array_max(F.transform("_spans", lambda s: s["n_repositories"])), F.lit(0)).alias("most_repositories"),
    )


def _sql_spans(kind: str) -> str:
    pattern = KINDS[kind].replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', 2)" if kind == "assign" else "m"
    return f"""
  SELECT r, owner, doc_id, '{kind}' AS kind, stop - length(m) AS start, stop, {value} AS value
  FROM (SELECT r, owner, doc_id, m, sum(length(m) + length(g)) OVER (PARTITION BY r ORDER BY i) AS stop
        FROM (SELECT r, owner, doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m,
                     unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS g,
                     unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i
              FROM docs WHERE regexp_matches(t, '{pattern}')))"""


_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop){}, '')"
ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS owner, coalesce(text, '') AS t FROM documents
), spans AS ({" UNION ALL ".join(map(_sql_spans, KINDS))}
), fit AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'generic'], kind) AS rank FROM spans
  WHERE (kind <> 'assign' OR length(value) >= {ASSIGN_LENGTH})
    AND (kind <> 'generic' OR (regexp_matches(value, '{GENERIC[0]}') AND regexp_matches(value, '{GENERIC[1]}')))
), clear AS (
  SELECT * FROM fit a WHERE kind <> 'generic'
     OR NOT EXISTS (SELECT 1 FROM fit b WHERE b.r = a.r AND b.kind <> 'generic' AND b.start < a.stop AND a.start < b.stop)
), held AS (
  SELECT value, count(DISTINCT (owner, doc_id)) AS n_repositories,
         count(DISTINCT coalesce(owner, '-')) < {EXAMPLE_OWNERS} AND count(DISTINCT (owner, doc_id)) < {EXAMPLE_REPOSITORIES} AND NOT regexp_matches(lower(value), '{PLACEHOLDER}')
         AND list_unique(string_split(value, '')) > {ASSIGN_LENGTH} AS live
  FROM clear GROUP BY value
), kept AS (
  SELECT clear.*, live, n_repositories FROM clear JOIN held USING (value) WHERE kind <> 'generic' OR live
)
SELECT docs.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({_LIST.format(" FILTER (kind <> 'generic')")}) AS base_sha256, {_LIST.format("")} AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, coalesce(max(n_repositories), 0) AS most_repositories
FROM docs LEFT JOIN kept USING (r) GROUP BY docs.r, docs.doc_id
"""
