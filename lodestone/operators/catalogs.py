"""Catalogs of code, content and configuration: lookups, joins with confidence, paging, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Confidence of a match and of a guess; of an item that says none; how many a trace shows, and a search per kind.
FOUND, GUESSED, UNKNOWN = 0.9, 0.4, 0.5
TRACED, PER_KIND = 5, 5


def matching(rows: DataFrame, ident: str, label: str | None, query: str) -> DataFrame:
    """Rows whose id contains the query, or whose label does in either case."""
    test = F.col(ident).contains(query)
    if label:
        test = test | F.lower(F.col(label)).contains(query.lower())
    return rows.filter(test)


def exact_or_matching(rows: DataFrame, ident: str, query: str) -> DataFrame:
    """The row with exactly this id alone, if there is one; else those whose id contains it."""
    found = rows.filter(F.col(ident).contains(query))
    few = found.filter(F.col(ident) == query)
    hit = few.select(F.lit(1).alias("_hit")).limit(1)
    return few.unionByName(found.join(F.broadcast(hit), F.lit(True), "left_anti"))  # one row at most is broadcast


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in the given order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def best_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def handlers(routes: DataFrame, classes: DataFrame) -> DataFrame:
    """(route, controller, file, confidence): each route's file by its controller's short class name, the least of several."""
    short = F.regexp_extract("controller", r"([^\\:]+)(?:::[^\\]*)?$", 1)
    first = classes.groupBy("class").agg(F.min("file").alias("file"))
    rows = routes.withColumn("class", short).join(first, "class", "left")
    return rows.select("route", "controller", "file", F.when(F.col("file").isNull(), GUESSED).otherwise(FOUND).alias("confidence"))


def forms_with_routes(forms: DataFrame, routes: DataFrame) -> DataFrame:
    """(form, routes): the routes whose controller names the form's class as one of its parts, sorted; none gives an empty list.

    The parts of a controller are exploded and joined on equality, so nothing is
    compared with everything; parts that no form has, such as the namespace that all
    share, go before routes are gathered.
    """
    parts = routes.select("route", F.explode(F.array_distinct(F.split("controller", r"[\\:]+"))).alias("form")).join(forms.select("form").distinct(), "form", "left_semi")
    found = parts.groupBy("form").agg(F.array_sort(F.collect_set("route")).alias("routes"))
    return forms.join(found, "form", "left").select("form", F.coalesce("routes", F.array().cast("array<string>")).alias("routes"))


def trace(*domains: DataFrame, limit: int = TRACED) -> DataFrame:
    """The likeliest items (domain, name, confidence) of several domains; no confidence counts 0.5."""
    rows = domains[0]
    for d in domains[1:]:
        rows = rows.unionByName(d, allowMissingColumns=True)
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(UNKNOWN))).orderBy(F.desc("confidence"), "domain", "name").limit(limit)


def search(query: str, limit: int = PER_KIND, **kinds: DataFrame) -> DataFrame:
    """(kind, id): at most so many ids of each kind that contain the query, in order."""
    out = None
    for kind, rows in kinds.items():
        found = rows.filter(F.col("id").contains(query)).orderBy("id").limit(limit).select(F.lit(kind).alias("kind"), "id")
        out = found if out is None else out.unionByName(found)
    return out


def entries(rows: DataFrame, key: str, mapping: str, skip: tuple[str, ...] = ("_defaults",)) -> DataFrame:
    """(key, name, value): the entries of a map, without those that start with a skipped name."""
    return rows.select(key, F.explode(mapping).alias("name", "value")).filter(~F.col("name").isin(*skip))


def _definitions(files: DataFrame, at: str) -> DataFrame:
    """(file_path, name, _d): the entries of the object at a path of parsed files that are objects themselves, as variants; each file is parsed once."""
    found = files.select("file_path", F.explode(F.try_variant_get(F.try_parse_json("data"), at, "map<string,variant>")).alias("name", "_d"))
    return found.filter(F.schema_of_variant("_d").startswith("OBJECT"))


def _said(of: Column | str, at: str) -> Column:
    """A text at a path of a variant; null if there is none or it is empty."""
    return F.nullif(F.try_variant_get(of, at, "string"), F.lit(""))


def services(files: DataFrame) -> DataFrame:
    """(service_id, class, tags, file) of the services that parsed files (file_path, data) define.

    ``_defaults`` and entries that are no mappings are left out; a class that isn't
    said is empty, and tags without a name don't count.
    """
    rows = _definitions(files, "$.services").filter("name <> '_defaults'")
    names = F.transform(F.try_variant_get("_d", "$.tags", "array<variant>"), lambda x: _said(x, "$.name"))
    tags = F.coalesce(F.array_compact(names), F.array().cast("array<string>"))
    return rows.select(F.col("name").alias("service_id"), F.coalesce(_said("_d", "$.class"), F.lit("")).alias("class"), tags.alias("tags"), F.col("file_path").alias("file"))


def routes(files: DataFrame) -> DataFrame:
    """(route_name, path, controller, file) of the routes that parsed files (file_path, data) define; the controller is the form where there is none."""
    handler = F.coalesce(_said("_d", "$.defaults._controller"), _said("_d", "$.defaults._form"), F.lit(""))
    rows = _definitions(files, "$")
    return rows.select(F.col("name").alias("route_name"), F.coalesce(_said("_d", "$.path"), F.lit("")).alias("path"), handler.alias("controller"), F.col("file_path").alias("file"))


# The kinds of field that refer to something, and what they refer to unless they say.
REFERENCES, DEFAULT_TARGET = ("entity_reference", "entity_reference_revisions", "image", "file"), "node"


def reference_edges(fields: DataFrame) -> DataFrame:
    """(bundle, field, type, target_type, target_bundle): a row per target of each field that refers to something."""
    rows = fields.filter(F.col("type").isin(*REFERENCES)).withColumn("target_type", F.coalesce("target_type", F.lit(DEFAULT_TARGET)))
    return rows.select("bundle", "field", "type", "target_type", F.explode_outer("target_bundles").alias("target_bundle"))


def field_usage(fields: DataFrame, bundle: str | None = None) -> DataFrame:
    """(field, type, bundles, n): in which bundles each field is used; of one bundle, its fields alone, each with all its bundles."""
    used = fields.groupBy("field", "type").agg(F.array_sort(F.collect_set("bundle")).alias("bundles"))
    used = used.withColumn("n", F.size("bundles").cast("long"))
    return used.filter(F.array_contains("bundles", bundle)) if bundle is not None else used


# What an enrichment reply calls its parts, and how many tags of which length count.
MAX_TAGS, TAG_LENGTH = 10, 60


def enrichment(reply: Column) -> Column:
    """struct(summary, tags) of a reply with the sections SUMMARY and TAGS; null if both are empty."""
    summary = F.regexp_replace(F.regexp_replace(F.regexp_extract(reply, r"(?is)SUMMARY:\s*(.*?)\s*(?:TAGS:|$)", 1), r"^\s+", ""), r"\s+$", "")
    cut = F.split(F.regexp_extract(reply, r"(?is)TAGS:\s*(.*)$", 1), r"[,\n]+")
    tags = F.slice(F.filter(F.transform(cut, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", ""))), lambda x: (x != "") & (F.length(x) < TAG_LENGTH)), 1, MAX_TAGS)
    both = F.struct(summary.alias("summary"), tags.alias("tags"))
    return F.when((summary != "") | (F.size(tags) > 0), both)


def owners(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, owner, confidence): the least module that ships an object (1), that its name starts with (0.9), or none (0.1)."""
    shipped = files.groupBy("name").agg(F.min("module").alias("_ships"))
    head = names.withColumn("_head", F.substring_index("name", ".", 1)).join(shipped, "name", "left")
    known = files.select(F.col("module").alias("_head"), F.lit(True).alias("_known")).distinct()
    rows = head.join(known, "_head", "left")
    owner = F.coalesce("_ships", F.when(F.col("_known"), F.col("_head")))
    return rows.select("name", owner.alias("owner"), F.when(F.col("_ships").isNotNull(), 1.0).when(F.col("_known"), 0.9).otherwise(0.1).alias("confidence"))


def file_suggestions(names: DataFrame) -> DataFrame:
    """(name, place, suggestion): the template names of a hook a__b__c, the most specific first."""
    rows = names.withColumn("_p", F.split("name", "__"))
    place = rows.select("name", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_n"))
    text = F.concat(F.translate(F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "--"), "_", "-"), F.lit(".html.twig"))
    return place.select("name", (F.size("_p") - F.col("_n") + 1).cast("long").alias("place"), text.alias("suggestion"))
