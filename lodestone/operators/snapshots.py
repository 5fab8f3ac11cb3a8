"""Two snapshots of named objects compared, their dependencies and the risk of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scratch import spread


def risk(name: Column, changed: Column) -> Column:
    """How risky a change of an object is, by its name and changed keys."""
    high = name.isin("system.site", "core.extension") | name.startswith("field.storage.") | name.startswith("node.type.")
    return F.when(high, "high").when(F.array_contains(changed, "dependencies"), "medium").otherwise("low")


def diff(active: DataFrame, sync: DataFrame) -> DataFrame:
    """(name, status, changed_keys, risk_level) of two snapshots (name, data map<string,string>).

    An object that only the target has is added, one that only the current state
    has is removed (always a high risk), else it is changed or identical.  Keys
    are compared as a set, so their order doesn't matter.
    """
    a, b = active.select("name", F.col("data").alias("_a")), sync.select("name", F.col("data").alias("_b"))
    rows = a.join(b, "name", "full_outer")
    keys = F.array_union(F.coalesce(F.map_keys("_a"), F.array().cast("array<string>")), F.coalesce(F.map_keys("_b"), F.array().cast("array<string>")))
    unequal = F.filter(keys, lambda k: ~F.try_element_at(F.col("_a"), k).eqNullSafe(F.try_element_at(F.col("_b"), k)))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(unequal) == 0, "identical").otherwise("changed")
    out = rows.select("name", status.alias("status"), F.array_sort(unequal).alias("changed_keys"))
    level = F.when(F.col("status") == "removed", "high").when(F.col("status") == "added", "low").otherwise(risk(F.col("name"), F.col("changed_keys")))
    return out.withColumn("risk_level", level)


def drift(diffed: DataFrame, prefix: str = "") -> DataFrame:
    """The objects under a prefix that aren't identical."""
    return diffed.filter(F.col("name").startswith(prefix) & (F.col("status") != "identical"))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (name, required_by), dealt out before they are compared: few are equal, so a task that combined them first would hold all of its share of the input."""
    return spread(pairs, "name", "required_by").distinct()


def dependents(objects: DataFrame, depth: int = 1) -> DataFrame:
    """(name, required_by, depth) from objects (name, depends_on array<string>): who needs an object, directly or over others."""
    direct = _distinct_pairs(objects.select(F.explode("depends_on").alias("name"), F.col("name").alias("required_by")))
    out, level = direct.withColumn("depth", F.lit(1)), direct
    for d in range(2, depth + 1):
        step = level.select("name", F.col("required_by").alias("_via")).join(direct.select(F.col("name").alias("_via"), "required_by"), "_via").select("name", "required_by")
        level = _distinct_pairs(step).join(out, ["name", "required_by"], "left_anti")
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out


def impact(diffed: DataFrame, needed: DataFrame) -> DataFrame:
    """(name, status, risk_level, dependents, touched_domains, followups) of each object that changes."""
    many = needed.filter("depth = 1").groupBy("name").agg(F.count("*").alias("dependents"))
    rows = diffed.filter("status <> 'identical'").join(many, "name", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0).cast("long")))
    domains = {"field.": "data_schema", "views.view.": "ui_display", "core.extension": "module_lifecycle"}
    touched = F.array_compact(F.array(*(F.when(F.col("name").startswith(k), v) for k, v in domains.items())))
    follow = F.array_compact(F.array(F.when(F.col("risk_level") == "high", "backup"), F.when(F.col("dependents") > 0, "verify dependents")))
    return rows.select("name", "status", "risk_level", "dependents", touched.alias("touched_domains"), follow.alias("followups"))


def deployment_risk(drifted: DataFrame) -> DataFrame:
    """One row: how many objects drift, how many of them risk schema or modules, and their least names (ten at most)."""
    risky = F.col("name").contains("field.storage") | F.col("name").contains("core.extension")
    return drifted.agg(F.count("*").alias("drifting"), F.count_if(risky).alias("risky"), F.min(F.when(risky, F.col("name"))).alias("first_risky"))
