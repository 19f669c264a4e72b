"""Which techniques a library claims and has shown to detect, against a catalogue with revoked entries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def techniques_of(tags: Column) -> Column:
    """Technique ids in an array of tags, sorted and distinct."""
    named = F.filter(F.transform(tags, F.lower), lambda t: t.rlike(r"^attack\.t[0-9]{4}(\.[0-9]{3})?$"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda t: F.upper(F.substring(t, 8, 20)))))


def parent(technique: Column) -> Column:
    return F.substring_index(technique, ".", 1)


def active(catalog: DataFrame, platform: str | None = None, sub: bool = True) -> DataFrame:
    """Techniques neither revoked nor deprecated, of a platform in any case, with or without sub-techniques."""
    out = catalog.filter("not revoked and not deprecated")
    if platform:
        out = out.filter(F.exists("platforms", lambda p: F.lower(p) == platform.lower()))
    return out if sub else out.filter("not is_subtechnique")


def resolve(catalog: DataFrame) -> DataFrame:
    """id, resolved: where a chain of revocations ends, null if that one isn't active, isn't there, or the chain is a circle.

    Only revoked techniques lead on. A chain keeps the ids that it has seen and goes to none of them again, so it ends.
    """
    spark = catalog.sparkSession
    catalog.select("id", "revoked", "revoked_by", (~F.col("revoked") & ~F.col("deprecated")).alias("live")).createOrReplaceTempView("__catalog")
    chain = spark.sql("""
        WITH RECURSIVE chain(id, at, seen) AS (
            SELECT id, id, array(id) FROM __catalog
            UNION ALL
            SELECT c.id, k.revoked_by, array_append(c.seen, k.revoked_by) FROM chain c JOIN __catalog k ON c.at = k.id
            WHERE k.revoked AND k.revoked_by IS NOT NULL AND NOT array_contains(c.seen, k.revoked_by))
        SELECT id, max_by(at, size(seen)) AS at FROM chain GROUP BY id""")
    ends = spark.table("__catalog").select(F.col("id").alias("at"), "live")
    return chain.join(ends, "at", "left").select("id", F.when(F.col("live"), F.col("at")).alias("resolved"))


def by_technique(catalog: DataFrame, rules: DataFrame, passing: DataFrame) -> DataFrame:
    """id, claimed, validated (numbers of rules, and of passing ones) of each technique, none included. rules has rule_id, techniques."""
    ok = passing.select("rule_id").distinct().withColumn("ok", F.lit(True))
    said = rules.select("rule_id", F.explode(F.array_distinct("techniques")).alias("id")).join(ok, "rule_id", "left")
    return catalog.select("id", "tactics").join(said, "id", "left").groupBy("id", "tactics").agg(F.count("rule_id").alias("claimed"), F.count_if("ok").alias("validated"))


def by_tactic(per_technique: DataFrame) -> DataFrame:
    return per_technique.select(F.explode("tactics").alias("tactic"), "claimed", "validated").groupBy("tactic").agg(F.count("*").alias("total"), F.count_if(F.col("claimed") > 0).alias("covered"), F.count_if(F.col("validated") > 0).alias("validated"))


def summary(per_technique: DataFrame) -> DataFrame:
    some = F.col("claimed") > 0
    return per_technique.agg(F.count("*").alias("total"), F.count_if(some).alias("covered"), F.count_if(F.col("validated") > 0).alias("validated"), F.count_distinct(F.when(some, parent(F.col("id")))).alias("parents_covered")).withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("covered"), F.col("total")), F.lit(0.0)))


def stale_tags(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, id, why (stale: revoked or deprecated; uncatalogued: unknown) of tags that no active technique has."""
    said = rules.select("rule_id", F.explode(F.array_distinct("techniques")).alias("id"))
    missing = said.join(active(catalog), "id", "left_anti")
    return missing.join(catalog.select("id", F.lit("stale").alias("why")), "id", "left").select("rule_id", "id", F.coalesce("why", F.lit("uncatalogued")).alias("why"))


def technique_match(rules: Column, dataset: Column, lenient: bool = False) -> Column:
    """Whether a rule's techniques name one of a dataset's, or its parent; leniently also a sibling."""
    wide = F.array_union(dataset, F.transform(dataset, parent))
    return F.arrays_overlap(F.transform(rules, parent), F.transform(dataset, parent)) if lenient else F.arrays_overlap(rules, wide)


def detection_matrix(datasets: DataFrame, file_hits: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rules_fired, any_alert, technique_detected, lenient of datasets (id, techniques, host_files) by the hits of their files (file, rule_id)."""
    fired = datasets.select("id", "techniques", F.explode_outer("host_files").alias("file")).join(file_hits.select("file", "rule_id").distinct(), "file", "left").join(rules.select("rule_id", F.col("techniques").alias("said")), "rule_id", "left")
    strict, loose = (F.coalesce(F.bool_or(technique_match(F.col("said"), F.col("techniques"), x)), F.lit(False)) for x in (False, True))
    return fired.groupBy("id").agg(F.count_distinct("rule_id").alias("rules_fired"), strict.alias("technique_detected"), loose.alias("lenient")).withColumn("any_alert", F.col("rules_fired") > 0)


def claimed(datasets: DataFrame, rules: DataFrame) -> DataFrame:
    """id, claimed: whether any rule (rule_id, techniques) names one of a dataset's techniques or its parent, fired or not."""
    wide = datasets.select("id", F.explode(F.array_union("techniques", F.transform("techniques", parent))).alias("technique"))
    said = rules.select(F.explode("techniques").alias("technique")).distinct()
    named = wide.join(said, "technique", "left_semi").select("id").distinct().withColumn("claimed", F.lit(True))
    return datasets.select("id").distinct().join(named, "id", "left").fillna(False, ["claimed"])


def missed(matrix: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows of a detection matrix whose technique is claimed and wasn't detected."""
    return matrix.join(claims.filter("claimed"), "id", "left_semi").filter("not technique_detected")


def navigator_layer(per_technique: DataFrame, name: str = "coverage") -> str:
    """A layer for the ATT&CK Navigator: 2 for validated techniques, 1 for claimed ones. Its rows are a catalogue's."""
    rows = per_technique.filter("claimed > 0").orderBy("id").collect()
    scores = [{"techniqueID": r["id"], "score": 2 if r["validated"] else 1, "comment": f"{r['claimed']} rules"} for r in rows]
    return json.dumps({"name": name, "domain": "enterprise-attack", "versions": {"layer": "4.5"}, "techniques": scores, "gradient": {"minValue": 0, "maxValue": 2, "colors": ["#ffffff", "#ffe08a", "#66bb6a"]}})
