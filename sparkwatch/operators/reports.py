"""Reports on a library: false positives on benign logs, what a change of schema breaks, how engines and drafts compare."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import mcnemar
from ..model import GatePolicy, Rule
from ..plans.compile import rule_fields
from . import coverage, decay
from . import routes as rt

#: A text field longer than this many bytes isn't indexed by search engines.
LONGEST_TERM = 32_766


# false positives on benign logs


def routed_events(by_key: DataFrame, routes: DataFrame) -> DataFrame:
    """rule_id, routed_events: how many events a rule's routes lead to, guards aside, from counts by (channel, eid)."""
    keys = by_key.select(F.col("channel").alias("__channel"), F.col("eid").alias("__eid"), "n")
    return rt.candidates(keys, routes).groupBy("rule_id").agg(F.sum("n").alias("routed_events"))


def known_false_positives(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, patterns of a list that separates by semicolons: rule, title, pattern (none: anything). A heading is left out."""
    rows = spark.read.schema("rule_id string, title string, pattern string").option("sep", ";").option("mode", "PERMISSIVE").csv(path)
    return rows.filter("rule_id <> 'RuleId'").groupBy("rule_id").agg(F.sort_array(F.collect_list(F.coalesce("pattern", F.lit(".*")))).alias("patterns"))


def false_positives(rules: DataFrame, hits: DataFrame, routed: DataFrame, known: DataFrame, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """rules with routed_events, hits, alerts_per_day, gate (pass or fail) and known_fp, from hits (rule_id, hits) on logs of policy.corpus_days."""
    listed = known.select("rule_id").distinct().withColumn("known_fp", F.lit(True))
    out = rules.join(routed, "rule_id", "left").join(hits.select("rule_id", "hits"), "rule_id", "left").join(listed, "rule_id", "left").fillna(0, ["routed_events", "hits"]).fillna(False, ["known_fp"])
    daily = F.col("hits") / F.lit(float(policy.corpus_days))
    return out.withColumn("alerts_per_day", daily).withColumn("gate", F.when(daily <= policy.budget, "pass").otherwise("fail"))


def false_positive_summary(report: DataFrame) -> DataFrame:
    """One row: rules, those observable, fired and over budget, all alerts, and how far the rules that fired are on the known list."""
    fired, known = F.col("hits") > 0, F.col("known_fp")
    medium = F.col("level").isin("medium", "high", "critical")
    count = lambda c, name: F.count_if(c).alias(name)
    return report.agg(
        F.count("*").alias("rules"), count(F.col("routed_events") > 0, "observable"), count(fired, "fired"), F.sum("hits").alias("alerts"), count(F.col("gate") == "fail", "gate_fail"),
        count(fired & medium, "fired_medium_up"), count(fired & medium & known, "fired_medium_up_known"), count(fired & known, "known_fired"), count(fired & (F.col("level") != "low") & ~known, "not_low_unlisted"),
    )


def unlisted(report: DataFrame, known: DataFrame) -> DataFrame:
    """Rules that fired and are not on the known list, most hits first."""
    return report.filter("hits > 0").join(known.select("rule_id"), "rule_id", "left_anti").orderBy(F.desc("hits"), "rule_id")


# rollups


def attribute_counts(rules: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute, value, rules: how many rules have each value; an empty one is `(none)`."""
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit("(none)")).alias("value")) for a in attributes])).alias("x")
    return rules.select(values).groupBy("x.attribute", "x.value").agg(F.count("*").alias("rules"))


def rules_with_findings(findings: DataFrame) -> DataFrame:
    """One row: rules with errors, and rules with warnings."""
    of = lambda severity: F.count_distinct(F.when(F.col("severity") == severity, F.col("rule_id")))
    return findings.agg(of("error").alias("rules_with_errors"), of("warning").alias("rules_with_warnings"))


def medians(rows: DataFrame, by: str, column: str) -> DataFrame:
    """median (the mean of the two in the middle) and upper_median (the larger of them) of a column by group."""
    return rows.groupBy(by).agg(F.median(column).alias("median"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)").alias("upper_median"))


def majority_channel(events: DataFrame, by: str, channel: str = "Channel") -> DataFrame:
    """The channel that most events of a group have, and how many; ties go to the first name."""
    counts = events.groupBy(by, F.coalesce(F.col(channel), F.lit("unknown")).alias("channel")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(F.struct("channel", "n"), F.struct(-F.col("n"), F.col("channel"))).alias("m")).select(by, "m.*")


def aggregation_census(texts: DataFrame) -> DataFrame:
    """folder, files, with_count_call, with_aggregation_condition, correlation_documents: of rule texts (folder, text)."""
    aggregated = r"(?m)^[ \t]*condition:.*\|[ \t]*(count|min|max|avg|sum|near)\b"
    some = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    text = F.col("text")
    return texts.groupBy("folder").agg(F.count("*").alias("files"), some(F.contains(text, F.lit("count(")), "with_count_call"), some(text.rlike(aggregated), "with_aggregation_condition"), F.coalesce(F.sum(F.regexp_count(text, F.lit(r"(?m)^correlation:"))), F.lit(0)).cast("long").alias("correlation_documents"))


def rule_texts(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """folder, text of the YAML files under folders of a rule repository, one file a row."""
    parts = None
    for f in folders:
        part = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yml").text(f"{root}/{f}", wholetext=True).select(F.lit(f).alias("folder"), F.col("value").alias("text"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def coverage_levels(catalog: DataFrame, rules: DataFrame, passing: DataFrame, gate_fail: DataFrame) -> DataFrame:
    """level (claimed, validated, validated_and_gated) and a coverage summary under each: of all rules, of those that pass on captures, and of those without gate failures."""
    sets = {"claimed": rules.select("rule_id"), "validated": passing.select("rule_id"), "validated_and_gated": passing.select("rule_id").join(gate_fail.select("rule_id"), "rule_id", "left_anti")}
    out = None
    for level, ok in sets.items():
        part = coverage.summary(coverage.by_technique(catalog, rules, ok)).select(F.lit(level).alias("level"), "total", "covered", "validated", "parents_covered")
        out = part if out is None else out.unionByName(part)
    return out


# what a change of schema breaks


def removal_truth(found: DataFrame, by_file: DataFrame, removed: str = rt.SYSMON) -> DataFrame:
    """rule_id, fires_after: rules that fire on captures which hold both process creations, and whether they still do without the removed channel.

    found has file, rule_id, channel; by_file has file, channel, eid, n.
    """
    has = lambda c, i: F.bool_or((F.col("channel") == c) & (F.col("eid") == i) & (F.col("n") > 0))
    both = by_file.groupBy("file").agg(has(removed, 1).alias("a"), has(rt.SECURITY, 4688).alias("b")).filter("a and b").select("file")
    return found.join(both, "file", "left_semi").groupBy("rule_id").agg(F.bool_or(F.col("channel") != removed).alias("fires_after"))


_ORDER = ("ok", "degraded", "broken", "source-missing")
Inventory = dict[tuple[str, int], set[str]]


def _anywhere(inventory: Inventory) -> set[str]:
    return set().union(*inventory.values())


def _flags(rule: Rule, before: Inventory, after: Inventory, everywhere: list[set[str]]) -> tuple[bool, bool, bool, bool]:
    """What a rule's verdict, the fields of its own source and those of all sources say, and whether its verdict is worse."""
    old, new = decay.analyse(rule, before), decay.analyse(rule, after)
    worse = _ORDER.index(new.status) > _ORDER.index(old.status)
    was, gone = old.status != "source-missing", new.status == "source-missing"
    missing = [(rule_fields(rule) - set(decay.META_FIELDS)) - there for there in everywhere]
    return worse and new.status in _ORDER[2:], was and (gone or bool(set(new.missing) - set(old.missing))), bool(missing[1] - missing[0]), worse


def decay_flags(rules: list[Rule], before: DataFrame, after: DataFrame) -> DataFrame:
    """rule_id and what three monitors flag when the inventory changes: verdict (worse, and can't fire), by_source and anywhere (fields that are newly missing in a rule's own source, and in all).

    The inventories are what decay.observed gives; they have a row for each source and are read by the driver, as is the library.
    """
    old, new = ({(r["channel"], r["eid"]): set(r["fields"]) for r in df.collect()} for df in (before, after))
    everywhere = [_anywhere(old), _anywhere(new)]
    return before.sparkSession.createDataFrame([(r.key, *_flags(r, old, new, everywhere)) for r in rules], "rule_id string, verdict boolean, by_source boolean, anywhere boolean, worsened boolean")


METHODS = ("verdict", "by_source", "anywhere")


def decay_changes(rules: list[Rule], evidence: DataFrame) -> DataFrame:
    """change, method, rules (that fired before), decayed (that no longer do), flagged, found, false_alarms, recall, precision, only_verdict, only_method, p: how each monitor does on each schema change.

    evidence is what decay.evidence gives, stored: a row a rule or a set of fields, which the driver reads with the
    library. only_verdict and only_method say how often just one of the verdict monitor and this one is right; p is the
    exact two-sided one of that.
    """
    spark = evidence.sparkSession
    fired: dict[str, set[str]] = {}
    seen: dict[str, Inventory] = {}
    for r in evidence.select("change", "rule_id", "channel", "eid", "fields").distinct().collect():
        if r["rule_id"] is not None:
            fired.setdefault(r["change"], set()).add(r["rule_id"])
        else:
            seen.setdefault(r["change"], {}).setdefault((r["channel"], r["eid"]), set()).update(r["fields"])
    before, of = fired.get("", set()), {r.key: r for r in rules}
    there = {change: _anywhere(inventory) for change, inventory in seen.items()}
    flags = [
        (change, key, key not in fired.get(change, set()), flags[0], method, flag)
        for change in sorted({*seen, *fired} - {""}) for key in sorted(before & set(of)) for flags in [_flags(of[key], seen.get("", {}), seen.get(change, {}), [there.get("", set()), there.get(change, set())])] for method, flag in zip(METHODS, flags, strict=False)
    ]
    rows = spark.createDataFrame(flags, "change string, rule_id string, decayed boolean, verdict boolean, method string, flag boolean")
    right = lambda c: F.col(c) == F.col("decayed")
    out = rows.groupBy("change", "method").agg(
        F.count("*").alias("rules"), F.count_if("decayed").alias("decayed"), F.count_if("flag").alias("flagged"), F.count_if(F.expr("flag and decayed")).alias("found"), F.count_if(F.expr("flag and not decayed")).alias("false_alarms"),
        F.count_if(right("verdict") & ~right("flag")).alias("only_verdict"), F.count_if(~right("verdict") & right("flag")).alias("only_method"),
    ).withColumns({"recall": F.try_divide("found", "decayed"), "precision": F.try_divide("found", "flagged")})
    told = [(*r, mcnemar(r["only_verdict"], r["only_method"])) for r in out.collect()]  # a row for each change and method
    return spark.createDataFrame(told, out.schema.add("p", "double"))


def decay_methods(flags: DataFrame, decayed: DataFrame, universe: DataFrame) -> DataFrame:
    """method, flagged, found, decayed, recall, precision, false_alarms, and how often only the verdict monitor or only the method is right, on rules with evidence."""
    truth = universe.select("rule_id").distinct().join(decayed.select("rule_id").distinct().withColumn("decayed", F.lit(True)), "rule_id", "left").fillna(False, ["decayed"])
    long = flags.join(truth, "rule_id").select("rule_id", "decayed", "verdict", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("flag")) for m in ("verdict", "by_source", "anywhere")])).alias("x")).select("rule_id", "decayed", "verdict", "x.*")
    right = lambda c: F.col(c) == F.col("decayed")
    out = long.groupBy("method").agg(F.count_if("flag").alias("flagged"), F.count_if(F.expr("flag and decayed")).alias("found"), F.count_if("decayed").alias("decayed"), F.count_if(F.expr("flag and not decayed")).alias("false_alarms"), F.count_if(right("verdict") & ~right("flag")).alias("only_verdict_right"), F.count_if(~right("verdict") & right("flag")).alias("only_method_right"))
    return out.withColumns({"recall": F.try_divide("found", "decayed"), "precision": F.try_divide("found", "flagged")})


# engines and drafts side by side


def agreement(a: DataFrame, b: DataFrame, index: str = "event_idx") -> DataFrame:
    """rule_id, both, only_a, only_b, same: how the hits (rule_id and an index) of two engines compare, rules of either."""
    keys = ["rule_id", index]
    each = a.select(*keys).distinct().withColumn("a", F.lit(True)).join(b.select(*keys).distinct().withColumn("b", F.lit(True)), keys, "full")
    out = each.groupBy("rule_id").agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return out.withColumn("same", F.expr("only_a = 0 and only_b = 0"))


def verdicts_of_two(a: DataFrame, b: DataFrame, cases: DataFrame, index: str = "event_idx") -> DataFrame:
    """One row: cases, both, only_a, only_b, neither (whether each engine fires on a case), same_count, same_events (cases on which they agree in how many events they hit, and which), kappa.

    a and b are hits (rule_id, file, index) of two engines, one of them perhaps read from a table that another engine
    wrote; cases (rule_id, file) are what both were asked. Event sets are compared by their number and the sum of their
    hashes, so none is gathered.
    """
    keys = ["rule_id", "file"]
    of = lambda df, name: df.select(*keys, index).distinct().groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64(index).cast("decimal(38,0)")).alias(f"h_{name}"))
    each = cases.select(*keys).distinct().join(of(a, "a"), keys, "left").join(of(b, "b"), keys, "left").fillna(0, ["n_a", "n_b"])
    fires = {x: F.col(f"n_{x}") > 0 for x in "ab"}
    count = lambda c, name: F.count_if(c).alias(name)
    out = each.agg(
        F.count("*").alias("cases"), count(fires["a"] & fires["b"], "both"), count(fires["a"] & ~fires["b"], "only_a"), count(~fires["a"] & fires["b"], "only_b"), count(~fires["a"] & ~fires["b"], "neither"),
        count(F.col("n_a") == F.col("n_b"), "same_count"), count((F.col("n_a") == F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b")), "same_events"),
    )
    n, a_yes, b_yes = F.col("cases"), F.col("both") + F.col("only_a"), F.col("both") + F.col("only_b")
    agree, chance = (F.col("both") + F.col("neither")) / n, (a_yes * b_yes + (n - a_yes) * (n - b_yes)) / (n * n)
    return out.withColumn("kappa", F.when(chance == 1, 1.0).otherwise((agree - chance) / (1 - chance)))


def paired(a: DataFrame, b: DataFrame, key: str, value: str = "hit") -> DataFrame:
    """key, a, b: the results of two methods on the same cases; a case that one of them doesn't have is a miss there."""
    one = lambda df, name: df.groupBy(key).agg(F.bool_or(value).alias(name))
    return one(a, "a").join(one(b, "b"), key, "full").fillna(False, ["a", "b"])


def draft_results(drafts: DataFrame, found: DataFrame, benign: str) -> DataFrame:
    """rule_id, file, fires, benign_hits: whether a draft (rule_id, file of its own capture) fires there, and how often on benign logs, from hits (rule_id, file)."""
    counts = found.groupBy("rule_id").agg(F.count_if(F.col("file") == benign).alias("benign_hits"))
    own = found.select("rule_id", "file").distinct().withColumn("fires", F.lit(True))
    return drafts.join(own, ["rule_id", "file"], "left").join(counts, "rule_id", "left").fillna(False, ["fires"]).fillna(0, ["benign_hits"])


# what leaves the engine


def search_document(event: Column, longest: int = LONGEST_TERM) -> Column:
    """An event's map for a search index: dots in names become underscores (of names that meet so the first in order stays), texts over `longest` bytes are left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(event, lambda k, v: v.isNotNull() & (F.octet_length(v) <= longest))))
    named = F.transform(entries, lambda e: F.struct(F.replace(e["key"], F.lit("."), F.lit("_")).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), 1)["value"]))


def results(tables: dict[str, DataFrame], path: str, sources: dict[str, DataFrame] | None = None, most: int = 10_000) -> dict[str, Any]:
    """Writes reports as one JSON file of the driver: the rows of each table (reports, of at most `most` rows), and where they come from."""
    spark = next(iter(tables.values())).sparkSession
    out: dict[str, Any] = {"provenance": {"spark": spark.version, "written": datetime.now(UTC).isoformat(timespec="seconds"), "rows": {k: df.count() for k, df in (sources or {}).items()}}}
    for name, df in tables.items():
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"{name} is no report: more than {most} rows")
        out[name] = rows
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, ensure_ascii=False)
    return out
