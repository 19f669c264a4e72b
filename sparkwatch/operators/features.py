"""Static features of rules, and models that predict from them which rules will be noisy."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import ENCODING
from ..functions.stored import Scratch, numbered, small
from ..model import Rule
from ..plans.compile import walk

# Names that features are made of.
LEVEL = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
STATUS = {"unsupported": 0, "deprecated": 0, "experimental": 1, "test": 2, "stable": 3}
CATEGORIES = (
    "process_creation", "registry_set", "registry_event", "image_load", "file_event", "network_connection", "process_access", "ps_script",
    "ps_module", "pipe_created", "dns_query", "create_remote_thread", "registry_delete", "registry_add", "driver_load",
)
SERVICES = ("security", "system", "application", "powershell", "windefend", "sysmon")
COUNTED = ("contains", "startswith", "endswith", "re", "all", "exists", "cidr", "windash")
FLAGGED = ("Image", "CommandLine", "ParentImage", "OriginalFileName", "TargetObject", "ImageLoaded", "TargetFilename", "Hashes", "EventID")


def features(rule: Rule) -> dict[str, float]:
    """65 numbers that can be read off a rule."""
    path, category = rule.path.replace("\\", "/").lower(), rule.logsource.category.lower()
    condition, names = " ".join(rule.conditions).lower(), [n.lower() for n in rule.selections]
    atoms = [(k.split("|")[0], k.split("|")[1:], v if isinstance(v, list) else [v]) for s in rule.selections.values() for k, v in walk(s)]
    fielded = [a for a in atoms if a[0]]
    sizes = [len(str(v)) for _, _, values in fielded for v in values if v is not None]
    fields, said = {a[0] for a in fielded}, " ".join(rule.falsepositives).lower()
    out: dict[str, float] = {"level": LEVEL.get(rule.level, 2), "status": STATUS.get(rule.status, 1), "hunting": "rules-threat-hunting" in path, "emerging": "rules-emerging-threats" in path}
    out |= {f"cat_{c}": category == c for c in CATEGORIES} | {"cat_other": bool(category) and category not in CATEGORIES}
    out |= {f"svc_{s}": rule.logsource.service.lower() == s for s in SERVICES}
    out |= {
        "n_selections": len(names), "n_filters": sum(n.startswith("filter") for n in names), "n_optional_filters": sum(n.startswith("filter_optional") for n in names),
        "has_not": " not " in f" {condition} ", "n_or": condition.count(" or "), "n_and": condition.count(" and "), "one_of": "1 of" in condition,
    }
    out |= {f"mod_{m}": sum(len(v) * mods.count(m) for _, mods, v in fielded) for m in COUNTED}
    out["mod_eq"] = sum(len(v) for _, mods, v in fielded if all(m == "cased" for m in mods))
    out["mod_enc"] = sum(len(v) for _, mods, v in fielded for m in mods if m in ENCODING and m not in COUNTED)
    out["mod_expand"] = sum(mods.count("expand") for _, mods, _ in fielded)
    out |= {
        "n_values": sum(len(v) for _, _, v in fielded), "n_keywords": sum(len(v) for k, _, v in atoms if not k), "n_fields": len(fields),
        "min_len": min(sizes, default=0), "mean_len": sum(sizes) / len(sizes) if sizes else 0, "short_values": sum(n < 5 for n in sizes),
        "wildcards": sum(isinstance(x, str) and "*" in x for _, _, v in atoms for x in v),
    }
    out |= {f"field_{f}": f in fields for f in FLAGGED}
    out |= {
        "n_falsepositives": len(rule.falsepositives), "fp_mentions_legit": bool(re.search("legitimate|admin|software|installer|update", said)),
        "fp_unknown": said.strip() in ("unknown", "unlikely", ""), "n_tags": len(rule.tags), "desc_len": len(rule.description),
    }
    return {k: float(v) for k, v in out.items()}


def feature_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [{"rule_id": r.key, **features(r)} for r in rules]
    names = list(rows[0]) if rows else ["rule_id", *features(Rule())]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` {'string' if n == 'rule_id' else 'double'}" for n in names))


# models of noise: held-out scores are written once, and all figures are taken of that table

#: What a reviewer would go by without a model: signs of a noisy rule, from columns of the feature table.
HEURISTICS = {
    "heuristic_level": lambda: -F.col("level"),
    "heuristic_hunting": lambda: F.col("hunting") - 0.1 * F.col("level"),
    "heuristic_no_filter": lambda: -F.col("n_filters") - 0.1 * F.col("level"),
}


def _models(seed: int, rounds: int) -> dict[str, Any]:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    given = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "__w"}
    return {"logistic": LogisticRegression(regParam=0.01, maxIter=200, **given), "boosted": GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed, **given)}


def stratified(table: DataFrame, label: str, folds: int, seed: int) -> DataFrame:
    """table with __y, __fold (each has as many of either label, give or take one) and __w, under which both labels weigh the same in all.

    Within a label rows are ordered by a hash of rule_id and the seed, over ranges.
    """
    y = F.when(F.col(label).cast("double") > 0, 1.0).otherwise(0.0)
    dealt = numbered(table.withColumn("__y", y).withColumn("__order", F.xxhash64("rule_id", F.lit(seed))), "__y", "__order", name="__place").drop("__order")
    sizes = {r["__y"]: r["n"] for r in dealt.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.when(F.col("__y") > 0, n / (2 * sizes.get(1.0, 1))).otherwise(n / (2 * sizes.get(0.0, 1)))
    return dealt.withColumn("__fold", F.pmod(F.col("__place"), F.lit(folds)).cast("int")).withColumn("__w", weight).drop("__place")


def held_out(table: DataFrame, names: list[str], label: str = "label", folds: int = 5, seed: int = 7, rounds: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """model, rule_id, y, score: of each row by models that were fitted without its fold, by HEURISTICS where their columns are there, and by chance. Written once."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scratch = scratch or Scratch(table.sparkSession)
    data = scratch.write(stratified(table, label, folds, seed), "folds")
    assemble, scale = VectorAssembler(inputCols=names, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    parts = []
    for k in range(folds):
        rest, part = data.filter(F.col("__fold") != k), data.filter(F.col("__fold") == k)
        if len(rest.select("__y").distinct().take(2)) < 2:
            raise ValueError("each fold needs rows of both labels beside it")
        ready = Pipeline(stages=[assemble, scale]).fit(rest)
        shown, asked = ready.transform(rest), ready.transform(part)
        for name, model in _models(seed, rounds).items():
            fitted = model.fit(shown)
            scored = (scratch.model(fitted, f"{name}-{k}-model") if getattr(fitted, "hasSummary", False) else fitted).transform(asked)
            parts.append(scratch.write(scored.select(F.lit(name).alias("model"), "rule_id", F.col("__y").alias("y"), vector_to_array("probability")[1].alias("score")), f"{name}-{k}"))
    known = set(table.columns)
    plain = {n: h() for n, h in HEURISTICS.items() if {"level"} | ({"hunting"} if n.endswith("hunting") else {"n_filters"} if n.endswith("filter") else set()) <= known}
    plain["random"] = F.pmod(F.xxhash64("rule_id", F.lit(f"random {seed}")), F.lit(1 << 30)) / (1 << 30)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("score")) for n, c in plain.items()])).alias("s")
    parts.append(data.select("rule_id", F.col("__y").alias("y"), each).select("s.model", "rule_id", "y", "s.score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return scratch.write(every, "held-out", last=True)


def _ranked(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, score, pos, neg, tp, fp, p, n: of each group of equal scores the (weighted) rows of either label, those that score as high or higher, and all that `by` has.

    Running sums go over ranges of (by, score): however few values `by` has, no task sees all rows of one.
    """
    w = F.col(weight) if weight else F.lit(1)
    groups = scored.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") > 0, w).otherwise(0)).cast("double").alias("pos"), F.sum(F.when(F.col("y") > 0, 0).otherwise(w)).cast("double").alias("neg"))
    placed = numbered(groups, *by, F.desc("score"), sums={"pos": "tp", "neg": "fp"})
    totals = placed.groupBy(*by).agg(F.min("tp").alias("__tp"), F.min("fp").alias("__fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    own = placed.join(small(totals, totals.count()), by)
    return own.withColumns({"tp": F.col("tp") - F.col("__tp") + F.col("pos"), "fp": F.col("fp") - F.col("__fp") + F.col("neg")}).drop("position", "__tp", "__fp")


def _areas() -> list[Column]:
    """Both areas of a `_ranked` group."""
    p, n = F.max("p"), F.max("n")
    lost = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    kept = F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
    both = (p > 0) & (n > 0)
    return [F.when(both, 1 - lost / (p * n)).alias("roc_auc"), F.when(both, kept / p).alias("pr_auc")]


def areas(scored: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, roc_auc, pr_auc of weighted rows (by, y, score): the area under the ROC curve with ties halved, and the average precision with tied rows taken together. Null with one label only."""
    return _ranked(scored, by, weight).groupBy(*by).agg(*_areas())


def metrics(scored: DataFrame, share: float = 0.1) -> DataFrame:
    """model, rows, positives, roc_auc, pr_auc, precision_at_k (k: as many as there are positives) and recall_at_share of held-out scores, ties broken at random in expectation."""
    size, before = F.col("pos") + F.col("neg"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    top = lambda k: F.sum(F.col("pos") * F.greatest(F.lit(0), F.least(size, k - before)) / size)
    k, few = F.greatest(F.lit(1), F.col("p")), F.greatest(F.lit(1), F.floor((F.col("p") + F.col("n")) * share))
    counts = [(F.max("p") + F.max("n")).cast("long").alias("rows"), F.max("p").cast("long").alias("positives")]
    tops = [(top(k) / F.max(k)).alias("precision_at_k"), (top(few) / F.greatest(F.lit(1), F.max("p"))).alias("recall_at_share")]
    return _ranked(scored, ["model"]).groupBy("model").agg(*counts, *_areas(), *tops)


def cross_validate(table: DataFrame, names: list[str], label: str = "label", folds: int = 5, seed: int = 7, rounds: int = 20) -> DataFrame:
    """`metrics` of logistic regression, boosted trees, what a reviewer would go by, and chance, by stratified held-out folds."""
    return metrics(held_out(table, names, label, folds, seed, rounds))


def repeated(table: DataFrame, names: list[str], label: str = "label", folds: int = 5, seeds: tuple[int, ...] = tuple(range(10)), rounds: int = 20) -> DataFrame:
    """model, metric, mean, lo, hi: over cross-validations with other folds, with the mean's 95 % t interval. It tells what the dealing of folds does, not what other rules would."""
    from ..functions.stats import t_quantile

    every = None
    for s in seeds:
        one = cross_validate(table, names, label, folds, s, rounds)
        every = one if every is None else every.unionByName(one)
    figures = ("roc_auc", "pr_auc", "precision_at_k", "recall_at_share")
    long = every.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in figures])).alias("f")).select("model", "f.*")
    half = F.lit(t_quantile(0.975, len(seeds) - 1) if len(seeds) > 1 else 0.0) * F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / F.sqrt(F.count("*"))
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), (F.avg("value") - half).alias("lo"), (F.avg("value") + half).alias("hi"))


def bootstrap_areas(scored: DataFrame, reference: str = "heuristic_level", draws: int = 1000, seed: int = 7) -> DataFrame:
    """model, metric, lo, hi, delta_lo, delta_hi, at_or_below, draws: 95 % intervals of both areas and of their difference to a reference's, and in how many draws that isn't above 0.

    Rules are drawn with replacement, the same ones for all models of a draw; draws of one label only don't count. Each
    rule's number of times in a draw is its weight. A draw of a model is one group of as many rows as there are rules.
    """
    rules = numbered(scored.select("rule_id").distinct(), "rule_id", name="at")
    n = rules.count()
    spark = scored.sparkSession
    drawn = spark.range(draws * n).select((F.col("id") % draws).alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("at")).groupBy("draw", "at").agg(F.count("*").alias("w"))
    rows = drawn.join(rules, "at").join(scored, "rule_id").select("draw", "model", "y", "score", "w")
    each = Scratch(spark).write(areas(rows, ["draw", "model"], "w").filter("roc_auc is not null"), "areas")
    long = each.select("draw", "model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("roc_auc", "pr_auc")])).alias("f")).select("draw", "model", "f.*")
    own = long.filter(F.col("model") == reference).select("draw", "metric", F.col("value").alias("against"))
    both = long.join(own, ["draw", "metric"]).withColumn("delta", F.col("value") - F.col("against"))
    at = lambda c, p: F.percentile(c, F.lit(p))
    return both.groupBy("model", "metric").agg(at("value", 0.025).alias("lo"), at("value", 0.975).alias("hi"), at("delta", 0.025).alias("delta_lo"), at("delta", 0.975).alias("delta_hi"), F.count_if(F.col("delta") <= 0).alias("at_or_below"), F.count("*").alias("draws"))


def importance(table: DataFrame, names: list[str], label: str = "label", repeats: int = 5, seed: int = 7, rounds: int = 20) -> DataFrame:
    """feature, importance: how much average precision of boosted trees, fitted to all rows, is lost on average when a feature's values are dealt to other rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scratch = Scratch(table.sparkSession)
    data = scratch.write(stratified(table, label, 2, seed), "rows")
    assemble, scale = VectorAssembler(inputCols=names, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    fitted = Pipeline(stages=[assemble, scale, _models(seed, rounds)["boosted"]]).fit(data)
    ready = scratch.write(fitted.transform(data).select("rule_id", F.col("__y").alias("y"), vector_to_array("__x").alias("x"), vector_to_array("probability")[1].alias("score")), "ready")
    base = areas(ready.withColumn("of", F.lit(0)), ["of"]).first()["pr_auc"]
    # each feature's values in an order of their own, once for each repeat
    trials = F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1))).alias("trial")
    rows = ready.select("rule_id", "y", "x", trials).withColumn("feature", (F.col("trial") % len(names)).cast("int"))
    order = lambda *by: F.row_number().over(Window.partitionBy("trial").orderBy(*by))
    placed = rows.withColumn("place", order("rule_id"))
    dealt = rows.select("trial", F.get("x", F.col("feature")).alias("value"), order(F.xxhash64("rule_id", "trial", F.lit(seed)), "rule_id").alias("place"))
    changed = placed.join(dealt, ["trial", "place"]).select("trial", "feature", "y", F.transform("x", lambda v, i: F.when(i == F.col("feature"), F.col("value")).otherwise(v)).alias("x"))
    scored = fitted.stages[-1].transform(changed.withColumn("__x", array_to_vector("x"))).select("trial", "feature", "y", vector_to_array("probability")[1].alias("score"))
    lost = areas(scored, ["trial", "feature"]).groupBy("feature").agg((F.lit(base) - F.avg("pr_auc")).alias("importance"))
    return lost.select(F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature"), "importance")
