"""What must hold before a rule ships: fixtures, the benign corpus, captures, and the last release's numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Fields
from ..functions.network import register
from ..functions.stored import Scratch
from ..model import GatePolicy, Rule, UnsupportedRule


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


#: How many missed fixtures of a rule are named.
MISSED = 20


def _counts(labelled: DataFrame) -> DataFrame:
    """Fixtures and corpus of each rule, and how many of them it fired on."""
    n = lambda kind, hit=False: F.count_if((F.col("kind") == kind) & F.col("hit") if hit else F.col("kind") == kind)
    return labelled.groupBy("rule_id").agg(n("tp").alias("tp_total"), n("tp", True).alias("tp_fired"), n("tn").alias("tn_total"), n("tn", True).alias("tn_fired"), n("corpus").alias("corpus_size"), n("corpus", True).alias("fp_hits"))


def _missed(labelled: DataFrame, most: int) -> DataFrame:
    """rule_id, missed_tps: the first `most` fixtures that a rule should have fired on and didn't. Each task keeps so many a rule."""
    of = labelled.filter((F.col("kind") == "tp") & ~F.col("hit")).select("rule_id", "idx")
    first = of.withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy("idx"))).filter(F.col("n") <= most)
    return first.groupBy("rule_id").agg(F.sort_array(F.collect_list("idx")).alias("missed_tps"))


def judged(counts: DataFrame, missed: DataFrame, policy: GatePolicy = GatePolicy()) -> DataFrame:
    """Rates of counted rules, whether they pass, and why not (reasons in fixed order). Ratios are not rounded; without a denominator they are 0."""
    tp, tn, fp = F.col("tp_fired"), F.col("tn_fired"), F.col("fp_hits")
    out = counts.withColumns({
        "precision": _share(tp, tp + tn + fp), "recall": _share(tp, F.col("tp_total")), "fp_rate": _share(fp, F.col("corpus_size")),
        "alerts_per_day": F.coalesce(F.try_divide(fp, F.lit(float(policy.corpus_days))), fp.cast("double")),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("tp_total") == 0, "no true-positive fixtures"),
        F.when(tp < F.col("tp_total"), F.format_string("missed %d/%d true positives", F.col("tp_total") - tp, F.col("tp_total"))),
        F.when(tn > 0, F.format_string("fired on %d true negatives", tn)),
        F.when(F.col("fp_rate") > policy.max_fp_rate, "false-positive rate over the limit"),
        F.when(F.col("alerts_per_day") > policy.budget, "alerts a day over the budget"),
    ))
    out = out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0).join(missed, "rule_id", "left")
    return out.withColumn("missed_tps", F.coalesce("missed_tps", F.array().cast(missed.schema["missed_tps"].dataType)))


def evaluate(labelled: DataFrame, policy: GatePolicy = GatePolicy(), most: int = MISSED) -> DataFrame:
    """One row a rule from (rule_id, kind: tp, tn or corpus, idx, hit): counts, rates, passed, reasons, missed_tps (the first `most`; tp_total - tp_fired says how many there are).

    Not routed: fixtures and corpus are tested as they are.
    """
    return judged(_counts(labelled), _missed(labelled, most), policy)


def fixtures(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_id, kind, idx, event (a map of texts): the test events that rules carry. A library's, so they come from the driver."""
    text = lambda e: {k: None if v is None else str(v) for k, v in e.items()}
    rows = [(r.key, kind, i, text(e)) for r in rules for kind, es in (("tp", r.true_positives), ("tn", r.true_negatives)) for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "rule_id string, kind string, idx long, event map<string,string>")


def gate_library(rules: list[Rule], fixtures: DataFrame, corpus: DataFrame, fields: Fields, policy: GatePolicy = GatePolicy(), index: str = "event_idx", most: int = MISSED, chunk: int = 250) -> DataFrame:
    """As `evaluate`, for a library of any size in one read of the corpus: a row for each rule that isn't deprecated.

    fixtures has rule_id, kind (tp or tn), idx and the corpus's columns that `fields` reads. Fixtures and events are tested
    together, by one projection: a fixture by its own rule, an event by all, whatever their log sources are. Only hits and
    counts leave it. A rule that can't be compiled doesn't pass, and its reason says so.
    """
    from ..plans.compile import Compiler
    from .scan import ready

    spark, shared = corpus.sparkSession, {}
    register(spark)
    compiler = Compiler(fields, shared)
    predicates: dict[str, str] = {}
    broken: dict[str, str] = {}
    for r in rules:
        if r.status != "deprecated" and r.key not in predicates and r.key not in broken:
            try:
                predicates[r.key] = compiler.rule(r)
            except UnsupportedRule as e:
                broken[r.key] = str(e)
    texts, columns = ready(predicates, shared)
    same = [c for c in corpus.columns if c in fixtures.columns and c not in ("rule_id", "kind", "idx")]
    events = corpus.select(F.lit(None).cast("string").alias("__rule"), F.lit("corpus").alias("__kind"), F.col(index).cast("long").alias("__idx"), *same)
    cases = fixtures.select(F.col("rule_id").alias("__rule"), F.col("kind").alias("__kind"), F.col("idx").cast("long").alias("__idx"), *same)

    def tested(rows: DataFrame) -> DataFrame:
        """rule_id, kind, idx, hit: a row for each fixture, each event (rule_id empty) and each hit on an event."""
        own = F.col("__rule")
        ids = list(texts)
        test = lambda k: f"CASE WHEN (__rule IS NULL OR __rule = {SPARK.text(k)}) AND ({texts[k]}) THEN {SPARK.text(k)} END"
        parts = [F.expr(f"array_compact(array({', '.join(map(test, ids[i : i + chunk]))}))") for i in range(0, len(ids), chunk)]
        fired = F.concat(*parts) if parts else F.array().cast("array<string>")
        row = lambda rule, hit: F.struct(rule.alias("rule_id"), F.col("__kind").alias("kind"), F.col("__idx").alias("idx"), hit.alias("hit"))
        found = rows.withColumns(columns).withColumn("__fired", fired)
        each = F.when(own.isNotNull(), F.array(row(own, F.array_contains("__fired", own)))).otherwise(F.array_append(F.transform("__fired", lambda k: row(k, F.lit(True))), row(F.lit(""), F.lit(False))))
        return found.select(F.explode(each).alias("x")).select("x.*")

    scratch = Scratch(spark)
    counts = scratch.write(_counts(tested(events.unionByName(cases))), "gate", last=True)
    size = counts.filter("rule_id = ''").agg(F.sum("corpus_size")).first()[0] or 0
    known = spark.createDataFrame([(k, broken.get(k)) for k in (*predicates, *broken)], "rule_id string, __broken string")
    numbers = [c for c in counts.columns if c != "rule_id"]
    every = known.join(counts, "rule_id", "left").fillna(0, numbers).withColumn("corpus_size", F.lit(size).cast("long"))
    out = judged(every, _missed(tested(cases), most), policy)
    why = F.when(F.col("__broken").isNotNull(), F.array(F.concat(F.lit("not supported: "), F.col("__broken")))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0).drop("__broken")


def fleet_failures(rates: DataFrame, sizes: list[int], policy: GatePolicy) -> DataFrame:
    """For fleets of so many hosts: how many rules go over the budget, from (rule_id, alerts_per_host_day)."""
    hosts = F.explode(F.array(*map(F.lit, sizes))).alias("hosts")
    return rates.select("alerts_per_host_day", hosts).groupBy("hosts").agg(F.count_if(F.col("alerts_per_host_day") * F.col("hosts") > policy.budget).alias("failing"))


def group_stats(rules: DataFrame, key: str) -> DataFrame:
    """observable, fired, fired_pct and gate_fail by a rule attribute."""
    return rules.groupBy(key).agg(F.count_if("observable").alias("observable"), F.count_if("fired").alias("fired"), F.count_if("gate_fail").alias("gate_fail")).withColumn("fired_pct", _share(F.col("fired") * 100.0, F.col("observable")))


def regressions(baseline: DataFrame, current: DataFrame, factor: float = 3.0) -> DataFrame:
    """Rules whose recall fell or whose false positives rose by more than the factor; rules new to the baseline are left out."""
    old = baseline.select("rule_id", F.col("recall").alias("recall_before"), F.col("fp_hits").alias("fp_before"))
    both = current.select("rule_id", "recall", "fp_hits").join(old, "rule_id")
    fell, rose = F.col("recall") < F.col("recall_before"), F.col("fp_hits") > F.greatest(F.col("fp_before"), F.lit(1)) * factor
    return both.withColumn("kinds", F.array_compact(F.array(F.when(fell, "recall_drop"), F.when(rose, "fp_spike")))).filter(F.size("kinds") > 0)


def replay(cases: DataFrame, rules: DataFrame, files: DataFrame, matches: DataFrame) -> DataFrame:
    """Status of captures: (case_id, rule_id, file, expected) against supported rules, readable files and counts of routed and matched events.

    rules has rule_id, supported, routable; files has file, events; matches has case_id, routed, matched.
    """
    out = cases.join(rules, "rule_id", "left").join(files, "file", "left").join(matches, "case_id", "left").fillna(0, ["routed", "matched"])
    enough = (F.col("matched") > 0) & (F.col("matched") >= F.coalesce(F.col("expected"), F.lit(1)))
    status = F.when(~F.coalesce("supported", F.lit(True)), "unsupported").when(F.col("supported").isNull(), "missing-rule").when(F.col("events").isNull(), "unreadable").when(~F.col("routable"), "unroutable").when(enough, "pass").otherwise("fail")
    return out.withColumn("exact", F.col("matched") == F.col("expected")).withColumn("status", status)


def score(rules: DataFrame) -> DataFrame:
    """Quality of each rule, 0 to 100 and a grade, from lint counts, metadata, tests and gate results (null: not tested)."""
    points = lambda cond, p: F.when(cond, p).otherwise(0)
    tested = F.col("recall").isNotNull()
    parts = {
        "lint": F.greatest(F.lit(0), 20 - 10 * F.col("errors") - 3 * F.col("warnings")),
        "metadata": points(F.col("has_references"), 4) + points(F.col("has_falsepositives"), 4) + points(F.col("has_author"), 4) + points(F.col("description_length") >= 40, 3),
        "attack_mapping": points(F.col("n_techniques") > 0, 10),
        "test_depth": F.least(F.lit(15), 3 * F.col("n_tests")),
        "recall_points": F.coalesce(F.bround(20 * F.col("recall")), F.lit(0)),
        "precision_points": F.coalesce(F.bround(10 * F.col("precision")), F.lit(0)),
        "noise": F.when(~tested, 0).when(F.col("fp_hits") == 0, 10).when(F.col("passed"), 5).otherwise(0),
    }
    out = rules.withColumns({k: v.cast("int") for k, v in parts.items()})
    total = sum((F.col(k) for k in parts), F.lit(0))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return out.withColumn("score", total).withColumn("grade", grade)


def replay_captures(cases: DataFrame, rules: list[Rule], events: DataFrame) -> DataFrame:
    """Replays captures: cases (case_id, rule_id, title, file, expected) against a library, over events (file, event_idx, Channel, EventID, event) of all their files.

    A file without an event can't be read, or isn't there. Routed are the events that a rule's log source covers.
    """
    from .scan import Library, hits

    spark, fields = events.sparkSession, Fields(events.schema, document="event")
    library = Library.build(rules, fields, include_deprecated=True)
    routable = Library(dict.fromkeys(library.predicates, "TRUE"), library.rules, library.routes)
    known = spark.createDataFrame([(k, k not in library.unsupported, k in library.rules) for k in dict.fromkeys(r.key for r in rules)], "rule_id string, supported boolean, routable boolean")
    files = events.groupBy("file").agg(F.count("*").alias("events"))
    count = lambda lib, name: hits(events, lib, ["file"], lambda n: fields(n).sql).groupBy("rule_id", "file").agg(F.count("*").alias(name))
    matches = cases.select("case_id", "rule_id", "file").join(count(routable, "routed"), ["rule_id", "file"], "left").join(count(library, "matched"), ["rule_id", "file"], "left").select("case_id", "routed", "matched")
    return replay(cases, known, files, matches)
