"""Commands over rule folders and logs. Exit codes: 0 fine, 1 findings, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dialect import Fields
from .functions.stored import materialize
from .model import GatePolicy, Rule
from .operators import coverage, decay, draft, features, gate, lint, scan
from .plans.compile import rule_sql
from .sources import captures, logs, synth
from .sources import rules as rule_files


#: Commands and what they take: rules are files or folders, one or more.
COMMANDS = {
    "lint": "rules", "test": "rules events", "scan": "rules events", "regress": "rules captures", "ingest": "events out", "coverage": "rules", "score": "rules",
    "decay": "rules events", "features": "rules", "convert": "rules events", "draft": "report", "synth": "out",
}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="sparkwatch", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, wants in COMMANDS.items():
        p = sub.add_parser(name)
        for w in wants.split():
            p.add_argument(w, nargs="+" if w == "rules" else None)
        p.add_argument("--strict", action="store_true")
        p.add_argument("--days", type=float, default=1.0)
        p.add_argument("--top", type=int, default=20)
        p.add_argument("--fail-on-gate", action="store_true")
        p.add_argument("--allow-empty", action="store_true")
        p.add_argument("--save-baseline", metavar="FILE")
        p.add_argument("--baseline", metavar="FILE")
        p.add_argument("--corpus", metavar="LOGS")
        p.add_argument("--attack", metavar="BUNDLE")
        p.add_argument("--platform", default="Windows")
        p.add_argument("--navigator", metavar="FILE")
        p.add_argument("--routed", action="store_true")
        p.add_argument("--capacity", type=float, default=200.0)
        p.add_argument("--share", type=float, default=0.10)
        p.add_argument("--technique", action="append", default=[])
        p.add_argument("--keywords", action="store_true")
    return top.parse_args(argv)


def _missing(a: argparse.Namespace) -> list[str]:
    """Inputs that aren't there, among those that name local files."""
    given = [*getattr(a, "rules", []), *(getattr(a, k) for k in ("events", "captures", "report") if hasattr(a, k)), *(x for x in (a.baseline, a.corpus, a.attack) if x)]
    return [p for p in given if "://" not in p and "*" not in p and not Path(p).exists()]


def _gate(spark: SparkSession, rules: list[Rule], events: DataFrame, policy: GatePolicy) -> DataFrame:
    """Gate results of a library on its fixtures and a corpus."""
    return gate.gate_library(rules, gate.fixtures(spark, rules), events, Fields(events.schema, document="event"), policy)


def _catalog(spark: SparkSession, path: str | None) -> DataFrame:
    return rule_files.load_stix(spark, path) if path else rule_files.fallback_catalog(spark)


def _against(spark: SparkSession, path: str, result: DataFrame) -> DataFrame:
    """Rules that are worse than in a saved baseline, which has a row for each rule."""
    old = json.loads(Path(path).read_text(encoding="utf-8"))
    before = spark.createDataFrame([(k, float(v["recall"]), int(v["fp_hits"])) for k, v in old.items()], "rule_id string, recall double, fp_hits long")
    return gate.regressions(before, result)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = _arguments(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if missing := _missing(a):
        print(f"no such file or folder: {', '.join(missing)}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    rules, errors = rule_files.load_rule_dir(*a.rules) if hasattr(a, "rules") else ([], {})
    for path, why in errors.items():
        print(f"{path}: {why}", file=sys.stderr)
    if hasattr(a, "rules") and not rules and not a.allow_empty:
        print("no rules", file=sys.stderr)
        return 2
    policy = GatePolicy(corpus_days=a.days, daily_capacity=a.capacity, capacity_share=a.share)
    if a.command == "synth":
        return 0 if logs.write_jsonl(synth.generate(spark), a.out, gzipped=False) else 1
    if a.command == "ingest":
        print(logs.ingest(spark, a.events, a.out).count())
        return 0
    events = logs.read_logs(spark, a.events) if hasattr(a, "events") else None
    if a.command == "lint":
        found = lint.lint_rules(spark, rules)
        found.show(a.top, truncate=100)
        worst = found.filter("severity = 'error'") if not a.strict else found
        return int(bool(errors) or not worst.isEmpty())
    if a.command == "test":
        result = _gate(spark, rules, events, policy)
        result.show(a.top, truncate=60)
        if a.save_baseline:
            rows = result.select("rule_id", "recall", "fp_hits").collect()  # a row for each rule
            Path(a.save_baseline).write_text(json.dumps({r["rule_id"]: {"recall": r["recall"], "fp_hits": r["fp_hits"]} for r in rows}, indent=1), encoding="utf-8")
        if a.baseline:
            worse = _against(spark, a.baseline, result)
            worse.show(a.top, truncate=60)
            return int(not worse.isEmpty())
        return int(not result.filter("not passed").isEmpty())
    if a.command == "regress":
        cases = captures.regression_cases(spark, a.captures)
        files = [r["file"] for r in cases.select("file").distinct().collect() if Path(r["file"]).exists()]  # a catalogue's files
        if not files:
            print("no captures", file=sys.stderr)
            return 0 if a.allow_empty else 2
        found = logs.read_json_files(spark, files, skip_broken=True).withColumn("file", F.regexp_replace("file", "^file:/*", "/"))
        replayed = gate.replay_captures(cases, rules, found)
        replayed.groupBy("status").count().orderBy("status").show()
        failed = replayed.filter("status <> 'pass'")
        failed.select("rule_id", "file", "status", "expected", "matched").show(a.top, truncate=80)
        return int(not failed.isEmpty())
    if a.command == "draft":
        text = Path(a.report).read_text(encoding="utf-8")
        lines = [r["command"] for r in draft.command_lines(spark.createDataFrame([(text,)], "text string")).collect()]  # of one report
        made = (draft.draft_keywords if a.keywords else draft.draft)(lines, a.technique, Path(a.report).stem)
        print(json.dumps(made, indent=1) if made else "the report says too little", file=sys.stdout if made else sys.stderr)
        return int(made is None)
    if a.command == "scan":
        fields = Fields(events.schema, document="event")
        library = scan.Library.build(rules, fields)
        out = scan.gate(scan.hits_per_rule(scan.hits(events, library, ["event_idx"], lambda n: fields(n).sql)), policy)
        out.orderBy(F.desc("hits"), "rule_id").show(a.top, truncate=60)
        return int(a.fail_on_gate and not out.filter("not passed").isEmpty())
    table = rule_files.rules_table(spark, rules)
    if a.command == "coverage":
        passed = _gate(spark, rules, logs.read_logs(spark, a.corpus), policy).filter("passed") if a.corpus else table.limit(0)
        catalog = _catalog(spark, a.attack)
        per = materialize(coverage.by_technique(coverage.active(catalog, a.platform), table, passed), "coverage")
        coverage.summary(per).show()
        coverage.by_tactic(per).orderBy("tactic").show(50, truncate=False)
        print("gaps: " + ", ".join(r["id"] for r in per.filter("claimed = 0").orderBy("id").limit(40).collect()))
        coverage.stale_tags(catalog, table).show(a.top, truncate=60)
        if a.navigator:
            Path(a.navigator).write_text(coverage.navigator_layer(per), encoding="utf-8")
        return 0
    if a.command == "score":
        counts = lint.lint_rules(spark, rules).groupBy("rule_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        ready = table.join(counts, "rule_id", "left").fillna(0, ["errors", "warnings"]).withColumn("n_techniques", F.size("techniques"))
        if a.corpus:
            tested = _gate(spark, rules, logs.read_logs(spark, a.corpus), policy).select("rule_id", "recall", "precision", "fp_hits", "passed")
        else:
            tested = spark.createDataFrame([], "rule_id string, recall double, precision double, fp_hits long, passed boolean")
        gate.score(ready.join(tested, "rule_id", "left")).select("rule_id", "title", "score", "grade").orderBy("rule_id").show(a.top, truncate=80)
        return 0
    if a.command == "decay":
        shape = decay.observed_maps(events)
        gone = decay.drift_of(rules, shape)
        gone.show(a.top, truncate=80)
        issues = gone.count()
        if a.routed:
            out = decay.verdicts(rules, shape).filter("status <> 'ok'")
            out.show(a.top, truncate=80)
            issues += out.filter("status in ('broken', 'source-missing')").count()
        if a.baseline:
            worse = _against(spark, a.baseline, _gate(spark, rules, events, policy))
            worse.show(a.top, truncate=60)
            issues += worse.count()
        print(f"{issues} issues")
        return int(issues > 0)
    if a.command == "features":
        features.feature_table(spark, rules).show(a.top)
        return 0
    failed = 0
    for r in rules:
        try:
            print(rule_sql(r, events.schema, document="event"))
        except ValueError as e:
            failed += 1
            print(f"{r.key}: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
