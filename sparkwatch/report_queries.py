"""Registered queries of the reports, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .model import LogSource, Rule
from .operators import coverage, decay, lint, reports, routes, scan
from .plans.compile import hit_column
from .queries import _CATALOG, _FIELDS, _ID, _SAID, CATALOG_ROWS, HITS, POLICY, ROUTES, RULE_WHERE, TELEMETRY, _event_rules, all_hits, library, library_rules, query, table, telemetry
from .sources import captures, logs
from .sources.rules import CATALOG_SCHEMA, rules_table

_ROUTES_SQL = "(VALUES " + ", ".join(f"('{_ID}{i:012d}', '{c}', {'NULL' if e is None else e})" for i, r in ROUTES.items() for c, e in r.pairs) + ") r(rule_id, c, e)"
_ROUTED = f"SELECT r.rule_id, count(*) AS routed_events FROM ({TELEMETRY}) t JOIN {_ROUTES_SQL} ON (r.c = t.\"Channel\" OR r.c = '*') AND (r.e IS NULL OR r.e = t.\"EventID\") GROUP BY 1"
_LEVELS = "(VALUES " + ", ".join(f"('{r.key}', '{r.level}')" for r in library_rules()) + ") l(rule_id, level)"
#: Rules on the list of known false positives, with a pattern or none.
KNOWN = [(f"{_ID}{i:012d}", "t", p) for i, p in ((1, "a.*"), (5, None), (1, None))]
_REPORT = f"SELECT rule_id, level, coalesce(routed_events, 0) AS routed_events, coalesce(n, 0) AS hits, coalesce(n, 0) / 30.0 AS alerts_per_day, CASE WHEN coalesce(n, 0) / 30.0 <= 20 THEN 'pass' ELSE 'fail' END AS gate, rule_id IN ('{_ID}000000000001', '{_ID}000000000005') AS known_fp FROM {_LEVELS} LEFT JOIN ({_ROUTED}) USING (rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({HITS}) h GROUP BY 1) USING (rule_id)"


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "rule_id string, title string, pattern string")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    built = library(df)
    routed = reports.routed_events(scan.events_by_key(df), built.routes_table(spark))
    return reports.false_positives(rules_table(spark, library_rules()).select("rule_id", "level"), scan.hits_per_rule(scan.hits(df, built, ["event_id"]), "event_id"), routed, _known(spark), POLICY)


@query(_ROUTED)
def routed_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return reports.routed_events(scan.events_by_key(df), library(df).routes_table(spark))


@query(_REPORT)
def fp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"SELECT count(*) AS rules, count(*) FILTER (routed_events > 0) AS observable, count(*) FILTER (hits > 0) AS fired, CAST(sum(hits) AS BIGINT) AS alerts, count(*) FILTER (gate = 'fail') AS gate_fail, count(*) FILTER (hits > 0 AND level IN ('medium', 'high', 'critical')) AS fired_medium_up, count(*) FILTER (hits > 0 AND level IN ('medium', 'high', 'critical') AND known_fp) AS fired_medium_up_known, count(*) FILTER (hits > 0 AND known_fp) AS known_fired, count(*) FILTER (hits > 0 AND level <> 'low' AND NOT known_fp) AS not_low_unlisted FROM ({_REPORT})")
def fp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.false_positive_summary(_report(spark, sf_dir))


@query(f"SELECT rule_id, hits FROM ({_REPORT}) WHERE hits > 0 AND NOT known_fp")
def fp_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unlisted(_report(spark, sf_dir), _known(spark)).select("rule_id", "hits")


# rollups

_KINDS = "(SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))"


@query(f"SELECT attribute, value, count(*) AS rules FROM (SELECT unnest([{{'attribute': 'status', 'value': 'test'}}, {{'attribute': 'level', 'value': 'low'}}, {{'attribute': 'product', 'value': 'windows'}}, {{'attribute': 'title', 'value': 'type ' || event_type}}, {{'attribute': 'service', 'value': '(none)'}}], recursive := true) FROM {_KINDS}) GROUP BY 1, 2")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attribute_counts(rules_table(spark, _event_rules(spark, sf_dir)), ["status", "level", "product", "title", "service"])


@query(f"SELECT count(*) AS rules_with_errors, count(*) AS rules_with_warnings FROM {_KINDS}")
def lint_rules_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rules_with_findings(lint.lint_rules(spark, _event_rules(spark, sf_dir)))


@query('SELECT event_type, median(value) AS "median", list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events GROUP BY 1')
def median_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.medians(table(spark, sf_dir, "events"), "event_type", "value")


@query('SELECT "group", channel, n FROM (SELECT user_id % 50 AS "group", event_type AS channel, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY n DESC, channel) = 1')
def majority_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.majority_channel(telemetry(spark, sf_dir).withColumn("group", F.col("user_id") % 50), "group")


_TEXTS = "SELECT coalesce(source, 'none') AS folder, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN chr(10) || '  condition: sel | count() by User > 5' WHEN 1 THEN chr(10) || 'correlation:' || chr(10) || 'correlation: x' WHEN 2 THEN chr(10) || ' condition: sel | counting' ELSE '' END AS text FROM documents"


@query(f"SELECT folder, count(*) AS files, count(*) FILTER (contains(text, 'count(')) AS with_count_call, count(*) FILTER (regexp_matches(text, '(?m)^[ \\t]*condition:.*\\|[ \\t]*(count|min|max|avg|sum|near)\\b')) AS with_aggregation_condition, CAST(sum(len(regexp_extract_all(text, '(?m)^correlation:'))) AS BIGINT) AS correlation_documents FROM ({_TEXTS}) GROUP BY 1")
def aggregation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines of rules behind them, by their source as folder."""
    k = F.col("doc_id") % 4
    more = F.when(k == 0, "\n  condition: sel | count() by User > 5").when(k == 1, "\ncorrelation:\ncorrelation: x").when(k == 2, "\n condition: sel | counting").otherwise("")
    texts = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("folder"), F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return reports.aggregation_census(texts)


_PASSING = f"(SELECT rule_id, count(*) AS n FROM ({HITS}) h GROUP BY 1)"


def _levels() -> str:
    summary = "SELECT '{level}' AS level, count(*) AS total, count(*) FILTER (claimed > 0) AS covered, count(*) FILTER (ok > 0) AS validated, count(DISTINCT split_part(id, '.', 1)) FILTER (claimed > 0) AS parents_covered FROM (SELECT k.id, count(s.rule_id) AS claimed, count(s.rule_id) FILTER ({where}) AS ok FROM {catalog} LEFT JOIN {said} USING (id) LEFT JOIN {passing} p USING (rule_id) WHERE k.live GROUP BY k.id)"
    levels = {"claimed": "s.rule_id IS NOT NULL", "validated": "p.n > 0", "validated_and_gated": "p.n > 0 AND p.n / 30.0 <= 20"}
    return " UNION ALL ".join(summary.format(level=k, where=w, catalog=_CATALOG, said=_SAID, passing=_PASSING) for k, w in levels.items())


@query(_levels())
def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scan.gate(all_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("hits")), POLICY)
    catalog = coverage.active(spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA))
    return reports.coverage_levels(catalog, rules_table(spark, library_rules()), per, per.filter("not passed"))


# decay

_CAPTURED = f"SELECT user_id % 20 AS file, CASE WHEN \"Channel\" = 'click' AND user_id % 3 = 0 THEN '{routes.SYSMON}' WHEN \"Channel\" = 'purchase' AND user_id % 2 = 0 THEN '{routes.SECURITY}' ELSE \"Channel\" END AS channel"


@query(f"WITH e AS ({_CAPTURED}, CASE \"Channel\" WHEN 'purchase' THEN 4688 ELSE \"EventID\" END AS eid FROM ({TELEMETRY}) t), f AS (SELECT file FROM e GROUP BY 1 HAVING bool_or(channel = '{routes.SYSMON}' AND eid = 1) AND bool_or(channel = '{routes.SECURITY}' AND eid = 4688)), h AS ({_CAPTURED}, rule_id FROM ({HITS}) x) SELECT rule_id, bool_or(channel <> '{routes.SYSMON}') AS fires_after FROM h WHERE file IN (SELECT file FROM f) GROUP BY 1")
def removal_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as captures, some of whose clicks are Sysmon's and some of whose purchases are process creations of Security."""
    file = (F.col("user_id") % 20).alias("file")
    channel = F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), routes.SYSMON).when((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0), routes.SECURITY).otherwise(F.col("event_type")).alias("channel")
    eid = F.when(F.col("event_type") == "purchase", 4688).otherwise(F.col("EventID")).alias("eid")
    by_file = telemetry(spark, sf_dir).groupBy(file, channel, eid).agg(F.count("*").alias("n"))
    return reports.removal_truth(all_hits(spark, sf_dir).select("rule_id", file, channel), by_file)


def _windows() -> list[Rule]:
    return [Rule(**{**r.__dict__, "logsource": LogSource("windows")}) for r in library_rules()]


_FLAGS = f"SELECT rule_id, bool_or(needed AND field = 'value') AS verdict, bool_or(field = 'value') AS by_source, bool_or(field = 'value') AS anywhere, bool_or(field = 'value') AS worsened FROM {_FIELDS} WHERE (SELECT count(value) FROM events) > 0 GROUP BY 1"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return reports.decay_flags(_windows(), decay.observed(df), decay.observed(df.drop("value")))


@query(_FLAGS)
def decay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


_LOST = " UNION ALL ".join(f"SELECT '{_ID}{i:012d}' AS rule_id, count(*) FILTER ({w}) AS before, count(*) FILTER ({w.replace('value', 'CAST(NULL AS DOUBLE)')}) AS after FROM ({TELEMETRY}) t" for i, w in RULE_WHERE.items())


@query(f"SELECT method, count(*) FILTER (flag) AS flagged, count(*) FILTER (flag AND decayed) AS found, count(*) FILTER (decayed) AS decayed, count(*) FILTER (flag AND NOT decayed) AS false_alarms, count(*) FILTER (verdict = decayed AND flag <> decayed) AS only_verdict_right, count(*) FILTER (verdict <> decayed AND flag = decayed) AS only_method_right, count(*) FILTER (flag AND decayed) / nullif(count(*) FILTER (decayed), 0) AS recall, count(*) FILTER (flag AND decayed) / nullif(count(*) FILTER (flag), 0) AS precision FROM (SELECT f.rule_id, l.after = 0 AS decayed, f.verdict, unnest(['verdict', 'by_source', 'anywhere']) AS method, unnest([f.verdict, f.by_source, f.anywhere]) AS flag FROM ({_FLAGS}) f JOIN ({_LOST}) l USING (rule_id) WHERE l.before > 0) GROUP BY 1")
def decay_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that no longer fire once `value` is gone, against what three monitors flag."""
    df = telemetry(spark, sf_dir)
    gone = df.withColumn("value", F.lit(None).cast("double"))
    before, after = (scan.hits(x, library(x), ["event_id"]).select("rule_id").distinct() for x in (df, gone))
    return reports.decay_methods(_flags(spark, sf_dir), before.join(after, "rule_id", "left_anti"), before)


# side by side


@query(f"SELECT rule_id, count(*) AS both, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, TRUE AS same FROM ({HITS}) h GROUP BY 1")
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed scan against each rule's own predicate under its route."""
    df = scan.keyed(telemetry(spark, sf_dir))
    tests = F.array_compact(F.array(*[F.when(hit_column(df, r) & routes.applies(ROUTES[i], F.col("__channel"), F.col("__eid"), F.col), F.lit(r.key)) for i, r in enumerate(library_rules(), 1)]))
    one_by_one = df.select("event_id", F.explode(tests).alias("rule_id"))
    return reports.agreement(scan.hits(telemetry(spark, sf_dir), library(df), ["event_id"]), one_by_one, "event_id")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.hit, FALSE) AS a, coalesce(b.hit, FALSE) AS b FROM (SELECT user_id, bool_or(value >= 90) AS hit FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, bool_or(value < 5) AS hit FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.user_id = b.user_id")
def paired_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods on users as cases, neither of which has all of them."""
    df = table(spark, sf_dir, "events")
    a = df.filter("event_type = 'click'").select("user_id", (F.col("value") >= 90).alias("hit"))
    b = df.filter("event_type = 'signup'").select("user_id", (F.col("value") < 5).alias("hit"))
    return reports.paired(a, b, "user_id")


@query(f"SELECT r.rule_id, r.file, o.own IS NOT NULL AS fires, coalesce(h.benign, 0) AS benign_hits FROM (VALUES ('{_ID}000000000001', 'error'), ('{_ID}000000000002', 'error'), ('{_ID}000000000003', 'view'), ('{_ID}000000000009', 'click')) r(rule_id, file) LEFT JOIN (SELECT rule_id, event_type, count(*) AS own FROM ({HITS}) x GROUP BY 1, 2) o ON o.rule_id = r.rule_id AND o.event_type = r.file LEFT JOIN (SELECT rule_id, count(*) FILTER (event_type = 'signup') AS benign FROM ({HITS}) y GROUP BY 1) h ON h.rule_id = r.rule_id")
def draft_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as drafts for channels as captures; signups are benign."""
    drafts = spark.createDataFrame([(f"{_ID}{i:012d}", f) for i, f in ((1, "error"), (2, "error"), (3, "view"), (9, "click"))], "rule_id string, file string")
    return reports.draft_results(drafts, all_hits(spark, sf_dir).select("rule_id", F.col("event_type").alias("file")), "signup")


@query("SELECT round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, count(*) AS n FROM (SELECT avg(value) AS value FROM events GROUP BY event_type)")
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    return stats.mean_interval(means, "value").select(F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n")


@query("SELECT round(sum(hits * greatest(0, least(size, 50 - (running - size))) / size) / 50, 9) AS precision_at_k, round(sum(hits * greatest(0, least(size, ceil(0.1 * total) - (running - size))) / size) / sum(hits), 9) AS recall_at_share FROM (SELECT score, size, hits, sum(size) OVER (ORDER BY score DESC) AS running, sum(size) OVER () AS total FROM (SELECT n_chars // 100 AS score, count(*) AS size, count(*) FILTER (toxic = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1))")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    out = stats.rank_metrics(df, "score", "toxic", 50)
    return out.select(F.round("precision_at_k", 9).alias("precision_at_k"), F.round("recall_at_share", 9).alias("recall_at_share"))


# captures and documents


@query("SELECT event_id, CAST(4 AS INT) AS fields, event_type AS event_type, CAST(user_id AS VARCHAR) AS a_user FROM events")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events flattened for a search index: dots in names, names that meet, and a text that is too long."""
    doc = F.to_json(F.struct("event_type", F.col("user_id").alias("a.user"), F.lit("later").alias("a_user"), F.struct("value").alias("nested"), F.lit("x").alias("n.k"), F.when(F.col("event_id") % 500 == 0, F.repeat(F.lit("y"), 40_000)).alias("long")))
    got = table(spark, sf_dir, "events").select("event_id", reports.search_document(logs.normalised(doc)).alias("d"))
    return got.select("event_id", F.size("d").alias("fields"), F.col("d.event_type").alias("event_type"), F.col("d.a_user").alias("a_user"))


@query("WITH m AS (SELECT doc_id AS key, coalesce(text, '') || ' see capture_' || (doc_id % 40) || '.zip and T1059.001, T1105' AS text FROM documents), f AS (SELECT DISTINCT 'capture_' || (event_id % 25) || '.zip' AS name FROM events) SELECT f.name, m.key, 'T1059.001,T1105' AS techniques FROM f JOIN m ON contains(m.text, ' ' || f.name || ' ')")
def named_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that name a capture's file, and the techniques that they name."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" see capture_"), (F.col("doc_id") % 40).cast("string"), F.lit(".zip and T1059.001, T1105"))
    metadata = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), said.alias("text"))
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("capture_"), (F.col("event_id") % 25).cast("string"), F.lit(".zip")).alias("name"))
    return captures.named_in(files, metadata).withColumn("techniques", F.array_join("techniques", ","))
