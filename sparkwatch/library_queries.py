"""Registered queries on files of logs that Spark writes from the tables, on libraries of thousands of rules, and on models of noise."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dialect import Fields
from .functions.stored import materialize, shared_dir
from .model import LogSource, Rule
from .operators import coverage, decay, features, gate, index, lint, reports, routes, scan
from .plans.compile import selection_column
from .queries import _DETECTIONS, _ID, _SAID, _UNROUTED, HITS, RULE_WHERE, TELEMETRY, all_hits, full_library, library, library_rules, query, routed_telemetry, table, telemetry
from .sources import captures, logs
from .sources.rules import rules_table

# files of logs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def json_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines with the events in order of their ids; behind each tenth stands a line that is no event."""
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("Channel"), "user_id", "props")).alias("line"))
    junk = F.when(F.col("event_id") % 10 == 3, F.array("line", F.lit("{not json"))).otherwise(F.array("line"))
    out = _folder(spark, "lines")
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.explode(junk).alias("value")).write.text(out)
    return out


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of text files, numbered within their files and over all files."""
    read = logs.in_order(logs.read_jsonl(spark, json_lines(spark, sf_dir)))
    return read.select(F.col("event")["event_id"].cast("long").alias("event_id"), "position")


@query("SELECT CAST(p // 700 AS INT) AS shard, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) GROUP BY 1")
def ordered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 700 events each in the order of the files, written and read again."""
    out = _folder(spark, "shards")
    logs.write_shards(logs.read_jsonl(spark, json_lines(spark, sf_dir)), out, 700)
    eid = F.get_json_object("value", "$.event_id").cast("long")
    return spark.read.text(out).groupBy("shard").agg(F.count("*").alias("n"), F.min(eid).alias("lo"), F.max(eid).alias("hi"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON files: a document of records for each user, one after the other, streamed and opened again."""
    records = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("event_id", "user_id", F.lit("s3").alias("eventSource"), F.col("event_type").alias("eventName")).alias("r"))
    docs = records.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]).alias("Records"))
    out = _folder(spark, "documents")
    docs.sortWithinPartitions("user_id").select("Records").write.json(out)
    read = logs.read_json_files(spark, out, "*.json").select("file", "event_idx", *[F.col("event")[c].cast("long").alias(c) for c in ("user_id", "event_id")])
    first = read.groupBy("file", "user_id").agg(F.min("event_idx").alias("first"))
    return read.join(first, ["file", "user_id"]).select("user_id", "event_id", (F.col("event_idx") - F.col("first")).alias("place"))


_KINDS = "SELECT event_id, event_id % 4 AS kind, event_type, CAST(user_id AS VARCHAR) AS u FROM events"


@query(
    "SELECT event_id, CASE kind WHEN 1 THEN 'System' ELSE event_type END AS channel, CASE kind WHEN 0 THEN 'P' WHEN 1 THEN 'flat' ELSE '' END AS provider, u AS who, "
    f"CASE kind WHEN 0 THEN 'v' || u WHEN 2 THEN 'text ' || u WHEN 3 THEN '[\"x\",\"' || u || '\",null]' END AS extra FROM ({_KINDS}) k"
)
def evtx_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVTX in JSON in its several forms: names with blanks, sections that wrap, override or are texts, elements with attributes, lists."""
    head = '{"Event":{"System":{"Channel":"%2$s","EventID":1'
    forms = [
        head + ',"Provider":{"#attributes":{"Name":"P"}}},"EventData":{"Who":"%1$d","New Value":"v%1$d"}}}',
        head + ',"Provider":{"Name":"flat"}},"UserData":{"LogFileCleared":{"#attributes":{"x":1},"Channel":"System","Who":"%1$d"}}}}',
        head + '},"EventData":"text %1$d","UserData":{"Who":"%1$d","Other":"o"}}}',
        head + '},"EventData":{"Who":{"#text":"%1$d","#attributes":{"x":1}},"Gone":{"#attributes":{"x":1}},"Data":["x",{"#text":"%1$d"},{"#attributes":{}}]}}}',
    ]
    doc = F.coalesce(*[F.when(F.col("event_id") % 4 == i, F.format_string(f, "user_id", "event_type")) for i, f in enumerate(forms)])
    m = table(spark, sf_dir, "events").select("event_id", logs.normalised(doc).alias("m"))
    return m.filter("m.Gone IS NULL").select("event_id", *[F.col(f"m.{c}").alias(n) for c, n in (("Channel", "channel"), ("Provider_Name", "provider"), ("Who", "who"))], F.coalesce("m.NewValue", "m.Data").alias("extra"))


@query(
    "SELECT event_id, CASE WHEN kind < 2 THEN 'source' ELSE 'named' END AS provider, CASE WHEN kind >= 2 THEN 'source' END AS source, 'h' || u AS computer, event_type AS at_, "
    f"CASE WHEN kind % 2 = 0 THEN 'c:\\' || u ELSE 'own' END AS image FROM ({_KINDS}) k"
)
def flat_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records of process creations: the envelope goes, source, host and time are renamed, and images too unless there is one."""
    names = F.when(F.col("event_id") % 4 >= 2, F.lit("named")).alias("Provider_Name")
    image = F.when(F.col("event_id") % 2 == 1, F.lit("own")).alias("Image")
    user = F.col("user_id").cast("string")
    fields = [F.lit("security").alias("Channel"), F.lit(4688).alias("EventID"), F.lit("source").alias("SourceName"), names, F.concat(F.lit("h"), user).alias("Hostname"), F.col("event_type").alias("@timestamp"), F.lit("m").alias("Message")]
    doc = F.to_json(F.struct(*fields, F.concat(F.lit("c:\\"), user).alias("NewProcessName"), image))
    m = table(spark, sf_dir, "events").select("event_id", logs.aliased(logs.normalised(doc)).alias("m")).filter("m.Message IS NULL AND m.Hostname IS NULL")
    got = {"Provider_Name": "provider", "SourceName": "source", "Computer": "computer", "TimeCreated": "at_", "Image": "image"}
    return m.select("event_id", *[F.col(f"m.{c}").alias(n) for c, n in got.items()])


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'linux-sysmon/operational' WHEN 2 THEN 'aws-cloudtrail' WHEN 5 THEN CASE WHEN event_id % 12 = 5 THEN 'security' END ELSE 'linux-auditd' END AS channel, "
    "CAST(CASE event_id % 6 WHEN 0 THEN 3 WHEN 5 THEN CASE WHEN event_id % 12 = 5 THEN 4688 END ELSE 0 END AS INT) AS eid, "
    "CASE event_id % 6 WHEN 0 THEN 'Linux-Sysmon' WHEN 1 THEN '1.2:' || event_id WHEN 3 THEN '1.2:' || event_id WHEN 5 THEN CASE WHEN event_id % 12 = 5 THEN 'a.exe' END END AS told FROM events WHERE event_id % 6 <> 4"
)
def mixed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text logs (Sysmon XML, auditd, CloudTrail, syslog; other lines are none) and JSON files, read as one."""
    line = [
        '<Event><System><Provider Name="Linux-Sysmon"/><EventID>3</EventID></System><Data Name="Id">%1$d</Data></Event>',
        "type=EXECVE msg=audit(1.2:%1$d): Id=%1$d Id=again",
        '{"Records":[{"eventSource":"s3","eventName":"get","Id":"%1$d"},{"Id":"no event"}]}',
        '{"SyslogMessage":"type=EXECVE msg=audit(1.2:%1$d): Id=%1$d"}',
        '{"Hostname":"not among lines","Id":"%1$d"}',
    ]
    record = [(5, '{"Hostname":"h","Channel":"security","EventID":4688,"NewProcessName":"a.exe","Id":"%1$d"}'), (11, '{"SyslogMessage":"neither","Id":"%1$d"}')]
    events, out = table(spark, sf_dir, "events"), _folder(spark, "mixed")
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == i, F.format_string(f, "event_id")) for i, f in enumerate(line)])
    events.select(text.alias("value")).filter("value IS NOT NULL").write.text(f"{out}/lines")
    doc = F.coalesce(*[F.when(F.col("event_id") % 12 == i, F.format_string(f, "event_id")) for i, f in record])
    events.select(F.from_json(doc, "Hostname string, Channel string, EventID int, NewProcessName string, SyslogMessage string, Id string").alias("d")).filter("d IS NOT NULL").select("d.*").write.json(f"{out}/records")
    read = logs.read_logs(spark, out)
    return read.select(F.col("event.Id").cast("long").alias("event_id"), F.col("Channel").alias("channel"), F.col("EventID").alias("eid"), F.coalesce("event.audit_id", "event.Provider_Name", "event.Image").alias("told"))


@query("SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier FROM events QUALIFY earlier IS NOT NULL")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rules whose ids are users: where an id was used before."""
    rules = table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("path"), F.col("event_id").alias("load_order"))
    return lint.first_with_id(rules).select(F.col("rule_id").alias("user_id"), F.col("path").alias("event_id"), "earlier")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, FALSE AS helper FROM events GROUP BY 1")
def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as compressed JSON lines, without helper columns, and read again."""
    out = _folder(spark, "written")
    logs.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(1).alias("__helper")), out)
    read = logs.read_jsonl(spark, out)
    kind = F.col("event.event_type").alias("event_type")
    return read.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.col("event.event_id").cast("long")).alias("ids"), F.bool_or(F.map_contains_key("event", "__helper")).alias("helper"))


_FLAGS = "SELECT event_id, user_id % 2 = 0 AS flag, CASE user_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' END AS word FROM events"


@query(f"SELECT event_id FROM ({_FLAGS}) f WHERE flag OR word = 'TRUE'")
def sel_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth value meets flags and, in any case, the text that spells it."""
    df = _flags(spark, sf_dir)
    return df.filter(selection_column(df, [{"flag": True}, {"word": True}])).select("event_id")


@query(f"SELECT event_id FROM ({_FLAGS}) f WHERE word IS NULL")
def sel_empty_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No values at all ask for a field that isn't there."""
    df = _flags(spark, sf_dir)
    return df.filter(selection_column(df, {"word": []})).select("event_id")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", (u % 2 == 0).alias("flag"), F.when(u % 3 == 0, "TRUE").when(u % 3 == 1, "yes").alias("word"))


def _told(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Users as files, each with its events, and the five rules of the flagship."""
    df = telemetry(spark, sf_dir).withColumn("file", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return scan.told(df, library(df), lambda n: Fields(df.schema)(n).sql, "event_id")


@query(f"SELECT rule_id, 'user ' || user_id AS file, event_type AS channel, count(*) AS hits FROM ({HITS}) h GROUP BY 1, 2, 3")
def scan_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir)["hits"]


@query("SELECT 'user ' || user_id AS file, count(*) AS events FROM events GROUP BY 1")
def events_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir)["events"]


# thousands of literals

EACH = 700


def literal_library() -> list[Rule]:
    """2,800 rules, each with literals of its own: one literal; two that must be there; beginnings less an exception; alternatives of two fields."""
    out = []
    for n in range(EACH):
        out += [
            ({"s": {"CommandLine|contains": f"-user U{n:05d} "}, "condition": "s"}, LogSource("windows")),
            ({"s": {"CommandLine|contains|all": [f" -cents {n:06d}", ".exe"]}, "condition": "s"}, LogSource("windows", "process_creation")),
            ({"s": {"CommandLine|startswith": [f"click.exe -user u{n:05d}", f"View.exe -user u{n:05d}"]}, "not_1": {"CommandLine|contains": "-key k01"}, "condition": "s and not 1 of not_*"}, LogSource("windows", "process_creation")),
            ({"a": {"CommandLine": f"*user u{n % 150:05d} -key k{n % 100:03d}*"}, "b": {"Parent|endswith": f"parent{EACH + n:06d}"}, "condition": "a or b"}, LogSource("windows")),
        ]
    return [Rule(id=f"{_ID}{i:012d}", title=f"literals {i}", detection=d, logsource=source) for i, (d, source) in enumerate(out)]


def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processes: clicks and views in Sysmon, errors in Security, others in a channel that only rules for all of Windows see."""
    cents = F.round(F.col("value") * 100).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    key = F.get_json_object("props", "$.k").cast("long")
    line = F.concat("event_type", F.lit(".exe -user u"), pad(F.col("user_id"), 5), F.lit(" -key k"), pad(key, 3), F.lit(" -cents "), pad(cents, 6))
    channel = F.when(F.col("event_type").isin("click", "view"), routes.SYSMON).when(F.col("event_type") == "error", routes.SECURITY).otherwise("application")
    eid = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", 4688).otherwise(7)
    return table(spark, sf_dir, "events").select("event_id", channel.alias("Channel"), eid.alias("EventID"), line.alias("CommandLine"), F.concat(F.lit("parent"), pad(cents, 6)).alias("Parent"))


_LITERAL_HITS = f"""
WITH t AS (SELECT event_id, event_type, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events),
h AS (SELECT event_id, 4 * u AS i FROM t WHERE u < {EACH}
UNION ALL SELECT event_id, 4 * c + 1 FROM t WHERE c BETWEEN 0 AND {EACH - 1} AND event_type IN ('click', 'view', 'error')
UNION ALL SELECT event_id, 4 * u + 2 FROM t WHERE u < {EACH} AND event_type IN ('click', 'view') AND k // 10 <> 1
UNION ALL SELECT event_id, 4 * n + 3 FROM t, range({EACH}) r(n) WHERE (t.u = n % 150 AND t.k = n % 100) OR t.c = {EACH} + n)
SELECT '{_ID}' || lpad(CAST(i AS VARCHAR), 12, '0') AS rule_id"""


@query(f"{_LITERAL_HITS}, count(*) AS hits, min(event_id) AS first_hit FROM h GROUP BY 1")
def scan_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 2,800 rules of distinct literals, found by an index of these."""
    df = command_lines(spark, sf_dir)
    found = index.hits(df, scan.Library.build(literal_library(), Fields(df.schema)), ["event_id"])
    return scan.hits_per_rule(found, "event_id")


@query(f"{_LITERAL_HITS}, event_id FROM h")
def scan_literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = command_lines(spark, sf_dir)
    return index.hits(df, scan.Library.build(literal_library(), Fields(df.schema)), ["event_id"]).select("rule_id", "event_id")


# the gate of a library

_N = len(full_library())
_TESTS = ", ".join(f"coalesce({w}, FALSE) AS m{j}" for j, (_, w) in enumerate(_DETECTIONS))
_GATE = f"""
WITH t AS (SELECT event_id, {_TESTS} FROM events),
r AS (SELECT n, n % 3 AS j FROM range({_N}) x(n)),
f AS (SELECT (event_id // 3) % {_N} AS n, event_id % 2 = 0 AS tp, event_id, CASE ((event_id // 3) % {_N}) % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS hit FROM t WHERE event_id % 3 = 0),
c AS (SELECT n, count(*) FILTER (tp) AS tp_total, count(*) FILTER (tp AND hit) AS tp_fired, count(*) FILTER (NOT tp) AS tn_total, count(*) FILTER (NOT tp AND hit) AS tn_fired, min(event_id) FILTER (tp AND NOT hit) AS first_missed FROM f GROUP BY 1),
e AS (SELECT count(*) AS size, count(*) FILTER (m0) AS h0, count(*) FILTER (m1) AS h1, count(*) FILTER (m2) AS h2 FROM t WHERE event_id % 3 <> 0),
a AS (SELECT r.n, coalesce(tp_total, 0) AS tp_total, coalesce(tp_fired, 0) AS tp_fired, coalesce(tn_total, 0) AS tn_total, coalesce(tn_fired, 0) AS tn_fired, size AS corpus_size, CASE j WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END AS fp_hits, coalesce(first_missed, -1) AS first_missed FROM r LEFT JOIN c USING (n), e)
SELECT '{_ID}' || lpad(CAST(n AS VARCHAR), 12, '0') AS rule_id, tp_total, tp_fired, tn_total, tn_fired, corpus_size, fp_hits, first_missed, CAST(least(20, tp_total - tp_fired) AS INT) AS n_missed,
coalesce(tp_fired / nullif(tp_fired + tn_fired + fp_hits, 0), 0.0) AS precision, coalesce(tp_fired / nullif(tp_total, 0), 0.0) AS recall,
tp_total > 0 AND tp_fired = tp_total AND tn_fired = 0 AND fp_hits / corpus_size <= 0.001 AND fp_hits <= 20 AS passed FROM a"""


@query(_GATE)
def gate_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a library over all routes: a third of the events are fixtures, each of one rule, the rest is the corpus."""
    df = routed_telemetry(spark, sf_dir)
    number = F.lpad((F.floor(F.col("event_id") / 3) % _N).cast("string"), 12, "0")
    cases = df.filter("event_id % 3 = 0").withColumns({"rule_id": F.concat(F.lit(_ID), number), "kind": F.when(F.col("event_id") % 2 == 0, "tp").otherwise("tn"), "idx": F.col("event_id")})
    out = gate.gate_library(full_library(), cases, df.filter("event_id % 3 <> 0"), Fields(df.schema), index="event_id")
    first = F.coalesce(F.get("missed_tps", F.lit(0)), F.lit(-1)).alias("first_missed")
    return out.select("rule_id", "tp_total", "tp_fired", "tn_total", "tn_fired", "corpus_size", "fp_hits", first, F.size("missed_tps").alias("n_missed"), "precision", "recall", "passed")


# changes of schema


def decay_library() -> list[Rule]:
    """Rules over the fields that changes of schema take away: in several sources, under filters, as alternatives."""
    process, security, windows = LogSource("windows", "process_creation"), LogSource("windows", "", "security"), LogSource("windows")
    found = [
        ({"s": {"CommandLine|contains": "run 1"}, "condition": "s"}, process),
        ({"s": {"Hashes|contains": "MD5=1"}, "condition": "s"}, process),
        ({"s": {"Image|endswith": "click.exe"}, "condition": "s"}, process),
        ({"s": {"User": "u7"}, "condition": "s"}, process),
        ({"s": {"Image|contains": "view"}, "condition": "s"}, windows),
        ({"s": {"CommandLine|contains": "run 2"}, "condition": "s"}, security),
        ({"s": {"Image|endswith": ".exe"}, "f": {"CommandLine|contains": "run"}, "condition": "s and not f"}, process),
        ({"a": {"Hashes|contains": "MD5=2"}, "b": {"Image": "error.exe"}, "condition": "a or b"}, process),
    ]
    return [Rule(id=f"{_ID}{i:012d}", title=f"decay {i}", detection=d, logsource=source) for i, (d, source) in enumerate(found, 1)]


def process_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as maps: clicks and views are Sysmon's process creations and connections, errors Security's process creations."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    channel = F.when(kind.isin("click", "view"), "Microsoft-Windows-Sysmon/Operational").when(kind == "error", "Security").otherwise("application")
    eid = F.when(kind == "click", 1).when(kind == "view", 3).when(kind == "error", 4688).otherwise(7)
    values = {"Channel": channel, "EventID": eid, "Image": F.concat(kind, F.lit(".exe")), "CommandLine": F.concat(F.lit("run "), F.col("user_id").cast("string")), "Hashes": F.concat(F.lit("MD5="), k), "User": F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))}
    return table(spark, sf_dir, "events").select("event_id", F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v.cast("string"))]).alias("event"))


_CHANGED = f"""
WITH e AS (SELECT event_type AS t, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('click', 'view') THEN 'sysmon' WHEN event_type = 'error' THEN 'security' ELSE 'application' END AS ch, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'error' THEN 4688 ELSE 7 END AS id FROM events),
c AS (SELECT e.*, v.change, v.change IN ('sysmon_to_4688', '4688_no_cmdline', '4688_no_cmdline_mixed') AND ch = 'sysmon' AS conv FROM e, (VALUES ('none'), ('ecs_rename'), ('sysmon_to_4688'), ('4688_no_cmdline'), ('4688_no_cmdline_mixed'), ('no_commandline'), ('no_hashes')) v(change)),
x AS (SELECT change, CASE WHEN conv THEN 'security' ELSE ch END AS ch, CASE WHEN conv THEN 4688 ELSE id END AS id,
  CASE WHEN change <> 'ecs_rename' THEN t || '.exe' END AS image,
  CASE WHEN change IN ('ecs_rename', 'no_commandline') OR (conv AND change LIKE '4688%') OR (change = '4688_no_cmdline' AND ch = 'security' AND id = 4688) THEN NULL ELSE 'run ' || user_id END AS line,
  CASE WHEN change IN ('ecs_rename', 'no_hashes') OR conv THEN NULL ELSE 'md5=' || k END AS hashes,
  CASE WHEN change = 'ecs_rename' OR conv THEN NULL ELSE 'u' || (user_id % 10) END AS who
  FROM c WHERE NOT (conv AND id <> 1)),
p AS (SELECT *, (ch = 'sysmon' AND id = 1) OR (ch = 'security' AND id = 4688) AS process FROM x),
h AS (SELECT change, unnest([CASE WHEN process AND contains(line, 'run 1') THEN 1 END, CASE WHEN process AND contains(hashes, 'md5=1') THEN 2 END, CASE WHEN process AND ends_with(image, 'click.exe') THEN 3 END, CASE WHEN process AND who = 'u7' THEN 4 END,
  CASE WHEN contains(image, 'view') THEN 5 END, CASE WHEN ch = 'security' AND contains(line, 'run 2') THEN 6 END, CASE WHEN process AND ends_with(image, '.exe') AND NOT coalesce(contains(line, 'run'), FALSE) THEN 7 END, CASE WHEN process AND (contains(hashes, 'md5=2') OR image = 'error.exe') THEN 8 END]) AS n FROM p)"""


@query(f"{_CHANGED} SELECT change, '{_ID}' || lpad(CAST(n AS VARCHAR), 12, '0') AS rule_id, count(*) AS hits FROM h WHERE n IS NOT NULL GROUP BY 1, 2")
def decay_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each rule before and after six changes of schema, in one read."""
    found = decay.evidence(process_maps(spark, sf_dir), decay_library()).filter("rule_id is not null")
    return found.select(F.when(F.col("change") == "", "none").otherwise(F.col("change")).alias("change"), "rule_id", F.col("n").alias("hits"))


@query(f"{_CHANGED}, b AS (SELECT DISTINCT n FROM h WHERE change = 'none' AND n IS NOT NULL) SELECT v.change, count(*) AS rules, count(*) FILTER (a.n IS NULL) AS decayed FROM b CROSS JOIN (SELECT DISTINCT change FROM c WHERE change <> 'none') v LEFT JOIN (SELECT DISTINCT change, n FROM h) a ON a.change = v.change AND a.n = b.n GROUP BY 1")
def decay_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the rules that fired no longer do, by change: what the monitors are held against."""
    rules = decay_library()
    told = reports.decay_changes(rules, materialize(decay.evidence(process_maps(spark, sf_dir), rules), "evidence"))
    return told.filter("method = 'verdict'").select("change", "rules", "decayed")


@query()
def decay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three monitors on six changes of schema, with exact paired p values."""
    rules = decay_library()
    return reports.decay_changes(rules, materialize(decay.evidence(process_maps(spark, sf_dir), rules), "evidence"))


# engines

_ABLATION = " UNION ALL ".join(f"SELECT '{_ID}{i:012d}' AS rule_id, count(*) FILTER ({RULE_WHERE[i]}) AS routed, count(*) FILTER ({_UNROUTED[i]}) AS unrouted FROM ({TELEMETRY}) t" for i in RULE_WHERE)


@query(_ABLATION)
def routing_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What routing takes from each rule's hits."""
    df = telemetry(spark, sf_dir)
    return scan.ablation(df, library(df)).select("rule_id", "routed", "unrouted")


_ALL_UNROUTED = " UNION ALL ".join(f"SELECT '{_ID}{i:012d}' AS rule_id, * FROM ({TELEMETRY}) t WHERE {w}" for i, w in _UNROUTED.items())
_SIDE = "SELECT rule_id, user_id AS file, count(*) AS n, list_sort(list(event_id)) AS ids FROM ({}) x GROUP BY 1, 2"


@query(
    f"WITH a AS ({_SIDE.format(HITS)}), b AS ({_SIDE.format(_ALL_UNROUTED)}), c AS (SELECT DISTINCT r.rule_id, e.user_id AS file FROM events e, (VALUES {', '.join(f'({chr(39)}{_ID}{i:012d}{chr(39)})' for i in RULE_WHERE)}) r(rule_id)), "
    "j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y, coalesce(a.ids, []) = coalesce(b.ids, []) AS same FROM c LEFT JOIN a USING (rule_id, file) LEFT JOIN b USING (rule_id, file)), "
    "s AS (SELECT count(*) AS cases, count(*) FILTER (x > 0 AND y > 0) AS both_, count(*) FILTER (x > 0 AND y = 0) AS only_a, count(*) FILTER (x = 0 AND y > 0) AS only_b, count(*) FILTER (x = 0 AND y = 0) AS neither, count(*) FILTER (x = y) AS same_count, count(*) FILTER (same) AS same_events FROM j), "
    "k AS (SELECT *, ((both_ + only_a) * (both_ + only_b) + (cases - both_ - only_a) * (cases - both_ - only_b)) / (cases * cases) AS chance FROM s) "
    "SELECT cases, both_, only_a, only_b, neither, same_count, same_events, round(((both_ + neither) / cases - chance) / (1 - chance), 9) AS kappa FROM k"
)
def two_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as captures, each with every rule: the routed scan against one without routes, whose hits are read from a table."""
    from .plans.compile import hit_column

    df = telemetry(spark, sf_dir)
    tests = F.array_compact(F.array(*[F.when(hit_column(df, r), F.lit(r.key)) for r in library_rules()]))
    other = materialize(df.select("event_id", F.col("user_id").alias("file"), F.explode(tests).alias("rule_id")), "engine")
    own = all_hits(spark, sf_dir).select("rule_id", F.col("user_id").alias("file"), "event_id")
    cases = df.select(F.col("user_id").alias("file")).distinct().select("file", F.explode(F.array(*[F.lit(r.key) for r in library_rules()])).alias("rule_id"))
    out = reports.verdicts_of_two(own, other, cases, "event_id")
    return out.withColumnRenamed("both", "both_").withColumn("kappa", F.round("kappa", 9))


# captures


@query(f"SELECT d.id, coalesce(bool_or(s.id = d.t OR s.id = split_part(d.t, '.', 1)), FALSE) AS claimed FROM (SELECT DISTINCT event_type AS id, CASE WHEN event_type IN ('error', 'click') THEN 'T1059.001' WHEN event_type = 'signup' THEN 'T1110.003' ELSE 'T1486' END AS t FROM events) d LEFT JOIN {_SAID} ON TRUE GROUP BY 1")
def detection_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as captures of one technique each, and whether any rule names it, fired or not."""
    what = F.when(F.col("id").isin("error", "click"), "T1059.001").when(F.col("id") == "signup", "T1110.003").otherwise("T1486")
    sets = telemetry(spark, sf_dir).select(F.col("event_type").alias("id")).distinct().select("id", F.array(what).alias("techniques"))
    return coverage.claimed(sets, rules_table(spark, library_rules()))


@query("WITH m AS (SELECT doc_id AS key, coalesce(text, '') || ' see report ' || (doc_id % 40) || ' (final).pcap, a.b and T1105' AS text FROM documents), f AS (SELECT DISTINCT unnest(['report ' || (event_id % 25) || ' (final).pcap', 'a.b', 'nowhere ' || (event_id % 25)]) AS name FROM events) SELECT f.name, m.key FROM f JOIN m ON contains(m.text, f.name)")
def contained_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that hold a file's name, blanks, brackets and short ones included."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" see report "), (F.col("doc_id") % 40).cast("string"), F.lit(" (final).pcap, a.b and T1105"))
    metadata = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), said.alias("text"))
    n = (F.col("event_id") % 25).cast("string")
    files = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat(F.lit("report "), n, F.lit(" (final).pcap")), F.lit("a.b"), F.concat(F.lit("nowhere "), n))).alias("name"))
    return captures.named_in(files, metadata).select("name", "key")


# models of noise


@query(
    "WITH s AS (SELECT CAST(l.toxic AS DOUBLE) AS y, -floor(d.n_chars / 200) AS score FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), "
    "r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g) SELECT round(1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc, round(sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos), 9) AS pr_auc FROM r"
)
def rank_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas under the ROC and precision-recall curves of a score with many ties."""
    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.lit("length").alias("model"), F.col("toxic").cast("double").alias("y"), (-F.floor(F.col("n_chars") / 200)).alias("score"))
    return features.areas(scored, ["model"]).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


@query()
def noise_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the place of rules: models of low quality from counts, by stratified held-out folds, beside plain signs and chance."""
    text = F.coalesce("text", F.lit(""))
    counts = {"level": F.length(text), "hunting": F.regexp_count(text, F.lit(r"[0-9]")), "n_filters": F.regexp_count(text, F.lit(r"\n")), "marks": F.regexp_count(text, F.lit(r"[^\w\s]"))}
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", *[v.cast("double").alias(k) for k, v in counts.items()]), "counts")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label")).filter("label is not null")
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("rule_id"), "label", *counts)
    return features.cross_validate(rows, list(counts), folds=2, rounds=5)
