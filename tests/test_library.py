"""Libraries at size: the literal index and the gate against the plain ways, event numbers over splits, archives as streams, exact shards."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkwatch.functions.dialect import Fields
from sparkwatch.model import GatePolicy, LogSource, Rule
from sparkwatch.operators import gate, index, scan
from sparkwatch.plans.compile import hit_column
from sparkwatch.sources import logs, members

WORDS = ["alpha", "Bravo", "charlie", "delta-7", "échoes", "foxtrot.exe", "golf club", "/enc x", "straße", "KELVIN", "mississippi"]
SOURCES = [LogSource("windows"), LogSource("windows", "process_creation"), LogSource("windows", "", "security"), LogSource("linux", "process_creation"), LogSource("windows", "registry_add")]


def random_rules(rng, n):
    def word():
        w = rng.choice(WORDS)
        if rng.random() < 0.3:
            w = rng.choice(["*" + w, w[:4] + "*" + w[4:], w + "?", w.upper(), w[:3]])
        return w

    def field():
        mods = rng.choice(["", "|contains", "|startswith", "|endswith", "|contains|all", "|cased|contains", "|windash|contains", "|neq", "|re", "|exists"])
        if mods == "|re":
            return {f"a{mods}": "br.vo"}
        if mods == "|exists":
            return {f"b{mods}": rng.random() < 0.5}
        return {f"{rng.choice(['a', 'b', 'c', 'd.e', 'nowhere'])}{mods}": rng.choice([word(), [word(), word()], [word(), None], 7])}

    def selection():
        kind = rng.random()
        if kind < 0.15:
            return [word(), word()]
        if kind < 0.25:
            return {"|all": [word(), word()]}
        if kind < 0.4:
            return [field(), field() | field()]
        return field() | (field() if rng.random() < 0.5 else {})

    conditions = ["s", "s and not t", "s or t", "1 of them", "all of them", "not s", ["s", "t"], "s and (t or not u)"]
    return [Rule(id=f"r{i}", detection={"s": selection(), "t": selection(), "u": selection(), "condition": rng.choice(conditions)}, logsource=rng.choice(SOURCES)) for i in range(n)]


def random_events(spark, rng, n, as_map):
    def text():
        return None if rng.random() < 0.2 else " ".join(rng.choice([*WORDS, "FOXTROT.EXE", "bravo", "miſsiſsippi", "K"]) for _ in range(rng.randint(1, 4)))

    channels = ["Security", "Microsoft-Windows-Sysmon/Operational", "linux-sysmon/operational", "Other", None]
    rows = [(i, rng.choice(channels), rng.choice([1, 12, 4688, None]), text(), text(), [x for x in [text(), text()] if x], {"e": text()}, rng.choice(["CreateKey", "x"])) for i in range(n)]
    df = spark.createDataFrame(rows, "event_idx long, Channel string, EventID int, a string, b string, c array<string>, d struct<e: string>, EventType string")
    if not as_map:
        return df
    nested = F.when(F.col("d.e").isNotNull(), F.to_json("d"))
    event = F.map_filter(F.create_map(*[x for k, v in {"a": F.col("a"), "b": F.col("b"), "c": F.array_join("c", " "), "d": nested, "EventType": F.col("EventType")}.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return df.select("event_idx", "Channel", "EventID", event.alias("event"))


@pytest.mark.parametrize("seed,as_map", [(1, False), (2, True)])
def test_the_index_finds_what_a_scan_finds(spark, seed, as_map):
    rng = random.Random(seed)
    df = random_events(spark, rng, 150, as_map).cache()
    fields = Fields(df.schema, document="event" if as_map else None)
    library = scan.Library.build(random_rules(rng, 120), fields)
    known = index.LiteralIndex(library)
    assert 20 < len(known.rules) < len(library.rules)
    plain = {(r.rule_id, r.event_idx) for r in scan.hits(df, library, ["event_idx"], lambda n: fields(n).sql).collect()}
    rows = [(r.rule_id, r.event_idx) for r in index.hits(df, library, ["event_idx"], fields).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain and len(plain) > 300


def test_the_index_reads_once_and_takes_no_rule_of_none(spark):
    df = random_events(spark, random.Random(3), 20, False)
    library = scan.Library.build([Rule(id="a", detection={"s": {"a|contains": "alpha"}, "condition": "s"}, logsource=SOURCES[0]), Rule(id="b", detection={"s": {"EventID": 1}, "condition": "s"}, logsource=SOURCES[0])], Fields(df.schema))
    made = index.hits(df, library, ["event_idx"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Union" not in plan
    nothing = scan.Library.build([], Fields(df.schema))
    assert index.hits(df, nothing, ["event_idx"]).count() == 0
    one = scan.Library.build([Rule(id="x'y", detection={"s": {"b|endswith": "o\\*'s"}, "condition": "s"}, logsource=SOURCES[0])], Fields(df.schema))
    quoted = spark.createDataFrame([(1, "Security", 1, "two*'s"), (2, "Security", 1, "twoX's")], "event_idx long, Channel string, EventID int, b string")
    assert [tuple(r) for r in index.hits(quoted, one, ["event_idx"]).collect()] == [(1, "x'y")]


def test_anchors():
    of = lambda d: index.anchors(Rule(detection=d))
    assert of({"s": {"a|contains": ["LongWord", "other"]}, "condition": "s"}) == {("a", "longword"), ("a", "other")}
    assert of({"s": {"a|contains|all": ["ab", "longword"]}, "condition": "s"}) == {("a", "longword")}
    assert of({"s": {"a": "x*longer?tail"}, "condition": "s"}) == {("a", "longer")}
    assert of({"s": {"a": "*glass*"}, "condition": "s"}) is None  # under patterns an s may be another letter
    assert of({"s": {"a|re": "longword"}, "condition": "s"}) is None and of({"s": {"a|contains": ["longword", None]}, "condition": "s"}) is None
    assert of({"s": {"a": "longword"}, "t": {"b": 1}, "condition": "s or t"}) is None
    assert of({"s": {"a": "longword"}, "t": {"b": 1}, "condition": "s and not t"}) == {("a", "longword")}
    assert of({"s": ["keyword"], "condition": "s"}) == {("", "keyword")}


def test_gate_of_a_library(spark):
    rng = random.Random(4)
    df = random_events(spark, rng, 60, True).cache()
    rules = random_rules(rng, 40)
    rules[0].status = "deprecated"
    rules += [Rule(id="broken", detection={"s": {"a|nope": 1}, "condition": "s"}), Rule(id="no fixtures", detection={"s": {"a": "zzz"}, "condition": "s"})]
    for r in rules[:40]:
        r.true_positives = [{"a": rng.choice(WORDS), "b": None} for _ in range(rng.randint(0, 30))]
        r.true_negatives = [{"a": rng.choice(WORDS)} for _ in range(rng.randint(0, 2))]
    policy = GatePolicy(max_fp_rate=0.2, corpus_days=2.0)
    got = {r.rule_id: r for r in gate.gate_library(rules, gate.fixtures(spark, rules), df, Fields(df.schema, document="event"), policy, most=3).collect()}
    assert set(got) == {r.key for r in rules[1:]}
    assert got["broken"].reasons[0].startswith("not supported") and not got["broken"].passed
    assert "no true-positive fixtures" in got["no fixtures"].reasons and got["no fixtures"].corpus_size == 60
    fixtures = gate.fixtures(spark, rules).cache()
    for r in rules[1:12]:
        own = fixtures.filter(F.col("rule_id") == r.key)
        hit = {(x.kind, x.idx) for x in own.filter(hit_column(own, r, document="event")).collect()}
        fp = df.filter(hit_column(df, r, document="event")).count()
        x = got[r.key]
        missed = [i for i in range(len(r.true_positives)) if ("tp", i) not in hit]
        assert (x.tp_total, x.tn_total, x.fp_hits, x.missed_tps) == (len(r.true_positives), len(r.true_negatives), fp, missed[:3])
        assert (x.tp_fired, x.tn_fired) == (len(r.true_positives) - len(missed), sum(k == "tn" for k, _ in hit))
        assert x.passed == (x.tp_total > 0 and not missed and not x.tn_fired and fp / 60 <= 0.2 and fp / 2 <= policy.budget)


def test_event_numbers_over_splits_without_a_shuffle_of_events(spark, tmp_path):
    lake = tmp_path / "lake"
    lake.mkdir()
    for name, rows in (("a", 2000), ("b", 3), ("c", 900)):
        with open(lake / f"{name}.jsonl", "w") as f:
            k = 0
            for i in range(rows):
                if i % 7 == 0:
                    f.write("not json\n" if i % 2 else "[1]\n")
                else:
                    f.write(json.dumps({"k": k, "pad": "x" * (i % 90)}) + "\n")
                    k += 1
    with gzip.open(lake / "d.log.gz", "wt") as f:
        f.writelines(f"type=EXECVE msg=audit(1700000000.123:{i}): argc=2 k={i}\n" + "prose\n" * (i % 3) for i in range(300))
    (lake / "e.log").write_text(json.dumps({"Records": [{"eventSource": "s", "eventName": "n", "k": i} for i in range(40)]}) + "\n" + json.dumps({"SyslogMessage": "type=X msg=audit(1:2): k=40"}) + "\n" + json.dumps({"SyslogMessage": "k=1"}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = logs.read_logs(spark, str(lake))
        assert df.select(F.col("file")).distinct().count() == 5 and df.filter("event_idx <> cast(event.k as bigint)").count() == 0
        assert {r.f: r.n for r in df.groupBy(F.substring_index("file", "/", -1).alias("f")).agg(F.countDistinct("event_idx").alias("n")).collect()} == {"a.jsonl": 1714, "b.jsonl": 2, "c.jsonl": 771, "d.log.gz": 300, "e.log": 41}
        lines = logs.read_jsonl(spark, str(lake), glob="*.jsonl")
        lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        shuffled = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert shuffled and plan.count("from_json") > 0 and all("file" in x for x in shuffled) and "Union" not in plan
        whole = logs.in_order(df)
        assert sorted(r.position for r in whole.collect()) == list(range(2828))
        out = logs.write_shards(df, str(tmp_path / "shards"), 500)
        assert {r.shard: r.n for r in out.collect()} == {0: 500, 1: 500, 2: 500, 3: 500, 4: 500, 5: 328}
        assert len(list((tmp_path / "shards").glob("shard=*/*.gz"))) == 6
        with gzip.open(next((tmp_path / "shards" / "shard=3").glob("*.gz")), "rt") as f:
            assert [int(json.loads(x)["k"]) for x in f][:2] == [1500, 1501]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives_by_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(30):
            z.writestr(f"d/{m:02d}.json", json.dumps([{"m": m, "i": i} for i in range(m)]))
        z.writestr("audit", "type=EXECVE msg=audit(1:2): m=30 i=0\nprose\ntype=EXECVE msg=audit(1:2): m=30 i=1")
        z.writestr("d/", "")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for m in range(3):
            data = json.dumps({"Records": [{"m": m, "i": i} for i in range(5)], "more": {"x": 1}}).encode()
            info = tarfile.TarInfo(f"m{m}.json")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write('{"m":0,"i":0} [{"m":0,"i":1}, 7, {"m":0,"i":2}] 5 "x"')
    df = logs.read_json_files(spark, str(tmp_path)).withColumn("f", F.substring_index("file", "/", -1))
    got = {}
    for r in df.orderBy("f", "event_idx").collect():
        got.setdefault(r.f, []).append((r.event_idx, int(r.event["m"]), int(r.event["i"])))
    want = {"many.zip": [(m, i) for m in range(30) for i in range(m)] + [(30, 0), (30, 1)], "t.tar.gz": [(m, i) for m in range(3) for i in range(5)], "g.json.gz": [(0, 0), (0, 1), (0, 2)]}
    assert got == {k: [(n, *x) for n, x in enumerate(v)] for k, v in want.items()}
    listed = members.members(spark, str(tmp_path), "*.zip")
    assert listed.count() == 31 and members.records(listed).rdd.getNumPartitions() > 1


def test_broken_members_are_passed_over_alone(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.json", '{"a":1}{"a":2}')
        z.writestr("b.json", '{"b":1}{"b":')
        z.writestr("c.json", '{"c":1}')
    (tmp_path / "n.zip").write_bytes(b"PK no archive")
    with pytest.raises(Exception):
        logs.read_json_files(spark, str(tmp_path)).collect()
    assert [r.event for r in logs.read_json_files(spark, str(tmp_path), skip_broken=True).orderBy("event_idx").collect()] == [{"a": "1"}, {"a": "2"}, {"c": "1"}]


def test_streams_of_json():
    rng = random.Random(5)
    texts = ['{"a":1}\n{"a":2}{"a":3} [{"a":4},{"a":5}]', "", " \n", "[]", "[1, 2, {\"x\": [1, {\"y\": \"é\\u00e9\"}]}]", "12 34 {\"k\": 5e3} true", '{"Records": [{"r": 1}, 2, "x"], "z": [1]}{"Records": 5}', '{"z": 1, "Records": [{"r": 1}]}', '{"Records":[]}', json.dumps([{"long": "x" * 5000}] * 3)]
    for t in texts:
        whole = list(members.json_records([t]))
        for _ in range(5):
            cuts = sorted(rng.sample(range(len(t) + 1), min(len(t), rng.randint(0, 12))))
            pieces = [t[i:j] for i, j in zip([0, *cuts], [*cuts, len(t)])]
            assert list(members.json_records(pieces)) == whole
    assert [json.loads(x) for x in members.json_records([texts[6]])] == [{"r": 1}, 2, "x", {"Records": 5}] and list(members.objects("[1,{}] 2 {\"a\":1}")) == [{}, {"a": 1}]
    for bad in ("{", "[1", "[1 2]", '{"a":1}}', '{"Records":[1}', "[1,]", "nul"):
        with pytest.raises(ValueError):
            list(members.json_records([bad]))
    # of a long list no more is held than a piece and a value
    scanner = members.Scanner(json.dumps([{"i": i, "pad": "x" * 50} for i in range(20_000)])[k : k + 4096] for k in range(0, 1_600_000, 4096))
    scanner.take("[")
    most = 0
    for n, x in enumerate(scanner.values(), 1):
        most = max(most, len(scanner._text))
    assert n == 20_000 and most < 20_000


def test_changes_of_maps_are_those_of_columns(spark):
    """Each rule's hits after a change of maps, in one read, equal those of a scan of the changed table."""
    from sparkwatch import library_queries as lq
    from sparkwatch.operators import decay, reports

    rng = random.Random(6)
    channels = ["Microsoft-Windows-Sysmon/Operational", "Security", "other"]
    rows = [(rng.choice(channels), rng.choice([1, 3, 4688]), f"{rng.choice(['click', 'view', 'error'])}.exe", rng.choice([f"run {rng.randint(1, 3)}", None]), rng.choice([f"MD5={rng.randint(1, 3)}", None]), f"u{rng.randint(6, 8)}") for _ in range(200)]
    df = spark.createDataFrame(rows, "Channel string, EventID int, Image string, CommandLine string, Hashes string, User string")
    names = df.columns
    maps = df.select(F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull()).alias("event"))
    rules = lq.decay_library()
    seen = decay.evidence(maps, rules).cache()
    got = {}
    for r in seen.filter("rule_id is not null").collect():
        got.setdefault(r.change, {})[r.rule_id] = r.n
    want = {}
    for change, f in {"": lambda x: x, **decay.SCHEMA_CHANGES}.items():
        changed = f(df).withColumn("i", F.lit(0))
        library = scan.Library.build(rules, Fields(changed.schema))
        want[change] = {r.rule_id: r.hits for r in scan.hits_per_rule(scan.hits(changed, library, ["i"]), "i").collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    told = {(r.change, r.method): r for r in reports.decay_changes(rules, seen).collect()}
    assert len(told) == 18
    for change in decay.SCHEMA_CHANGES:
        fired = set(want[""])
        lost = fired - set(want[change])
        before, after = (decay.observed(f(df)) for f in (lambda x: x, decay.SCHEMA_CHANGES[change]))
        if change == "ecs_rename":
            continue  # columns of the changed table have names with dots, which `observed` tells as they are: the flags are compared for the others
        flags = {r.rule_id: r for r in reports.decay_flags([x for x in rules if x.key in fired], before, after).collect()}
        for method in reports.METHODS:
            x = told[(change, method)]
            flagged = {k for k, r in flags.items() if r[method]}
            assert (x.rules, x.decayed, x.flagged, x.found, x.false_alarms) == (len(fired), len(lost), len(flagged), len(flagged & lost), len(flagged - lost)), (change, method)
            right = lambda m: {k for k in fired if flags[k][m] == (k in lost)}
            assert x.only_verdict == len(right("verdict") - right(method)) and x.only_method == len(right(method) - right("verdict"))


def test_verdicts_of_two_engines(spark):
    from sparkwatch.operators import reports

    a = spark.createDataFrame([("r", "f", 1), ("r", "f", 2), ("r", "g", 1), ("s", "f", 5), ("r", "f", 2)], "rule_id string, file string, event_idx long")
    b = spark.createDataFrame([("r", "f", 2), ("r", "f", 1), ("r", "h", 1), ("s", "f", 6)], "rule_id string, file string, event_idx long")
    cases = spark.createDataFrame([(r, f) for r in "rs" for f in "fgh"], "rule_id string, file string")
    x = reports.verdicts_of_two(a, b, cases).first()
    assert (x.cases, x.both, x.only_a, x.only_b, x.neither, x.same_count, x.same_events) == (6, 2, 1, 1, 2, 4, 3)
    assert abs(x.kappa - (4 / 6 - 0.5) / 0.5) < 1e-12
    assert reports.verdicts_of_two(a, a, cases).first().kappa == 1.0


def test_revocations_end(spark):
    from sparkwatch.operators import coverage
    from sparkwatch.sources.rules import CATALOG_SCHEMA

    row = lambda i, revoked, by, deprecated=False: (i, i, ["t"], ["Windows"], False, revoked, deprecated, by)
    chain = [row(f"C{i}", True, f"C{i + 1}") for i in range(40)] + [row("C40", False, "C0")]
    rows = chain + [row("A", True, "B"), row("B", True, "A"), row("D", True, None), row("E", True, "gone"), row("F", True, "G"), row("G", False, None, True), row("H", False, "A")]
    got = {r.id: r.resolved for r in coverage.resolve(spark.createDataFrame(rows, CATALOG_SCHEMA)).collect()}
    assert all(got[f"C{i}"] == "C40" for i in range(41)) and got["H"] == "H" and [got[k] for k in "ABDEFG"] == [None] * 6
    sets = spark.createDataFrame([("x", ["T1003.001"]), ("y", ["T1003"]), ("z", [])], "id string, techniques array<string>")
    rules = spark.createDataFrame([("r", ["T1003"])], "rule_id string, techniques array<string>")
    assert {r.id: r.claimed for r in coverage.claimed(sets, rules).collect()} == {"x": True, "y": True, "z": False}
    matrix = spark.createDataFrame([("x", True), ("y", False), ("z", False)], "id string, technique_detected boolean")
    assert [r.id for r in coverage.missed(matrix, coverage.claimed(sets, rules)).collect()] == ["y"]


def test_recorded_windows_and_contained_names(spark, tmp_path):
    from sparkwatch.sources import captures

    (tmp_path / "live" / "emulation").mkdir(parents=True)
    (tmp_path / "live" / "emulation" / "window.txt").write_text("techniques=T1003,T1059\nstart = 100\nnoise\n")
    (tmp_path / "live" / "emulation" / "a.log").write_text("type=X msg=audit(99:1): a=1\n")
    (tmp_path / "live" / "bare").mkdir()
    (tmp_path / "live" / "bare" / "window.txt").write_text("x")
    made = captures.emulations(spark, str(tmp_path))
    assert [(r.id, r.techniques, len(r.host_files), r.start, r.end) for r in made.collect()] == [("live:emulation", ["T1003", "T1059"], 1, 100.0, None)]
    events = spark.createDataFrame([("live:emulation", 99.0), ("live:emulation", 100.0), ("else", 1.0)], "id string, at double")
    assert [r.at for r in captures.within(events, made, "at").collect()] == [100.0]
    names = ["a b (1).pcap", "x", "été", "longer name.zip", "", "no such"]
    texts = [(1, "see a b (1).pcap T1003"), (2, "x marks l'été"), (3, None), (4, "LONGER NAME.ZIP"), (5, "longer name.zip longer name.zip\nx"), (5, "longer name.zip longer name.zip\nx")]
    got = sorted((r.name, r.key) for r in captures.named_in(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(texts, "key int, text string")).collect())
    assert got == sorted((n, k) for k, t in dict.fromkeys(texts) for n in names if n and t and n in t)
    assert captures.named_in(spark.createDataFrame([("",)], "name string"), spark.createDataFrame(texts, "key int, text string")).count() == 0


def test_files_are_parsed_once(spark, tmp_path):
    lake = tmp_path / "lake"
    lake.mkdir()
    for name in "ab":
        (lake / f"{name}.jsonl").write_text("\n".join(json.dumps({"Channel": "Security" if i % 2 else "Other", "EventID": i % 3, "Image": f"{name}{i % 5}.exe"}) for i in range(20)))
    rules = [Rule(id="r", detection={"s": {"Image|startswith": "a1"}, "condition": "s"}, logsource=LogSource("windows")), Rule(id="q", detection={"s": {"Image|endswith": "3.exe"}, "condition": "s"}, logsource=LogSource("windows", "", "security")), Rule(id="no", detection={"s": {"Image": "zzz"}, "condition": "s"}, logsource=LogSource("windows"))]
    out = scan.scan_files(spark, [str(lake)], rules, logs.read_logs)
    short = lambda r: r.file.rsplit("/", 1)[-1]
    assert {(short(r), r.rule_id, r.channel): r.hits for r in out["hits"].collect()} == {("a.jsonl", "r", "security"): 2, ("a.jsonl", "r", "other"): 2, ("a.jsonl", "q", "security"): 2, ("b.jsonl", "q", "security"): 2}
    assert {short(r): r.events for r in out["events"].collect()} == {"a.jsonl": 20, "b.jsonl": 20} and out["by_key"].agg(F.sum("n")).first()[0] == 40
    assert {r.rule_id: (r.hits, short(r.first), r.first.event_idx) for r in out["first"].collect()} == {"r": (4, "a.jsonl", 1), "q": (4, "a.jsonl", 3)}
    examples = out["examples"].filter("rule_id = 'r'").orderBy("n").collect()
    assert [r.event_idx for r in examples] == [1, 6, 11] and json.loads(examples[0].event)["event"]["Image"] == "a1.exe"
    for df in out.values():
        assert "Scan text" not in df._jdf.queryExecution().executedPlan().toString()
    empty = scan.scan_files(spark, [str(lake)], [], logs.read_logs)
    assert empty["hits"].count() == 0 and empty["events"].count() == 2


def test_streams_count_what_batches_count(spark, tmp_path):
    from sparkwatch.operators import decay
    from sparkwatch.streaming import rules as streaming

    rng = random.Random(8)
    df = random_events(spark, rng, 90, False)
    for part in range(3):
        df.filter(F.col("event_idx") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).cache()
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    library = scan.Library.build(random_rules(rng, 40), Fields(df.schema))
    seen = {}
    runs = [
        streaming.store(streaming.by_key(stream()), str(tmp_path / "keys"), str(tmp_path / "c1")),
        streaming.store(streaming.held_fields(stream()), str(tmp_path / "fields"), str(tmp_path / "c2")),
        streaming.on_hits(streaming.stream_hits(stream(), library, ["event_idx"]), lambda batch, n: seen.__setitem__(n, {(r.rule_id, r.event_idx) for r in batch.collect()}), str(tmp_path / "c3")),
        streaming.on_hits(index.hits(stream(), library, ["event_idx"]), lambda batch, n: seen.__setitem__(100 + n, {(r.rule_id, r.event_idx) for r in batch.collect()}), str(tmp_path / "c4")),
    ]
    for run in runs:
        assert run.trigger(availableNow=True).start().awaitTermination(120)
    plain = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert plain(streaming.stored(spark, str(tmp_path / "keys"), ["channel", "eid"])) == plain(scan.events_by_key(df))
    held = streaming.stored(spark, str(tmp_path / "fields"), ["channel", "eid", "field"])
    assert plain(streaming.inventory(held)) == plain(decay.observed(df)) and len(list((tmp_path / "fields").glob("batch=*"))) == 3
    want = {(r.rule_id, r.event_idx) for r in scan.hits(df, library, ["event_idx"]).collect()}
    assert set().union(*(v for k, v in seen.items() if k < 100)) == want == set().union(*(v for k, v in seen.items() if k >= 100))
