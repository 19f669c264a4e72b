"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

events stand for telemetry: Channel is the event type, EventID is props.k modulo 8. Every other column keeps its name.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats
from .functions.dialect import Fields
from .model import GatePolicy, LogSource, Rule
from .operators import coverage, decay, draft, features, gate, lint, routes, scan
from .plans.compile import hit_column, rule_column, selection_column
from .sources import logs
from .sources.rules import CATALOG_SCHEMA, rules_table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}

TELEMETRY = "SELECT *, event_type AS \"Channel\", CAST(json_extract(props, '$.k') AS BIGINT) % 8 AS \"EventID\" FROM events"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracle[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"Channel": F.col("event_type"), "EventID": F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(8))})


def select(name: str, source: str, keep: list[str], selection: Any, where: str, **fields: Any) -> None:
    """A query that filters a table by one selection, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = telemetry(spark, sf_dir) if source == "telemetry" else table(spark, sf_dir, source)
        return df.filter(selection_column(df, selection, **fields)).select(*keep)

    run.__name__ = name
    _queries[name] = run
    _oracle[name] = f"SELECT {', '.join(keep)} FROM {f'({TELEMETRY})' if source == 'telemetry' else source} t WHERE {where}"


# one selection

select("sel_eq_ci", "events", ["event_id", "event_type"], {"event_type": "ERROR"}, "lower(event_type) = 'error'")
select("sel_in_list", "part", ["p_partkey", "p_brand"], {"p_brand": ["brand#11", "BRAND#23", "Brand#45"]}, "lower(p_brand) IN ('brand#11', 'brand#23', 'brand#45')")
select("sel_contains", "documents", ["doc_id"], {"text|contains": ["License", "@MAIL"]}, "contains(lower(text), 'license') OR contains(lower(text), '@mail')")
select("sel_contains_all", "documents", ["doc_id"], {"text|contains|all": ["the ", "and ", "tion"]}, "contains(lower(text), 'the ') AND contains(lower(text), 'and ') AND contains(lower(text), 'tion')")
select("sel_startswith", "pages", ["page_id", "url"], {"url|startswith": ["HTTPS://www.", "http://m."]}, "starts_with(lower(url), 'https://www.') OR starts_with(lower(url), 'http://m.')")
select("sel_endswith", "pages", ["page_id", "url"], {"url|endswith": [".html", "#top"]}, "ends_with(lower(url), '.html') OR ends_with(lower(url), '#top')")
select("sel_cased", "part", ["p_partkey"], {"p_brand|cased|startswith": "Brand#1"}, "starts_with(p_brand, 'Brand#1')")
select("sel_wildcard", "pages", ["page_id"], {"url": "http*://*.example.???/en/*"}, "regexp_matches(url, '^http.*://.*\\.example\\.[^/]{3}/en/.*$', 'is')")
select("sel_escaped_wildcard", "pages", ["page_id"], {"url|contains": "\\?page="}, "contains(lower(url), '?page=')")
select("sel_regex", "documents", ["doc_id"], {"text|re": r"[0-9]{1,3}(\.[0-9]{1,3}){3}"}, r"regexp_matches(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}')")
select("sel_regex_i", "documents", ["doc_id"], {"text|re|i": "TOKEN = .[0-9a-f]{8}"}, "regexp_matches(text, '(?i)TOKEN = .[0-9a-f]{8}')")
select("sel_regex_m", "documents", ["doc_id"], {"text|re|m": "^Licensed under [A-Z]"}, "regexp_matches(text, '(?m)^Licensed under [A-Z]')")
select("sel_regex_s", "documents", ["doc_id"], {"text|re|s": "^The.*License"}, "regexp_matches(text, '(?s)^The.*License')")
select("sel_gt", "lineitem", ["l_orderkey", "l_linenumber"], {"l_quantity|gt": 49}, "l_quantity > 49")
select("sel_lte", "events", ["event_id"], {"value|lte": 1.5}, "value <= 1.5")
select("sel_between", "lineitem", ["l_orderkey", "l_linenumber"], {"l_discount|gte": 0.05, "l_discount|lte": 0.07, "l_quantity|lt": 24}, "l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
select("sel_numeric", "orders", ["o_orderkey"], {"o_custkey": [7, 11, 42, "100"]}, "o_custkey IN (7, 11, 42, 100)")
select("sel_exists", "events", ["event_id"], {"k|exists": True, "nothing|exists": False}, "json_extract_string(props, '$.k') IS NOT NULL", document="props")
select("sel_json_gte", "events", ["event_id"], {"k|gte": 90}, "CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90", document="props")
select("sel_missing_field", "events", ["event_id"], {"nowhere|contains": "x"}, "FALSE")
select("sel_neq", "events", ["event_id"], {"event_type|neq": ["click", "VIEW"]}, "NOT coalesce(lower(event_type) IN ('click', 'view'), FALSE)")
select("kw_any", "part", ["p_partkey"], ["STEEL", "Brand#2?"], "contains(lower(concat_ws(chr(10), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'steel') OR regexp_matches(lower(concat_ws(chr(10), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'brand#2.', 's')")
select("kw_all", "customer", ["c_custkey"], {"|all": ["Customer#", "BUILDING"]}, "contains(lower(concat_ws(chr(10), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'customer#') AND contains(lower(concat_ws(chr(10), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'building')")


@query("SELECT event_id FROM events WHERE contains(event_type, 'click') OR contains(CAST(user_id AS VARCHAR), '42') OR contains(props, '42') OR contains(CAST(user_id AS VARCHAR), '17') OR contains(props, '17')")
def kw_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords over events kept as one document each: values match, nested ones too, keys don't."""
    doc = F.to_json(F.struct(F.col("event_type").alias("signup"), F.struct(F.col("user_id").alias("click"), F.array("props").alias("error")).alias("n")))
    df = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"), F.lit("error click").alias("file"))
    return df.filter(selection_column(df, ["CLICK", "42", "17"], document="doc")).select("event_id")


@query("SELECT event_id, event_type AS \"Channel\" FROM events WHERE contains(event_type, 'sign') OR regexp_matches(CAST(user_id AS VARCHAR), '9.1')")
def kw_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords over parsed logs, whose events are maps."""
    doc = F.to_json(F.struct(F.col("event_type").alias("Channel"), F.struct(F.col("user_id").alias("click")).alias("data"), F.lit("x").alias("Signal")))
    df = table(spark, sf_dir, "events").select("event_id", logs.normalised(doc).alias("event"))
    return df.filter(selection_column(df, ["SIGN", "9?1"], document="event")).select("event_id", F.col("event.Channel").alias("Channel"))


select("sel_list_of_maps", "telemetry", ["event_id"], [{"Channel": "error", "EventID": [1, 2]}, {"value|gte": 90}], "(event_type = 'error' AND \"EventID\" IN (1, 2)) OR value >= 90")


def condition(name: str, detection: dict[str, Any], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = telemetry(spark, sf_dir)
        return df.filter(rule_column(df, Rule(detection=detection))).select("event_id")

    run.__name__ = name
    _queries[name] = run
    _oracle[name] = f"SELECT event_id FROM ({TELEMETRY}) t WHERE {where}"


_SELS = {"sel_error": {"Channel": "error"}, "sel_high": {"value|gte": 50}, "filter_low": {"EventID": [0, 1]}, "filter_user": {"user_id|lt": 10}}
condition("cond_not_filter", _SELS | {"condition": "sel_error and not 1 of filter_*"}, "event_type = 'error' AND NOT (\"EventID\" IN (0, 1) OR user_id < 10)")
condition("cond_1_of", _SELS | {"condition": "1 of sel_*"}, "event_type = 'error' OR value >= 50")
condition("cond_all_of_them", _SELS | {"condition": "all of them"}, "event_type = 'error' AND value >= 50 AND \"EventID\" IN (0, 1) AND user_id < 10")
condition("cond_list_or", _SELS | {"condition": ["sel_error and filter_low", "sel_high and filter_user"]}, "(event_type = 'error' AND \"EventID\" IN (0, 1)) OR (value >= 50 AND user_id < 10)")
condition("cond_precedence", _SELS | {"condition": "sel_high or sel_error and filter_low"}, "value >= 50 OR (event_type = 'error' AND \"EventID\" IN (0, 1))")
condition("cond_parentheses", _SELS | {"condition": "(sel_high or sel_error) AND NOT (filter_low OR filter_user)"}, "(value >= 50 OR event_type = 'error') AND NOT (\"EventID\" IN (0, 1) OR user_id < 10)")

_IP = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"


@query(f"SELECT doc_id, ip FROM (SELECT doc_id, regexp_extract(text, '{_IP}', 1) AS ip FROM documents) t WHERE regexp_matches(ip, '^(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}$') AND try_cast(split_part(ip, '.', 1) AS INT) BETWEEN 128 AND 191 AND try_cast(split_part(ip, '.', 2) AS INT) <= 255 AND try_cast(split_part(ip, '.', 3) AS INT) <= 255 AND try_cast(split_part(ip, '.', 4) AS INT) <= 255")
def sel_cidr_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _IP, 1).alias("ip"))
    return df.filter(selection_column(df, {"ip|cidr": "128.0.0.0/2"}))


@query()
def sel_cidr_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and event ids as IPv6 addresses, those in a network of 16 hosts."""
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("2001:db8::"), F.hex("user_id")).alias("ip"))
    return df.filter(selection_column(df, {"ip|cidr": "2001:db8::/124"}))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def sel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.filter(selection_column(df, {"quality": None})).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE lower(o_orderstatus) = lower(l_linestatus)")
def sel_fieldref(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return df.filter(selection_column(df, {"o_orderstatus|fieldref": "l_linestatus"})).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: lower(x) IN ('steel', 'red'))) > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: starts_with(lower(x), 'b'))) > 0")
def sel_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return df.filter(selection_column(df, {"words": ["steel", "RED"], "words|startswith": "b"})).select("p_partkey")


def encoded(name: str, key: str, value: str, made: Callable[[], Column], sql: str, where: str) -> None:
    """Documents with an encoded literal put behind a third of their sources, found again by the rule's encoding."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 3 == 0, made()).otherwise("")).alias("line"))
        return df.filter(selection_column(df, {key: value})).select("doc_id")

    run.__name__ = name
    _queries[name] = run
    _oracle[name] = f"SELECT doc_id FROM (SELECT doc_id, coalesce(source, '') || CASE WHEN doc_id % 3 = 0 THEN {sql} ELSE '' END AS line FROM documents) t WHERE {where}"


encoded("enc_windash", "line|windash|contains", " -enc", lambda: F.lit(" /enc x"), "' /enc x'", "contains(line, ' /enc') OR contains(line, ' -enc')")
encoded("enc_base64", "line|base64|cased|contains", "foobar", lambda: F.base64(F.lit("foobar").cast("binary")), "base64('foobar'::BLOB)", "contains(line, 'Zm9vYmFy')")
encoded("enc_base64offset", "line|base64offset|cased|contains", "foobar", lambda: F.base64(F.concat(F.substring("source", 1, 2), F.lit("foobar!")).cast("binary")), "base64((substring(source, 1, 2) || 'foobar!')::BLOB)", "contains(line, 'Zm9vYmFy') OR contains(line, 'Zvb2Jhc') OR contains(line, 'mb29iYX')")
encoded("enc_wide", "line|wide|contains", "ab", lambda: F.lit("a\0b\0"), "'a' || chr(0) || 'b' || chr(0)", "contains(line, 'a' || chr(0) || 'b' || chr(0))")

# routes and scans

POLICY = GatePolicy(corpus_days=30.0)


def library_rules() -> list[Rule]:
    """A small library over the telemetry view; tags name techniques."""
    make = lambda i, detection, tags, **more: Rule(id=f"00000000-0000-4000-8000-{i:012d}", title=f"rule {i}", detection=detection, tags=tags, description="A rule of the telemetry view that the queries share.", **more)
    return [
        make(1, {"s": {"value|gte": 80}, "condition": "s"}, ["attack.execution", "attack.t1059.001"], level="high", status="stable", references=["x"], falsepositives=["legitimate admins"]),
        make(2, {"s": {"user_id|lt": 20}, "f": {"EventID": [3, 4]}, "condition": "s and not f"}, ["attack.t1059"], level="low", status="test"),
        make(3, {"s": {"props|contains": '"k": 7'}, "t": {"value|lt": 5}, "condition": "s or t"}, ["attack.t1105", "attack.command-and-control"], level="medium"),
        make(4, {"s": {"props|re": '"k": 9[0-9]'}, "condition": "all of them"}, ["attack.t1110"], level="critical", author="someone"),
        make(5, {"s": {"event_type": "purchase"}, "condition": "s"}, ["attack.t1086"], level="informational", status="stable"),
    ]


#: The events that each rule is for: (channel or * for all, event id or null for any), and a guard.
ROUTES = {
    1: routes.Route((("error", None),)),
    2: routes.Route((("click", 1), ("click", 2), ("click", 3), ("view", 1))),
    3: routes.Route(((routes.ANY, None),)),
    4: routes.Route((("signup", None), ("purchase", 2))),
    5: routes.Route((("purchase", None),), ("user_id", ("7", "8", "9", "10", "11", "12"))),
}
RULE_WHERE = {
    1: "(\"Channel\" = 'error') AND value >= 80",
    2: "((\"Channel\" = 'click' AND \"EventID\" IN (1, 2, 3)) OR (\"Channel\" = 'view' AND \"EventID\" = 1)) AND user_id < 20 AND NOT \"EventID\" IN (3, 4)",
    3: "(contains(props, '\"k\": 7') OR value < 5)",
    4: "(\"Channel\" = 'signup' OR (\"Channel\" = 'purchase' AND \"EventID\" = 2)) AND regexp_matches(props, '\"k\": 9[0-9]')",
    5: "\"Channel\" = 'purchase' AND user_id IN (7, 8, 9, 10, 11, 12)",
}
_ID = "00000000-0000-4000-8000-"
HITS = " UNION ALL ".join(f"SELECT '{_ID}{i:012d}' AS rule_id, * FROM ({TELEMETRY}) t WHERE {w}" for i, w in RULE_WHERE.items())


def library(df: DataFrame) -> scan.Library:
    rules = library_rules()
    built = scan.Library.build([Rule(**{**r.__dict__, "logsource": LogSource("windows")}) for r in rules], Fields(df.schema))
    built.routes = {r.key: ROUTES[i] for i, r in enumerate(rules, 1)}
    return built


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return scan.hits(df, library(df))


@query("SELECT event_id, rule_id FROM (" + TELEMETRY + f") t JOIN (VALUES ('{_ID}000000000001', 'error', NULL), ('{_ID}000000000002', 'click', 1), ('{_ID}000000000002', 'click', 2), ('{_ID}000000000002', 'click', 3), ('{_ID}000000000002', 'view', 1), ('{_ID}000000000003', '*', NULL), ('{_ID}000000000004', 'signup', NULL), ('{_ID}000000000004', 'purchase', 2), ('{_ID}000000000005', 'purchase', NULL)) r(rule_id, c, e) ON (r.c = t.\"Channel\" OR r.c = '*') AND (r.e IS NULL OR r.e = t.\"EventID\")")
def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return routes.candidates(scan.keyed(df).select("event_id", "__channel", "__eid"), library(df).routes_table(spark)).select("event_id", "rule_id")


@query(f"SELECT count(*) AS evaluations FROM ({TELEMETRY}) t JOIN (VALUES ('error', NULL), ('click', 1), ('click', 2), ('click', 3), ('view', 1), ('*', NULL), ('signup', NULL), ('purchase', 2), ('purchase', NULL)) r(c, e) ON (r.c = t.\"Channel\" OR r.c = '*') AND (r.e IS NULL OR r.e = t.\"EventID\")")
def route_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return scan.evaluations(df, library(df))


@query(f"SELECT event_id FROM ({TELEMETRY}) t WHERE {RULE_WHERE[5]}")
def route_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.keyed(telemetry(spark, sf_dir))
    return df.filter(routes.applies(ROUTES[5], F.col("__channel"), F.col("__eid"), F.col)).select("event_id")


@query(f"SELECT event_id FROM ({TELEMETRY}) t")
def route_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.keyed(telemetry(spark, sf_dir))
    return df.filter(routes.applies(ROUTES[3], F.col("__channel"), F.col("__eid"), F.col)).select("event_id")


@query(f"SELECT rule_id, count(*) AS hits, min(event_id) AS first_hit FROM ({HITS}) h GROUP BY rule_id")
def scan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return scan.hits_per_rule(scan.hits(df, library(df), ["event_id"]), "event_id")


@query(f"SELECT rule_id, event_id FROM ({HITS}) h")
def scan_hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry(spark, sf_dir)
    return scan.hits(df, library(df), ["event_id"])


@query(f"SELECT \"Channel\" AS channel, CAST(\"EventID\" AS INT) AS eid, count(*) AS n FROM ({TELEMETRY}) t GROUP BY 1, 2")
def scan_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.events_by_key(telemetry(spark, sf_dir))


@query(f"SELECT rule_id, event_id, props, n FROM (SELECT rule_id, event_id, substring(props, 1, 300) AS props, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY event_id) AS INT) AS n FROM ({HITS}) h) WHERE n <= 3")
def scan_examples_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.examples(all_hits(spark, sf_dir).select("rule_id", "event_id", "props"), 3, "event_id")


@query(f"SELECT rule_id, event_type AS channel, count(*) AS hits FROM ({HITS}) h GROUP BY 1, 2")
def scan_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_hits(spark, sf_dir).groupBy("rule_id", F.col("event_type").alias("channel")).agg(F.count("*").alias("hits"))


@query(f"SELECT rule_id, count(*) AS hits, min(event_id) AS first_hit FROM ({HITS}) h GROUP BY 1 ORDER BY hits DESC, rule_id LIMIT 3")
def scan_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.top_rules(all_hits(spark, sf_dir).withColumnRenamed("event_id", "event_idx"), 3)


def _sources() -> list[LogSource]:
    """A log source for every category and service that has events."""
    windows = sorted({*routes.SYSMON_CATEGORIES, *routes.OTHER_CATEGORIES})
    services = sorted({*routes.SERVICES, *routes.SERVICES_OF_MANY})
    return [
        *(LogSource("windows", c) for c in windows), *(LogSource("windows", "", x) for x in services), LogSource("windows"), *(LogSource("linux", c) for c in sorted(routes.LINUX_CATEGORIES)),
        LogSource("linux", "", "auditd"), LogSource("aws", "", "cloudtrail"), LogSource("windows", "registry_set", "sysmon"), LogSource("windows", "process_creation", "security"),
    ]


_DETECTIONS: list[tuple[dict[str, Any], str]] = [
    ({"s": {"value|gte": 20}, "condition": "s"}, "value >= 20"),
    ({"s": {"props|contains": ['"k": 1', '"K": 2']}, "f": {"event_type": "CLICK"}, "condition": "s and not f"}, "(contains(props, '\"k\": 1') OR contains(props, '\"k\": 2')) AND event_type <> 'click'"),
    ({"s": {"user_id|lt": 500, "event_type|startswith": ["P", "s"]}, "condition": "s"}, "user_id < 500 AND (starts_with(event_type, 'p') OR starts_with(event_type, 's'))"),
]


def full_library() -> list[Rule]:
    """Three rules for each log source, over all routes."""
    return [Rule(id=f"{_ID}{3 * i + j:012d}", title=f"{source} {j}", detection=d, logsource=source) for i, source in enumerate(_sources()) for j, (d, _) in enumerate(_DETECTIONS)]


def _slots() -> list[tuple[str, int]]:
    """Each channel and id that a route names, and an id that none names for channels routed as a whole."""
    found = [r for r in map(routes.route, _sources()) if r]
    return sorted({(c, 77 if i is None else i) for r in found for c, i in r.pairs if c != routes.ANY})


_SLOTS = "(VALUES " + ", ".join(f"({n}, '{c}', {i})" for n, (c, i) in enumerate(_slots())) + ") z(slot, channel, eid)"
_PAIRS = "(VALUES " + ", ".join(f"({3 * i + j}, {j}, {repr(c)}, {'NULL' if e is None else e}, {repr('|'.join(r.guard[1])) if r.guard else 'NULL'})" for i, r in enumerate(map(routes.route, _sources())) for c, e in r.pairs for j in range(3)) + ") r(n, j, c, e, guard)"
_LIBRARY_HITS = f"""SELECT DISTINCT '{_ID}' || lpad(CAST(r.n AS VARCHAR), 12, '0') AS rule_id, t.event_id, t.channel FROM
(SELECT e.*, z.channel, z.eid, CASE event_type WHEN 'click' THEN 'createkey' WHEN 'view' THEN 'deletevalue' ELSE 'setvalue' END AS change FROM events e JOIN {_SLOTS} ON e.event_id % {len(_slots())} = z.slot) t
JOIN {_PAIRS} ON (r.c = t.channel OR (r.c = '*' AND t.channel NOT IN ({', '.join(map(repr, routes.NOT_WINDOWS))}))) AND (r.e IS NULL OR r.e = t.eid) AND (r.guard IS NULL OR list_contains(string_split(r.guard, '|'), t.change))
WHERE CASE r.j {' '.join(f'WHEN {j} THEN {w}' for j, (_, w) in enumerate(_DETECTIONS))} END"""


def routed_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to all channels and ids that routes name; EventType says what a registry event did."""
    slots = spark.createDataFrame([(n, c, i) for n, (c, i) in enumerate(_slots())], "slot int, Channel string, EventID int")
    change = F.when(F.col("event_type") == "click", "CreateKey").when(F.col("event_type") == "view", "DeleteValue").otherwise("SetValue")
    events = table(spark, sf_dir, "events").withColumns({"slot": (F.col("event_id") % len(_slots())).cast("int"), "EventType": change})
    return events.join(F.broadcast(slots), "slot").drop("slot")


def library_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = routed_telemetry(spark, sf_dir)
    return scan.hits(df, scan.Library.build(full_library(), Fields(df.schema)), ["event_id", "Channel"])


@query(f"SELECT rule_id, count(*) AS hits, min(event_id) AS first_hit FROM ({_LIBRARY_HITS}) h GROUP BY 1")
def scan_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a library over all routes, some three hundred rules."""
    return scan.hits_per_rule(library_hits(spark, sf_dir), "event_id")


@query(f"SELECT rule_id, event_id, channel FROM ({_LIBRARY_HITS}) h")
def scan_library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library_hits(spark, sf_dir).select("rule_id", "event_id", F.col("Channel").alias("channel"))


# gates


@query(f"SELECT rule_id, hits, hits / 30.0 AS alerts_per_day, hits / 30.0 <= 20 AS passed FROM (SELECT rule_id, count(*) AS hits FROM ({HITS}) h GROUP BY 1)")
def gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.gate(all_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("hits")), POLICY)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases of five rules: errors should fire, signups should not, the rest is the corpus; not routed."""
    df = telemetry(spark, sf_dir)
    tests = F.array(*[F.struct(F.lit(r.key).alias("rule_id"), hit_column(df, r).alias("hit")) for r in library_rules()])
    kind = F.when(F.col("event_type") == "error", "tp").when(F.col("event_type") == "signup", "tn").otherwise("corpus")
    return df.select(kind.alias("kind"), F.col("event_id").alias("idx"), F.explode(tests).alias("t")).select("t.*", "kind", "idx")


_UNROUTED = {1: "value >= 80", 2: "user_id < 20 AND NOT \"EventID\" IN (3, 4)", 3: "(contains(props, '\"k\": 7') OR value < 5)", 4: "regexp_matches(props, '\"k\": 9[0-9]')", 5: "event_type = 'purchase'"}
_CASES = " UNION ALL ".join(f"SELECT '{_ID}{i:012d}' AS rule_id, CASE event_type WHEN 'error' THEN 'tp' WHEN 'signup' THEN 'tn' ELSE 'corpus' END AS kind, event_id AS idx, {w} AS hit FROM ({TELEMETRY}) t" for i, w in _UNROUTED.items())
_COUNTS = f"SELECT rule_id, count(*) FILTER (kind = 'tp') AS tp_total, count(*) FILTER (kind = 'tp' AND hit) AS tp_fired, count(*) FILTER (kind = 'tn') AS tn_total, count(*) FILTER (kind = 'tn' AND hit) AS tn_fired, count(*) FILTER (kind = 'corpus') AS corpus_size, count(*) FILTER (kind = 'corpus' AND hit) AS fp_hits, coalesce(min(idx) FILTER (kind = 'tp' AND NOT hit), -1) AS first_missed FROM ({_CASES}) c GROUP BY rule_id"


@query(f"SELECT *, coalesce(tp_fired / nullif(tp_fired + tn_fired + fp_hits, 0), 0.0) AS precision, coalesce(tp_fired / nullif(tp_total, 0), 0.0) AS recall, coalesce(fp_hits / nullif(corpus_size, 0), 0.0) AS fp_rate, fp_hits / 30.0 AS alerts_per_day FROM ({_COUNTS})")
def gate_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate.evaluate(_labelled(spark, sf_dir), POLICY)
    return out.withColumn("first_missed", F.coalesce(F.get("missed_tps", F.lit(0)), F.lit(-1))).drop("missed_tps", "reasons", "passed")


@query(f"SELECT rule_id, concat_ws('; ', CASE WHEN tp_total = 0 THEN 'no true-positive fixtures' END, CASE WHEN tp_fired < tp_total THEN 'missed ' || (tp_total - tp_fired) || '/' || tp_total || ' true positives' END, CASE WHEN tn_fired > 0 THEN 'fired on ' || tn_fired || ' true negatives' END, CASE WHEN fp_hits / corpus_size > 0.001 THEN 'false-positive rate over the limit' END, CASE WHEN fp_hits / 30.0 > 20 THEN 'alerts a day over the budget' END) AS reasons, tp_fired = tp_total AND tp_total > 0 AND tn_fired = 0 AND fp_hits / corpus_size <= 0.001 AND fp_hits / 30.0 <= 20 AS passed FROM ({_COUNTS})")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.evaluate(_labelled(spark, sf_dir), POLICY).select("rule_id", F.array_join("reasons", "; ").alias("reasons"), "passed")


@query(f"SELECT hosts, count(*) FILTER (hits / 30.0 * hosts > 20) AS failing FROM (SELECT rule_id, count(*) AS hits FROM ({HITS}) h GROUP BY 1), (VALUES (1), (3), (10), (30), (100)) f(hosts) GROUP BY hosts")
def gate_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = all_hits(spark, sf_dir).groupBy("rule_id").agg((F.count("*") / 30.0).alias("alerts_per_host_day"))
    return gate.fleet_failures(rates, [1, 3, 10, 30, 100], POLICY)


_HALVES = f"SELECT rule_id, count(*) FILTER (day(ts) <= 15) / count(*) AS recall_before, count(*) FILTER (day(ts) > 15) / count(*) AS recall, count(*) FILTER (day(ts) <= 15) AS fp_before, 4 * count(*) FILTER (day(ts) > 15) AS fp_hits FROM ({HITS}) h GROUP BY 1"


@query(f"SELECT * FROM (SELECT rule_id, recall, fp_hits, recall_before, fp_before, concat_ws(',', CASE WHEN recall < recall_before THEN 'recall_drop' END, CASE WHEN fp_hits > greatest(fp_before, 1) * 3.0 THEN 'fp_spike' END) AS kinds FROM ({_HALVES})) WHERE kinds <> ''")
def baseline_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.day("ts") <= 15
    both = all_hits(spark, sf_dir).groupBy("rule_id").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"), F.count("*").alias("n"))
    before = both.select("rule_id", (F.col("a") / F.col("n")).alias("recall"), F.col("a").alias("fp_hits"))
    now = both.select("rule_id", (F.col("b") / F.col("n")).alias("recall"), (4 * F.col("b")).alias("fp_hits"))
    return gate.regressions(before, now).withColumn("kinds", F.array_join("kinds", ","))


_STATUS = f"""SELECT c.rule_id, c.channel, c.expected, coalesce(n.n, 0) AS events, coalesce(h.n, 0) AS matched,
CASE WHEN c.rule_id LIKE '%9' THEN 'missing-rule' WHEN n.n IS NULL THEN 'unreadable' WHEN coalesce(h.n, 0) > 0 AND h.n >= coalesce(c.expected, 1) THEN 'pass' ELSE 'fail' END AS status
FROM (VALUES ('{_ID}000000000001', 'error', 1), ('{_ID}000000000004', 'signup', 100000), ('{_ID}000000000005', 'purchase', NULL), ('{_ID}000000000003', 'nowhere', 1), ('{_ID}000000000009', 'click', 1)) c(rule_id, channel, expected)
LEFT JOIN (SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1) n USING (channel) LEFT JOIN (SELECT rule_id, event_type AS channel, count(*) AS n FROM ({HITS}) x GROUP BY 1, 2) h USING (rule_id, channel)"""


@query(_STATUS)
def regress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as captures: each case names a rule, a capture and how many hits it should have."""
    rows = [(f"{_ID}{i:012d}", c, n) for i, c, n in ((1, "error", 1), (4, "signup", 100_000), (5, "purchase", None), (3, "nowhere", 1), (9, "click", 1))]
    cases = spark.createDataFrame(rows, "rule_id string, file string, expected int").withColumn("case_id", F.concat_ws("|", "rule_id", "file"))
    rules = spark.createDataFrame([(r.key, True, True) for r in library_rules()], "rule_id string, supported boolean, routable boolean")
    files = telemetry(spark, sf_dir).groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("events"))
    found = all_hits(spark, sf_dir).groupBy(F.concat_ws("|", "rule_id", "event_type").alias("case_id")).agg(F.count("*").alias("matched")).withColumn("routed", F.col("matched"))
    out = gate.replay(cases, rules, files, found)
    return out.select("rule_id", F.col("file").alias("channel"), "expected", F.coalesce("events", F.lit(0)).alias("events"), "matched", "status")


@query(f"SELECT level, count(*) AS observable, count(*) FILTER (coalesce(n, 0) > 0) AS fired, count(*) FILTER (coalesce(n, 0) / 30.0 > 20) AS gate_fail, 100.0 * count(*) FILTER (coalesce(n, 0) > 0) / count(*) AS fired_pct FROM (VALUES ('{_ID}000000000001', 'high'), ('{_ID}000000000002', 'low'), ('{_ID}000000000003', 'medium'), ('{_ID}000000000004', 'critical'), ('{_ID}000000000005', 'informational')) r(rule_id, level) LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({HITS}) h GROUP BY 1) USING (rule_id) GROUP BY level")
def gate_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = all_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = rules_table(spark, library_rules()).join(n, "rule_id", "left").withColumns({"observable": F.lit(True), "fired": F.coalesce("n", F.lit(0)) > 0, "gate_fail": F.coalesce("n", F.lit(0)) / 30.0 > POLICY.budget})
    return gate.group_stats(rules, "level")


# coverage

CATALOG_ROWS = [
    ("T1059", "interpreter", ["execution"], ["Windows", "Linux"], False, False, False, None),
    ("T1059.001", "shell", ["execution"], ["Windows"], True, False, False, None),
    ("T1105", "transfer", ["command-and-control"], ["windows"], False, False, False, None),
    ("T1110", "guessing", ["credential-access"], ["Linux"], False, False, False, None),
    ("T1086", "old shell", ["execution"], ["Windows"], False, True, False, "T1086.1"),
    ("T1086.1", "older shell", ["execution"], ["Windows"], True, True, False, "T1059.001"),
    ("T1999", "loop", ["impact"], ["Windows"], False, True, False, "T1999"),
    ("T1033", "who am i", ["discovery", "execution"], ["Windows"], False, False, False, None),
]
_CATALOG = "(VALUES " + ", ".join(f"('{i}', {t!r}, {live}, {by!r})".replace("None", "NULL").replace('"', "'") for i, t, live, by in ((r[0], r[2], not r[5], r[7]) for r in CATALOG_ROWS)) + ") k(id, tactics, live, revoked_by)"
_FIRED = f"(SELECT DISTINCT rule_id FROM ({HITS}) h)"
_SAID = "(VALUES " + ", ".join(f"('{_ID}{i:012d}', '{t}')" for i, t in ((1, "T1059.001"), (2, "T1059"), (3, "T1105"), (4, "T1110"), (5, "T1086"))) + ") s(rule_id, id)"
_PER = f"(SELECT k.id, k.tactics, count(s.rule_id) AS claimed, count(f.rule_id) AS validated FROM {_CATALOG} LEFT JOIN {_SAID} USING (id) LEFT JOIN {_FIRED} f USING (rule_id) WHERE k.live GROUP BY k.id, k.tactics)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA)
    return coverage.by_technique(coverage.active(catalog), rules_table(spark, library_rules()), all_hits(spark, sf_dir))


@query(f"SELECT id, claimed, validated FROM {_PER} p")
def coverage_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).drop("tactics")


@query(f"SELECT tactic, count(*) AS total, count(*) FILTER (claimed > 0) AS covered, count(*) FILTER (validated > 0) AS validated FROM (SELECT unnest(tactics) AS tactic, claimed, validated FROM {_PER} p) GROUP BY 1")
def coverage_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_tactic(_coverage(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (claimed > 0) AS covered, count(*) FILTER (validated > 0) AS validated, count(DISTINCT split_part(id, '.', 1)) FILTER (claimed > 0) AS parents_covered, 100.0 * count(*) FILTER (claimed > 0) / count(*) AS pct FROM {_PER} p")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.summary(_coverage(spark, sf_dir))


@query(f"SELECT s.rule_id, s.id, CASE WHEN k.id IS NULL THEN 'uncatalogued' ELSE 'stale' END AS why, coalesce(n.n, 0) AS hits FROM {_SAID} LEFT JOIN {_CATALOG} USING (id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({HITS}) h GROUP BY 1) n USING (rule_id) WHERE k.live IS NULL OR NOT k.live")
def stale_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = all_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("hits"))
    stale = coverage.stale_tags(spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA), rules_table(spark, library_rules()))
    return stale.join(n, "rule_id", "left").fillna(0, ["hits"])


@query(f"WITH RECURSIVE chain(id, at_, n) AS (SELECT id, id, 0 FROM {_CATALOG} UNION ALL SELECT c.id, k.revoked_by, c.n + 1 FROM chain c JOIN {_CATALOG} ON c.at_ = k.id WHERE k.revoked_by IS NOT NULL AND c.n < 9) SELECT t.event_id, r.resolved FROM (SELECT event_id, CASE \"EventID\" WHEN 0 THEN 'T1086' WHEN 1 THEN 'T1999' WHEN 2 THEN 'T1105' ELSE 'T1110' END AS id FROM ({TELEMETRY}) x) t JOIN (SELECT c.id, CASE WHEN k.live THEN c.at_ END AS resolved FROM chain c JOIN {_CATALOG} ON k.id = c.at_ QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY n DESC) = 1) r USING (id)")
def resolve_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events tagged by their id with techniques, some revoked, and what these are now."""
    now = coverage.resolve(spark.createDataFrame(CATALOG_ROWS, CATALOG_SCHEMA))
    eid = F.col("EventID")
    tagged = telemetry(spark, sf_dir).select("event_id", F.when(eid == 0, "T1086").when(eid == 1, "T1999").when(eid == 2, "T1105").otherwise("T1110").alias("id"))
    return tagged.join(F.broadcast(now), "id").select("event_id", "resolved")


@query(f"SELECT channel AS id, count(DISTINCT rule_id) AS rules_fired, count(DISTINCT rule_id) > 0 AS any_alert, coalesce(bool_or(s.id = d.id OR s.id = split_part(d.id, '.', 1)), FALSE) AS technique_detected, coalesce(bool_or(split_part(s.id, '.', 1) = split_part(d.id, '.', 1)), FALSE) AS lenient FROM (SELECT event_type AS channel, CASE WHEN event_type IN ('error', 'click') THEN 'T1059.001' WHEN event_type = 'signup' THEN 'T1110.003' ELSE 'T1486' END AS id FROM (SELECT DISTINCT event_type FROM events)) d LEFT JOIN (SELECT DISTINCT event_type AS channel, rule_id FROM ({HITS}) h) x USING (channel) LEFT JOIN {_SAID} USING (rule_id) GROUP BY channel")
def technique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as captures of one technique each, and whether a rule that fires there names it."""
    kinds = telemetry(spark, sf_dir).select(F.col("event_type").alias("id")).distinct()
    what = F.when(F.col("id").isin("error", "click"), "T1059.001").when(F.col("id") == "signup", "T1110.003").otherwise("T1486")
    datasets = kinds.select("id", F.array(what).alias("techniques"), F.array("id").alias("host_files"))
    return coverage.detection_matrix(datasets, all_hits(spark, sf_dir).withColumnRenamed("event_type", "file"), rules_table(spark, library_rules()))


# decay

_SEEN = "event_id,ts,user_id,event_type,value,props,Channel,EventID"


@query(f"SELECT \"Channel\" AS channel, CAST(\"EventID\" AS INT) AS eid, '{','.join(sorted(_SEEN.split(',')))}' AS fields FROM ({TELEMETRY}) t GROUP BY 1, 2")
def field_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.observed(telemetry(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query("SELECT DISTINCT unnest(json_keys(props)) AS path FROM events")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.observed_paths(table(spark, sf_dir, "events"), "props")


_COLLECTED = "(SELECT unnest([" + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{n}' END" for c, n in (("event_id", "event_id"), ("ts", "ts"), ("user_id", "user_id"), ("event_type", "event_type"), ("props", "props"), ("event_type", "Channel"), ("props", "EventID"))) + "]) AS field FROM events)"
_FIELDS = "(VALUES " + ", ".join(f"('{_ID}{i:012d}', '{f}', {need}, {meta})" for i, f, need, meta in ((1, "value", True, False), (2, "user_id", True, False), (2, "EventID", False, True), (3, "props", False, False), (3, "value", False, False), (4, "props", True, False), (5, "event_type", True, False))) + ") v(rule_id, field, needed, meta)"


@query(f"SELECT rule_id, string_agg(field, ',' ORDER BY field) AS missing FROM {_FIELDS} WHERE field NOT IN (SELECT field FROM {_COLLECTED} WHERE field IS NOT NULL) GROUP BY 1")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that rules miss where the collector has stopped sending `value`."""
    from .plans.compile import rule_fields

    rows = [(r.key, sorted(rule_fields(r))) for r in library_rules()]
    out = decay.drift(spark.createDataFrame(rows, "rule_id string, fields array<string>"), telemetry(spark, sf_dir).drop("value"))
    return out.withColumn("missing", F.array_join("missing", ","))


@query(f"SELECT path FROM {_COLLECTED.replace('AS field', 'AS path')} WHERE path IS NOT NULL UNION SELECT 'doc' UNION SELECT unnest(['doc.who', 'doc.n', 'doc.n.k']) UNION SELECT DISTINCT 'k' || (event_id % 3) FROM events UNION SELECT 'tags'")
def present_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of columns, of structs and of keys in a map."""
    nested = F.struct(F.col("user_id").alias("who"), F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit(None).cast("string").alias("none")).alias("n")).alias("doc")
    tags = F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.lit("x")).alias("tags")
    return decay.present_paths(telemetry(spark, sf_dir).drop("value").select("*", nested, tags))


_STATUS_NOW = f"SELECT rule_id, CASE WHEN bool_or(needed AND gone) THEN 'broken' WHEN bool_or(gone AND NOT meta) THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT *, field NOT IN (SELECT field FROM {_COLLECTED} WHERE field IS NOT NULL) AS gone FROM {_FIELDS}) GROUP BY 1"


@query(_STATUS_NOW)
def decay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule(**{**r.__dict__, "logsource": LogSource("windows")}) for r in library_rules()]
    return decay.verdicts(rules, decay.observed(telemetry(spark, sf_dir).drop("value"))).select("rule_id", "status")


@query("SELECT event_type AS \"event.type\", count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def schema_change_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decay.rename(table(spark, sf_dir, "events"), {"event_type": "event.type", "user_id": "user.id"})
    return df.groupBy("`event.type`").agg(F.count("*").alias("n"), F.sum("`user.id`").alias("users"))


@query(f"SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'Security' ELSE event_type END AS channel, CASE WHEN event_type = 'click' THEN 4688 ELSE CAST(\"EventID\" AS INT) END AS eid, CASE WHEN event_type = 'click' THEN event_type || user_id END AS process, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS subject, CASE WHEN event_type = 'click' THEN 'Microsoft-Windows-Security-Auditing' END AS provider, CASE WHEN event_type <> 'click' THEN props END AS command FROM ({TELEMETRY}) t WHERE event_type <> 'click' OR \"EventID\" = 1")
def schema_change_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as Sysmon: only its id 1 stays, as Security 4688 under the names of that, without a command line."""
    sysmon = F.when(F.col("event_type") == "click", "Microsoft-Windows-Sysmon/Operational").otherwise(F.col("event_type"))
    df = telemetry(spark, sf_dir).select(sysmon.alias("Channel"), "EventID", F.col("event_id").alias("ProcessId"), F.concat("event_type", F.col("user_id").cast("string")).alias("Image"), F.col("user_id").cast("string").alias("User"), F.col("props").alias("CommandLine"))
    out = decay.to_4688(df, command_line=False)
    return out.select(F.coalesce("NewProcessId", "ProcessId").alias("id"), F.col("Channel").alias("channel"), F.col("EventID").alias("eid"), F.col("NewProcessName").alias("process"), F.col("SubjectUserName").alias("subject"), F.col("Provider_Name").alias("provider"), F.col("CommandLine").alias("command"))


@query("SELECT count(*) FILTER (decayed AND flagged) AS found, count(*) FILTER (decayed) AS decayed, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND NOT decayed) AS false_alarms, count(*) FILTER (decayed AND flagged) / nullif(count(*) FILTER (decayed), 0) AS recall, count(*) FILTER (decayed AND flagged) / nullif(count(*) FILTER (flagged), 0) AS precision FROM (SELECT quality = 0 AS decayed, toxic = 1 AS flagged FROM labels)")
def decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.scores(table(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("decayed"), (F.col("toxic") == 1).alias("flagged")))


# parsing

_HREF = r'([a-z]+)="([^"]*)"'


@query(r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source FROM pages""")
def parse_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of addresses, and one of their parameters."""
    query_part = F.regexp_extract("url", r"\?([^#]*)", 1)
    params = F.map_filter(F.str_to_map(query_part, F.lit("&"), F.lit("=")), lambda k, v: k != "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(\w+)://", 1).alias("scheme"), F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("host"), F.coalesce(F.try_element_at(params, F.lit("utm_source")), F.lit("")).alias("utm_source"))


@query(f"SELECT page_id, CAST(len(regexp_extract_all(html, '{_HREF}', 1)) AS INT) AS n, array_to_string(regexp_extract_all(html, '{_HREF}', 1), ',') AS names FROM pages")
def parse_xml_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(names).alias("n"), F.array_join(names, ",").alias("names"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') || 'é' || chr(10) || 'ABC€ &nope; & 😀') AS decoded FROM pages")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references by name, decimal and hexadecimal; unknown names and bare marks stay."""
    text = F.concat("html", F.lit("&eacute;&#10;&#x41;&#66;&#X43;&euro; &nope; & &#x1F600;"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(logs.unescape(text)).alias("decoded"))


@query("SELECT event_id, 'linux-sysmon/operational' AS channel, CAST(user_id AS VARCHAR) AS image, event_type AS \"user\" FROM events")
def parse_sysmon_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string('<Event><System><EventID>1</EventID><Computer>h</Computer></System><EventData><Data Name="Image">%d</Data><Data Name="User">%s</Data><Data Name="None"/></EventData></Event>', "user_id", "event_type")
    got = table(spark, sf_dir, "events").select("event_id", logs.sysmon_xml(line).alias("m"))
    return got.select("event_id", F.col("m.Channel").alias("channel"), F.col("m.Image").alias("image"), F.col("m.User").alias("user"))


@query("SELECT event_id, 'EXECVE' AS type, CAST(user_id AS VARCHAR) AS a0, event_type AS a1 FROM events")
def parse_auditd(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("type=EXECVE msg=audit(1700000000.123:%d): argc=2 a0=%d a1=\"%s\" a0=again\x1dend", "event_id", "user_id", "event_type")
    got = table(spark, sf_dir, "events").select("event_id", logs.auditd(line).alias("m"))
    return got.select("event_id", F.col("m.type").alias("type"), F.col("m.a0").alias("a0"), F.col("m.a1").alias("a1"))


@query("SELECT event_id, 'aws-cloudtrail' AS channel, event_type AS name, CAST(user_id AS VARCHAR) AS who FROM events")
def parse_cloudtrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.lit("s3").alias("eventSource"), F.col("event_type").alias("eventName"), F.struct(F.col("user_id").cast("string").alias("userName")).alias("requestParameters"), F.lit("x").alias("@timestamp")))
    got = table(spark, sf_dir, "events").select("event_id", logs.normalised(doc).alias("event"))
    at = Fields(got.schema, document="event")
    return got.select("event_id", F.col("event.Channel").alias("channel"), F.expr(at("eventName").sql).alias("name"), F.expr(at("requestParameters.userName").sql).alias("who"))


@query("SELECT event_id, event_type AS \"Channel\", CAST(user_id AS VARCHAR) AS image FROM events")
def parse_evtx_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.struct(F.col("event_type").alias("Channel"), F.struct(F.lit(1).alias("#text")).alias("EventID"), F.lit("h").alias("Computer"))
    doc = F.to_json(F.struct(F.struct(system.alias("System"), F.struct(F.col("user_id").cast("string").alias("Image")).alias("EventData")).alias("Event")))
    got = table(spark, sf_dir, "events").select("event_id", logs.normalised(doc).alias("m"))
    return got.select("event_id", F.col("m.Channel").alias("Channel"), F.col("m.Image").alias("image"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_records_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as one document of records, opened again."""
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"Records":['), F.array_join(F.collect_list("props"), ","), F.lit("]}")).alias("doc"))
    one = docs.select("user_id", F.explode(F.from_json(F.get_json_object("doc", "$.Records"), "array<string>")).alias("r"))
    return one.groupBy("user_id", F.get_json_object("r", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


# samples, spans, statistics


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id % 7 = 0) t WHERE n <= 5")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event, at most five a type."""
    some = table(spark, sf_dir, "events").filter("event_id % 7 = 0")
    return some.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).filter("n <= 5").select("event_id", "event_type")


@query("SELECT CAST(floor(event_id / 1000) AS INT) AS shard, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.shards(table(spark, sf_dir, "events"), 1000, "event_id").groupBy("shard").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("SELECT event_type, greatest(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) / 86400.0, 1.0 / 24) AS days FROM events GROUP BY 1")
def span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.greatest(seconds / 86400.0, F.lit(1.0 / 24)).alias("days"))


@query("SELECT quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS k, greatest(0.0, (p + 3.8416 / (2 * n2)) / (1 + 3.8416 / n2) - 1.96 * sqrt(p * (1 - p) / n2 + 3.8416 / (4 * n2 * n2)) / (1 + 3.8416 / n2)) AS lo, least(1.0, (p + 3.8416 / (2 * n2)) / (1 + 3.8416 / n2) + 1.96 * sqrt(p * (1 - p) / n2 + 3.8416 / (4 * n2 * n2)) / (1 + 3.8416 / n2)) AS hi FROM (SELECT *, avg(toxic) OVER (PARTITION BY quality) AS p, CAST(count(*) OVER (PARTITION BY quality) AS DOUBLE) AS n2 FROM labels) GROUP BY quality, p, n2")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return out.withColumns({"lo": F.round(lo, 9), "hi": F.round(hi, 9)})


_oracle["wilson_ci"] = "SELECT quality, n, k, round(lo, 9) AS lo, round(hi, 9) AS hi FROM (" + _oracle["wilson_ci"] + ")"


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.discordant(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b")


@query("SELECT both_, neither, a, b, n, round(((both_ + neither) / n - pe) / (1 - pe), 9) AS kappa FROM (SELECT *, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both_, count(*) FILTER (quality = 0 AND toxic = 0) AS neither, count(*) FILTER (quality = 1) AS a, count(*) FILTER (toxic = 1) AS b, count(*) AS n FROM labels))")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.kappa(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y")), "x", "y")
    return out.withColumn("kappa", F.round("kappa", 9)).withColumnRenamed("both", "both_")


@query("SELECT round(sum(hits * greatest(0, least(size, 50 - (running - size))) / size), 9) AS expected_hits FROM (SELECT score, size, hits, sum(size) OVER (ORDER BY score DESC) AS running FROM (SELECT n_chars // 100 AS score, count(*) AS size, count(*) FILTER (toxic = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1))")
def expected_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.expected_top_k(df, "score", "toxic", 50).select(F.round("expected_hits", 9).alias("expected_hits"))


# rules as data


def _event_rules(spark: SparkSession, sf_dir: str) -> list[Rule]:
    """A rule for each event type that occurs, as a library grown from the data."""
    kinds = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    return [Rule(id=f"{_ID}{i:012d}", title=f"type {k}", detection={"s": {"event_type": k}, "condition": "s"}, tags=["attack.t1059"] if i % 2 else ["nope.x"], level="low", status="test", description="x" * 10 * i, logsource=LogSource("windows"), falsepositives=["unknown"]) for i, k in enumerate(kinds, 1)]


@query("SELECT severity, code, findings, findings AS rules FROM (SELECT count(*) AS n, count(*) FILTER (i % 2 = 0) AS even FROM (SELECT row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))), LATERAL (VALUES ('error', 'A112', n), ('warning', 'W203', even), ('warning', 'W207', n), ('warning', 'W212', even)) v(severity, code, findings) WHERE findings > 0")
def lint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.rollup(lint.lint_rules(spark, _event_rules(spark, sf_dir)))


@query("SELECT '00000000-0000-4000-8000-' || lpad(CAST(i AS VARCHAR), 12, '0') AS rule_id, CAST(10 * i AS DOUBLE) AS desc_len, CAST(length(event_type) AS DOUBLE) AS mean_len, 1.0::DOUBLE AS n_selections, 1.0::DOUBLE AS mod_eq, 1.0::DOUBLE AS fp_unknown FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events))")
def rule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_table(spark, _event_rules(spark, sf_dir)).select("rule_id", "desc_len", "mean_len", "n_selections", "mod_eq", "fp_unknown")


@query("SELECT '00000000-0000-4000-8000-' || lpad(CAST(i AS VARCHAR), 12, '0') AS rule_id, CAST(greatest(0, 20 - 10 - 3 * (1 + 2 * (1 - i % 2))) + 4 + CASE WHEN 10 * i >= 40 THEN 3 ELSE 0 END + CASE WHEN i % 2 = 1 THEN 10 ELSE 0 END + 20 + round_even(10 * n / total, 0) + 5 AS INT) AS score FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY event_type) AS i FROM events GROUP BY 1)")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the data's own rules, with shares of events as precision."""
    rules = _event_rules(spark, sf_dir)
    counts = lint.lint_rules(spark, rules).groupBy("rule_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    n = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("type "), "event_type").alias("title")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    result = n.select("title", F.lit(1.0).alias("recall"), share.alias("precision"), F.col("n").alias("fp_hits"), F.lit(True).alias("passed"))
    return gate.score(rules_table(spark, rules).withColumn("n_techniques", F.size("techniques")).join(counts, "rule_id").join(result, "title")).select("rule_id", F.col("score").cast("int").alias("score"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS commands FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT doc_id, coalesce(text, '') || chr(10) || 'PS C:\\x> certutil.exe -urlcache ' || doc_id AS text FROM documents)) WHERE line LIKE 'PS C:%' GROUP BY 1")
def draft_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a command at their end, found among the lines of prose."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nPS C:\\x> certutil.exe -urlcache "), F.col("doc_id").cast("string")).alias("text"))
    found = draft.command_lines(texts).filter(F.col("command").startswith("certutil.exe "))
    return found.groupBy("doc_id").agg(F.count("*").alias("commands"))


@query()
def draft_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("schtasks.exe /create /tn "), F.substring_index("text", " ", 1), F.lit(" http://x.example.com/a")).alias("text"))
    return draft.behavioural_tokens(draft.command_lines(said))


def queries() -> dict[str, Query]:
    from . import library_queries, report_queries  # noqa: F401  they register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import library_queries, report_queries  # noqa: F401

    return dict(_oracle)
