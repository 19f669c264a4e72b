"""Selections and conditions against expected results, as tables of cases, and against a plain evaluator on random events."""

import fnmatch
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwatch.functions.dialect import Fields
from sparkwatch.functions.literals import expand, pattern, tokens
from sparkwatch.functions.regex import to_java, valid_in_java
from sparkwatch.model import Rule, UnsupportedRule
from sparkwatch.plans import conditions
from sparkwatch.plans.compile import required_event_ids, rule_column, rule_fields, rule_sql, run, selection_column

EVENT = [(1, "C:\\Windows\\cmd.exe", "cmd /c whoami -enc abc", "10.1.2.3", "0:0:0:0:0:0:0:1", "0x1410", "SYSTEM", "system", 7, "", ["alpha", "Beta"], ("inner",), True)]
SCHEMA = "EventID int, Image string, CommandLine string, DestinationIp string, SourceIp string, GrantedAccess string, ParentUser string, User string, Count int, Empty string, Tags array<string>, proc struct<name: string>, Flag boolean"
CASES = [
    ({"Image|endswith": "\\CMD.exe"}, True), ({"Image|cased|endswith": "\\CMD.exe"}, False), ({"Image|cased|endswith": "\\cmd.exe"}, True),
    ({"CommandLine|contains|all": ["whoami", "enc"]}, True), ({"CommandLine|contains|all": ["whoami", "zzz"]}, False), ({"CommandLine|contains": ["zzz", "WHO"]}, True),
    ({"Image": "c:\\\\*\\\\cmd.???"}, True), ({"Image": "*cmd"}, False), ({"Image|contains": "win*cmd"}, True), ({"CommandLine|contains": "\\*"}, False),
    ({"DestinationIp|cidr": "10.0.0.0/8"}, True), ({"DestinationIp|cidr": "10.1.2.4/31"}, False), ({"SourceIp|cidr": "::1/128"}, True), ({"Image|cidr": "10.0.0.0/8"}, False),
    ({"GrantedAccess|gte": 5136}, True), ({"GrantedAccess|gt": 5136}, False), ({"Count|lt": 8}, True), ({"Image|lt": 8}, False), ({"Count|gte": "0x7"}, True),
    ({"Missing": None}, True), ({"Empty": None}, True), ({"Image": None}, False), ({"Image": []}, False), ({"Missing|exists": False}, True), ({"Image|exists": True}, True),
    ({"ParentUser|fieldref": "User"}, True), ({"ParentUser|fieldref": "Image"}, False), ({"CommandLine|re": "-e(nc)?\\s"}, True), ({"CommandLine|re|i": "WHOAMI"}, True),
    ({"CommandLine|re": "WHOAMI"}, False), ({"Count": 7}, True), ({"Count": "7"}, True), ({"Count": [1, 2]}, False), ({"EventID": [1, 2]}, True), ({"Flag": True}, True), ({"Flag": False}, False),
    ({"Image|neq": "x"}, True), ({"Missing|neq": "x"}, True), ({"CommandLine|windash|contains": " /enc"}, True), ({"CommandLine|contains": " /enc"}, False),
    ({"Tags": "BETA"}, True), ({"Tags|all": ["alpha", "beta"]}, True), ({"Tags|all": ["alpha", "gamma"]}, False), ({"proc.name": "INNER"}, True), ({"proc.none": None}, True),
    (["whoami", "nothing"], True), ({"|all": ["whoami", "10.1"]}, True), ({"|all": ["whoami", "nothing"]}, False), ("nothing", False), ([{"Count": 8}, {"Count": 7}], True),
]


def test_selection_cases(spark):
    df = spark.createDataFrame(EVENT, SCHEMA)
    got = df.select(*[F.coalesce(selection_column(df, s), F.lit(False)).alias(f"c{i}") for i, (s, _) in enumerate(CASES)]).first()
    assert [(s, got[i]) for i, (s, _) in enumerate(CASES)] == CASES


def test_missing_fields_are_false_and_their_negation_true(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, a string")
    rule = Rule(detection={"s": {"a": "x"}, "condition": "not s"})
    assert [r.id for r in df.filter(rule_column(df, rule)).collect()] == [1]
    assert [r.id for r in run(df, rule, "id").collect()] == [1]


def test_documents_resolve_exact_keys_before_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": "path"}}',), ('{"a.b": "exact", "a": {"b": "path"}}',)], "doc string")
    assert df.filter(selection_column(df, {"a.b": "exact"}, document="doc")).count() == 1
    assert df.filter(selection_column(df, {"a.b": "path"}, document="doc")).count() == 1
    variant = df.select(F.parse_json("doc").alias("doc"))
    assert variant.filter(selection_column(variant, {"a.b": "exact"}, document="doc")).count() == 1
    mapped = df.select(F.from_json("doc", "map<string,string>").alias("m"))
    assert mapped.filter(selection_column(mapped, {"a.b": "path"}, document="m")).count() == 1


@pytest.mark.parametrize(("text", "want"), [
    ("a or b and c", ("or", (("sel", "a"), ("and", (("sel", "b"), ("sel", "c")))))), ("NOT a AND b", ("and", (("not", ("sel", "a")), ("sel", "b")))),
    ("not (a or b)", ("not", ("or", (("sel", "a"), ("sel", "b"))))), ("1 of f_*", ("any", ("f_1", "f_2"))), ("all of them", ("all", ("a", "b", "c", "f_1", "f_2"))), ("any of f_1", ("any", ("f_1",))),
])
def test_conditions(text, want):
    assert conditions.parse(text, ["a", "b", "c", "f_1", "f_2", "_hidden"]) == want


@pytest.mark.parametrize("text", ["", "a and", "(a", "a)", "a b", "1 of x*", "d", "a | count() > 3", "not", "1 of", "and a"])
def test_malformed_conditions(text):
    with pytest.raises(UnsupportedRule):
        conditions.parse(text, ["a", "b"])


@pytest.mark.parametrize("detection", [{"s": {"a|expand": "x"}, "condition": "s"}, {"s": {"a|nope": "x"}, "condition": "s"}, {"s": {}, "condition": "s"}, {"s": {"a|cidr": "x"}, "condition": "s"}, {"s": {"a|re": "("}, "condition": "s"}, {"s": {"a": 1}}])
def test_unsupported_rules(spark, detection):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(UnsupportedRule):
        rule_sql(Rule(detection=detection), df.schema)


def test_required_event_ids_and_fields():
    of = lambda d: required_event_ids(Rule(detection=d))
    a, b, c = {"EventID": [1, 2]}, {"EventID": 2, "x|contains": "y"}, {"x": 1}
    assert of({"a": a, "b": b, "condition": "a and b"}) == {2}
    assert of({"a": a, "b": b, "condition": "a or b"}) == {1, 2}
    assert of({"a": a, "c": c, "condition": "a or c"}) is None
    assert of({"a": a, "c": c, "condition": "a and not c"}) == {1, 2}
    assert of({"a": a, "b": {"EventID": 3}, "condition": "all of them"}) == set()
    assert rule_fields(Rule(detection={"s": [{"x|re": "a"}, {"y|fieldref": "z"}], "k": ["word"], "condition": "s"})) == {"x", "y", "z"}


def test_literals():
    assert tokens("a\\*b*c\\\\?") == [("a*b", False), ("*", True), ("c\\", False), ("?", True)]
    assert expand("foobar", ["base64offset"]) == ["Zm9vYmFy", "Zvb2Jhc", "mb29iYX"]
    assert expand("ab", ["wide"]) == ["a\0b\0"] and expand("ab", ["utf16be"]) == ["\0a\0b"]
    assert set(expand("-a", ["windash"])) == {"-a", "/a", "\u2013a", "\u2014a", "\u2015a"}
    assert expand("A", ["wide", "base64"]) == ["QQA="]
    assert re.fullmatch(pattern("a.b*c?"), "a.bXXcY")


@pytest.mark.parametrize(("pattern_", "text", "want"), [(r"abc\Z", "abc\n", False), (r"a\wb", "aéb", True), (r"(?i)école", "ÉCOLE", True), (r"(?P<x>a)(?P=x)", "aa", True), (r"[[]", "[", True), (r"[]a]+", "]a", True), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False)])
def test_python_patterns_in_java(spark, pattern_, text, want):
    assert bool(re.search(pattern_, text)) == want
    java = to_java(pattern_)
    assert valid_in_java(spark, java)
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java)).first()[0] == want


values = st.sampled_from(["alpha", "Beta", "a*a", "al?ha", "", "x", None])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(values, values), min_size=1, max_size=6), st.lists(values, min_size=1, max_size=3), st.sampled_from(["", "|contains", "|startswith", "|endswith"]), st.booleans(), st.booleans())
def test_random_rules_match_a_plain_evaluator(spark, rows, wanted, how, negate, every):
    def one(value, want):
        if want is None:
            return value is None or value == ""
        if value is None:
            return False
        glob = {"": "%s", "|contains": "*%s*", "|startswith": "%s*", "|endswith": "*%s"}[how] % want.lower()
        return fnmatch.fnmatchcase(value.lower(), glob)

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")
    rule = Rule(detection={"s": {f"a{how}{'|all' if every else ''}": wanted}, "t": {"b": None}, "condition": "not s or t" if negate else "s or t"})
    hit = lambda a: (all if every else any)(one(a, w) for w in wanted)
    want = [i for i, (a, b) in enumerate(rows) if (hit(a) != negate) or b in (None, "")]
    assert sorted(r.id for r in df.filter(rule_column(df, rule)).collect()) == want


def test_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = df.filter(selection_column(df, {"l_quantity|gt": 49})).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "GreaterThan(l_quantity" in plan
    assert Fields(df.schema)("nowhere").kind == "null"
