"""Rules whose fields are no longer collected: inventories, schema changes, and what they break."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Rule, UnsupportedRule
from ..plans import conditions
from ..plans.compile import rule_fields, walk
from . import routes as rt

# Fields that every event has, and names under another schema.
META_FIELDS = ("EventID", "Channel", "Provider_Name", "Computer", "TimeCreated")
ECS = {
    "Image": "process.executable", "CommandLine": "process.command_line", "ParentImage": "process.parent.executable",
    "ParentCommandLine": "process.parent.command_line", "OriginalFileName": "process.pe.original_file_name", "User": "user.name",
    "TargetObject": "registry.path", "Details": "registry.data.strings", "TargetFilename": "file.path", "ImageLoaded": "dll.path",
    "DestinationIp": "destination.ip", "DestinationPort": "destination.port", "QueryName": "dns.question.name", "PipeName": "file.name",
    "ScriptBlockText": "powershell.file.script_block_text", "Hashes": "process.hash",
    "IntegrityLevel": "winlog.event_data.IntegrityLevel", "TargetImage": "winlog.event_data.TargetImage", "SourceImage": "winlog.event_data.SourceImage",
    "GrantedAccess": "winlog.event_data.GrantedAccess", "CallTrace": "winlog.event_data.CallTrace",
}

def observed(events: DataFrame, channel: str = "Channel", event_id: str = "EventID") -> DataFrame:
    """channel, eid, fields: names of the top-level fields that hold a value, by source."""
    names = [c for c in events.columns if not c.startswith("__")]
    present = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in names]))
    keys = events.select(rt.channel_key(channel).alias("channel"), rt.event_id_key(event_id).alias("eid"), present.alias("f"))
    shapes = keys.distinct()  # few: one for each set of fields that occurs
    return shapes.select("channel", "eid", F.explode("f").alias("f")).groupBy("channel", "eid").agg(F.array_sort(F.collect_set("f")).alias("fields"))


def observed_maps(events: DataFrame) -> DataFrame:
    """channel, eid, fields of events that are maps (Channel, EventID, event): their keys, by source. Each task tells a set of keys once."""
    shapes = events.select(F.lower(F.coalesce("Channel", F.lit(""))).alias("channel"), F.coalesce("EventID", F.lit(0)).alias("eid"), F.array_sort(F.map_keys(F.map_filter("event", lambda k, v: v.isNotNull()))).alias("f")).distinct()
    return shapes.select("channel", "eid", F.explode("f").alias("f")).groupBy("channel", "eid").agg(F.array_sort(F.collect_set("f")).alias("fields"))


def drift_of(rules: list[Rule], seen: DataFrame) -> DataFrame:
    """rule_id, missing: fields of rules that no source of an inventory has, under their own name or as the head of a dotted path."""
    said = seen.sparkSession.createDataFrame([(r.key, f) for r in rules for f in sorted(rule_fields(r))], "rule_id string, field string")
    there = seen.select(F.explode("fields").alias("there")).distinct()
    named = said.withColumn("names", F.explode(F.array_distinct(F.array("field", F.substring_index("field", ".", 1)))))
    held = named.join(there, F.col("names") == F.col("there"), "left_semi").select("rule_id", "field").distinct()
    return said.join(held, ["rule_id", "field"], "left_anti").groupBy("rule_id").agg(F.array_sort(F.collect_set("field")).alias("missing"))


def observed_paths(documents: DataFrame, column: str) -> DataFrame:
    """Dotted paths of all keys in a column of JSON texts; their structure is merged task by task."""
    schema = documents.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    paths: list[str] = []

    def collect(t: Any, prefix: str) -> None:
        for f in getattr(t, "fields", []):
            paths.append(prefix + f.name)
            collect(f.dataType, f"{prefix}{f.name}.")

    from pyspark.sql.types import StructType

    text = (schema or "VOID").replace("OBJECT<", "STRUCT<")
    if text.startswith("STRUCT"):
        collect(StructType.fromDDL(f"x {text}")[0].dataType, "")
    return documents.sparkSession.createDataFrame([(p,) for p in sorted(paths)], "path string")


def drift(rules: DataFrame, events: DataFrame) -> DataFrame:
    """rule_id, missing: fields of rules (rule_id, fields) that no event has; rules without any are left out.

    A field is a column that holds a value somewhere, a dotted path into structs that does, or a dotted path of keys in a map.
    """
    seen = present_paths(events).select(F.col("path").alias("field"))
    said = rules.select("rule_id", F.explode("fields").alias("field"))
    return said.join(F.broadcast(seen), "field", "left_anti").groupBy("rule_id").agg(F.array_sort(F.collect_set("field")).alias("missing"))  # broadcast: names of columns and keys


def present_paths(events: DataFrame) -> DataFrame:
    """path: of columns, nested fields and map keys that hold a value in some event. Each task tells a path once."""
    from pyspark.sql import types as T

    found: list[Column] = []

    def walk(column: Column, kind: T.DataType, path: str) -> None:
        found.append(F.when(column.isNotNull(), F.array(F.lit(path))))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column.getField(f.name), f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, T.MapType):
            found.append(F.map_keys(column))

    for f in events.schema.fields:
        if not f.name.startswith("__"):
            walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    shapes = events.select(F.flatten(F.array_compact(F.array(*found))).alias("paths")).distinct()  # few: one for each set of fields that occurs
    return shapes.select(F.explode("paths").alias("path")).distinct()


def _needs(key: str, value: Any) -> bool:
    """Whether a key of a selection can only hold if its field is there."""
    name, *mods = key.split("|")
    values = value if isinstance(value, list) else [value]
    if not name or name in META_FIELDS or None in values:
        return False
    return not ("exists" in mods and not values[0])


@dataclass(frozen=True)
class Verdict:
    status: str  # ok, degraded, broken or source-missing
    missing: tuple[str, ...] = ()
    blind_filters: tuple[str, ...] = ()


def analyse(rule: Rule, inventory: dict[tuple[str, int], set[str]]) -> Verdict:
    """What is left of a rule where only these fields are collected.

    broken: no condition can hold any more. degraded: it can, but a field is missing or a filter can't exclude what it
    should. The inventory has a set for each (channel, event id), as `observed` collects them.
    """
    found = rt.route(rule.logsource)
    keys = [k for k in inventory if found and any(c in (rt.ANY, k[0]) and i in (None, k[1]) for c, i in found.pairs)]
    if not keys:
        return Verdict("source-missing")
    there = set().union(*(inventory[k] for k in keys))
    of = rule.selections

    def holds(selection: Any) -> bool:
        if isinstance(selection, dict):
            return all(k.split("|")[0] in there or not _needs(k, v) for k, v in selection.items())
        if isinstance(selection, list) and selection and all(isinstance(x, dict) for x in selection):
            return any(holds(x) for x in selection)
        return True

    blind: list[str] = []

    def possible(node: conditions.Node) -> bool:
        kind, *rest = node
        if kind == "sel":
            return holds(of[rest[0]])
        if kind == "not":
            inner = rest[0]
            names = [inner[1]] if inner[0] == "sel" else list(inner[1]) if inner[0] in ("any", "all") else []
            blind.extend(n for n in names if not holds(of[n]))
            return True
        if kind == "and":
            return all(possible(n) for n in rest[0])
        if kind == "or":
            return any([possible(n) for n in rest[0]])
        return (any if kind == "any" else all)(holds(of[n]) for n in rest[0])

    alive = False
    for c in rule.conditions:
        try:
            alive = possible(conditions.parse(c, list(of)))
        except UnsupportedRule:
            alive = True
        if alive:
            break
    missing = tuple(sorted(f for f in rule_fields(rule) if f not in there and f not in META_FIELDS))
    filters = tuple(sorted(set(blind)))
    return Verdict("broken" if not alive else "degraded" if missing or filters else "ok", missing, filters)


def verdicts(rules: list[Rule], seen: DataFrame) -> DataFrame:
    """rule_id, status, missing, blind_filters of a library; the inventory has a row for each source and is collected."""
    spark = seen.sparkSession
    inventory = {(r["channel"], r["eid"]): set(r["fields"]) for r in seen.collect()}
    rows = [(r.key, v.status, list(v.missing), list(v.blind_filters)) for r in rules for v in [analyse(r, inventory)]]
    return spark.createDataFrame(rows, "rule_id string, status string, missing array<string>, blind_filters array<string>")


# schema changes


def rename(df: DataFrame, names: dict[str, str] = ECS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


# What Security 4688 calls the fields of a Sysmon process creation that it carries.
AS_4688 = {"NewProcessName": "Image", "Image": "Image", "ParentProcessName": "ParentImage", "ParentImage": "ParentImage", "SubjectUserName": "User", "NewProcessId": "ProcessId", "Computer": "Computer"}
PROVIDER_4688 = "Microsoft-Windows-Security-Auditing"


def to_4688(df: DataFrame, command_line: bool = True, everywhere: bool = True) -> DataFrame:
    """Without Sysmon: its process creations as Security 4688 with what that carries under its names, its other events gone.

    Columns that only the converted events have are added. Own 4688 events lose the command line only `everywhere`.
    """
    channel, eid = rt.channel_key(), rt.event_id_key()
    number = df.schema["EventID"].dataType
    made = {"Channel": F.lit("Security"), "EventID": F.lit(4688).cast(number), "Provider_Name": F.lit(PROVIDER_4688)}
    made |= {new: F.col(old) for new, old in AS_4688.items() if old in df.columns}
    if command_line and "CommandLine" in df.columns:
        made["CommandLine"] = F.col("CommandLine")
    converted = df.filter((channel == rt.SYSMON) & (eid == 1)).select(*[v.alias(k) for k, v in made.items()])
    rest = df.filter(channel != rt.SYSMON)
    if not command_line and everywhere and "CommandLine" in df.columns:
        own = (channel == rt.SECURITY) & (eid == 4688)
        rest = rest.withColumn("CommandLine", F.when(~own, F.col("CommandLine")))
    return rest.unionByName(converted, allowMissingColumns=True)


SCHEMA_CHANGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ecs_rename": rename,
    "sysmon_to_4688": to_4688,
    "4688_no_cmdline": lambda df: to_4688(df, False),
    "4688_no_cmdline_mixed": lambda df: to_4688(df, False, False),
    "no_commandline": lambda df: df.drop("CommandLine"),
    "no_hashes": lambda df: df.drop("Hashes"),
}


# the same changes of events that are maps, so that one read of a corpus shows what each of them does


def _map_rename(event: Column, names: dict[str, str] = ECS) -> Column:
    """Keys under their new names; what stood under a new name before goes."""
    new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(F.map_filter(event, lambda k, v: ~k.isin(*names.values())), lambda k, v: F.coalesce(F.try_element_at(new, k), k))


def _map_without(event: Column, *names: str) -> Column:
    return F.map_filter(event, lambda k, v: ~k.isin(*names))


def _map_4688(event: Column, command_line: bool = True, everywhere: bool = True) -> Column:
    """As to_4688; null for an event that goes."""
    get = lambda k: F.try_element_at(event, F.lit(k))
    channel, eid = F.lower(F.coalesce(get("Channel"), F.lit(""))), F.coalesce(get("EventID").try_cast("int"), F.lit(0))
    made = {"Channel": F.lit("Security"), "EventID": F.lit("4688"), "Provider_Name": F.lit(PROVIDER_4688), **{new: get(old) for new, old in AS_4688.items()}}
    if command_line:
        made["CommandLine"] = get("CommandLine")
    converted = F.map_filter(F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    rest = event
    if not command_line and everywhere:
        rest = F.when((channel == rt.SECURITY) & (eid == 4688), _map_without(event, "CommandLine")).otherwise(event)
    return F.when(channel != rt.SYSMON, rest).when(eid == 1, converted)


MAP_CHANGES: dict[str, Callable[[Column], Column]] = {
    "ecs_rename": _map_rename,
    "sysmon_to_4688": _map_4688,
    "4688_no_cmdline": lambda e: _map_4688(e, False),
    "4688_no_cmdline_mixed": lambda e: _map_4688(e, False, False),
    "no_commandline": lambda e: _map_without(e, "CommandLine"),
    "no_hashes": lambda e: _map_without(e, "Hashes"),
}


def evidence(events: DataFrame, rules: list[Rule], changes: dict[str, Callable[[Column], Column]] = MAP_CHANGES) -> DataFrame:
    """change (empty: none), rule_id, channel, eid, fields, n: how often each rule fires, and what each source's events hold, before and after every change.

    Events (with `event`, a map) are read once and each takes all its forms in turn. A row is either about a rule's hits
    (rule_id) or about a source's sets of fields (channel, eid, fields); both are counted by one aggregation, which meets
    a row a rule or a set of fields in each task.
    """
    from ..functions.dialect import Fields
    from . import scan

    forms = F.array(F.struct(F.lit("").alias("change"), F.col("event")), *[F.struct(F.lit(name).alias("change"), f(F.col("event")).alias("event")) for name, f in changes.items()])
    each = events.select(F.explode(forms).alias("x")).select("x.change", "x.event").filter("event is not null")
    get = lambda k: F.try_element_at("event", F.lit(k))
    each = each.select("change", "event", get("Channel").alias("Channel"), get("EventID").try_cast("int").alias("EventID"))
    fields = Fields(each.schema, document="event")
    library = scan.Library.build(rules, fields)
    keys = scan.keyed(each)
    none = F.array().cast("array<string>")
    fired = none
    if any(r.pairs for r in library.routes.values()):
        asked = scan.routed(library, lambda n: fields(n).sql)
        keys = keys.withColumns(asked.columns)
        fired = F.when(asked.covered, asked.matching).otherwise(none)
    held = F.array_sort(F.map_keys(F.map_filter("event", lambda k, v: v.isNotNull())))
    kind = "struct<rule_id: string, channel: string, eid: int, fields: array<string>>"
    empty = lambda t: F.lit(None).cast(t)
    hit = F.transform(fired, lambda k: F.struct(k, empty("string"), empty("int"), empty("array<string>")).cast(kind))
    shape = F.struct(empty("string"), F.col("__channel"), F.col("__eid"), held).cast(kind)
    rows = keys.select("change", F.explode(F.array_append(hit, shape)).alias("x")).select("change", "x.*")
    return rows.groupBy("change", "rule_id", "channel", "eid", "fields").agg(F.count("*").alias("n"))


def worsened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules whose verdict is worse after a change."""
    rank = lambda c: F.element_at(F.create_map(*[x for i, s in enumerate(("ok", "degraded", "broken", "source-missing")) for x in (F.lit(s), F.lit(i))]), F.col(c))
    both = before.select("rule_id", F.col("status").alias("before")).join(after.select("rule_id", F.col("status").alias("after")), "rule_id")
    return both.filter(rank("after") > rank("before"))


def scores(flags: DataFrame) -> DataFrame:
    """Recall, precision and false alarms of a decay check, from (rule_id, decayed, flagged)."""
    hit, said, true = F.count_if(F.expr("decayed and flagged")), F.count_if("flagged"), F.count_if("decayed")
    return flags.agg(hit.alias("found"), true.alias("decayed"), said.alias("flagged"), F.count_if(F.expr("flagged and not decayed")).alias("false_alarms")).withColumns({"recall": F.try_divide("found", "decayed"), "precision": F.try_divide("found", "flagged")})


def field_values(rule: Rule) -> list[tuple[str, Any]]:
    return [p for s in rule.selections.values() for p in walk(s)]
