"""A library of rules over events: all hits in one pass, and what is counted of them.

The events are read once, whatever the library. Rules are grouped by the route pairs that they share, and an event's
channel and id say which groups are for it: at most one of each kind (any channel, the channel as a whole, channel and id).
One projection tests those groups' rules, and events without a hit end there. Texts that several rules read in lower case
are lower-cased once. Groups are cut into chunks, which keeps generated methods small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Fields
from ..functions.network import register
from ..functions.stored import Scratch
from ..model import GatePolicy, Rule, UnsupportedRule
from ..plans.compile import Compiler, required_event_ids
from . import routes as rt


@dataclass
class Library:
    """Compiled rules, their routes, and the rules left out with the reason."""

    predicates: dict[str, str]
    rules: dict[str, Rule]
    routes: dict[str, rt.Route]
    unsupported: dict[str, str] = field(default_factory=dict)
    unroutable: list[str] = field(default_factory=list)
    shared: dict[str, str] = field(default_factory=dict)  # columns that predicates read, as expressions

    @classmethod
    def build(cls, rules: list[Rule], fields: Fields, include_deprecated: bool = False, drop: set[str] = frozenset()) -> Library:  # type: ignore[assignment]
        """A rule's key is its id, or its path without one; of rules that share a key the first counts."""
        out = cls({}, {}, {})
        compiler = Compiler(fields, out.shared)
        for r in rules:
            if r.key in out.rules or r.key in drop or (r.status == "deprecated" and not include_deprecated):
                continue
            try:
                predicate, required = compiler.rule(r), required_event_ids(r)
            except UnsupportedRule as e:
                out.unsupported[r.key] = str(e)
                continue
            found = rt.route(r.logsource)
            if found is None:
                out.unroutable.append(r.key)
                continue
            out.rules[r.key], out.predicates[r.key], out.routes[r.key] = r, predicate, rt.indexed(found, required)
        return out

    def routes_table(self, spark: SparkSession) -> DataFrame:
        return rt.routes_table(spark, self.routes)

    def without(self, keys: set[str]) -> Library:
        keep = lambda d: {k: v for k, v in d.items() if k not in keys}
        return Library(keep(self.predicates), keep(self.rules), keep(self.routes), self.unsupported, self.unroutable, self.shared)


def keyed(events: DataFrame, channel: str = "Channel", event_id: str = "EventID") -> DataFrame:
    return events.withColumns({"__channel": rt.channel_key(channel), "__eid": rt.event_id_key(event_id)})


def _kind(pair: tuple[str, int | None]) -> int:
    """0: any channel, 1: a channel as a whole, 2: a channel and an id. An event meets at most one pair of each kind."""
    return 0 if pair[0] == rt.ANY else 1 if pair[1] is None else 2


def _groups(library: Library) -> list[dict[tuple[str, ...], list[tuple[str, int | None]]]]:
    """For each kind of pair the rules that are for the same pairs, and those pairs."""
    of: dict[tuple[str, int | None], list[str]] = {}
    for k, r in library.routes.items():
        for pair in dict.fromkeys(r.pairs):
            of.setdefault(pair, []).append(k)
    out: list[dict[tuple[str, ...], list[tuple[str, int | None]]]] = [{}, {}, {}]
    for pair, ids in of.items():
        out[_kind(pair)].setdefault(tuple(ids), []).append(pair)
    return out


def _number(groups: dict[tuple[str, ...], list[tuple[str, int | None]]]) -> Column:
    """The number of the group that an event belongs to: a choice by channel first, then by id."""
    by: dict[str, dict[int | None, list[int]]] = {}
    for g, pairs in enumerate(groups.values()):
        for channel, eid in pairs:
            by.setdefault(channel, {}).setdefault(eid, []).append(g)
    out = None
    for channel, ids in by.items():
        if channel == rt.ANY:
            return F.when(~F.col("__channel").isin(*rt.NOT_WINDOWS), F.lit(ids[None][0]))
        if None in ids:
            inner = F.lit(ids[None][0])
        else:
            same: dict[int, list[int]] = {}
            for eid, (g,) in ids.items():
                same.setdefault(g, []).append(eid)  # type: ignore[arg-type]
            inner = None
            for g, eids in same.items():
                here = F.col("__eid").isin(*eids)
                inner = F.when(here, F.lit(g)) if inner is None else inner.when(here, F.lit(g))
        at = F.col("__channel") == channel
        out = F.when(at, inner) if out is None else out.when(at, inner)
    return out


def _overlap(library: Library) -> bool:
    """Whether an event may meet a rule by two kinds of pairs."""
    return any(len({_kind(p) for p in r.pairs}) > 1 for r in library.routes.values())


def _pruned(events: DataFrame, library: Library) -> DataFrame:
    """Events that some route is for, as far as the files' partitions and statistics can tell: `channel_key` is what ingest writes."""
    pairs = {p for r in library.routes.values() for p in r.pairs}
    if "channel_key" in events.columns and all(c != rt.ANY for c, _ in pairs):
        events = events.filter(F.col("channel_key").isin(*sorted({c for c, _ in pairs})))
    if pairs and all(i is not None for _, i in pairs) and dict(events.dtypes).get("EventID") in ("tinyint", "smallint", "int", "bigint"):
        ids = sorted({i for _, i in pairs})
        events = events.filter(F.col("EventID").isin(*ids) if 0 not in ids else F.col("EventID").isin(*ids) | F.col("EventID").isNull())
    return events


def ready(predicates: dict[str, str], shared: dict[str, str]) -> tuple[dict[str, str], dict[str, Column]]:
    """Predicates, and the columns that several of them read; what only one reads stands in it."""
    used = " ".join(predicates.values())
    columns = {alias: F.expr(sql) for alias, sql in shared.items() if used.count(alias) > 1}
    for alias, sql in shared.items():
        if alias not in columns and alias in used:
            predicates = {k: p.replace(alias, sql) for k, p in predicates.items()}
    return predicates, columns


def guarded(predicate: str, route: rt.Route, resolve: Callable[[str], str]) -> str:
    """A predicate, under its route's guard if that has one."""
    if not route.guard:
        return predicate
    name, values = route.guard
    return f"({predicate}) AND lower(coalesce(cast({resolve(name)} as string), '')) IN ({', '.join(map(SPARK.text, values))})"


@dataclass
class Routed:
    """What a library asks of an event: columns to add, which events are for any of its rules, and the ids of the rules that match."""

    columns: dict[str, Column]
    covered: Column
    matching: Column


def routed(library: Library, resolve: Callable[[str], str], chunk: int = 250) -> Routed:
    """The tests of a library's rules on events with __channel and __eid, by groups of rules with the same pairs."""
    kinds = [(k, g) for k, g in enumerate(_groups(library)) if g]
    texts, shared = ready(library.predicates, library.shared)
    test = lambda key: f"CASE WHEN {guarded(texts[key], library.routes[key], resolve)} THEN {SPARK.text(key)} END"

    def found(kind: int, groups: dict[tuple[str, ...], list[tuple[str, int | None]]]) -> str:
        out = []
        for g, ids in enumerate(groups):
            parts = [f"array_compact(array({', '.join(map(test, ids[i : i + chunk]))}))" for i in range(0, len(ids), chunk)]
            out.append(f"WHEN __group{kind} = {g} THEN {parts[0] if len(parts) == 1 else 'concat(' + ', '.join(parts) + ')'}")
        return f"CASE {' '.join(out)} ELSE cast(array() as array<string>) END"

    every = F.concat(*[F.expr(found(k, g)) for k, g in kinds])  # as text, which is parsed at once
    covered = reduce(Column.__or__, [F.col(f"__group{k}").isNotNull() for k, _ in kinds])
    return Routed({f"__group{k}": _number(g) for k, g in kinds} | shared, covered, F.array_distinct(every) if _overlap(library) else every)


def hits(events: DataFrame, library: Library, keep: list[str] | None = None, fields: Callable[[str], str] | None = None, chunk: int = 250) -> DataFrame:
    """rule_id and the columns `keep` of events, a row for each rule that an event matches (each rule once)."""
    register(events.sparkSession)
    keep = events.columns if keep is None else keep
    if not any(r.pairs for r in library.routes.values()):
        return events.select(*keep, F.lit("").alias("rule_id")).limit(0)
    asked = routed(library, fields or (lambda n: Fields(events.schema)(n).sql), chunk)
    keys = keyed(_pruned(events, library)).withColumns(asked.columns).filter(asked.covered)
    return keys.select(*keep, F.explode(asked.matching).alias("rule_id"))


def ablation(events: DataFrame, library: Library, fields: Callable[[str], str] | None = None, chunk: int = 250) -> DataFrame:
    """rule_id, routed, unrouted, tested: hits of each rule under its route and without it, and how many events its route has it tested on. One read: an event is tested by all rules once."""
    register(events.sparkSession)
    resolve = fields or (lambda n: Fields(events.schema)(n).sql)
    texts, shared = ready(library.predicates, library.shared)

    def covers(route: rt.Route) -> str:
        windows = f"__channel NOT IN ({', '.join(map(SPARK.text, rt.NOT_WINDOWS))})"
        parts = [(windows if c == rt.ANY else f"__channel = {SPARK.text(c)}") + ("" if i is None else f" AND __eid = {i}") for c, i in route.pairs]
        return guarded(" OR ".join(f"({p})" for p in parts) or "FALSE", route, resolve)

    def row(key: str) -> str:
        test = f"struct({SPARK.text(key)} AS rule_id, coalesce({covers(library.routes[key])}, FALSE) AS covered, coalesce({texts[key]}, FALSE) AS hit)"
        return test

    ids = list(texts)
    if not ids:
        return events.sparkSession.createDataFrame([], "rule_id string, routed long, unrouted long, tested long")
    parts = [F.expr(f"filter(array({', '.join(map(row, ids[i : i + chunk]))}), x -> x.covered OR x.hit)") for i in range(0, len(ids), chunk)]
    found = keyed(events).withColumns(shared).select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
    return found.groupBy("rule_id").agg(F.count_if(F.expr("hit AND covered")).alias("routed"), F.count_if("hit").alias("unrouted"), F.count_if("covered").alias("tested"))


def hits_per_rule(found: DataFrame, index: str = "event_idx") -> DataFrame:
    """rule_id, hits, first_hit."""
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"), F.min(index).alias("first_hit"))


def events_by_key(events: DataFrame, channel: str = "Channel", event_id: str = "EventID") -> DataFrame:
    return keyed(events, channel, event_id).groupBy(F.col("__channel").alias("channel"), F.col("__eid").alias("eid")).agg(F.count("*").alias("n"))


def evaluations(events: DataFrame, library: Library) -> DataFrame:
    """How often a predicate is tested after routing."""
    return rt.candidates(keyed(events).select("__channel", "__eid"), library.routes_table(events.sparkSession)).agg(F.count("*").alias("evaluations"))


def examples(found: DataFrame, k: int, index: str = "event_idx", cut: int = 300) -> DataFrame:
    """The first k hits of each rule, long texts cut; each task keeps k a rule before the shuffle."""
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy(index))).filter(F.col("n") <= k)
    return top.select(*[F.substring(c, 1, cut).alias(c) if t == "string" and c != "rule_id" else F.col(c) for c, t in top.dtypes])


def top_rules(found: DataFrame, k: int) -> DataFrame:
    return hits_per_rule(found).orderBy(F.desc("hits"), "rule_id").limit(k)


def gate(per_rule: DataFrame, policy: GatePolicy) -> DataFrame:
    """Alerts a day of each rule against its budget."""
    daily = F.col("hits") / F.lit(policy.corpus_days)
    return per_rule.withColumn("alerts_per_day", daily).withColumn("passed", daily <= F.lit(policy.budget))


def told(events: DataFrame, library: Library, fields: Callable[[str], str], index: str = "event_idx") -> dict[str, DataFrame]:
    """What a library says of files of events (file, Channel, EventID, index and its own columns), from one read of them.

    The read stores a narrow row for each event and one for each hit, which alone has the event's text; of these are hits
    by (file, rule, channel), events by file and by (channel, id), first hits by rule, and the first three examples of each.
    """
    spark = events.sparkSession
    register(spark)
    none, fired = F.array().cast("array<string>"), None
    keys = keyed(events)
    if any(r.pairs for r in library.routes.values()):
        asked = routed(library, fields)
        keys, fired = keys.withColumns(asked.columns), F.when(asked.covered, asked.matching).otherwise(none)
    own = [c for c in events.columns if c not in ("file", index)]
    each = keys.select("file", "__channel", "__eid", F.col(index).alias("event_idx"), F.struct(*own).alias("__own"), F.explode(F.array_append(none if fired is None else fired, F.lit(None).cast("string"))).alias("rule_id"))
    text = F.when(F.col("rule_id").isNotNull(), F.to_json("__own"))
    rows = Scratch(spark).write(each.select("file", F.col("__channel").alias("channel"), F.col("__eid").alias("eid"), "event_idx", "rule_id", text.alias("event")), "told", last=True)
    found, of = rows.filter("rule_id is not null"), rows.filter("rule_id is null")
    return {
        "hits": found.groupBy("file", "rule_id", "channel").agg(F.count("*").alias("hits")),
        "events": of.groupBy("file").agg(F.count("*").alias("events")),
        "by_key": of.groupBy("channel", "eid").agg(F.count("*").alias("n")),
        "first": found.groupBy("rule_id").agg(F.count("*").alias("hits"), F.min(F.struct("file", "event_idx")).alias("first")),
        "examples": examples(found.select("rule_id", "file", "event_idx", "event"), 3),
    }


def scan_files(spark: SparkSession, paths: list[str], rules: list[Rule], reader: Callable[..., DataFrame], drop: set[str] = frozenset(), **options: Any) -> dict[str, DataFrame]:  # type: ignore[assignment]
    """`told` of log files and a library, whose events `reader` gives as maps."""
    events = reader(spark, paths, **options)
    fields = Fields(events.schema, document="event")
    return told(events, Library.build(rules, fields, drop=drop), lambda n: fields(n).sql)
