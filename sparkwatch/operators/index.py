"""A library of thousands of literals over events: only the rules whose literals an event holds are tested in full.

Most rules can't match without one of a few literals (anchors) somewhere in an event's text. Each anchor is known by four of
its characters, the ones that fewest rules have. An event's text is cut into its distinct runs of four characters, these are
looked up in a table of the library's (a broadcast hash join), and of the rules found there each one's own predicate is
tested. So an event's cost depends on its length and on the rules that come near it, not on the size of the library. Rules
without an anchor are tested as a scan does, for the same rows of the same single read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals as lit
from ..functions.dialect import SPARK, Fields
from ..functions.network import register
from ..model import Rule
from ..plans import conditions
from . import routes as rt
from . import scan

#: Characters by which an anchor is known.
GRAM = 4
_UNANCHORED = ("re", "cidr", "exists", "fieldref", "neq", *lit.COMPARE)
_ASCII = re.compile(r"[\x00-\x7f]+")

#: Literals of which a matching event holds one, with the field it is in (empty: any); None if that can't be told.
Anchors = frozenset[tuple[str, str]] | None


def _piece(value: str) -> str:
    """The longest part of a value, in lower case, that every text it matches holds: ASCII, which lower-casing takes letter by letter.

    Between wildcards, patterns match regardless of case, under which s has a second form that lower-casing keeps apart.
    """
    wild = lit.has_wildcard(value)
    found = [m for text, w in lit.tokens(value) if not w for m in _ASCII.findall(text)] if wild else _ASCII.findall(lit.plain(value))
    if wild:
        found = [part for m in found for part in re.split("[sS]", m)]
    return max(found, key=len, default="").lower()


def _better(options: list[Anchors]) -> Anchors:
    """Of anchors that must all be there, those with the longest shortest literal, and of these the fewest."""
    known = [o for o in options if o]
    return max(known, key=lambda o: (min(min(len(x), 12) for _, x in o), -len(o)), default=None)


def _any_of(options: list[Anchors]) -> Anchors:
    return frozenset().union(*options) if options and all(options) else None  # type: ignore[arg-type]


def _values(name: str, value: Any, mods: list[str]) -> Anchors:
    """Anchors of a field's (or, without a name, a keyword's) values."""
    encodings = [m for m in mods if m in lit.ENCODING]

    def one(v: Any) -> Anchors:
        if not isinstance(v, str):
            return None
        pieces = [_piece(x) for x in (lit.expand(v, encodings) if encodings else [v])]
        return frozenset((name, p) for p in pieces) if all(len(p) >= GRAM for p in pieces) else None

    each = [one(v) for v in (value if isinstance(value, list) else [value])]
    return _better(each) if "all" in mods else _any_of(each)


def _selection(selection: Any) -> Anchors:
    if isinstance(selection, dict):
        parts: list[Anchors] = []
        for key, value in selection.items():
            name, *mods = key.split("|")
            if not any(m in _UNANCHORED for m in mods):
                parts.append(_values(name, value, mods))
        return _better(parts)
    if isinstance(selection, list):
        return _any_of([_selection(x) if isinstance(x, dict) else _values("", str(x), []) for x in selection])
    return _values("", str(selection), [])


def anchors(rule: Rule) -> Anchors:
    """Literals without one of which no condition of a rule can hold."""
    of = rule.selections

    def node(tree: conditions.Node) -> Anchors:
        kind, *rest = tree
        if kind == "sel":
            return _selection(of[rest[0]])
        if kind == "not":
            return None
        parts = [_selection(of[n]) for n in rest[0]] if kind in ("any", "all") else [node(n) for n in rest[0]]
        return _better(parts) if kind in ("all", "and") else _any_of(parts)

    return _any_of([node(conditions.parse(c, list(of))) for c in rule.conditions])


def _grams(literal: str) -> list[str]:
    return [literal[i : i + GRAM] for i in range(len(literal) - GRAM + 1)]


class LiteralIndex:
    """Which rules of a library are known by which characters, and where in an event these are looked for."""

    def __init__(self, library: scan.Library) -> None:
        found = {k: a for k, r in library.rules.items() if library.routes[k].pairs and (a := anchors(r))}
        self.library, self.rules = library, list(found)
        common = Counter(g for a in found.values() for g in {g for _, x in a for g in _grams(x)})
        self.grams = {k: sorted({min(_grams(x), key=lambda g: (common[g], g)) for _, x in a}) for k, a in found.items()}
        self.fields = sorted({name for a in found.values() for name, _ in a})
        self.rest = library.without(set(found))

    def text(self, fields: Fields) -> Column:
        """The text that anchors are looked for in, in lower case: the fields that they are of, or all values if some are keywords."""
        from ..plans.compile import Compiler

        compiler = Compiler(fields)
        if "" in self.fields:
            parts = [compiler._blob()] if fields.document is None else [compiler._blob(), *(compiler._text(fields(n)) for n in self.fields if n)]
        else:
            parts = [f"array_join({a.sql}, '\\n')" if a.array else compiler._text(a) for a in map(fields, self.fields)]
        return F.lower(F.concat_ws("\n", *[F.expr(p) for p in parts]))

    def table(self, spark: SparkSession) -> DataFrame:
        """__gram, __rule (a number), __earlier (grams under which the rule is found first), __pairs (its routes): a row for each anchor, and one for all rules without."""
        rows = [(g, n, grams[:i], [(c, e) for c, e in self.library.routes[k].pairs]) for n, k in enumerate(self.rules) for grams in [self.grams[k]] for i, g in enumerate(grams)]
        if any(r.pairs for r in self.rest.routes.values()):
            rows.append(("", -1, [], []))
        return spark.createDataFrame(rows, "__gram string, __rule int, __earlier array<string>, __pairs array<struct<channel: string, eid: int>>")


def _chosen(tests: list[tuple[str, str]], fan: int = 12) -> Column:
    """The id of the rule whose number is in `__rule`, if its test holds: a tree of choices by ranges of numbers, so that few are looked at."""

    def choose(lo: int, hi: int) -> str:
        if hi - lo == 1:
            test, key = tests[lo]
            return f"CASE WHEN {test} THEN {SPARK.text(key)} END"
        step = 1
        while step * fan < hi - lo:
            step *= fan
        return "CASE " + " ".join(f"WHEN __rule < {min(i + step, hi)} THEN {choose(i, min(i + step, hi))}" for i in range(lo, hi, step)) + " END"

    return F.expr(choose(0, len(tests)))  # as text, which is parsed at once


def hits(events: DataFrame, library: scan.Library, keep: list[str] | None = None, fields: Fields | None = None) -> DataFrame:
    """As scan.hits gives them: rule_id and the columns `keep` of events, a row for each rule that an event matches."""
    spark = events.sparkSession
    register(spark)
    keep, fields = events.columns if keep is None else keep, fields or Fields(events.schema)
    resolve: Callable[[str], str] = lambda n: fields(n).sql
    index = LiteralIndex(library)
    if not index.rules:
        return scan.hits(events, library, keep, resolve)
    texts, shared = scan.ready({k: library.predicates[k] for k in index.rules}, library.shared)
    tests = [(scan.guarded(texts[k], library.routes[k], resolve), k) for k in index.rules]
    asked = scan.routed(index.rest, resolve) if any(r.pairs for r in index.rest.routes.values()) else scan.Routed({}, F.lit(False), F.array().cast("array<string>"))
    keys = scan.keyed(scan._pruned(events, library)).withColumns({"__text": index.text(fields)} | shared | asked.columns)
    runs = F.array_distinct(F.regexp_extract_all("__text", F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))
    found = keys.withColumn("__gram", F.explode(F.when(asked.covered, F.array_append(runs, F.lit(""))).otherwise(runs)))
    near = found.join(F.broadcast(index.table(spark)), "__gram")  # broadcast: a library's literals
    for_it = F.exists("__pairs", lambda p: F.when(p["channel"] == rt.ANY, ~F.col("__channel").isin(*rt.NOT_WINDOWS)).otherwise((p["channel"] == F.col("__channel")) & F.coalesce(p["eid"] == F.col("__eid"), F.lit(True))))
    first = ~F.exists("__earlier", lambda g: F.contains(F.col("__text"), g))
    near = near.filter((F.col("__rule") < 0) | (for_it & first))
    matching = F.when(F.col("__rule") < 0, asked.matching).otherwise(F.array_compact(F.array(_chosen(tests))))
    return near.select(*keep, F.explode(matching).alias("rule_id"))
