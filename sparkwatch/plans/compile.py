"""Rules as predicates: SQL expressions that Catalyst plans, or the oracle's engine runs.

A missing field makes a leaf NULL, which a filter treats as false and AND and OR carry along as such; only where a rule
negates is NULL made false first, so that `not` of it is true. Leaves stay bare, so filters reach the files' statistics.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals as lit
from ..functions.dialect import DUCKDB, SPARK, Fields, Operand
from ..functions.regex import to_java, valid_in_java
from ..model import Rule, UnsupportedRule
from . import conditions

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _and(parts: list[str]) -> str:
    return "(" + " AND ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "TRUE"


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "FALSE"


def _not(sql: str) -> str:
    return f"(NOT coalesce({sql}, FALSE))"


class Compiler:
    """Compiles selections over `fields`. With `shared`, texts in lower case become names there, for the caller to compute once."""

    def __init__(self, fields: Fields, shared: dict[str, str] | None = None) -> None:
        self.fields, self.d, self.shared = fields, fields.dialect, shared

    # leaves

    def _text(self, a: Operand) -> str:
        return a.sql if a.kind in ("text", "null") else f"cast({a.sql} as {'string' if self.d.spark else 'varchar'})"

    def _number(self, a: Operand) -> str:
        if a.kind == "number":
            return f"cast({a.sql} as double)"
        s = f"trim({self._text(a)})"
        hexed = f"cast(conv(substring({s}, 3), 16, 10) as double)" if self.d.spark else f"try_cast(try_cast({s} as bigint) as double)"
        return f"(CASE WHEN {self.d.matches(s, _NUMBER)} THEN try_cast({s} as double) WHEN {self.d.matches(s, '^0[xX][0-9a-fA-F]{1,15}$')} THEN {hexed} END)"

    def _lower(self, a: str) -> str:
        sql = f"lower({a})"
        if self.shared is None or a == "x":  # x: an element of an array
            return sql
        for alias, known in self.shared.items():
            if known == sql:
                return alias
        self.shared[f"__lower_{len(self.shared)}_"] = sql
        return f"__lower_{len(self.shared) - 1}_"

    def _words(self, a: str, values: list[str], how: str, cased: bool) -> str:
        """Any of the values, as equality, prefix, suffix or substring of text `a`."""
        s = a if cased else self._lower(a)
        fold = (lambda v: v) if cased else str.lower
        wild = [v for v in values if lit.has_wildcard(v)]
        flat = list(dict.fromkeys(fold(lit.plain(v)) for v in values if not lit.has_wildcard(v)))
        parts = []
        if flat and how == "eq":
            parts.append(f"{s} IN ({', '.join(map(self.d.text, flat))})")
        elif flat:
            parts += [{"contains": self.d.contains, "startswith": self.d.starts, "endswith": self.d.ends}[how](s, v) for v in flat]
        flags = "" if cased else "iu" if self.d.spark else "i"
        for v in wild:
            body = lit.pattern(v)
            body = {"eq": f"^{body}\\z", "startswith": f"^{body}", "endswith": f"{body}\\z", "contains": body}[how]
            parts.append(self.d.matches(a, f"(?s{flags}){body}"))
        return _or(parts)

    def _cidr(self, a: str, network: str) -> str:
        try:
            net = ipaddress.ip_network(network, strict=False)
        except ValueError as e:
            raise UnsupportedRule(f"not a network: {network}") from e
        if net.version == 6:
            if not self.d.spark:
                raise UnsupportedRule("IPv6 networks need Spark")
            return f"in_ipv6_network({a}, {self.d.text(str(net))})"
        octet = lambda i: f"try_cast(split_part({a}, '.', {i}) as bigint)"
        value = f"({octet(1)} * 16777216 + {octet(2)} * 65536 + {octet(3)} * 256 + {octet(4)})"
        size = 2 ** (32 - net.prefixlen)
        shape = self.d.matches(a, r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
        lo = int(net.network_address)
        return _and([shape, *(f"{octet(i)} <= 255" for i in range(1, 5)), f"{value} BETWEEN {lo} AND {lo + size - 1}"])

    def _regex(self, a: str, pattern: str, flags: str) -> str:
        try:
            java = to_java(pattern, flags)
        except re.error as e:
            raise UnsupportedRule(f"not a pattern: {pattern!r}") from e
        session = SparkSession.getActiveSession() if self.d.spark else None
        if session is not None and not valid_in_java(session, java):
            raise UnsupportedRule(f"not a pattern for Java: {pattern!r}")
        return self.d.matches(a, java if self.d.spark else (f"(?{flags}){pattern}" if flags else pattern))

    def _value(self, value: Any, mods: list[str]) -> Callable[[Operand], str]:
        """The predicate of one value on one (not multi-valued) operand."""
        d = self.d
        encodings = [m for m in mods if m in lit.ENCODING]
        how = next((m for m in lit.STRING if m in mods), "eq")
        flags = "".join(f for f in "ims" if f in mods)
        if "re" in mods:
            return lambda a: self._regex(self._text(a), str(value), flags)
        if value is None:
            return lambda a: f"({a.sql} IS NULL)" if a.kind in ("number", "boolean") else f"({a.sql} IS NULL OR {a.sql} = '')"
        if "cidr" in mods:
            return lambda a: self._cidr(self._text(a), str(value))
        if compare := next((m for m in mods if m in lit.COMPARE), None):
            sign = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}[compare]
            try:
                bound = float(value) if not isinstance(value, str) else float(int(value, 0)) if re.fullmatch(r"0[xXbBoO]\w+", value) else float(value)
            except (TypeError, ValueError):
                return lambda a: "FALSE"
            return lambda a: f"{self._number(a)} {sign} {bound!r}"
        if isinstance(value, bool):
            return lambda a: f"{a.sql} = {str(value).upper()}" if a.kind == "boolean" else f"lower({self._text(a)}) IN ('{str(value).lower()}', '{int(value)}')"
        if isinstance(value, (int, float)) and how == "eq" and not encodings:
            return lambda a: f"{a.sql} = {value!r}" if a.kind == "number" else f"trim({self._text(a)}) = {d.text(str(value))}" if a.kind != "boolean" else f"cast({a.sql} as int) = {value!r}"
        values = lit.expand(str(value), encodings) if encodings else [str(value)]
        return lambda a: self._words(self._text(a), values, how, "cased" in mods)

    def _checks(self, values: list[Any], mods: list[str]) -> list[Callable[[Operand], str]]:
        """A predicate for each value, or one for all plain texts of an OR list."""
        simple = [v for v in values if isinstance(v, str)]
        apart = "all" in mods or "re" in mods or "cidr" in mods or any(m in lit.COMPARE for m in mods)
        if apart or len(simple) < 2:
            return [self._value(v, mods) for v in values]
        encodings = [m for m in mods if m in lit.ENCODING]
        how = next((m for m in lit.STRING if m in mods), "eq")
        every = [x for v in simple for x in (lit.expand(v, encodings) if encodings else [v])]
        grouped = lambda a: self._words(self._text(a), every, how, "cased" in mods)
        return [grouped, *(self._value(v, mods) for v in values if not isinstance(v, str))]

    # selections

    def field(self, key: str, value: Any) -> str:
        name, *mods = key.split("|")
        for m in mods:
            if m not in lit.KNOWN:
                raise UnsupportedRule(f"modifier {m!r}")
        a = self.fields(name)
        values = value if isinstance(value, list) else [value]
        values = values or [None]
        if "exists" in mods:
            return f"({a.sql} IS {'NOT ' if values[0] else ''}NULL)"
        if "fieldref" in mods:
            refs = [self.fields(str(v)) for v in values]
            parts = [f"lower({self._text(a)}) = lower(coalesce({self._text(r)}, 'none'))" for r in refs]
            return _and(parts) if "all" in mods else _or(parts)
        checks = self._checks(values, mods)
        if a.array:
            empty = f"({a.sql} IS NULL OR {self.d.size(a.sql)} = 0)"
            missing = Operand("cast(null as string)" if self.d.spark else "cast(null as varchar)", "null")
            parts = [f"CASE WHEN {empty} THEN {c(missing)} ELSE {self.d.any_of(a.sql, c(a.each()))} END" for c in checks]
        else:
            parts = [c(a) for c in checks]
        sql = _and(parts) if "all" in mods else _or(parts)
        return _not(sql) if "neq" in mods else sql

    def _blob(self) -> str:
        """All values of an event as one text, a line each; of a document only its values, without the columns around it."""
        sep = "'\\n'" if self.d.spark else "chr(10)"
        if self.fields.document:
            return self.fields.values(sep)
        parts = []
        for a in self.fields.leaves():
            if a.array:
                parts.append(f"array_join({a.sql}, '\\n')" if self.d.spark else f"array_to_string({a.sql}, chr(10))")
            else:
                parts.append(self._text(a))
        return f"concat_ws({sep}, {', '.join(parts)})" if parts else self.d.text("")

    def keyword(self, value: Any, mods: list[str] | None = None) -> str:
        """A word anywhere among an event's values, in any case."""
        encodings = [m for m in mods or [] if m in lit.ENCODING]
        values = lit.expand(str(value), encodings) if encodings else [str(value)]
        return self._words(self._blob(), values, "contains", False)

    def _map(self, selection: dict[str, Any]) -> str:
        if not selection:
            raise UnsupportedRule("an empty selection")
        parts = []
        for key, value in selection.items():
            if key.startswith("|"):
                words = [self.keyword(v, key.split("|")) for v in (value if isinstance(value, list) else [value])]
                parts.append(_and(words) if "all" in key.split("|") else _or(words))
            else:
                parts.append(self.field(key, value))
        return _and(parts)

    def selection(self, selection: Any) -> str:
        if isinstance(selection, dict):
            return self._map(selection)
        if isinstance(selection, list):
            if not selection:
                raise UnsupportedRule("an empty selection")
            return _or([self._map(x) if isinstance(x, dict) else self.keyword(x) for x in selection])
        return self.keyword(selection)

    # conditions

    def _node(self, node: conditions.Node, of: dict[str, str]) -> str:
        kind, *rest = node
        if kind == "sel":
            return of[rest[0]]
        if kind == "not":
            return _not(self._node(rest[0], of))
        if kind in ("any", "all"):
            parts = [of[n] for n in rest[0]]
        else:
            parts = [self._node(n, of) for n in rest[0]]
        return _and(parts) if kind in ("all", "and") else _or(parts)

    def rule(self, rule: Rule) -> str:
        names = rule.selections
        trees = [conditions.parse(c, list(names)) for c in rule.conditions]
        if not trees:
            raise UnsupportedRule("no condition")
        of = {n: self.selection(names[n]) for n in {x for t in trees for x in conditions.selections(t)}}
        return _or([self._node(t, of) for t in trees])


def rule_sql(rule: Rule, schema, dialect: str = "spark", **fields: Any) -> str:  # type: ignore[no-untyped-def]
    """A rule as a WHERE clause in the dialect `spark` or `duckdb`."""
    return Compiler(Fields(schema, SPARK if dialect == "spark" else DUCKDB, **fields)).rule(rule)


def rule_column(df: DataFrame, rule: Rule, **fields: Any) -> Column:
    """A rule as a predicate over df, for filters (NULL counts as false)."""
    from ..functions.network import register

    register(df.sparkSession)
    return F.expr(rule_sql(rule, df.schema, **fields))


def hit_column(df: DataFrame, rule: Rule, **fields: Any) -> Column:
    """A rule as a boolean that is never NULL."""
    return F.coalesce(rule_column(df, rule, **fields), F.lit(False))


def selection_column(df: DataFrame, selection: Any, **fields: Any) -> Column:
    """One selection (a map, a list or a keyword) as a predicate over df."""
    return rule_column(df, Rule(detection={"s": selection, "condition": "s"}), **fields)


def run(df: DataFrame, rule: Rule, index: str = "event_idx", **fields: Any) -> DataFrame:
    """Indices of the events that a rule matches."""
    return df.filter(rule_column(df, rule, **fields)).select(index)


# what can be told before a rule runs


def walk(selection: Any) -> list[tuple[str, Any]]:
    """(key, value) pairs of a selection; keywords have an empty key."""
    if isinstance(selection, dict):
        return [("" if k.startswith("|") else k, v) for k, v in selection.items()]
    if isinstance(selection, list):
        return [p for x in selection for p in walk(x)]
    return [("", selection)]


def rule_fields(rule: Rule) -> set[str]:
    """Fields that a rule reads, those it refers to included."""
    out: set[str] = set()
    for s in rule.selections.values():
        for key, value in walk(s):
            if key:
                name, *mods = key.split("|")
                out.add(name)
                if "fieldref" in mods:
                    out |= {str(v) for v in (value if isinstance(value, list) else [value])}
    return out


def _ids_of(selection: Any) -> set[int] | None:
    """EventIDs that a selection requires; None if it holds for any."""
    if isinstance(selection, dict):
        found: set[int] | None = None
        for key, value in selection.items():
            if key == "EventID":
                try:
                    ids = {int(v) for v in (value if isinstance(value, list) else [value])}
                except (TypeError, ValueError):
                    continue
                found = ids if found is None else found & ids
        return found
    if isinstance(selection, list) and selection and all(isinstance(x, dict) for x in selection):
        parts = [_ids_of(x) for x in selection]
        return None if any(p is None for p in parts) else set().union(*parts)  # type: ignore[arg-type]
    return None


def required_event_ids(rule: Rule) -> set[int] | None:
    """EventIDs without which no condition can hold; None if there are none to name. Along `and` they meet, along `or` they add up."""

    def of(node: conditions.Node) -> set[int] | None:
        kind, *rest = node
        if kind == "sel":
            return _ids_of(rule.selections[rest[0]])
        if kind == "not":
            return None
        parts = [_ids_of(rule.selections[n]) for n in rest[0]] if kind in ("any", "all") else [of(n) for n in rest[0]]
        if kind in ("and", "all"):
            known = [p for p in parts if p is not None]
            return set.intersection(*known) if known else None
        return None if not parts or any(p is None for p in parts) else set().union(*parts)  # type: ignore[arg-type]

    whole = [of(conditions.parse(c, list(rule.selections))) for c in rule.conditions]
    return None if not whole or any(w is None for w in whole) else set().union(*whole)  # type: ignore[arg-type]
