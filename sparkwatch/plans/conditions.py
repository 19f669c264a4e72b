"""Conditions of rules: `a and not 1 of filter_*` as nested tuples.

A node is ("sel", name), ("not", node), ("and", nodes), ("or", nodes), ("any", names) or ("all", names).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from ..model import UnsupportedRule

Node = tuple
_LEXEME = re.compile(r"\s*(\(|\)|[^\s()|]+|\|)")
_WORDS = ("and", "or", "not", "of", "them")


def _quantified(kind: str, pattern: str, names: list[str]) -> Node:
    if pattern.lower() == "them":
        return (kind, tuple(n for n in names if not n.startswith("_")))
    found = tuple(n for n in names if fnmatch.fnmatchcase(n, pattern))
    if not found:
        raise UnsupportedRule(f"no selection is named like {pattern!r}")
    return (kind, found)


def parse(condition: str, names: list[str]) -> Node:
    """`or` binds weakest, then `and`, then `not`; words in any case, names as written."""
    rest = _LEXEME.findall(condition)
    if not rest or "".join(rest) != "".join(condition.split()):
        raise UnsupportedRule(f"not a condition: {condition!r}")
    if "|" in rest:
        raise UnsupportedRule("aggregations are not supported")
    rest.reverse()

    def word() -> str:
        return rest[-1].lower() if rest else ""

    def chain(joiner: str, part) -> Node:  # type: ignore[no-untyped-def]
        nodes = [part()]
        while word() == joiner:
            rest.pop()
            nodes.append(part())
        return nodes[0] if len(nodes) == 1 else (joiner, tuple(nodes))

    def negation() -> Node:
        if word() == "not":
            rest.pop()
            return ("not", negation())
        return atom()

    def atom() -> Node:
        if not rest:
            raise UnsupportedRule(f"the condition ends too early: {condition!r}")
        t = rest.pop()
        if t == "(":
            node = either()
            if not rest or rest.pop() != ")":
                raise UnsupportedRule(f"a parenthesis is not closed: {condition!r}")
            return node
        if t.lower() in ("1", "any", "all") and word() == "of":
            rest.pop()
            if not rest or rest[-1] in ("(", ")"):
                raise UnsupportedRule(f"`of` needs a pattern: {condition!r}")
            return _quantified("all" if t.lower() == "all" else "any", rest.pop(), names)
        if t == ")" or t.lower() in _WORDS or t not in names:
            raise UnsupportedRule(f"{t!r} is no selection")
        return ("sel", t)

    def both() -> Node:
        return chain("and", negation)

    def either() -> Node:
        return chain("or", both)

    node = either()
    if rest:
        raise UnsupportedRule(f"unexpected {rest[-1]!r} in {condition!r}")
    return node


def selections(node: Node) -> Iterator[str]:
    """Names that a condition refers to."""
    if node[0] == "sel":
        yield node[1]
    elif node[0] in ("any", "all"):
        yield from node[1]
    else:
        for n in node[1] if node[0] in ("and", "or") else node[1:]:
            yield from selections(n)
