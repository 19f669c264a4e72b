"""What a rule's literals stand for: wildcards, and encodings that are expanded before anything runs."""

from __future__ import annotations

import base64
import re

# Modifiers of the rule format, and the dashes that windash tries.
STRING = ("contains", "startswith", "endswith")
ENCODING = ("windash", "wide", "utf16le", "utf16be", "utf16", "base64", "base64offset")
COMPARE = ("lt", "lte", "gt", "gte")
OTHER = ("re", "i", "m", "s", "all", "exists", "cased", "cidr", "fieldref", "neq")
KNOWN = (*STRING, *ENCODING, *COMPARE, *OTHER)
DASHES = ("-", "/", "\u2013", "\u2014", "\u2015")

_TOKEN = re.compile(r"\\[\\*?]|[*?]|\\|[^\\*?]+")


def tokens(value: str) -> list[tuple[str, bool]]:
    """A value as (text, is wildcard) parts. A backslash escapes a wildcard or a backslash, and else stands for itself."""
    out: list[tuple[str, bool]] = []
    for part in _TOKEN.findall(value):
        wild = part in ("*", "?")
        text = part[1:] if len(part) == 2 and part[0] == "\\" and part[1] in "\\*?" else part
        if out and not wild and not out[-1][1]:
            out[-1] = (out[-1][0] + text, False)
        else:
            out.append((text, wild))
    return out


def has_wildcard(value: str) -> bool:
    return any(wild for _, wild in tokens(value))


def plain(value: str) -> str:
    return "".join(text for text, _ in tokens(value))


def pattern(value: str) -> str:
    """The body of a regular expression (common to Java and RE2) for a value with wildcards."""
    return "".join({"*": ".*", "?": "."}[t] if wild else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t, wild in tokens(value))


def _dashes(value: str) -> list[str]:
    return list(dict.fromkeys([value, *(re.sub(r"(^|(?<=\s))[-/]", lambda m, d=d: d, value) for d in DASHES)]))


def _encoded(value: str, how: str) -> list[str]:
    if how == "windash":
        return _dashes(value)
    if how in ("wide", "utf16le", "utf16be", "utf16"):
        code = {"wide": "utf-16-le", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "utf16": "utf-16"}[how]
        return [value.encode(code).decode("latin-1")]
    data = value.encode("latin-1", "replace") if any(ord(c) > 255 for c in value) else value.encode("latin-1")
    if how == "base64":
        return [base64.b64encode(data).decode()]
    shifted = []
    for shift in range(3):  # the characters that depend on what stands before or behind are cut off
        text = base64.b64encode(b"\0" * shift + data).decode()
        whole = (shift + len(data)) * 8 // 6
        shifted.append(text[-(-shift * 8 // 6) : whole])
    return shifted


def expand(value: str, encodings: list[str]) -> list[str]:
    """Applies encodings left to right; each may give several variants, of which any may match."""
    values = [value]
    for how in encodings:
        values = [v for x in values for v in _encoded(x, how)]
    return values
