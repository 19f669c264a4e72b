"""Regular expressions written for Python, for Java's engine."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_GROUP = re.compile(r"\(\?P<(\w+)>")
_BACK = re.compile(r"\(\?P=(\w+)\)")
_FLAGS = re.compile(r"^\(\?([aiLmsux]+)\)")


def to_java(pattern: str, flags: str = "") -> str:
    """The same pattern for Java: Unicode classes and case folding, `.` stops only at a line feed, names without P, \\Z as \\z.

    Raises re.error for what Python itself rejects.
    """
    re.compile(pattern)
    own = ""
    if m := _FLAGS.match(pattern):
        own, pattern = m[1].replace("a", "").replace("L", "").replace("u", ""), pattern[m.end() :]
    out, inside, i = [], False, 0
    pattern = _BACK.sub(r"\\k<\1>", _GROUP.sub(r"(?<\1>", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\z" if pattern[i + 1] == "Z" and not inside else pattern[i : i + 2])
            i += 2
            continue
        if inside and c == "[" or inside and pattern.startswith("&&", i):
            out.append("\\" + c)
        else:
            out.append(c)
        if not inside and c == "[":
            inside = True
            for lead in ("^", "]"):  # a bracket that comes first in a class is itself
                if pattern.startswith(lead, i + 1):
                    i += 1
                    out.append("\\]" if lead == "]" else lead)
        elif inside and c == "]":
            inside = False
        i += 1
    return f"(?{''.join(dict.fromkeys('dU' + ('u' if 'i' in own + flags else '') + own + flags))})" + "".join(out)


def valid_in_java(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  py4j wraps PatternSyntaxException
        return False
    return True
