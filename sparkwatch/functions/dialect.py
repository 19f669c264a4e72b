"""The few spellings in which Spark SQL and the oracle's SQL differ, so that one compiler serves both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Dialect:
    name: str  # spark or duckdb

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def text(self, value: str) -> str:
        if not self.spark:
            return "'" + value.replace("'", "''") + "'"
        return "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\0": "\\u0000", "\x1a": "\\u001A"}.get(c, c) for c in value) + "'"

    def name_of(self, column: str) -> str:
        return f"`{column.replace('`', '``')}`" if self.spark else '"' + column.replace('"', '""') + '"'

    def starts(self, a: str, value: str) -> str:
        return f"{'startswith' if self.spark else 'starts_with'}({a}, {self.text(value)})"

    def ends(self, a: str, value: str) -> str:
        return f"{'endswith' if self.spark else 'ends_with'}({a}, {self.text(value)})"

    def contains(self, a: str, value: str) -> str:
        return f"contains({a}, {self.text(value)})"

    def matches(self, a: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({a}, {self.text(pattern)})"

    def any_of(self, array: str, body: str) -> str:
        return f"exists({array}, x -> {body})" if self.spark else f"len(list_filter({array}, lambda x: {body})) > 0"

    def size(self, array: str) -> str:
        return f"{'size' if self.spark else 'len'}({array})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


@dataclass(frozen=True)
class Operand:
    """A field as SQL: its text and whether it is text, number, boolean, an array of one of these, or missing."""

    sql: str
    kind: str
    array: bool = False

    def each(self) -> Operand:
        return Operand("x", self.kind)


def _kind(t: T.DataType) -> str:
    return "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "null" if isinstance(t, T.NullType) else "text"


class Fields:
    """Resolves a rule's field names over a schema.

    An exact column name wins, then a path through structs, then a key of the map, JSON or VARIANT column `document` (the
    exact key before the dotted path). A field that is nowhere is NULL, not an error. `renames` maps rule names to columns.
    """

    def __init__(self, schema: T.StructType, dialect: Dialect = SPARK, document: str | None = None, renames: dict[str, str] | None = None, types: dict[str, str] | None = None) -> None:
        self.schema, self.dialect, self.document, self.renames, self.types = schema, dialect, document, renames or {}, types or {}

    def _typed(self, sql: str, t: T.DataType) -> Operand:
        return Operand(sql, _kind(t.elementType), True) if isinstance(t, T.ArrayType) else Operand(sql, _kind(t))

    def __call__(self, name: str) -> Operand:
        name = self.renames.get(name, name)
        q = self.dialect.name_of
        if name in self.schema.names:
            return self._typed(q(name), self.schema[name].dataType)
        head, *rest = name.split(".")
        if rest and head in self.schema.names:
            sql, t = q(head), self.schema[head].dataType
            for part in rest:
                if not isinstance(t, T.StructType) or part not in t.names:
                    break
                sql, t = f"{sql}.{q(part)}", t[part].dataType
            else:
                return self._typed(sql, t)
        if self.document:
            if isinstance(self.schema[self.document].dataType, T.MapType):
                at = lambda k: f"try_element_at({q(self.document)}, {self.dialect.text(k)})"
                deep = f"get_json_object({at(head)}, {self.dialect.text('$.' + '.'.join(rest))})"
                return Operand(f"coalesce({at(name)}, {deep})" if rest else at(name), self.types.get(name, "text"))
            doc, exact, path = q(self.document), f"$['{name}']" if self.dialect.spark else f'$."{name}"', "$." + name
            get = f"try_variant_get({doc}, %s, 'string')" if isinstance(self.schema[self.document].dataType, T.VariantType) else f"{'get_json_object' if self.dialect.spark else 'json_extract_string'}({doc}, %s)"
            one = get % self.dialect.text(exact)
            return Operand(f"coalesce({one}, {get % self.dialect.text(path)})" if "." in name else one, self.types.get(name, "text"))
        return Operand("cast(null as string)" if self.dialect.spark else "cast(null as varchar)", "null")

    def values(self, separator: str) -> str:
        """All values of the document as one text, nested ones too; its keys are not among them.

        Of a JSON text the tokens are found, those that a colon follows left out, and the rest read again as an array,
        which takes escapes out of them. Nulls are no values.
        """
        d, doc, t = self.dialect, self.dialect.name_of(self.document), self.schema[self.document].dataType
        token = r'"(?:[^"\\]|\\.)*"\s*:?|-?[0-9][0-9.eE+-]*|true|false'
        if not d.spark:
            tokens = f"list_filter(regexp_extract_all({doc}, {d.text(token)}), lambda t: NOT ends_with(t, ':'))"
            return f"array_to_string(json_extract_string('[' || array_to_string({tokens}, ',') || ']', '$[*]'), {separator})"

        def leaves(json: str) -> str:
            tokens = f"filter(regexp_extract_all({json}, {d.text(token)}, 0), t -> NOT endswith(t, ':'))"
            return f"array_join(from_json(concat('[', array_join({tokens}, ','), ']'), 'array<string>'), {separator})"

        if isinstance(t, T.MapType):
            nested = "startswith(v, '{') OR startswith(v, '[')"
            return f"array_join(transform(map_values({doc}), v -> CASE WHEN {nested} THEN coalesce({leaves('v')}, v) ELSE v END), {separator})"
        return leaves(f"to_json({doc})" if isinstance(t, T.VariantType) else doc)

    def leaves(self) -> list[Operand]:
        """Every value of an event, for keywords; columns whose names start with two underscores are helpers."""
        out: list[Operand] = []

        def walk(sql: str, t: T.DataType) -> None:
            if isinstance(t, T.StructType):
                for f in t.fields:
                    walk(f"{sql}.{self.dialect.name_of(f.name)}", f.dataType)
            else:
                out.append(self._typed(sql, t))

        for f in self.schema.fields:
            if not f.name.startswith("__"):
                walk(self.dialect.name_of(f.name), f.dataType)
        return out
