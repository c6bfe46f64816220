"""A JSON schema as one column: all errors of a document, with their paths, told in one pass.

The schema (type, enum, minimum, maximum, required, properties, items) is compiled into nested array functions over
VARIANT values, so nothing runs row by row. A document that is no JSON is an error of its own; a null one too.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Spark calls the kinds of JSON values.
KINDS = {"string": "string", "boolean": "boolean", "integer": "integer", "number": "(?:integer|number)", "array": "array", "object": "object"}
NONE = "array<string>"


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kind_of(value: Column) -> Column:
    """string, boolean, integer, number, array, object or null, of a VARIANT value."""
    # the schema of what has parts would describe all of them
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "null")
        .when(is_object(value), "object")
        .when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array")
        .when(name == "VOID", "null")
        .when(name == "BIGINT", "integer")
        .when(F.startswith(name, F.lit("DECIMAL(")) & name.rlike(r",\s*0\)$") & ~value.cast("string").contains("."), "integer")
        .when(name.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), "number")
        .otherwise(F.lower(name))
    )


def _said(path: Column, *parts: Column | str) -> Column:
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.when(path == "", text).otherwise(F.concat(path, F.lit(": "), text))


def _below(path: Column, key: str) -> Column:
    return F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit("." + key)))


def _literal(value: Any) -> str:
    return "true" if value is True else "false" if value is False else "null" if value is None else str(value)


def _errors(value: Column, schema: dict[str, Any], path: Column, depth: int) -> Column:
    """Errors of a value that is there; ``depth`` names the lambdas' arguments apart."""
    wanted = schema.get("type")
    none = F.array().cast(NONE)
    if wanted is None:
        return none
    return bound(value, lambda v: bound(kind_of(v), lambda kind: _errors_of(v, kind, schema, path, depth)))


def _errors_of(value: Column, kind: Column, schema: dict[str, Any], path: Column, depth: int) -> Column:
    """The same of a value of a known kind."""
    wanted, none = schema["type"], F.array().cast(NONE)
    right = kind.rlike(f"^{KINDS[wanted]}$")
    wrong = F.array(_said(path, f"expected {wanted}, got ", kind))
    found: list[Column] = []
    if "enum" in schema:
        of_kind = {"string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool)}.get(wanted, lambda x: isinstance(x, int | float) and not isinstance(x, bool))
        allowed = [_literal(x) for x in schema["enum"] if of_kind(x)]
        held = F.coalesce(value.cast("string").isin(allowed) if allowed else F.lit(False), F.lit(False))
        found.append(F.when(~held, F.array(_said(path, "value ", value.cast("string"), f" not in enum [{', '.join(map(_literal, schema['enum']))}]"))))
    if wanted in ("integer", "number"):
        for name, sign in (("minimum", "<"), ("maximum", ">")):
            if name in schema:
                number, bound = F.try_variant_get(value, "$", "double"), schema[name]
                passed = number < bound if sign == "<" else number > bound
                found.append(F.when(passed, F.array(_said(path, "value ", value.cast("string"), f" {sign} {name} {bound}"))))
    if wanted == "object":
        fields = {k: F.try_variant_get(value, f"$['{k}']", "variant") for k in {**schema.get("properties", {}), **dict.fromkeys(schema.get("required", []))}}
        there = {k: v.isNotNull() for k, v in fields.items()}  # one that holds JSON's null is there
        found += [F.when(~there[k], F.array(_said(path, f"missing required field '{k}'"))) for k in schema.get("required", [])]
        found += [F.when(there[k], _errors(fields[k], part, _below(path, k), depth)) for k, part in schema.get("properties", {}).items()]
    if wanted == "array" and "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")

        def each(item: Column, at: Column) -> Column:
            return _errors(item, schema["items"], F.concat(path, F.lit("["), at.cast("string"), F.lit("]")), depth + 1)

        found.append(F.flatten(F.transform(items, each)))
    told = F.flatten(F.array_compact(F.array(none, *(f.cast(NONE) for f in found))))
    return F.when(right, told).otherwise(wrong)


def schema_errors(document: Column, schema: dict[str, Any]) -> Column:
    """All errors (array of text, empty for a valid document) of a JSON text."""
    value = F.try_parse_json(document)
    return F.when(value.isNull(), F.array(F.lit("no JSON document"))).otherwise(_errors(value, schema, F.lit(""), 0))
