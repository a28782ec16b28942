"""JSON Schemas: Spark types and the rewrites that providers ask for."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def as_schema(schema: dict | str | None) -> dict | None:
    """A schema given as mapping or as JSON text of one."""
    if isinstance(schema, str):
        schema = json.loads(schema)
    if schema is not None and not isinstance(schema, dict):
        raise TypeError("an output schema must be a JSON object")
    return schema


def spark_type(schema: dict) -> T.DataType:
    """Spark type of a JSON Schema; what has no type of its own stays JSON text."""
    options = [s for s in schema.get("anyOf", schema.get("oneOf", ())) if s.get("type") != "null"]
    if options:
        return spark_type(options[0]) if len(options) == 1 else T.StringType()
    kind = schema.get("type")
    if isinstance(kind, list):
        kinds = [k for k in kind if k != "null"]
        return spark_type({**schema, "type": kinds[0]}) if len(kinds) == 1 else T.StringType()
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items") or {}))
    if kind == "object" and schema.get("properties"):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in schema["properties"].items()])
    return _SIMPLE.get(kind, T.StringType())


def property_fields(schema: dict | None) -> list[T.StructField]:
    """One nullable column for each property at the top."""
    return [T.StructField(k, spark_type(v)) for k, v in ((schema or {}).get("properties") or {}).items()]


def fitted(value: Any, kind: T.DataType) -> Any:
    """A parsed JSON value as the column type takes it; what does not fit becomes null, or JSON text where text is wanted."""
    if value is None:
        return None
    match kind:
        case T.StringType():
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        case T.BooleanType():
            return value if isinstance(value, bool) else None
        case T.LongType():
            whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
            return int(value) if whole and -(2**63) <= value < 2**63 else None
        case T.DoubleType():
            return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        case T.ArrayType():
            return [fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
        case T.StructType():
            return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    return None


def _rewritten(node: Any, change) -> Any:
    """Copy of a schema with ``change`` applied to every mapping, inner ones first."""
    if isinstance(node, dict):
        return change({k: _rewritten(v, change) for k, v in node.items()})
    if isinstance(node, list):
        return [_rewritten(v, change) for v in node]
    return node


def close_objects(schema: dict) -> dict:
    """Every object without a word on further properties forbids them."""

    def close(node: dict) -> dict:
        return {"additionalProperties": False, **node} if node.get("type") == "object" else node

    return _rewritten(schema, close)


def drop_integer_bounds(schema: dict) -> dict:
    """Integers lose their bounds, which some providers reject."""

    def drop(node: dict) -> dict:
        kept = {k: v for k, v in node.items() if k not in ("minimum", "maximum")}
        return kept if node.get("type") == "integer" else node

    return _rewritten(schema, drop)


def inline_definitions(schema: dict) -> dict:
    """Local references replaced by what they name, beside the keys next to them; others stay."""
    definitions = schema.get("$defs", {})

    def inline(node: Any, inside: tuple[str, ...] = ()) -> Any:
        if isinstance(node, list):
            return [inline(v, inside) for v in node]
        if not isinstance(node, dict):
            return node
        name = str(node.get("$ref", "")).removeprefix("#/$defs/")
        if name in definitions and node["$ref"] != name:
            if name in inside:
                raise ValueError(f"definition {name!r} refers to itself")
            beside = {k: inline(v, inside) for k, v in node.items() if k != "$ref"}
            return {**inline(definitions[name], (*inside, name)), **beside}
        return {k: inline(v, inside) for k, v in node.items() if k != "$defs"}

    return inline(schema)
