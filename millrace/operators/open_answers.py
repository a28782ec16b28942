"""Keys of answers beyond the schema: a VARIANT column, the schema that a table's rows share, typed paths."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a value may be where rows differ.
ANY = "VARIANT"


def plain(value: Any) -> Any:
    """A value that JSON can write: numbers beyond it become text."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def as_variant(text: Column) -> Column:
    """JSON text as a variant; text that is none becomes null."""
    return F.try_parse_json(text)


def shared_schema(df: DataFrame, column: str) -> str:
    """The schema that the rows' variants share, by Spark's aggregate: one text, however many rows there are. ``VOID`` if there are none."""
    return df.agg(F.schema_of_variant_agg(column).alias("s")).first().s or "VOID"


def merged_schemas(schemas: list[str]) -> str:
    """One schema of several, such as those of waves; where two differ the value may be anything."""
    found: Any = None
    for s in schemas:
        found = _merge(found, _parsed(s))
    return _text(found)


def _parsed(schema: str) -> T.DataType:
    return T._parse_datatype_string(schema.replace("OBJECT<", "STRUCT<").replace("VOID", "void"))


def _merge(a: T.DataType | None, b: T.DataType) -> T.DataType:
    if a is None or isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merge(fields.get(f.name), f.dataType)
        return T.StructType([T.StructField(k, v) for k, v in sorted(fields.items())])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    order = [T.LongType, T.DecimalType, T.DoubleType]
    if type(a) in order and type(b) in order:
        return max(a, b, key=lambda t: (order.index(type(t)), getattr(t, "precision", 0)))
    return T.VariantType()


def _text(kind: T.DataType | None) -> str:
    if kind is None or isinstance(kind, T.NullType):
        return "VOID"
    if isinstance(kind, T.StructType):
        return f"OBJECT<{', '.join(f'{f.name}: {_text(f.dataType)}' for f in kind.fields)}>"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_text(kind.elementType)}>"
    return kind.simpleString().upper()


def leaves(schema: str) -> dict[str, str]:
    """Path of every value that is no object, with its type: ``{"$.a.b": "BIGINT"}``."""
    found: dict[str, str] = {}

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}['{f.name}']" if not f.name.isidentifier() else f"{path}.{f.name}")
        else:
            found[path] = _text(kind)

    walk(_parsed(schema), "$")
    return found


def extracted(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns from paths of a variant, ``{name: (path, type)}``; a value of another type is null."""
    return df.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in paths.items()})
