"""Prompt templates, rendered as column expressions."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


class TemplateError(ValueError):
    """A template that cannot be rendered from columns."""


@dataclass(frozen=True)
class PromptTemplate:
    """Literal parts and column names in turn: ``parts[k]`` stands before ``fields[k]``."""

    parts: tuple[str, ...]
    fields: tuple[str, ...]

    @classmethod
    def parse(cls, source: str) -> PromptTemplate:
        """Parse ``{column}`` placeholders; doubled braces are braces."""
        parts, fields, text = [], [], ""
        for literal, name, spec, conversion in string.Formatter().parse(source):
            text += literal
            if name is None:
                continue
            if not name or spec or conversion or not name.replace("_", "a").replace("-", "a").isalnum():
                raise TemplateError(f"placeholder {{{name}}} must be a plain column name without a format")
            parts.append(text)
            fields.append(name)
            text = ""
        return cls((*parts, text), tuple(fields))

    @property
    def names(self) -> list[str]:
        """Distinct columns in order of use."""
        return list(dict.fromkeys(self.fields))

    @property
    def prefix(self) -> str:
        """Text before the first placeholder, the same in every prompt."""
        return self.parts[0]

    def swapped(self, fields: dict[str, str]) -> PromptTemplate:
        """The template with columns named otherwise."""
        return PromptTemplate(self.parts, tuple(fields.get(f, f) for f in self.fields))

    def check(self, df: DataFrame) -> None:
        for name in self.names:
            if name not in df.columns:
                raise TemplateError(f"template column {name!r} is not among {df.columns}")

    def column(self, df: DataFrame) -> Column:
        """The rendered prompt."""
        self.check(df)
        pieces: list[Column] = []
        for text, name in zip(self.parts, (*self.fields, None)):
            if text:
                pieces.append(F.lit(text))
            if name is not None:
                pieces.append(as_text(F.col(f"`{name}`"), df.schema[name].dataType))
        return F.concat(*pieces) if pieces else F.lit("")


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as Python writes it: null is None, booleans are capitalised."""
    if isinstance(kind, (T.StringType, T.IntegralType)):
        text = c.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float_text(c.cast("double"))
    elif isinstance(kind, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = c.cast("string")
    else:
        raise TemplateError(f"columns of type {kind.simpleString()} cannot stand in a prompt")
    return F.coalesce(text, F.lit("None"))


def _float_text(c: Column) -> Column:
    """Shortest text of a double. From 1e-4 up to 1e16 it is written in full, else with an exponent of two digits at least."""
    java = c.cast("string")
    mantissa, exponent = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", ""), F.substring_index(java, "E", -1).cast("int")
    wide = (F.abs(c) >= 1e16) | (F.abs(c) < 1e-4)
    power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    digits, sign = F.regexp_replace(mantissa, r"[-.]", ""), F.when(c < 0, "-").otherwise("")
    places = F.length(digits) - 1 - exponent
    plain = F.when(exponent < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).when(places > 0, F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))).otherwise(F.concat(sign, digits, F.repeat(F.lit("0"), -places), F.lit(".0")))
    finite = F.when(~java.contains("E"), java).when(wide, power).otherwise(plain)
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(finite)


def messages(prompt: Column, system: str | None = None) -> Column:
    """A user message, after a system message if there is one."""
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    if system is None:
        return F.array(user).cast(MESSAGES)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user).cast(MESSAGES)
