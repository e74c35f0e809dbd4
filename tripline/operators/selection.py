"""Rule fields and selections as Columns."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.functions.text import url_decode
from tripline.rules.model import MatchRule
from tripline.rules.regex import java_pattern

# Rule files may use these names for the event columns.
_ALIASES = {"timestamp": "ts", "id": "event_id"}


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """The column a dotted rule path reads, and its type.

    A step into something that has no such field reads as null.
    """
    first, *rest = path.split(".")
    first = _ALIASES.get(first, first)
    if first not in schema.fieldNames():
        return F.lit(None), T.NullType()
    column, dtype = F.col(first), schema[first].dataType
    for step in rest:
        if isinstance(dtype, T.StructType) and step in dtype.fieldNames():
            column, dtype = column.getField(step), dtype[step].dataType
        elif isinstance(dtype, T.MapType):
            column, dtype = F.try_element_at(column, F.lit(step)), dtype.valueType
        else:
            return F.lit(None), T.NullType()
    return column, dtype


def group_value(column: Column, dtype: T.DataType) -> Column:
    """A form of a field that can be counted distinct (variants cannot)."""
    return F.to_json(column) if isinstance(dtype, T.VariantType) else column


def selection(schema: T.StructType, wanted: dict[str, Any]) -> Column:
    """All of ``path: expected`` hold; never null, true when nothing is asked."""
    condition = F.lit(True)
    for path, expected in wanted.items():
        column, dtype = resolve(schema, path)
        options = expected if isinstance(expected, list) else [expected]
        either = F.lit(False)
        for option in options:
            either = either | _equals(column, dtype, option)
        condition = condition & either
    return condition


def text_of(schema: T.StructType, rule: MatchRule) -> Column:
    """The text a match rule searches; null when the field holds no text."""
    column, dtype = resolve(schema, rule.field)
    if isinstance(dtype, T.VariantType):
        column = F.when(F.schema_of_variant(column) == "STRING", column.cast("string"))
    elif not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    return url_decode(column) if rule.decode == "url" else column


def any_pattern(text: Column, rule: MatchRule) -> Column:
    found = F.lit(False)
    for pattern in rule.patterns:
        found = found | text.rlike(java_pattern(pattern))
    return F.coalesce(found, F.lit(False))


def _equals(column: Column, dtype: T.DataType, literal: Any) -> Column:
    """Equality by value and type: 22 equals 22.0 but not "22"."""
    if literal is None:
        if isinstance(dtype, T.VariantType):
            return F.coalesce(F.is_variant_null(column), F.lit(True))
        return column.isNull()
    if isinstance(dtype, T.VariantType):
        return _variant_equals(column, literal)
    if isinstance(literal, str):
        comparable = isinstance(dtype, T.StringType)
    elif isinstance(literal, bool):
        comparable = isinstance(dtype, (T.BooleanType, T.NumericType))
        literal = literal if isinstance(dtype, T.BooleanType) else int(literal)
    elif isinstance(literal, (int, float)):
        comparable = isinstance(dtype, T.NumericType)
    elif isinstance(literal, datetime):
        comparable = isinstance(dtype, T.TimestampType)
    else:
        comparable = False
    return column.eqNullSafe(F.lit(literal)) if comparable else F.lit(False)


def _variant_equals(column: Column, literal: Any) -> Column:
    kind = F.schema_of_variant(column)
    if isinstance(literal, bool):
        matches = (kind == "BOOLEAN") & (column.cast("string") == str(literal).lower())
    elif isinstance(literal, str):
        matches = (kind == "STRING") & (column.cast("string") == literal)
    elif isinstance(literal, (int, float)):
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        matches = numeric & (F.try_variant_get(column, "$", "double") == float(literal))
    else:
        matches = F.lit(False)
    return F.coalesce(matches, F.lit(False))
