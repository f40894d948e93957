"""Values shown in place of NULL when rows are read out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

READ_DEFAULTS: dict[type[T.DataType], str] = {
    T.StringType: "''",
    T.IntegerType: "0",
    T.BooleanType: "false",
}


def defaulted(schema: T.StructType, names: Iterable[str], raw: Iterable[str] = ()) -> list[str]:
    """SQL expressions for ``names``; text, counts and flags get a value, times stay NULL.

    Columns in ``raw`` are passed through untouched. Expressions as text go to
    ``selectExpr`` in one call, which builds a wide projection much faster
    than one call per function and column.
    """
    raw = set(raw)
    out = []
    for name in names:
        default = READ_DEFAULTS.get(type(schema[name].dataType))
        out.append(name if default is None or name in raw else f"coalesce({name}, {default}) AS {name}")
    return out
