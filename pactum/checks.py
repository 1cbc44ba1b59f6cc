"""Each constraint by itself, as a predicate on a column: null where the value is null.

check(c, ...) is what a contract's constraint of that name asks of a value of the right type; holds() asks any contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum import types as T
from pactum.compiler import Options, compile_type
from pactum.types import Type

_STRING, _NUMBER, _TEXTS = S.StringType(), S.DoubleType(), S.ArrayType(S.StringType())


def holds(c: Column, kind: S.DataType, t: Type) -> Column:
    """Whether a value of the column type satisfies a contract."""
    return F.when(c.isNotNull(), F.coalesce(compile_type(t, c, kind, "", Options(root=c, root_type=kind)).ok, F.lit(False)))


def min_length(c: Column, n: int) -> Column:
    return holds(c, _STRING, T.string.min_length(n))


def max_length(c: Column, n: int) -> Column:
    return holds(c, _STRING, T.string.max_length(n))


def pattern(c: Column, source: str) -> Column:
    return holds(c, _STRING, T.string.pattern(source))


def format(c: Column, name: str) -> Column:
    return holds(c, _STRING, T.string.format(name))


def minimum(c: Column, n: float) -> Column:
    return holds(c, _NUMBER, T.number.minimum(n))


def maximum(c: Column, n: float) -> Column:
    return holds(c, _NUMBER, T.number.maximum(n))


def exclusive_minimum(c: Column, n: float) -> Column:
    return holds(c, _NUMBER, T.number.exclusive_minimum(n))


def exclusive_maximum(c: Column, n: float) -> Column:
    return holds(c, _NUMBER, T.number.exclusive_maximum(n))


def multiple_of(c: Column, n: float) -> Column:
    return holds(c, _NUMBER, T.number.multiple_of(n))


def min_items(c: Column, n: int, kind: S.ArrayType = _TEXTS) -> Column:
    return holds(c, kind, T.array(T.anything).min_items(n))


def max_items(c: Column, n: int, kind: S.ArrayType = _TEXTS) -> Column:
    return holds(c, kind, T.array(T.anything).max_items(n))


def unique_items(c: Column, kind: S.ArrayType = _TEXTS) -> Column:
    return holds(c, kind, T.array(T.anything).unique_items())


def contains(c: Column, item: Type, least: int = 1, most: int | None = None, kind: S.ArrayType = _TEXTS) -> Column:
    return holds(c, kind, T.array(T.anything).contains(item, least, most))


def min_properties(c: Column, n: int, kind: S.MapType) -> Column:
    return holds(c, kind, T.record(T.anything).min_properties(n))


def max_properties(c: Column, n: int, kind: S.MapType) -> Column:
    return holds(c, kind, T.record(T.anything).max_properties(n))


def property_names(c: Column, name: Type, kind: S.MapType) -> Column:
    return holds(c, kind, T.record(T.anything).property_names(name))


def literal(c: Column, kind: S.DataType, value) -> Column:
    return holds(c, kind, T.literal(value))


def union(c: Column, kind: S.DataType, *arms: Type) -> Column:
    return holds(c, kind, T.union(*arms))
