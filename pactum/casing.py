"""Key casing: names of fields, through nested structs and arrays. Map keys are data and stay."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

_JOINERS = {"snake_case": "_", "SNAKE_CASE": "_", "kebab-case": "-", "dot.case": "."}


_ENDS = "_-.$"


def words(name: str) -> list[str]:
    """The words of a name in small letters; marks other than these three stay in their word."""
    if re.fullmatch("[A-Z0-9_]+", name):
        name = name.lower()
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"[-.]", "_", name)).lower()
    return [w for w in name.split("_") if w]


def _title(word: str) -> str:
    return word[:1].upper() + word[1:] if re.match("[a-z0-9]", word) else "_" + word


def convert(name: str, casing: str, preserve_ends: bool = True) -> str:
    """The name in another casing; an unknown casing leaves it. Marks at either end stay unless preserve_ends is off."""
    rest = name.lstrip(_ENDS)
    core = rest.rstrip(_ENDS)
    parts = words(core)
    if parts and casing in _JOINERS:
        core = _JOINERS[casing].join(parts)
        core = core.upper() if casing == "SNAKE_CASE" else core
    elif parts and casing.removesuffix("ID") in ("camelCase", "PascalCase"):
        # A word that doesn't begin with an ASCII letter or digit keeps the mark before it.
        core = parts[0] + "".join(map(_title, parts[1:]))
        if casing.startswith("Pascal"):
            core = core[:1].upper() + core[1:]
        if casing.endswith("ID") and core.endswith("Id"):
            core = core[:-2] + "ID"
    return name[: len(name) - len(rest)] + core + rest[len(rest.rstrip(_ENDS)) :] if preserve_ends else core


def _names(names: list[str], casing: str, preserve_ends: bool) -> list[str]:
    made: dict[str, str] = {}
    for name in names:
        new = convert(name, casing, preserve_ends)
        if new in made:
            raise ValueError(f"Casing conversion collision: {made[new]} and {name} both map to {new}")
        made[new] = name
    return list(made)


def _rename(c: Column, kind: S.DataType, casing: str, ends: bool) -> Column:
    if isinstance(kind, S.StructType):
        new = _names(kind.names, casing, ends)
        made = F.struct(*(_rename(c.getField(f.name), f.dataType, casing, ends).alias(n) for f, n in zip(kind.fields, new)))
        return F.when(c.isNotNull(), made)
    if isinstance(kind, S.ArrayType) and _nested(kind.elementType):
        return F.transform(c, lambda x: _rename(x, kind.elementType, casing, ends))
    return c


def _nested(kind: S.DataType) -> bool:
    return isinstance(kind, S.StructType) or (isinstance(kind, S.ArrayType) and _nested(kind.elementType))


def convert_casing(df: DataFrame, casing: str, preserve_ends: bool = True) -> DataFrame:
    new = _names(df.columns, casing, preserve_ends)
    return df.select(*(_rename(F.col(f"`{f.name}`"), f.dataType, casing, preserve_ends).alias(n) for f, n in zip(df.schema.fields, new)))


def _converted(value, casing: str, ends: bool):
    if isinstance(value, list):
        return [_converted(x, casing, ends) for x in value]
    if isinstance(value, dict):
        return dict(zip(_names(list(value), casing, ends), (_converted(x, casing, ends) for x in value.values())))
    return value


def convert_json(c: Column, casing: str, preserve_ends: bool = True) -> Column:
    """JSON texts with the keys of all objects in another casing, in an Arrow-batched UDF, since the keys are only known
    from the data. Two keys of an object that become one end the query; a text that isn't JSON gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = None if text is None else json.loads(text)
            except ValueError:
                return None
            return None if text is None else json.dumps(_converted(value, casing, preserve_ends), ensure_ascii=False, separators=(",", ":"))

        return texts.map(one)

    return run(c)
