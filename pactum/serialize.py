"""Encoders: typed columns to JSON or query text, in declared order.

A value that its type doesn't allow ends the query with 'Serialization error at "path": code'.
"""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum.types import ContractError, Type, label


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(c.cast("string")))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def number_text(c: Column) -> Column:
    """A double in the shortest digits: plain from 1e-6 up to 1e21, else with an exponent; -0 is 0."""
    plain = c.cast("string")
    sign = F.when(c < 0, "-").otherwise("")
    mantissa, power = F.regexp_extract(plain, r"^-?([0-9.]+)E", 1), F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    n = F.length(digits)
    short = F.when(n == 1, digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2), n)))
    made = (
        F.when(power >= 21, F.concat(short, F.lit("e+"), power.cast("string")))
        .when(power < -6, F.concat(short, F.lit("e"), power.cast("string")))
        .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(n <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - n)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, n)))
    )
    # The one number whose only digit is rounded otherwise when it may have two.
    return F.when(c == 0, "0").when(F.abs(c) == 5e-324, F.concat(sign, F.lit("5e-324"))).when(power.isNotNull(), F.concat(sign, made)).otherwise(F.regexp_replace(plain, r"\.0$", ""))


def _scalar(c: Column, kind: S.DataType) -> Column:
    if isinstance(kind, (S.TimestampType, S.TimestampNTZType, S.DateType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, S.BinaryType):
        return F.base64(c)
    if isinstance(kind, (S.DoubleType, S.FloatType)):
        return number_text(c)
    return c.cast("string")


def _fails(path: str, code: str | Column) -> Column:
    """Ends the query."""
    code = F.lit(code) if isinstance(code, str) else code
    return F.raise_error(F.concat(F.lit(f'Serialization error at "{path}": '), code) if path else code).cast("string")


def _under(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def _check_kind(t: Type | None) -> None:
    if t is not None and t.kind in ("function", "symbol", "promise", "class"):
        raise ContractError(f"{t.kind} cannot be written")


def _transformed(c: Column, t: Type | None, path: str, transform) -> Column:
    if transform is not None and (t is None or t.kind not in ("object", "record", "array", "tuple", "union", "set", "map", "null")):
        for fn in transform if isinstance(transform, (list, tuple)) else [transform]:
            c = F.when(c.isNotNull(), fn(c, {"type": "any" if t is None else t.kind, "path": path, "tags": () if t is None else t.tags}))
    return c


def _struct_fields(c: Column, kind: S.StructType, t: Type | None, mode: str, path: str):
    """(fields in declared order, extras, strict check): of the fields name, contract and path."""
    declared = dict(t.fields) if t is not None and t.kind == "object" else dict.fromkeys(kind.names)
    fields = [(n, f, _under(path, n)) for n, f in declared.items() if n in kind.names]
    extras = [n for n in kind.names if n not in declared]
    typed = t.value if t is not None and t.kind == "object" else None
    if typed is not None:
        fields += [(n, replace(typed, optional=True), _under(path, "[k]")) for n in extras]
    elif mode == "relaxed":
        fields += [(n, Type("any", optional=True), _under(path, n)) for n in extras]
    bad = [(n, c[n].isNotNull()) for n in extras] if mode == "strict" and typed is None else []
    return fields, bad


def json_text(c: Column, kind: S.DataType, t: Type | None = None, mode: str = "strip", path: str = "", transform=None) -> Column:
    """JSON of a value; absent optional fields are left out. Without a contract other nulls are written as null; with
    one, only where it allows null. NaN fails, infinities are written by name."""
    _check_kind(t)
    c = _transformed(c, t, path, transform)
    again = lambda x, k, part, at: json_text(x, k, part, mode, at, transform)
    if t is not None and t.kind == "union" and not isinstance(kind, S.VariantType):
        made = _union_text(c, kind, t, mode, path, lambda arm: again(c, kind, arm, path))
    elif isinstance(kind, S.VariantType):
        made = F.to_json(c)
    elif isinstance(kind, S.StructType) and t is not None and t.kind == "tuple":
        made = F.concat(F.lit("["), F.concat_ws(",", *(again(c[f.name], f.dataType, x, f"{path}[{i}]") for i, (f, x) in enumerate(zip(kind.fields, t.items)))), F.lit("]"))
    elif isinstance(kind, S.StructType):
        fields, bad = _struct_fields(c, kind, t, mode, path)
        parts = []
        for name, f, at in fields:
            part = F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), again(c[name], kind[name].dataType, f, at))
            parts.append(F.when(c[name].isNotNull(), part) if f is not None and f.optional else part)
        made = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}")) if parts else F.lit("{}")
        for name, there in reversed(bad):
            made = F.when(there, _fails(path, f"PropertyNotAllowed<{name}>")).otherwise(made)
    elif isinstance(kind, S.ArrayType):
        element = t.items[0] if t is not None and t.kind in ("array", "set") else None
        made = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: again(x, kind.elementType, element, path + "[]")), ","), F.lit("]"))
    elif isinstance(kind, S.MapType):
        value = t.items[1] if t is not None and t.items else None
        entry = lambda e: F.concat(quoted(e["key"]), F.lit(":"), again(e["value"], kind.valueType, value, _under(path, "[k]") if not path else path + "[k]"))
        made = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), entry), ","), F.lit("}"))
    elif isinstance(kind, (S.NumericType, S.BooleanType)):
        made = _scalar(c, kind)
        if isinstance(kind, (S.DoubleType, S.FloatType)):
            made = F.when(F.isnan(c), _fails(path, "Type<number>")).otherwise(made)
    else:
        made = quoted(_scalar(c, kind))
    if t is not None and t.kind == "literal":
        made = F.when(c == F.lit(t.value), made).otherwise(_fails(path, label(t)))
    loose = t is None or t.nullable or t.optional or t.kind in ("any", "null")
    return F.when(c.isNull(), F.lit("null") if loose else _fails(path, label(t))).otherwise(made)


def _matches(c: Column, kind: S.DataType, t: Type) -> Column:
    """Whether a value is written as this arm of a union: the first whose type it is."""
    from pactum.compiler import Options, compile_type

    plain = replace(t, checks=(), transforms=())
    return F.coalesce(compile_type(plain, c, kind, "", Options(mode="strip", root=c, root_type=kind)).ok, F.lit(False))


def _union_text(c: Column, kind: S.DataType, t: Type, mode: str, path: str, write) -> Column:
    out = _fails(path, label(t))
    for arm in reversed(t.items):
        if t.value and isinstance(kind, S.StructType) and t.value in kind.names:
            test = F.coalesce(c[t.value] == F.lit(dict(arm.fields)[t.value].value), F.lit(False))
        else:
            test = _matches(c, kind, arm)
        out = F.when(test, write(arm)).otherwise(out)
    return out


def uri_component(c: Column) -> Column:
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


_NO_PAIRS = "array<string>"


def query_text(c: Column, kind: S.StructType, t: Type | None = None, mode: str = "strip", transform=None) -> Column:
    """a=1&b[c]=2&d[]=3 of a struct, e[0]=4 of a tuple, f[k]=5 of a map; null is an empty value, an absent optional field
    is left out, a VARIANT is written deeply, an empty object in it as its name."""
    nothing = lambda: F.array().cast(_NO_PAIRS)
    under = lambda name, part: F.when(name == "", part).otherwise(F.concat(name, F.lit("["), part, F.lit("]")))

    def pairs(value: Column, k: S.DataType, f: Type | None, name: Column, path: str) -> Column:
        _check_kind(f)
        value = _transformed(value, f, path, transform)
        if isinstance(k, S.VariantType):
            return F.when(value.isNull(), nothing()).otherwise(_deep(value, name))
        if f is not None and f.kind == "union":
            out = _fails(path, label(f)).cast(_NO_PAIRS)
            for arm in reversed(f.items):
                test = F.coalesce(value[f.value] == F.lit(dict(arm.fields)[f.value].value), F.lit(False)) if f.value and isinstance(k, S.StructType) else _matches(value, k, arm)
                out = F.when(test, pairs(value, k, arm, name, path)).otherwise(out)
        elif isinstance(k, S.StructType) and f is not None and f.kind == "tuple":
            out = F.concat(*(pairs(value[x.name], x.dataType, part, F.concat(name, F.lit(f"[{i}]")), f"{path}[{i}]") for i, (x, part) in enumerate(zip(k.fields, f.items))))
        elif isinstance(k, S.StructType):
            fields, bad = _struct_fields(value, k, f, mode, path)
            parts = []
            for n, part, at in fields:
                made = pairs(value[n], k[n].dataType, part, under(name, F.lit(n)), at)
                parts.append(F.when(value[n].isNull(), nothing()).otherwise(made) if part is not None and part.optional else made)
            out = F.concat(*parts) if parts else nothing()
            for n, there in reversed(bad):
                out = F.when(there, _fails(path, f"PropertyNotAllowed<{n}>").cast(_NO_PAIRS)).otherwise(out)
        elif isinstance(k, S.ArrayType):
            element = f.items[0] if f is not None and f.kind in ("array", "set") else None
            out = F.flatten(F.transform(value, lambda x: pairs(x, k.elementType, element, F.concat(name, F.lit("[]")), path + "[]")))
        elif isinstance(k, S.MapType):
            element = f.items[1] if f is not None and f.items else None
            out = F.flatten(F.transform(F.map_entries(value), lambda e: pairs(e["value"], k.valueType, element, under(name, e["key"].cast("string")), path + "[k]")))
        else:
            return F.array(F.concat(uri_component(name), F.lit("="), F.coalesce(uri_component(_scalar(value, k)), F.lit(""))))
        return F.coalesce(out, nothing())

    return F.array_join(pairs(c, kind, t, F.lit(""), ""), "&")


def append_query_any(value, prefix: str = "") -> list[tuple[str, str]]:
    """(name, text) of a value of any shape."""
    if isinstance(value, list):
        return [p for x in value for p in append_query_any(x, prefix + "[]")]
    if isinstance(value, dict):
        made = [p for k, x in value.items() for p in append_query_any(x, f"{prefix}[{k}]" if prefix else k)]
        return made or ([(prefix, "")] if prefix and not value else made)
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value)
    return [(prefix, text)]


def _deep(c: Column, name: Column) -> Column:
    """The pairs of a VARIANT under a name, already encoded."""

    @F.pandas_udf("array<struct<name:string,text:string>>")
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else append_query_any(json.loads(t), n) for t, n in zip(texts, names)], dtype=object)

    return F.transform(run(F.to_json(c), name), lambda p: F.concat(uri_component(p["name"]), F.lit("="), uri_component(p["text"])))


def _replace(holder, key, replacer):
    """The value that replacer(key, value) gives, outer members first; ABSENT takes a member out."""
    from pactum.parse import ABSENT

    value = replacer(key, holder[int(key)] if isinstance(holder, list) else holder[key])
    if isinstance(value, list):
        return [None if (x := _replace(value, str(i), replacer)) is ABSENT else x for i in range(len(value))]
    if isinstance(value, dict):
        made = {k: _replace(value, k, replacer) for k in value}
        return {k: x for k, x in made.items() if x is not ABSENT}
    return value


def replaced(c: Column, replacer) -> Column:
    """JSON texts after replacer(key, value) on every member, in an Arrow-batched UDF; null where the root goes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from pactum.parse import ABSENT

        def one(text):
            made = None if text is None else _replace({"": json.loads(text)}, "", replacer)
            return None if text is None or made is ABSENT else json.dumps(made, ensure_ascii=False, separators=(",", ":"))

        return texts.map(one)

    return run(c)


def serializer(kind: S.DataType, t: Type | None = None, mode: str = "strip", format: str = "json", transform=None, replacer=None):
    """A reusable encoder, Column -> Column. replacer is for JSON only."""
    if format != "json":
        return lambda c: query_text(c, kind, t, mode, transform)
    write = lambda c: json_text(c, kind, t, mode, transform=transform)
    return write if replacer is None else lambda c: replaced(write(c), replacer)
