"""Contracts over typed and dynamic columns, compiled to Catalyst expressions: a success predicate, the value, the errors.

The predicate is a plain conjunction, so Spark pushes what it can to the scan; the errors are concatenated fragments,
which stay inside generated code, and parts that can't fail have none. Paths that are known are plain texts. In a typed
column SQL NULL stands for an absent value where the field is optional or has a default, and for null elsewhere; in a
VARIANT, SQL NULL is an absent value and JSON null is null. Error paths are built as the reference semantics have them:
a.b, a[0], key(k).
"""

from __future__ import annotations

import inspect
import json
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum import formats
from pactum.types import Check, ContractError, Type, code, label

ISSUES = "array<struct<path:string,value:string,error:string>>"
ERROR = f"array<struct<path:string,value:string,error:string,issues:{ISSUES}>>"
BLANKS = r"[\t\n\x0b\f\r\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
Path = str | Column


@dataclass
class Options:
    mode: str = "strict"  # strict, relaxed, strip
    from_: object = None  # None, 'json', 'query', 'string' or a callback of a value that isn't of its type
    root: Column | None = None
    root_type: S.DataType | None = None
    transform: object = None
    wire: bool = False  # the rules of parse()
    parents: tuple = ()  # the containers around a value, outermost first: (column, type)


@dataclass
class Compiled:
    """errors is None where there can be none."""

    ok: Column
    data: Column
    errors: Column | None
    kind: S.DataType
    plain: bool = False  # may hold UDFs


def none() -> Column:
    return F.array().cast(ERROR)


def joined(parts: list[Column | None]) -> Column | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once. No UDF can stand in what use makes."""
    return F.transform(F.array(value), use)[0]


def has_udf(t: Type) -> bool:
    """Whether a contract is checked by a UDF somewhere: for regular expressions, or by a user's function that may be one."""
    if t.kind == "regexp" or any(c.name == "Custom" or c.name == "Format" and c.args[0] == "regex" for c in t.checks) or any(n == "Custom" for n, _ in t.transforms):
        return True
    inner = [a for c in t.checks for a in c.args if isinstance(a, Type)] + ([t.value] if isinstance(t.value, Type) else [])
    return any(map(has_udf, [*t.items, *(f for _, f in t.fields), *inner]))


def errors_of(made: Compiled) -> Column:
    return none() if made.errors is None else made.errors


def text(c: Column, kind: S.DataType) -> Column:
    if isinstance(kind, S.VariantType):
        return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))
    if isinstance(kind, (S.StructType, S.ArrayType, S.MapType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(kind, S.BinaryType) else c.cast("string")


def lit(path: Path) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def error(path: Path, c: Column, kind: S.DataType, what: str | Column, issues: Column | None = None) -> Column:
    return F.array(
        F.struct(
            lit(path).alias("path"), text(c, kind).alias("value"), lit(what).alias("error"),
            (F.lit(None).cast(ISSUES) if issues is None else F.transform(issues, lambda e: F.struct(e["path"].alias("path"), e["value"].alias("value"), e["error"].alias("error")))).alias("issues"),
        )
    )


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def is_number(kind: S.DataType) -> bool:
    return isinstance(kind, S.NumericType)


def _call(fn, c: Column, t: Type, path: Path, opts: Options) -> Column:
    """A user's function of the value, or of the value and where it stands, by the parameters it takes."""
    try:
        wanted = len([p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)])
    except (TypeError, ValueError):
        wanted = 1
    return fn(c) if wanted < 2 else fn(c, context(t, path, opts))


def context(t: Type, path: Path, opts: Options) -> dict:
    """Where a value stands: key, path, parent, root, type, tags; index in an array as a Column."""
    if isinstance(path, str):
        parts = tokens(path)
        key, index = (parts[-1] if parts else ""), None
    else:
        key = F.regexp_extract(path, r"([^.\[\]]*)\]?\z", 1)
        index = F.regexp_extract(path, r"\[([0-9]+)\]\z", 1).try_cast("int")
    return {"key": key, "path": path, "parent": opts.parents[-1][0] if opts.parents else None, "root": opts.root, "index": index, "type": t.kind, "tags": t.tags}


def tokens(path: str) -> list[str]:
    """The parts of a path: names, and indices as '0'."""
    return re.findall(r"[^.\[\]]+", path)


def fails(check: Check, t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> Column:
    """Whether a non-null value of the right type breaks the constraint."""
    name, a = check.name, check.args
    if name == "MinLength":
        return utf16_length(c) < a[0]
    if name == "MaxLength":
        return utf16_length(c) > a[0]
    if name == "Pattern":
        broken = ~c.rlike(formats.java_pattern(a[0]))
        return broken if opts.wire else (utf16_length(c) > formats.LONGEST_SUBJECT) | broken
    if name == "Format":
        return ~formats.format_column(a[0], c)
    if name == "Minimum":
        return c < a[0]
    if name == "Maximum":
        return c > a[0]
    if name == "ExclusiveMinimum":
        return c <= a[0]
    if name == "ExclusiveMaximum":
        return c >= a[0]
    if name == "MultipleOf":
        if a[0] == 0:
            return F.lit(not opts.wire)
        if opts.wire or isinstance(kind, S.DecimalType) or (isinstance(kind, S.IntegralType) and isinstance(a[0], int)):
            return c % a[0] != 0
        q = c.cast("double") / float(a[0])
        return (F.abs(q) != float("inf")) & (F.abs(q - F.rint(q)) > 1e-8 * F.greatest(F.lit(1.0), F.abs(q)))
    if name in ("MinItems", "MaxItems"):
        return F.size(c) < a[0] if name == "MinItems" else F.size(c) > a[0]
    if name == "UniqueItems":
        if isinstance(kind, S.StructType):
            c, kind = F.array(*(F.to_json(F.struct(c[f])) for f in kind.names)), S.ArrayType(S.StringType())
        plain = not _has_map(kind.elementType)
        items = c if plain else F.transform(c, lambda x: F.to_json(x))
        return F.size(F.array_distinct(items)) < F.size(c)
    if name in ("MinProperties", "MaxProperties"):
        n = F.size(F.map_keys(c)) if isinstance(kind, S.MapType) else reduce(lambda x, y: x + y, [c[f].isNotNull().cast("int") for f in kind.names], F.lit(0))
        return n < a[0] if name == "MinProperties" else n > a[0]
    if name == "PropertyNames":
        return F.exists(F.map_keys(c), lambda k: ~F.coalesce(compile_type(a[0], k, S.StringType(), "", opts).ok, F.lit(False)))
    if name == "Custom":
        return ~_call(a[0], c, t, path, opts)
    raise ContractError(f"unknown constraint {name}")


def _has_map(kind: S.DataType) -> bool:
    if isinstance(kind, S.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (S.MapType, S.VariantType)) or (isinstance(kind, S.ArrayType) and _has_map(kind.elementType))


def constraint(check: Check, t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> tuple[Column, Column]:
    """(holds, errors) for a non-null value."""
    what = check.message or t.message
    if check.name == "Contains":
        item, least, most = check.args
        count = F.size(F.filter(c, lambda x: F.coalesce(compile_type(item, x, kind.elementType, "", opts).ok, F.lit(False))))
        few, many = count < least, (count > most if most is not None else F.lit(False))
        made = F.when(few, error(path, c, kind, what or f"Contains<min:{least}>")).when(many, error(path, c, kind, what or f"Contains<max:{most}>")).otherwise(none())
        return ~few & ~many, made
    if check.name == "Requires":
        holds, parts = F.lit(True), []
        for wanted in check.args[0]:
            # parse() looks for a key of the value itself, validate() for a path from the root or the parent.
            missing = ~_has_key(c, kind, wanted) if opts.wire else _resolve(wanted, opts).isNull()
            holds = holds & ~missing
            parts.append(F.when(missing, error(path, c, kind, what or f"Requires<{wanted}>")).otherwise(none()))
        return holds, joined(parts)
    if check.name == "PropertyNames":
        if not isinstance(kind, S.MapType):
            return F.lit(True), none()

        def broken(k):
            return errors_of(compile_type(check.args[0], k, S.StringType(), child(path, k), opts))

        bad = F.flatten(F.transform(F.map_keys(c), lambda k: F.slice(broken(k), 1, 1)))
        return ~fails(check, t, c, kind, path, opts), bad
    if opts.wire and t.kind == "bigint" and check.name in ("Minimum", "Maximum", "ExclusiveMinimum", "ExclusiveMaximum", "MultipleOf"):
        return F.lit(True), none()  # parse() holds only numbers to bounds
    broken = fails(check, t, c, kind, path, opts)
    said = f"Pattern<'{check.args[0]}'>" if opts.wire and check.name == "Pattern" else code(check)
    return ~broken, F.when(F.coalesce(broken, F.lit(False)), error(path, c, kind, what or said)).otherwise(none())


def _has_key(c: Column, kind: S.DataType, name: str) -> Column:
    if isinstance(kind, S.MapType):
        return F.try_element_at(c, F.lit(name)).isNotNull()
    return c[name].isNotNull() if isinstance(kind, S.StructType) and name in kind.names else F.lit(False)


def _resolve(path: str, opts: Options) -> Column:
    """The value at a path, as something that is null if there is none: from the root, or from the container that the
    leading dots lead up to."""
    dots = len(path) - len(path.lstrip("."))
    around = ((opts.root, opts.root_type), *opts.parents[1:])
    c, kind = around[0] if not dots or dots > len(opts.parents) else around[len(opts.parents) - dots]
    for part in tokens(path):
        if isinstance(kind, S.VariantType):
            c = F.try_variant_get(c, f"$[{part}]" if part.isdigit() else f"$[{json.dumps(part)}]", "variant")
        elif isinstance(kind, S.MapType):
            c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
        elif isinstance(kind, S.ArrayType) and part.isdigit():
            c, kind = F.get(c, F.lit(int(part))), kind.elementType
        elif isinstance(kind, S.StructType) and part in kind.names:
            c, kind = c[part], kind[part].dataType
        else:
            return F.lit(None).cast("string")
    return F.when(~F.is_variant_null(c), F.lit("")) if isinstance(kind, S.VariantType) else c


def child(path: Path, name: str | Column) -> Path:
    if isinstance(path, str):
        if isinstance(name, str):
            return f"{path}.{name}" if path else name
        return F.concat(F.lit(f"{path}."), name.cast("string")) if path else name.cast("string")
    return F.concat(path, F.lit("."), lit(name) if isinstance(name, str) else name.cast("string"))


def item(path: Path, i: int | Column) -> Path:
    if isinstance(path, str) and isinstance(i, int):
        return f"{path}[{i}]"
    return F.concat(lit(path), F.lit("["), F.lit(str(i)) if isinstance(i, int) else i.cast("string"), F.lit("]"))


TRANSFORMS = {
    "Trim": lambda c: F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", ""),
    "LowerCase": F.lower,
    "UpperCase": F.upper,
    "Capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647)),
}


def to_number(c: Column, wire: bool = False) -> Column:
    """The number that a whole text is, else null. Hexadecimal, octal and binary forms are numbers to parse() only."""
    decimal = lambda t: F.when(t.rlike(NUMBER), t.try_cast("double"))
    finite = lambda n: F.when(F.abs(n) != float("inf"), n)
    if not wire:
        return finite(decimal(TRANSFORMS["Trim"](c)))

    def read(t: Column) -> Column:
        value = decimal(t)
        for mark, digits, base in (("xX", "0-9a-fA-F", 16), ("oO", "0-7", 8), ("bB", "01", 2)):
            value = F.coalesce(value, F.when(t.rlike(rf"\A0[{mark}][{digits}]+\z"), F.conv(F.substring(t, 3, 2147483647), base, 10).try_cast("double")))
        return value

    return let(let(TRANSFORMS["Trim"](c), read), finite)


def to_boolean(c: Column, wire: bool = False) -> Column:
    low = F.lower(c)
    out = F.when(low.isin("true", "1", "yes", "on", *([""] if wire else [])), True)
    return out.when(low.isin("false", "0", "no", "off"), False)


def to_date(c: Column) -> Column:
    """ISO 8601 texts; other forms that some engines guess at are null."""
    iso = r"\A[0-9]{4}-[0-9]{2}(?:-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?)?\z"
    return F.when(c.rlike(iso), F.try_to_timestamp(F.when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c)))


REGEXP = S.StructType([S.StructField("source", S.StringType()), S.StructField("flags", S.StringType())])


def to_regexp(c: Column, plain: bool = False) -> Column:
    """/source/flags, and from a query any source, as struct(source, flags); null where it doesn't compile."""
    form = r"(?s)\A/(.*)/([gimuy]*)\z"
    slashed = F.struct(F.regexp_extract(c, form, 1).alias("source"), F.regexp_extract(c, form, 2).alias("flags"))
    out = F.when(c.rlike(form), slashed)
    if plain:
        out = out.otherwise(F.struct(c.alias("source"), F.lit("").alias("flags")))
    return F.when(c.isNotNull() & formats.format_column("regex", out["source"]), out)


def to_bigint(c: Column) -> Column:
    t = TRANSFORMS["Trim"](c)
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("decimal(38,0)"))


CHANGES = {"ToNumber": (to_number, S.DoubleType()), "ToBoolean": (to_boolean, S.BooleanType()), "ToDate": (to_date, S.TimestampType())}


def _change(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> tuple[Column, S.DataType]:
    for name, fn in t.transforms:
        if name == "Custom":
            c = F.when(c.isNotNull(), _call(fn, c, t, path, opts))
        elif isinstance(kind, S.StringType):
            if name in CHANGES:
                change, kind = CHANGES[name]
                c = change(c, opts.wire) if name != "ToDate" else change(c)
            else:
                c = TRANSFORMS[name](c)
    return c, kind


def natural(t: Type) -> S.DataType:
    """The column type of values of the type."""
    from pactum.jsonschema import to_struct_type

    return to_struct_type(t)


def _coerce(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> tuple[Column, S.DataType]:
    if callable(opts.from_):
        if t.kind in ("any", "union", "object", "record"):
            return c, kind
        # The callback sees only what isn't of the type.
        good = _is(t, c, kind)
        if good is None:
            kind = natural(t)
            return F.when(c.isNotNull(), _call(opts.from_, c, t, path, opts).cast(kind)), kind
        return F.when(F.coalesce(good, F.lit(True)), c).otherwise(_call(opts.from_, c, t, path, opts).cast(kind)), kind
    if opts.from_ in ("json", "query", "string") and isinstance(kind, S.StringType):
        if t.kind == "date":
            return to_date(c), S.TimestampType()
        if t.kind == "bigint":
            return to_bigint(c), S.DecimalType(38, 0)
        if t.kind == "binary":
            return F.unbase64(c), S.BinaryType()
        if t.kind == "regexp":
            return to_regexp(c, opts.from_ != "json"), REGEXP
        base = _base(t)
        if opts.from_ != "json" and base in ("number", "integer"):
            return to_number(c, opts.wire), S.DoubleType()
        if opts.from_ != "json" and base == "boolean":
            return to_boolean(c, opts.wire), S.BooleanType()
    if opts.from_ in ("query", "string") and t.kind in ("array", "set") and not isinstance(kind, (S.ArrayType, S.MapType, S.StructType)):
        return F.when(c.isNotNull(), F.array(c)), S.ArrayType(kind)
    return c, kind


def _base(t: Type) -> str:
    """The kind of scalar that a literal, or a choice among literals of one kind, is made of."""
    values = [t.value] if t.kind == "literal" else [a.value for a in t.items] if t.kind == "union" and t.items and all(a.kind == "literal" for a in t.items) else []
    kinds = {"boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number" for v in values}
    return kinds.pop() if len(kinds) == 1 else t.kind


def _lift(t: Type, c: Column, opts: Options) -> tuple[Column, S.DataType]:
    """A VARIANT as a column of the type's own kind, null where it holds another kind of value."""
    holds, query = F.schema_of_variant(c), opts.from_ in ("query", "string")
    get = lambda kind: F.try_variant_get(c, "$", kind)
    numeric = holds.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    kind = _base(t)
    if kind in ("string", "template"):
        return F.when(holds == "STRING", get("string")), S.StringType()
    if kind in ("number", "integer"):
        value = F.when(numeric, get("double"))
        return value.when(holds == "STRING", to_number(get("string"), opts.wire)) if query else value, S.DoubleType()
    if kind == "boolean":
        value = F.when(holds == "BOOLEAN", get("boolean"))
        if query:
            value = value.when((holds == "STRING") | numeric, to_boolean(get("string"), opts.wire))
        return value, S.BooleanType()
    if kind in ("array", "set", "tuple"):
        value = F.when(holds.startswith("ARRAY"), get("array<variant>"))
        if query and kind != "tuple":
            value = value.when(holds == "VOID", F.array().cast("array<variant>")).when(c.isNotNull(), F.array(c))
            value = F.coalesce(value, F.array().cast("array<variant>")) if opts.wire else value
        return value, S.ArrayType(S.VariantType())
    if kind in ("object", "record", "map"):
        return F.when(holds.startswith("OBJECT"), get("map<string,variant>")), S.MapType(S.StringType(), S.VariantType())
    if kind in ("date", "bigint", "binary", "regexp") and opts.from_ in ("json", "query", "string"):
        value, made = _coerce(Type(kind), F.when(holds == "STRING", get("string")), S.StringType(), "", opts)
        if kind == "bigint":
            value = F.coalesce(value, F.when(numeric, get("decimal(38,0)")))
        if kind == "regexp":
            parts = F.struct(F.try_variant_get(c, "$.source", "string").alias("source"), F.coalesce(F.try_variant_get(c, "$.flags", "string"), F.lit("")).alias("flags"))
            value = F.coalesce(value, F.when(holds.startswith("OBJECT") & formats.format_column("regex", parts["source"]), parts))
        return value, made
    return F.lit(None).cast(natural(Type(kind)) if kind in ("date", "bigint", "binary") else "string"), natural(Type(kind)) if kind in ("date", "bigint", "binary") else S.StringType()


def to_variant(c: Column, kind: S.DataType) -> Column:
    if isinstance(kind, S.VariantType):
        return c
    return F.to_variant_object(c) if isinstance(kind, (S.StructType, S.ArrayType, S.MapType)) else c.cast("variant")


def _is(t: Type, c: Column, kind: S.DataType) -> Column | None:
    """Whether a non-null value is of a scalar type; None if the column's type rules it out."""
    k = t.kind
    if k == "any":
        return F.lit(True)
    if k == "literal":
        return _equals(c, kind, t.value)
    if k in ("string", "template"):
        if not isinstance(kind, S.StringType):
            return None
        return F.lit(True) if k == "string" else c.rlike(r"(?s)\A" + "".join(_part(p) for p in t.items) + r"\z")
    if k == "number" and is_number(kind):
        return ~F.isnan(c) if isinstance(kind, (S.DoubleType, S.FloatType)) else F.lit(True)
    if k == "integer" and is_number(kind):
        return F.lit(True) if isinstance(kind, S.IntegralType) else c == F.floor(c)
    if k == "bigint" and (isinstance(kind, S.IntegralType) or (isinstance(kind, S.DecimalType) and kind.scale == 0)):
        return F.lit(True)
    same = {"boolean": S.BooleanType, "date": (S.TimestampType, S.TimestampNTZType, S.DateType), "binary": S.BinaryType, "object": (S.StructType, S.MapType), "record": (S.MapType, S.StructType), "map": S.MapType, "array": S.ArrayType, "set": S.ArrayType, "tuple": (S.StructType, S.ArrayType), "regexp": S.StructType}
    return F.lit(True) if k in same and isinstance(kind, same[k]) else None


def _part(p: Type) -> str:
    if p.kind == "literal":
        return re.escape(str(p.value))
    return {"string": ".*", "number": r"[0-9]+(?:\.[0-9]+)?", "bigint": "[0-9]+", "boolean": "(?:true|false)"}[p.kind]


def _equals(c: Column, kind: S.DataType, value) -> Column:
    right = S.StringType if isinstance(value, str) else S.BooleanType if isinstance(value, bool) else S.NumericType
    return c == F.lit(value) if isinstance(kind, right) else F.lit(False)


def compile_type(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> Compiled:
    if t.kind in ("function", "symbol", "promise", "class"):
        raise ContractError(f"{t.kind} has no meaning in data")
    original, first = c, kind
    dynamic = isinstance(kind, S.VariantType)
    if dynamic and t.kind not in ("any", "never", "null", "all") and (t.kind != "union" or _base(t) != "union"):
        c, kind = _lift(t, c, opts)
    if t.has_default:
        missing = F.lit(t.default).cast(kind) if not isinstance(t.default, (list, dict)) else F.from_json(F.lit(json.dumps(t.default)), kind)
        c = F.when(original.isNull(), missing).otherwise(c) if dynamic else F.coalesce(c, missing)
    c, kind = _change(t, c, kind, path, opts)
    c, kind = _coerce(t, c, kind, path, opts)
    inner = _value(t, c, kind, path, opts, original, first)
    absent = None
    if dynamic:
        tests = ([original.isNull()] if t.optional and not t.has_default else []) + ([F.is_variant_null(original)] if t.nullable else [])
        absent = reduce(lambda x, y: x | y, tests) if tests else None
    elif (t.optional or t.nullable) and not t.has_default:
        absent = original.isNull()
    if absent is None:
        return inner
    errors = None if inner.errors is None else F.when(absent, none()).otherwise(inner.errors)
    return Compiled(absent | inner.ok, F.when(absent, F.lit(None)).otherwise(inner.data), errors, inner.kind)


def _value(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options, raw: Column, raw_kind: S.DataType) -> Compiled:
    what = t.message or label(t)
    wrong = error(path, raw, raw_kind, what)
    if t.kind == "never":
        return Compiled(F.lit(False), c, wrong, kind)
    if t.kind == "null":
        ok = F.is_variant_null(c) if isinstance(kind, S.VariantType) else c.isNull()
        return Compiled(ok, c, F.when(F.coalesce(ok, F.lit(False)), none()).otherwise(wrong), kind)
    if t.kind == "union":
        return _union(t, c, kind, path, opts, wrong)
    if t.kind == "all":
        return _all(t, c, kind, path, opts)
    base = _is(t, c, kind)
    if base is None:
        return Compiled(F.lit(False), c, wrong, kind)
    ok, data, nested, out = (base, c, None, kind) if t.kind == "any" else _nested(t, c, kind, path, opts)
    if t.kind != "any":
        ok = base & ok
    if opts.transform is not None and t.kind in ("string", "number", "integer", "bigint", "boolean", "literal", "template", "date", "regexp", "any"):
        for fn in opts.transform if isinstance(opts.transform, (list, tuple)) else [opts.transform]:
            data = c = F.when(c.isNotNull(), fn(c, context(t, path, opts)))
    more = []
    for check in t.checks:
        holds, errors = constraint(check, t, c, out, path, opts)
        ok = ok & holds
        more.append(errors)
    here = joined([nested, *more])
    if t.kind == "any":
        return Compiled(ok, data, here if here is None else F.when(c.isNotNull(), here).otherwise(none()), out)
    good = F.coalesce(base & c.isNotNull(), F.lit(False))
    return Compiled(c.isNotNull() & ok, data, F.when(good, none() if here is None else here).otherwise(wrong), out)


def _nested(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options):
    """(ok, data, errors, type) of what a container holds."""
    inside = replace(opts, parents=(*opts.parents, (c, kind)))
    if t.kind in ("array", "set"):
        element = t.items[0]
        each = lambda x, i: compile_type(element, x, kind.elementType, item(path, i), inside)
        made = each(F.lit(None).cast(kind.elementType), F.lit(0))
        ok = F.forall(c, lambda x: F.coalesce(each(x, F.lit(0)).ok, F.lit(False)))
        data = F.transform(c, lambda x, i: each(x, i).data)
        data = F.array_distinct(data) if t.kind == "set" and not _has_map(made.kind) else data
        errors = None if made.errors is None else F.flatten(F.transform(c, lambda x, i: errors_of(each(x, i))))
        return ok, data, errors, S.ArrayType(made.kind)
    if t.kind in ("record", "map") and isinstance(kind, S.MapType):
        key, value = t.items
        at = lambda k: child(path, k) if t.kind == "record" else item(path, k)
        keyed = lambda k: compile_type(key, k, kind.keyType, F.concat(lit(path), F.lit(".key("), k.cast("string"), F.lit(")")), inside)
        each = lambda k, v: compile_type(value, v, kind.valueType, at(k), inside)
        made = each(F.lit("") if isinstance(kind.keyType, S.StringType) else F.lit(None).cast(kind.keyType), F.lit(None).cast(kind.valueType)).kind
        ok = F.forall(F.map_entries(c), lambda e: F.coalesce(keyed(e["key"]).ok & each(e["key"], e["value"]).ok, F.lit(False)))
        errors = F.flatten(F.transform(F.map_entries(c), lambda e: F.concat(errors_of(keyed(e["key"])), errors_of(each(e["key"], e["value"])))))
        return ok, F.transform_values(c, lambda k, v: each(k, v).data), errors, S.MapType(kind.keyType, made)
    if t.kind == "tuple":
        struct = isinstance(kind, S.StructType)
        parts = kind.names if struct else range(len(t.items))
        if struct and len(parts) != len(t.items):
            return F.lit(False), c, error(path, c, kind, label(t)), kind
        made = [compile_type(x, c[p] if struct else F.get(c, F.lit(p)), kind[p].dataType if struct else kind.elementType, item(path, n), inside) for n, (x, p) in enumerate(zip(t.items, parts))]
        ok = reduce(lambda x, y: x & y, [m.ok for m in made], F.lit(True))
        errors = joined([m.errors for m in made])
        names = list(parts) if struct else [f"_{p}" for p in parts]
        data = F.struct(*(m.data.alias(p) for m, p in zip(made, names))) if made else c
        out = S.StructType([S.StructField(p, m.kind) for m, p in zip(made, names)])
        if struct:
            return ok, data, errors, out
        right = F.size(c) == len(t.items)
        return right & ok, data, F.when(right, none() if errors is None else errors).otherwise(error(path, c, kind, label(t))), out
    if t.kind in ("object", "record") and isinstance(kind, S.StructType):
        return _object(t, c, kind, path, inside)
    if t.kind == "object":
        return _keys(t, c, kind, path, inside)
    return F.lit(True), c, None, kind


def _object(t: Type, c: Column, kind: S.StructType, path: Path, opts: Options):
    declared = dict(t.fields) if t.kind == "object" else {}
    extra_type = t.value if t.kind == "object" else t.items[1]
    ok, data, errors, out = F.lit(True), [], [], []

    def take(name, f, value, inner):
        nonlocal ok
        made = compile_type(f, value, inner, child(path, name), opts)
        ok = ok & made.ok
        errors.append(made.errors)
        data.append(made.data.alias(name))
        out.append(S.StructField(name, made.kind))

    for name, f in declared.items():
        there = name in kind.names
        take(name, f, c[name] if there else F.lit(None).cast("string"), kind[name].dataType if there else S.StringType())
    for name in (n for n in kind.names if n not in declared):
        if extra_type is not None and extra_type.kind == "any" and not extra_type.checks and not extra_type.transforms:
            data.append(c[name].alias(name))
            out.append(kind[name])
        elif extra_type is not None:
            take(name, replace(extra_type, optional=True), c[name], kind[name].dataType)
        elif opts.mode == "strict":
            ok = ok & c[name].isNull()
            errors.append(F.when(c[name].isNotNull(), error(path, c[name], kind[name].dataType, f"PropertyNotAllowed<{name}>")).otherwise(none()))
        elif opts.mode == "relaxed":
            data.append(c[name].alias(name))
            out.append(kind[name])
    return ok, F.struct(*data) if data else c, joined(errors), S.StructType(out) if out else kind


#: Holds the keys that an object doesn't declare, where they stay.
REST = "_rest"


def _keys(t: Type, c: Column, kind: S.MapType, path: Path, opts: Options):
    """An object whose keys are known from the data only."""
    declared = dict(t.fields)
    made = {name: compile_type(f, F.try_element_at(c, F.lit(name)), kind.valueType, child(path, name), opts) for name, f in declared.items()}
    ok = reduce(lambda x, y: x & y, [m.ok for m in made.values()], F.lit(True))
    errors = [m.errors for m in made.values()]
    data = [m.data.alias(name) for name, m in made.items()]
    out = [S.StructField(name, m.kind) for name, m in made.items()]
    rest = F.map_filter(c, lambda k, v: ~k.isin(list(declared))) if declared else c
    if t.value is not None:
        each = lambda k, v: compile_type(t.value, v, kind.valueType, child(path, k), opts)
        ok = ok & F.forall(F.map_entries(rest), lambda e: F.coalesce(each(e["key"], e["value"]).ok, F.lit(False)))
        one = each(F.lit(""), F.lit(None).cast(kind.valueType))
        errors.append(None if one.errors is None else F.flatten(F.transform(F.map_entries(rest), lambda e: errors_of(each(e["key"], e["value"])))))
        data.append(F.transform_values(rest, lambda k, v: each(k, v).data).alias(REST))
        out.append(S.StructField(REST, S.MapType(kind.keyType, one.kind)))
    elif opts.mode == "strict":
        ok = ok & (F.size(rest) == 0)
        errors.append(F.transform(F.map_entries(rest), lambda e: error(path, e["value"], kind.valueType, F.concat(F.lit("PropertyNotAllowed<"), e["key"], F.lit(">")))[0]))
    elif opts.mode == "relaxed":
        data.append(rest.alias(REST))
        out.append(S.StructField(REST, kind))
    return ok, F.struct(*data) if data else c, joined(errors), S.StructType(out) if out else kind


def _one_type(cases: list[tuple[Column, Column, S.DataType]], otherwise: Column, kind: S.DataType) -> tuple[Column, S.DataType]:
    """The data of the first case that applies, as one type: structs field by field, other types that differ as VARIANT."""
    kinds = [k for _, _, k in cases]
    if all(k == kinds[0] for k in kinds):
        out, rest = kinds[0], otherwise if kind == kinds[0] else F.lit(None)
        return reduce(lambda later, x: F.when(x[0], x[1]).otherwise(later), reversed(cases), rest), out
    if all(isinstance(k, S.StructType) for k in kinds):
        names = list(dict.fromkeys(n for k in kinds for n in k.names))
        parts = [_one_type([(test, c[n], k[n].dataType) for test, c, k in cases if n in k.names], F.lit(None), S.NullType()) for n in names]
        made = F.struct(*(c.alias(n) for n, (c, _) in zip(names, parts)))
        return F.when(reduce(lambda x, y: x | y, [x[0] for x in cases]), made), S.StructType([S.StructField(n, k) for n, (_, k) in zip(names, parts)])
    return reduce(lambda later, x: F.when(x[0], to_variant(x[1], x[2])).otherwise(later), reversed(cases), F.lit(None).cast("variant")), S.VariantType()


def _union(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options, wrong: Column) -> Compiled:
    if t.items and all(a.kind == "literal" for a in t.items) and not isinstance(kind, S.VariantType):
        values = [a.value for a in t.items if isinstance(a.value, str) == isinstance(kind, S.StringType) and isinstance(a.value, bool) == isinstance(kind, S.BooleanType)]
        ok = c.isin(values) if values else F.lit(False)
        return Compiled(ok, c, F.when(F.coalesce(ok, F.lit(False)), none()).otherwise(wrong), kind)
    what = t.message or label(t)
    named = isinstance(kind, S.StructType) and t.value in kind.names
    if t.value and (named or isinstance(kind, S.VariantType)):
        cases, ok, errors = [], F.lit(False), wrong
        for arm in reversed(t.items):
            # Another arm's fields are absent in the struct that holds all arms, so they don't count as unknown.
            made = compile_type(arm, c, kind, path, opts)
            value = dict(arm.fields)[t.value].value
            if named:
                here = _equals(c[t.value], kind[t.value].dataType, value)
            else:
                got, got_kind = _lift(Type("literal", value=value), F.try_variant_get(c, f"$[{json.dumps(t.value)}]", "variant"), replace(opts, from_=None))
                here = _equals(got, got_kind, value)
            here = F.coalesce(here, F.lit(False))
            cases.insert(0, (here, made.data, made.kind))
            ok, errors = F.when(here, made.ok).otherwise(ok), F.when(here, errors_of(made)).otherwise(errors)
        data, out = _one_type(cases, c, kind)
        return Compiled(c.isNotNull() & ok, data, errors, out)
    # First without coercion, then with it; the first arm that takes the value gives the result.
    passes = [opts] if opts.wire or not opts.from_ else [replace(opts, from_=None), opts]
    made = [compile_type(arm, c, kind, path, o) for o in passes for arm in t.items]
    taken = [F.coalesce(m.ok, F.lit(False)) for m in made]
    ok = reduce(lambda x, y: x | y, taken)
    data, out = _one_type([(test, m.data, m.kind) for test, m in zip(taken, made)], c, kind)
    issues = joined([m.errors for m in made[-len(t.items) :]])
    wrong = error(path, c, kind, what, issues)
    more, holds = [], ok
    for check in t.checks:
        held, errors = constraint(check, t, data, out, path, opts)
        holds = holds & held
        more.append(errors)
    return Compiled(holds, data, F.when(ok, joined(more) if more else none()).otherwise(wrong), out)


def _all(t: Type, c: Column, kind: S.DataType, path: Path, opts: Options) -> Compiled:
    """A value that is of all types: objects are merged, of other values the last type gives the result."""
    made = [compile_type(x, c, kind, path, replace(opts, mode="strip") if x.kind == "object" else opts) for x in t.items]
    ok = reduce(lambda x, y: x & y, [m.ok for m in made])
    data, out = made[-1].data, made[-1].kind
    if all(isinstance(m.kind, S.StructType) for m in made):
        fields = {f.name: (m.data[f.name], f.dataType) for m in made for f in m.kind.fields}
        data = F.when(c.isNotNull(), F.struct(*(v.alias(n) for n, (v, _) in fields.items())))
        out = S.StructType([S.StructField(n, k) for n, (_, k) in fields.items()])
    return Compiled(ok, data, joined([m.errors for m in made]), out)
