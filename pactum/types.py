"""Contracts: a small tree of types, constraints, transforms and defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


class ContractError(ValueError):
    """A contract that cannot be compiled."""


class ContractCompileError(ContractError):
    """Defaults or literals of a contract that break its own constraints; diagnostics lists them all."""

    def __init__(self, found: list[str]):
        super().__init__("; ".join(found))
        self.diagnostics = found


@dataclass(frozen=True)
class Check:
    name: str
    args: tuple = ()
    message: str | None = None


@dataclass(frozen=True)
class Type:
    kind: str
    checks: tuple[Check, ...] = ()
    transforms: tuple[tuple[str, Any], ...] = ()
    default: Any = field(default=None)
    has_default: bool = False
    optional: bool = False
    nullable: bool = False
    fields: tuple[tuple[str, Type], ...] = ()
    items: tuple[Type, ...] = ()
    value: Any = None
    message: str | None = None
    tags: tuple[str, ...] = ()
    brand: str | None = None

    def _with(self, name: str, *args, message: str | None = None) -> Type:
        return replace(self, checks=(*self.checks, Check(name, args, message)))

    def min_length(self, n, message=None): return self._with("MinLength", n, message=message)  # noqa: E704
    def max_length(self, n, message=None): return self._with("MaxLength", n, message=message)  # noqa: E704
    def length(self, a, b): return self.min_length(a).max_length(b)  # noqa: E704
    def pattern(self, source, message=None): return self._with("Pattern", source, message=message)  # noqa: E704
    def format(self, name, message=None): return self._with("Format", name, message=message)  # noqa: E704
    def minimum(self, n, message=None): return self._with("Minimum", n, message=message)  # noqa: E704
    def maximum(self, n, message=None): return self._with("Maximum", n, message=message)  # noqa: E704
    def exclusive_minimum(self, n, message=None): return self._with("ExclusiveMinimum", n, message=message)  # noqa: E704
    def exclusive_maximum(self, n, message=None): return self._with("ExclusiveMaximum", n, message=message)  # noqa: E704
    def range(self, a, b): return self.minimum(a).maximum(b)  # noqa: E704
    def multiple_of(self, n, message=None): return self._with("MultipleOf", n, message=message)  # noqa: E704
    def min_items(self, n, message=None): return self._with("MinItems", n, message=message)  # noqa: E704
    def max_items(self, n, message=None): return self._with("MaxItems", n, message=message)  # noqa: E704
    def unique_items(self, message=None): return self._with("UniqueItems", message=message)  # noqa: E704
    def min_properties(self, n, message=None): return self._with("MinProperties", n, message=message)  # noqa: E704
    def max_properties(self, n, message=None): return self._with("MaxProperties", n, message=message)  # noqa: E704
    def properties_range(self, a, b): return self.min_properties(a).max_properties(b)  # noqa: E704
    def property_names(self, t, message=None): return self._with("PropertyNames", t, message=message)  # noqa: E704
    def custom(self, fn: Callable, message=None): return self._with("Custom", fn, message=message)  # noqa: E704
    def requires(self, *paths, message=None): return self._with("Requires", paths, message=message)  # noqa: E704
    def fallback_message(self, message): return replace(self, message=message)  # noqa: E704
    def trim(self): return self.transform("Trim")  # noqa: E704
    def lower(self): return self.transform("LowerCase")  # noqa: E704
    def upper(self): return self.transform("UpperCase")  # noqa: E704
    def capitalize(self): return self.transform("Capitalize")  # noqa: E704
    def to_number(self): return self.transform("ToNumber")  # noqa: E704
    def to_boolean(self): return self.transform("ToBoolean")  # noqa: E704
    def to_date(self): return self.transform("ToDate")  # noqa: E704
    def map(self, fn): return self.transform("Custom", fn)  # noqa: E704
    def branded(self, name): return replace(self, brand=name)  # noqa: E704
    def tag(self, *names): return replace(self, tags=tuple(sorted({*self.tags, *names})))  # noqa: E704
    def opt(self): return replace(self, optional=True)  # noqa: E704
    def null(self): return replace(self, nullable=True)  # noqa: E704
    def nullish(self): return replace(self, optional=True, nullable=True)  # noqa: E704

    def contains(self, t: Type, least: int = 1, most: int | None = None, message=None) -> Type:
        return self._with("Contains", t, least, most, message=message)

    def transform(self, name: str, fn=None) -> Type:
        return replace(self, transforms=(*self.transforms, (name, fn)))

    def with_default(self, value) -> Type:
        return replace(self, default=value, has_default=True, optional=True)


string, number, integer, bigint, boolean = (Type(k) for k in ("string", "number", "integer", "bigint", "boolean"))
null, anything, never, date, binary, regexp = (Type(k) for k in ("null", "any", "never", "date", "binary", "regexp"))


def literal(value) -> Type:
    return Type("literal", value=value)


def template(*parts: str | Type) -> Type:
    """Text that is made of the parts in turn; types stand for any text of theirs."""
    return Type("template", items=tuple(literal(p) if isinstance(p, str) else p for p in parts))


def array(item: Type) -> Type:
    return Type("array", items=(item,))


def set_of(item: Type) -> Type:
    return Type("set", items=(item,))


def tuple_of(*items: Type) -> Type:
    return Type("tuple", items=items)


def record(value: Type) -> Type:
    return Type("record", items=(string, value))


def map_of(key: Type, value: Type) -> Type:
    return Type("map", items=(key, value))


def obj(extra: Type | None = None, **fields: Type) -> Type:
    """An object; extra is the type of undeclared keys, else they follow the mode."""
    return Type("object", fields=tuple(fields.items()), value=extra)


def union(*arms: Type | str | int | float | bool | None) -> Type:
    """Unions with null become nullable, unions of objects with one literal key each are told apart by it."""
    types = [null if a is None else a if isinstance(a, Type) else literal(a) for a in arms]
    rest = [t for t in types if t.kind != "null"]
    out = rest[0] if len(rest) == 1 else Type("union", items=tuple(rest), value=tag_of(rest))
    return replace(out, nullable=True) if len(rest) < len(types) else out


def enum(*values) -> Type:
    return union(*values)


def tag_of(arms: list[Type]) -> str | None:
    """The key that has a different literal in every arm."""
    if not arms or any(a.kind != "object" for a in arms):
        return None
    for key, first in arms[0].fields:
        found = [dict(a.fields).get(key) for a in arms]
        if first.kind == "literal" and all(f is not None and f.kind == "literal" for f in found) and len({(type(f.value), f.value) for f in found}) == len(arms):
            return key
    return None


def intersection(*members: Type) -> Type:
    """Objects are merged into one, and a later member's field wins; a value of other types is of each of them."""
    if any(m.kind != "object" for m in members):
        return Type("all", items=members)
    fields: dict[str, Type] = {}
    for m in members:
        fields.update(m.fields)
    return Type("object", fields=tuple(fields.items()), checks=tuple(c for m in members for c in m.checks), value=next((m.value for m in reversed(members) if m.value), None))


def with_modifiers(t: Type, changes: dict[str, Callable[[Type], Type]]) -> Type:
    """The type with the fields at dotted paths changed."""
    for path, change in changes.items():
        t = _change(t, path.split("."), change, path)
    return t


def _change(t: Type, parts: list[str], change, path: str) -> Type:
    if not parts:
        return change(t)
    if parts[0] not in dict(t.fields):
        raise ContractError(f"no field at {path}")
    return replace(t, fields=tuple((k, _change(f, parts[1:], change, path) if k == parts[0] else f) for k, f in t.fields))


def resolve_defaults(t: Type) -> Type:
    """The output type: what has a default is always there."""
    return replace(t, optional=t.optional and not t.has_default, fields=tuple((k, resolve_defaults(f)) for k, f in t.fields), items=tuple(map(resolve_defaults, t.items)))


def label(t: Type) -> str:
    """The error of a value that isn't of the type."""
    names = {"array": "Array", "set": "Set", "map": "Map", "record": "Object", "object": "Object", "date": "Date", "binary": "Buffer", "regexp": "RegExp"}
    if t.kind == "literal":
        return f"Literal<{text_of(t.value)}>"
    if t.kind == "union":
        return "Type<" + "|".join(text_of(a.value) if a.kind == "literal" else names.get(a.kind, a.kind) for a in t.items) + ">"
    if t.kind == "tuple":
        return f"Tuple<{len(t.items)}>"
    if t.kind == "template":
        return "`" + "".join(str(p.value) if p.kind == "literal" else "${" + p.kind + "}" for p in t.items) + "`"
    return f"Type<{names.get(t.kind, t.kind)}>"


def text_of(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return f"'{value}'" if isinstance(value, str) else f"{value:g}" if isinstance(value, float) else str(value)


def code(check: Check) -> str:
    if check.name == "Custom":
        name = getattr(check.args[0], "__name__", "")
        return f"Custom<{name}>" if name and name != "<lambda>" else "Custom"
    if check.name == "UniqueItems":
        return "UniqueItems"
    first = check.args[0]
    return f"{check.name}<{first if isinstance(first, str) else text_of(first)}>"
