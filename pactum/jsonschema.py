"""JSON Schema over JSON texts, and schemas made from contracts.

A schema without recursion is compiled to Columns over VARIANT (schema_columns). What expressions cannot say, recursive
references, dynamic anchors, unevaluated keys that depend on which branches succeed, contents and coercion, is compiled
once to closures and run in one Arrow-batched UDF. Each evaluation gives the errors and the keys and items it covered.
"""

from __future__ import annotations

import base64
import copy
import functools
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import formats
from pactum.types import ContractError, Type

_KINDS = {"string", "number", "integer", "boolean", "null", "array", "object"}
_TYPESCRIPT = {"Date", "RegExp", "bigint", "undefined", "Set", "Map", "Promise", "Buffer", "ArrayBuffer", "SharedArrayBuffer", "DataView", *(f"{a}{n}Array" for a, n in (("Uint", 8), ("Uint", 16), ("Uint", 32), ("Int", 8), ("Int", 16), ("Int", 32), ("Float", 32), ("Float", 64)))}


class Seen:
    """The errors (path, value, code, issues) of an evaluation, and the keys and items that a successful one has covered."""

    __slots__ = ("errors", "keys", "items")

    def __init__(self):
        self.errors, self.keys, self.items = [], set(), set()

    def apply(self, got: Seen) -> None:
        self.errors += got.errors
        if not got.errors:
            self.cover(got)

    def cover(self, got: Seen) -> None:
        self.keys |= got.keys
        self.items |= got.items


_OF = {type(None): "null", bool: "boolean", str: "string", list: "array", dict: "object", int: "number", float: "number"}


def kind_of(v) -> str:
    return _OF[type(v)]


def canonical(v) -> str:
    """Text that equal values share: numbers by value, keys in order."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, float) and v.is_integer() and math.copysign(1, v) * abs(v) < 1e300:
        return "-0" if v == 0 and math.copysign(1, v) < 0 else str(int(v))
    return json.dumps(v)


def is_multiple(v, n) -> bool:
    if n == 0:
        return False
    if isinstance(v, int) and isinstance(n, int):
        return v % n == 0
    q = v / n
    return math.isinf(q) or abs(q - round(q)) <= 1e-8 * max(1.0, abs(q))


def is_closed(s) -> bool:
    """Whether an object schema names all the keys it allows: an explicit object type does unless it says otherwise or
    leaves it to unevaluatedProperties."""
    return isinstance(s, dict) and s.get("type") == "object" and s.get("additionalProperties", "unevaluatedProperties" in s) is False


def opened(members: list) -> tuple[list, dict | None]:
    """The members of an allOf with their own closed roots opened, and the keys allowed where all are closed."""
    out = [{**s, "additionalProperties": True} if is_closed(s) else s for s in members]
    if not members or not all(map(is_closed, members)):
        return out, None
    return out, {"properties": {k for s in members for k in s.get("properties", {})}, "patterns": [p for s in members for p in s.get("patternProperties", {})]}


def child_path(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


class Schema:
    """A compiled schema. mode: what becomes of keys that a closed object doesn't name. from_: None, 'json' or 'query',
    the texts that count as dates, expressions, large integers, and with 'query' as numbers, booleans and lists."""

    def __init__(self, root, mode: str = "strict", from_: str | None = None):
        if not isinstance(root, (dict, bool)):
            raise ContractError("a schema is an object or a boolean")
        self.root, self.mode, self.from_, self.anchors, self.dynamic, self.known = root, mode, from_, {}, {}, {}
        self._collect(root)

    def _collect(self, s) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x)
        elif isinstance(s, dict):
            for name, table in (("$anchor", self.anchors), ("$dynamicAnchor", self.dynamic)):
                if isinstance(s.get(name), str):
                    table.setdefault(s[name], s)
            kinds = s.get("type")
            for k in kinds if isinstance(kinds, list) else [kinds]:
                if isinstance(k, str) and k not in _KINDS and "type" in s and not isinstance(s.get("properties"), str):
                    raise ContractError(f"unknown type {k}")
            if "x-typescript-type" in s and s["x-typescript-type"] not in _TYPESCRIPT:
                raise ContractError(f"Unsupported x-typescript-type: {s['x-typescript-type']}")
            for key, x in s.items():
                if key in ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies"):
                    self._collect(list(x.values()) if isinstance(x, dict) else x)
                elif key not in ("enum", "const", "default", "examples", "required", "type"):
                    self._collect(x)

    def target(self, ref: str):
        if ref.startswith(("http:", "https:")):
            raise ContractError(f"remote reference {ref}")
        if ref in ("#", ""):
            return self.root
        if ref.startswith("#/"):
            at = self.root
            for part in ref[2:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                try:
                    at = at[int(part)] if isinstance(at, list) else at[part]
                except (KeyError, IndexError, ValueError, TypeError):
                    raise ContractError(f"no schema at {ref}") from None
            return at
        name = ref.lstrip("#")
        if name in self.anchors or name in self.dynamic:
            return self.anchors.get(name, self.dynamic.get(name))
        raise ContractError(f"no schema at {ref}")

    def errors(self, v) -> list[tuple]:
        """(path, value, code) of each error, in order."""
        return [e[:3] for e in self.check(self.root, v, "").errors]

    def check(self, s, v, path: str) -> Seen:
        return self.compiled(s)(v, path)

    def compiled(self, s):
        """The schema as a function of a value and its path; one that is being compiled is looked up when it is called."""
        if s is True:
            return lambda v, path: Seen()
        if s is False:
            return _nothing
        key = id(s)
        if key not in self.known:
            self.known[key] = lambda v, path: self.known[key](v, path)
            self.known[key] = self._node(s)
        return self.known[key]

    def _node(self, s: dict):
        steps = []
        if "$ref" in s:
            steps.append(_applied(self.compiled(self.target(s["$ref"]))))
        if "$dynamicRef" in s:
            steps.append(_applied(self.compiled(self.dynamic.get(s["$dynamicRef"].lstrip("#")) or self.target(s["$dynamicRef"]))))
        if "$recursiveRef" in s:
            steps.append(_applied(self.compiled(self.root)))
        if "x-typescript-type" in s:
            steps.append(self._special(s))
        if "allOf" in s:
            members, keys = opened(s["allOf"])
            self.held = getattr(self, "held", []) + [members]  # ids of schemas stay theirs
            steps += [_applied(self.compiled(x)) for x in members]
            if keys is not None and self.mode == "strict":
                steps.append(_only(keys))
        for name, code in (("anyOf", "Type<Union>"), ("oneOf", "Type<OneOf>")):
            if name in s:
                steps.append(_choice([self.compiled(x) for x in s[name]], name == "oneOf", code))
        kinds = s.get("type")
        wanted = None if kinds is None else frozenset(kinds if isinstance(kinds, list) else [kinds])
        wrong = f"Type<{kinds}>" if isinstance(kinds, str) else "Type<Union>"
        own = {k: f for k, f in (("string", self._string(s)), ("number", self._number(s)), ("array", self._array(s)), ("object", self._object(s))) if f is not None}
        last = self._finish(s)

        def run(v, path):
            out = Seen()
            for step in steps:
                step(v, path, out)
            kind = _OF[type(v)]
            if wanted is not None and kind not in wanted and not ("integer" in wanted and kind == "number" and float(v).is_integer()):
                out.errors.append((path, v, wrong))
                return out
            if kind in own:
                own[kind](v, path, out)
            for step in last:
                step(v, path, out)
            return out

        return run

    def _special(self, s: dict):
        name, revive = s["x-typescript-type"], self.from_ in ("json", "query")
        code = "Type<RegExp>" if name == "RegExp" else f"Type<{name}>"
        items = self.compiled(s["items"]) if isinstance(s.get("items"), (dict, bool)) else None
        value = self.compiled(s["value"]) if "value" in s else None
        keys = self.compiled(s["key"]) if "key" in s else None

        def run(v, path, out):
            good = False
            if revive and name == "Date":
                good = isinstance(v, str) and _date(v)
            elif revive and name == "RegExp":
                source = v["source"] if isinstance(v, dict) and isinstance(v.get("source"), str) else found[1] if isinstance(v, str) and (found := re.fullmatch(r"(?s)/(.*)/[gimuy]*", v)) else v if isinstance(v, str) and self.from_ == "query" else None
                good = source is not None and formats.safe_pattern(source)
            elif revive and name == "bigint":
                good = isinstance(v, str) and re.fullmatch(r"\s*[+-]?[0-9]+\s*", v) is not None or _OF[type(v)] == "number" and float(v).is_integer()
            elif revive and name == "Set":
                good = isinstance(v, list)
            elif revive and name == "Map":
                good = isinstance(v, dict) or isinstance(v, list) and all(isinstance(x, list) and len(x) == 2 for x in v)
            if not good:
                out.errors.append((path, v, code))
            elif name == "Set" and items:
                for i, x in enumerate(v):
                    out.errors += items(x, f"{path}[{i}]").errors
            elif name == "Map":
                for k, x in v.items() if isinstance(v, dict) else v:
                    if keys:
                        out.errors += keys(k, f"{path}.key({k})").errors
                    if value:
                        out.errors += value(x, f"{path}[{k}]").errors

        return run

    def _string(self, s: dict):
        if not s.keys() & {"minLength", "maxLength", "pattern", "format", "contentEncoding", "contentMediaType", "contentSchema"}:
            return None
        least, most, pattern, name = s.get("minLength", 0), s.get("maxLength", math.inf), s.get("pattern"), s.get("format")
        search = _compiled(pattern).search if pattern is not None else None
        encoding, media, content = s.get("contentEncoding"), s.get("contentMediaType"), self.compiled(s["contentSchema"]) if "contentSchema" in s else None

        def run(v, path, out):
            size = len(v) if v.isascii() else len(v.encode("utf-16-le")) // 2
            add = lambda code: out.errors.append((path, v, code))
            if size < least:
                add(f"MinLength<{least}>")
            if size > most:
                add(f"MaxLength<{most}>")
            if search is not None and (size > formats.LONGEST_SUBJECT or not search(v)):
                add(f"Pattern<{pattern}>")
            if name is not None and not formats.has_format(name, v):
                add(f"Format<{name}>")
            decoded = v
            if encoding in ("base64", "base64url"):
                try:
                    raw = base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4 if encoding == "base64url" else 0), validate=True)
                    decoded = raw.decode("utf-8", "replace")
                except ValueError:
                    return add("ContentEncoding")
            if media == "application/json" or content is not None:
                try:
                    decoded = json.loads(decoded)
                except ValueError:
                    return add("ContentMediaType")
                if content is not None:
                    out.errors += content(decoded, path).errors

        return run

    def _number(self, s: dict):
        tests = []
        for key, code, broken in _bounds(s):
            test = {"<": lambda v, n: v < n, "<=": lambda v, n: v <= n, ">": lambda v, n: v > n, ">=": lambda v, n: v >= n, "multiple": lambda v, n: not is_multiple(v, n)}[broken]
            tests.append((test, s[key], f"{code}<{s[key]}>"))
        if not tests:
            return None

        def run(v, path, out):
            for test, n, code in tests:
                if test(v, n):
                    out.errors.append((path, v, code))

        return run

    def _array(self, s: dict):
        if not s.keys() & {"items", "prefixItems", "contains", "minItems", "maxItems", "uniqueItems", "additionalItems"}:
            return None
        first, rest = _items(s)
        first = [self.compiled(x) for x in first]
        closed, rest = rest is False, None if rest is None or rest is False else self.compiled(rest)
        has, least, most = self.compiled(s["contains"]) if "contains" in s else None, s.get("minContains", 1), s.get("maxContains", math.inf)
        fewest, many, unique = s.get("minItems", 0), s.get("maxItems", math.inf), s.get("uniqueItems")

        def run(v, path, out):
            for i, x in enumerate(v):
                if i < len(first):
                    out.errors += first[i](x, f"{path}[{i}]").errors
                    out.items.add(i)
                elif closed:
                    out.errors.append((f"{path}[{i}]", x, f"AdditionalItem<{i}>"))
                elif rest is not None:
                    out.errors += rest(x, f"{path}[{i}]").errors
                    out.items.add(i)
            if has is not None:
                good = [i for i, x in enumerate(v) if not has(x, "").errors]
                out.items.update(good)
                if len(good) < least:
                    out.errors.append((path, v, f"Contains<min:{least}>"))
                if len(good) > most:
                    out.errors.append((path, v, f"Contains<max:{most}>"))
            if len(v) < fewest:
                out.errors.append((path, v, f"MinItems<{fewest}>"))
            if len(v) > many:
                out.errors.append((path, v, f"MaxItems<{many}>"))
            if unique and len(set(map(canonical, v))) < len(v):
                out.errors.append((path, v, "UniqueItems"))

        return run

    def _object(self, s: dict):
        if s.get("type") != "object" and not s.keys() & {"properties", "required", "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "dependencies"}:
            return None
        declared = [(k, self.compiled(sub), _missing(k, sub) if k in s.get("required", ()) else None) for k, sub in s.get("properties", {}).items()]
        required = [k for k in s.get("required", ()) if k not in s.get("properties", {})]
        names = self.compiled(s["propertyNames"]) if "propertyNames" in s else None
        patterns = [(_compiled(source).search, self.compiled(sub)) for source, sub in s.get("patternProperties", {}).items()]
        known = set(s.get("properties", {}))
        extra = False if is_closed(s) else s.get("additionalProperties")
        closed, extra = extra is False, None if extra is None or extra is False else self.compiled(extra)
        strict = closed and self.mode == "strict"
        fewest, most = s.get("minProperties", 0), s.get("maxProperties", math.inf)
        needs = [(k, need if isinstance(need, list) else self.compiled(need)) for k, need in _dependent(s)]

        def run(v, path, out):
            for k, sub, missing in declared:
                if k in v:
                    out.errors += sub(v[k], child_path(path, k)).errors
                    out.keys.add(k)
                elif missing:
                    out.errors.append((child_path(path, k), None, missing))
            for k in required:
                if k not in v:
                    out.errors.append((child_path(path, k), None, f"Required<{k}>"))
            if names is not None:
                for k in v:
                    out.errors += [(child_path(path, k), k, e[2]) for e in names(k, child_path(path, k)).errors]
            for search, sub in patterns:
                for k in v:
                    if search(k):
                        out.errors += sub(v[k], child_path(path, k)).errors
                        out.keys.add(k)
            if strict or extra is not None:
                for k in v:
                    if k not in known and not any(search(k) for search, _ in patterns):
                        if strict:
                            out.errors.append((path, v[k], f"PropertyNotAllowed<{k}>"))
                        else:
                            out.errors += extra(v[k], child_path(path, k)).errors
                            out.keys.add(k)
            if len(v) < fewest:
                out.errors.append((path, v, f"MinProperties<{fewest}>"))
            if len(v) > most:
                out.errors.append((path, v, f"MaxProperties<{most}>"))
            for k, need in needs:
                if k in v:
                    if isinstance(need, list):
                        out.errors += [(child_path(path, d), None, f"Required<{d}>") for d in need if d not in v]
                    else:
                        out.apply(need(v, path))

        return run

    def _finish(self, s: dict) -> list:
        """What is checked last, in this order: not, if, unevaluated keys and items, enum, const."""
        steps = []
        if "not" in s:
            refused = self.compiled(s["not"])

            def negate(v, path, out):
                if not out.errors and not refused(v, path).errors:
                    out.errors.append((path, v, "Schema<not>"))

            steps.append(negate)
        if "if" in s:
            test, then, otherwise = self.compiled(s["if"]), *(self.compiled(s[k]) if k in s else None for k in ("then", "else"))

            def branch(v, path, out):
                got = test(v, path)
                if not got.errors:
                    out.cover(got)
                taken = otherwise if got.errors else then
                if taken is not None:
                    out.apply(taken(v, path))

            steps.append(branch)
        if "unevaluatedProperties" in s:
            steps.append(self._unevaluated(s["unevaluatedProperties"], dict))
        if "unevaluatedItems" in s:
            steps.append(self._unevaluated(s["unevaluatedItems"], list))
        for keyword, code, values in (("enum", "Enum", s.get("enum")), ("const", "Const", [s.get("const")])):
            if keyword in s:
                steps.append(_among(set(map(canonical, values)), f"{code}<{'|'.join(map(json.dumps, values))}>"))
        return steps

    def _unevaluated(self, sub, kind):
        check = None if sub is False else self.compiled(sub)

        def run(v, path, out):
            if not isinstance(v, kind):
                return
            done = out.keys if kind is dict else out.items
            for k in [k for k in (v if kind is dict else range(len(v))) if k not in done]:
                at = child_path(path, k) if kind is dict else f"{path}[{k}]"
                if check is None:
                    out.errors.append((path, v[k], f"UnevaluatedProperty<{k}>" if kind is dict else f"UnevaluatedItem<{k}>"))
                else:
                    out.errors += check(v[k], at).errors
                done.add(k)

        return run

    # What validateSchema makes of a value: defaults and coercion before the check, unknown keys out after it.

    def prepared(self, s, v):
        """The value with defaults filled in and, where texts may be coerced, of the types the schema names."""
        if not isinstance(s, dict):
            return v
        for ref in ("$ref", "$dynamicRef", "$recursiveRef"):
            if ref in s:
                v = self.prepared(self.root if ref == "$recursiveRef" else self.target(s[ref]), v)
        for sub in s.get("allOf", ()):
            v = self.prepared(sub, v)
        for name in ("anyOf", "oneOf"):
            if name in s:
                # Arms are tried as they are first, then with coercion.
                made = (self.prepared(sub, copy.deepcopy(v)) for sub in s[name])
                plain = next((v for sub in s[name] if not self.check(sub, v, "").errors), None)
                v = plain if plain is not None else next((x for sub, x in zip(s[name], made) if not self.check(sub, x, "").errors), v)
        kinds = s.get("type")
        if self.from_ == "query" and isinstance(kinds, str):
            v = _coerced(kinds, v)
        if isinstance(v, dict):
            for k, sub in s.get("properties", {}).items():
                if k in v:
                    v[k] = self.prepared(sub, v[k])
                elif isinstance(sub, dict) and "default" in sub:
                    v[k] = self.prepared(sub, copy.deepcopy(sub["default"]))
            extra = s.get("additionalProperties")
            for k in v:
                if k not in s.get("properties", {}):
                    for source, sub in s.get("patternProperties", {}).items():
                        if _compiled(source).search(k):
                            v[k] = self.prepared(sub, v[k])
                    if isinstance(extra, dict):
                        v[k] = self.prepared(extra, v[k])
        elif isinstance(v, list):
            first, rest = _items(s)
            v = [self.prepared(first[i] if i < len(first) else rest, x) for i, x in enumerate(v)]
        return v

    def stripped(self, s, v):
        """The value without the keys that closed objects don't name."""
        if not isinstance(s, dict):
            return v
        for ref in ("$ref", "$dynamicRef", "$recursiveRef"):
            if ref in s:
                v = self.stripped(self.root if ref == "$recursiveRef" else self.target(s[ref]), v)
        if "allOf" in s:
            members, keys = opened(s["allOf"])
            for sub in members:
                v = self.stripped(sub, v)
            if keys is not None and isinstance(v, dict):
                v = {k: x for k, x in v.items() if k in keys["properties"] or any(_compiled(p).search(k) for p in keys["patterns"])}
        for name in ("anyOf", "oneOf"):
            if name in s:
                arm = next((sub for sub in s[name] if not self.check(sub, v, "").errors), None)
                v = v if arm is None else self.stripped(arm, v)
        if isinstance(v, dict):
            declared, patterns = s.get("properties", {}), s.get("patternProperties", {})
            closed, extra, out = is_closed(s) or s.get("additionalProperties") is False, s.get("additionalProperties"), {}
            for k, x in v.items():
                fits = [sub for source, sub in patterns.items() if _compiled(source).search(k)]
                if k in declared or fits:
                    for sub in ([declared[k]] if k in declared else []) + fits:
                        x = self.stripped(sub, x)
                    out[k] = x
                elif not closed:
                    out[k] = self.stripped(extra, x) if isinstance(extra, dict) else x
            return out
        if isinstance(v, list):
            first, rest = _items(s)
            return [self.stripped(first[i] if i < len(first) else rest, x) for i, x in enumerate(v)]
        return v

    def result(self, v):
        """(errors, data): the errors of the prepared value, and what becomes of it if there are none."""
        v = self.prepared(self.root, v)
        found = self.check(self.root, v, "").errors
        return found, (self.stripped(self.root, v) if self.mode == "strip" and not found else v)


def _nothing(v, path):
    out = Seen()
    out.errors.append((path, v, "Schema<false>"))
    return out


def _applied(check):
    return lambda v, path, out: out.apply(check(v, path))


def _only(keys: dict):
    searches = [_compiled(p).search for p in keys["patterns"]]

    def run(v, path, out):
        if isinstance(v, dict):
            for k in v:
                if k not in keys["properties"] and not any(search(k) for search in searches):
                    out.errors.append((path, v[k], f"PropertyNotAllowed<{k}>"))

    return run


def _choice(arms: list, one: bool, code: str):
    def run(v, path, out):
        tried = [arm(v, path) for arm in arms]
        good = [t for t in tried if not t.errors]
        if not good:
            out.errors.append((path, v, code, [e for t in tried for e in t.errors]))
        elif one and len(good) > 1:
            out.errors.append((path, v, "Type<OneOf:multiple>"))
        else:
            for t in good:
                out.cover(t)

    return run


def _among(wanted: set, code: str):
    def run(v, path, out):
        if canonical(v) not in wanted:
            out.errors.append((path, v, code))

    return run


def _missing(key: str, sub) -> str:
    return f"Type<{sub['type']}>" if isinstance(sub, dict) and isinstance(sub.get("type"), str) else f"Required<{key}>"


def _items(s: dict) -> tuple[list, object]:
    """The schemas of the first items, and that of the rest."""
    if isinstance(s.get("items"), list):
        return s["items"], s.get("additionalItems")
    return s.get("prefixItems") or [], s.get("items")


def _dependent(s: dict) -> list:
    return list({**s.get("dependentRequired", {}), **s.get("dependentSchemas", {}), **s.get("dependencies", {})}.items())


def _bounds(s: dict) -> list[tuple[str, str, str]]:
    """(keyword, code, how a number breaks it); draft 4 has the exclusive ones as flags."""
    low, high = s.get("exclusiveMinimum"), s.get("exclusiveMaximum")
    out = [("minimum", "ExclusiveMinimum" if low is True else "Minimum", "<=" if low is True else "<"), ("maximum", "ExclusiveMaximum" if high is True else "Maximum", ">=" if high is True else ">")]
    out += [(key, code, test) for key, code, test, n in (("exclusiveMinimum", "ExclusiveMinimum", "<=", low), ("exclusiveMaximum", "ExclusiveMaximum", ">=", high)) if not isinstance(n, bool)]
    return [x for x in [*out, ("multipleOf", "MultipleOf", "multiple")] if x[0] in s]


def _date(text: str) -> bool:
    from datetime import datetime

    try:
        datetime.fromisoformat(text)
    except ValueError:
        return re.fullmatch(r"[0-9]{4}-(?:0[1-9]|1[0-2])", text) is not None
    return True


def _coerced(kind: str, v):
    if kind in ("number", "integer") and isinstance(v, str):
        text = v.strip()
        if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text):
            n = float(text)
            return v if math.isinf(n) else int(n) if n.is_integer() else n
    if kind == "boolean" and isinstance(v, (str, int, float)) and not isinstance(v, bool):
        low = str(v).lower()
        return True if low in ("true", "1", "yes", "on") else False if low in ("false", "0", "no", "off") else v
    if kind == "array" and not isinstance(v, (list, dict)) and v is not None:
        return [v]
    return v


@functools.cache
def _compiled(source: str):
    if not formats.safe_pattern(source):
        raise ContractError(f"unsafe pattern {source!r}")
    return re.compile(formats.python_pattern(source))


@functools.lru_cache(256)
def _schema(text: str, mode: str, from_: str | None = None) -> Schema:
    made = Schema(json.loads(text), mode, from_)
    made.compiled(made.root)
    return made


def compile_schema(schema, mode: str = "strict", from_: str | None = None) -> Schema:
    """From a cache by content; a schema that cannot be compiled fails here, on the driver."""
    return _schema(json.dumps(schema, sort_keys=False), mode, from_)


_ISSUE = "struct<path:string,value:string,error:string>"
ERRORS = f"array<struct<path:string,value:string,error:string,issues:array<{_ISSUE}>>>"


def _row(e: tuple) -> tuple:
    said = lambda x: (x[0], json.dumps(x[1], ensure_ascii=False), x[2])
    return (*said(e), [said(x) for x in e[3]] if len(e) > 3 else None)


def _load(text: str):
    return json.loads(text, parse_constant=_refuse)


def _refuse(name):
    raise ValueError(name)


def _interpreted(c: Column, schema, mode: str, from_: str | None) -> Column:
    source = json.dumps(schema)

    @F.pandas_udf(ERRORS)
    def run(texts: pd.Series) -> pd.Series:
        compiled = _schema(source, mode, from_)

        def one(text):
            if text is None:
                return None
            try:
                v = _load(text)
            except (ValueError, RecursionError):
                return [("", text, "Invalid JSON", None)]
            return [_row(e) for e in compiled.check(compiled.root, v, "").errors]

        return texts.map(one)

    return run(c)


def schema_errors(c: Column, schema, mode: str = "strict", from_: str | None = None) -> Column:
    """Errors of JSON texts: array of (path, value, error, issues). A null text gives null; text that isn't JSON one error."""
    compile_schema(schema, mode, from_)
    made = schema_columns(c, schema, mode) if from_ is None else None
    if made is None:
        return _interpreted(c, schema, mode, from_)
    return F.when(c.isNotNull(), F.when(made[0], F.array().cast(ERRORS)).otherwise(made[1]))


def is_schema(c: Column, schema, mode: str = "strict", from_: str | None = None) -> Column:
    """Whether JSON texts satisfy a schema; null where the text is."""
    compile_schema(schema, mode, from_)
    made = schema_columns(c, schema, mode) if from_ is None else None
    return F.size(_interpreted(c, schema, mode, from_)) == 0 if made is None else F.when(c.isNotNull(), made[0])


def validate_schema(df: DataFrame, on: str, schema, mode: str = "strict", from_: str | None = None) -> DataFrame:
    """df with _success, _data (JSON of the value with defaults and coerced, null unless it succeeds; strip takes unknown
    keys out) and _errors, for the JSON texts of a column."""
    compile_schema(schema, mode, from_)
    source = json.dumps(schema)

    @F.pandas_udf(f"data string, errors {ERRORS}")
    def run(texts: pd.Series) -> pd.DataFrame:
        compiled, rows = _schema(source, mode, from_), []
        for text in texts:
            try:
                found, data = compiled.result(_load(text)) if text is not None else ([("", None, "Invalid JSON")], None)
                rows.append((None if found else json.dumps(data, ensure_ascii=False, separators=(",", ":")), [_row(e) for e in found]))
            except (ValueError, RecursionError):
                rows.append((None, [("", text, "Invalid JSON", None)]))
        return pd.DataFrame(rows, columns=["data", "errors"])

    made = run(F.col(f"`{on}`"))
    return df.withColumn("_made", made).withColumns({"_success": F.size("_made.errors") == 0, "_data": F.col("_made.data"), "_errors": F.col("_made.errors")}).drop("_made")


def assert_schema(df: DataFrame, on: str, schema, mode: str = "strict", from_: str | None = None, error_factory=None) -> DataFrame:
    """df, the column replaced by its data; a row that fails ends the query with its message."""
    from pactum.api import _guarded

    checked = validate_schema(df, on, schema, mode, from_)
    made = _guarded(checked, F.col("_success"), F.col("_errors"), error_factory)
    return made.withColumn(on, F.col("_data")).select(*(f"`{c}`" for c in df.columns))


def assert_guard_schema(df: DataFrame, on: str, schema, mode: str = "strict", from_: str | None = None, error_factory=None) -> DataFrame:
    """df as it is; a row that fails, or whose root is a scalar that coercion would replace, ends the query."""
    from pactum.api import _guarded

    checked = validate_schema(df, on, schema, mode, from_)
    plain = schema_errors(F.col(f"`{on}`"), schema, mode)
    scalar = F.coalesce(~F.substring(F.ltrim("_data"), 1, 1).isin("{", "["), F.lit(False))
    root = F.when(F.size(plain) > 0, plain).otherwise(F.array(F.struct(F.lit("").alias("path"), F.col(f"`{on}`").alias("value"), F.lit("RootNotRewritable").alias("error"), F.lit(None).cast(f"array<{_ISSUE}>").alias("issues"))))
    same = ~scalar | (F.to_json(F.try_parse_json(F.col(f"`{on}`"))) == F.col("_data"))
    errors = F.when(F.col("_success") & ~same, root).otherwise(F.col("_errors"))
    return _guarded(checked, F.col("_success") & same, errors, error_factory).select(*(f"`{c}`" for c in df.columns))


# --- schemas without recursion as Columns ---------------------------------------------------------------------------

#: Keywords that only the interpreter serves.
_DYNAMIC = {"$dynamicRef", "$recursiveRef", "$dynamicAnchor", "unevaluatedProperties", "unevaluatedItems", "contentEncoding", "contentMediaType", "contentSchema", "x-typescript-type", "uniqueItems"}
#: Schemas that make larger plans than this are left to the interpreter.
MOST_NODES = 200
_NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _nodes(compiled: Schema, s, above: tuple = ()) -> int | None:
    """The number of schemas that a value is checked against, or None where that has no bound or needs the interpreter."""
    if not isinstance(s, dict):
        return 1
    if s.keys() & _DYNAMIC or id(s) in above or s.get("format") == "regex" or any('"' in k or "\\" in k or "'" in k for k in s.get("properties", {})):
        return None
    subs = [compiled.target(s["$ref"])] if "$ref" in s else []
    subs += [x for k in ("allOf", "anyOf", "oneOf") for x in s.get(k, ())] + [s[k] for k in ("not", "if", "then", "else", "additionalProperties", "propertyNames", "contains") if k in s]
    subs += [*s.get("properties", {}).values(), *s.get("patternProperties", {}).values(), *(x for _, x in _dependent(s) if not isinstance(x, list))]
    first, rest = _items(s)
    total = 1
    for sub in [*subs, *first, rest]:
        n = _nodes(compiled, sub, (*above, id(s)))
        if n is None:
            return None
        total += n
    return total


def schema_columns(c: Column, schema, mode: str = "strict") -> tuple[Column, Column] | None:
    """(whether JSON texts satisfy the schema, their errors) without Python, or None where the interpreter is needed."""
    from pactum.parse import is_json

    compiled = compile_schema(schema, mode)
    size = _nodes(compiled, compiled.root)
    if size is None or size > MOST_NODES:
        return None
    made = _Columns(compiled)
    ok, errors = made.node(compiled.root, F.try_parse_json(c), "")
    bad = F.array(F.struct(F.lit("").alias("path"), c.alias("value"), F.lit("Invalid JSON").alias("error"), F.lit(None).cast(f"array<{_ISSUE}>").alias("issues")))
    good = is_json(c)
    return good & F.coalesce(ok, F.lit(False)), F.when(~good, bad).otherwise(F.array().cast(ERRORS) if errors is None else errors)


class _Columns:
    """node(): (whether a VARIANT that is there satisfies a schema, its errors or None where there can be none)."""

    def __init__(self, compiled: Schema):
        self.compiled, self.mode = compiled, compiled.mode

    @staticmethod
    def error(path, v: Column, code, issues: Column | None = None) -> Column:
        from pactum.compiler import lit

        flat = F.lit(None).cast(f"array<{_ISSUE}>") if issues is None else F.transform(issues, lambda e: F.struct(e["path"].alias("path"), e["value"].alias("value"), e["error"].alias("error")))
        return F.struct(lit(path).alias("path"), F.coalesce(F.to_json(v), F.lit("null")).alias("value"), lit(code).alias("error"), flat.alias("issues"))

    def node(self, s, v: Column, path) -> tuple[Column, Column | None]:
        from pactum.compiler import joined

        none = lambda: F.array().cast(ERRORS)
        if s is True:
            return F.lit(True), None
        if s is False:
            return F.lit(False), F.array(self.error(path, v, "Schema<false>"))
        kind = F.schema_of_variant(v)
        is_kind = {"string": kind == "STRING", "number": kind.rlike(_NUMERIC), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}
        oks, errors = [], []

        def take(got):
            oks.append(got[0])
            errors.append(got[1])

        def test(holds: Column, code, value: Column = v, at=path, issues=None):
            holds = F.coalesce(holds, F.lit(False))
            oks.append(holds)
            errors.append(F.when(holds, none()).otherwise(F.array(self.error(at, value, code, issues))))

        if "$ref" in s:
            take(self.node(self.compiled.target(s["$ref"]), v, path))
        if "allOf" in s:
            members, keys = opened(s["allOf"])
            for x in members:
                take(self.node(x, v, path))
            if keys is not None and self.mode == "strict":
                take(self._extras(v, path, sorted(keys["properties"]), keys["patterns"], is_kind["object"]))
        for name, code in (("anyOf", "Type<Union>"), ("oneOf", "Type<OneOf>")):
            if name in s:
                arms = [self.node(x, v, path) for x in s[name]]
                good = [F.coalesce(ok, F.lit(False)) for ok, _ in arms]
                count = functools.reduce(lambda x, y: x + y, [g.cast("int") for g in good], F.lit(0))
                test(count > 0, code, issues=joined([e for _, e in arms]) if any(e is not None for _, e in arms) else none())
                if name == "oneOf":
                    test(count < 2, "Type<OneOf:multiple>")
        own = self._own(s, v, path, is_kind)
        kinds = s.get("type")
        before = list(oks)
        if kinds is not None:
            wanted = kinds if isinstance(kinds, list) else [kinds]
            whole = is_kind["number"] & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double")))
            right = functools.reduce(lambda x, y: x | y, [whole if k == "integer" else is_kind[k] for k in wanted])
            test(right, f"Type<{kinds}>" if isinstance(kinds, str) else "Type<Union>")
        inner_ok, inner_errors = own
        later, last = [], []
        so_far = [*before, *inner_ok]
        if "not" in s:
            ok, _ = self.node(s["not"], v, path)
            clear = functools.reduce(lambda x, y: x & y, [F.coalesce(o, F.lit(False)) for o in so_far], F.lit(True))
            later.append(~F.coalesce(ok, F.lit(False)))
            last.append(F.when(clear & F.coalesce(ok, F.lit(False)), F.array(self.error(path, v, "Schema<not>"))).otherwise(none()))
        if "if" in s:
            ok = F.coalesce(self.node(s["if"], v, path)[0], F.lit(False))
            then, otherwise = (self.node(s.get(k, True), v, path) for k in ("then", "else"))
            later.append(F.when(ok, then[0]).otherwise(otherwise[0]))
            if then[1] is not None or otherwise[1] is not None:
                last.append(F.when(ok, none() if then[1] is None else then[1]).otherwise(none() if otherwise[1] is None else otherwise[1]))
        for keyword, code, values in (("enum", "Enum", s.get("enum")), ("const", "Const", [s.get("const")])):
            if keyword in s:
                same = functools.reduce(lambda x, y: x | y, [F.coalesce(self._equals(v, x, kind), F.lit(False)) for x in values], F.lit(False))
                later.append(same)
                last.append(F.when(same, none()).otherwise(F.array(self.error(path, v, f"{code}<{'|'.join(map(json.dumps, values))}>"))))
        if kinds is not None:
            gate = F.coalesce(right, F.lit(False))
            rest = joined([*inner_errors, *last])
            errors.append(None if rest is None else F.when(gate, rest).otherwise(none()))
        else:
            errors += [*inner_errors, *last]
        every = [*oks, *inner_ok, *later]
        return functools.reduce(lambda x, y: x & y, every) if every else F.lit(True), joined(errors)

    def _equals(self, v: Column, x, kind: Column) -> Column:
        if isinstance(x, dict):
            members = F.try_variant_get(v, "$", "map<string,variant>")
            parts = [F.coalesce(self._equals(F.try_element_at(members, F.lit(k)), y, F.schema_of_variant(F.try_element_at(members, F.lit(k)))), F.lit(False)) for k, y in x.items()]
            return functools.reduce(lambda a, b: a & b, parts, kind.startswith("OBJECT") & (F.size(members) == len(x)))
        if isinstance(x, list):
            items = F.try_variant_get(v, "$", "array<variant>")
            parts = [F.coalesce(self._equals(F.get(items, F.lit(i)), y, F.schema_of_variant(F.get(items, F.lit(i)))), F.lit(False)) for i, y in enumerate(x)]
            return functools.reduce(lambda a, b: a & b, parts, kind.startswith("ARRAY") & (F.size(items) == len(x)))
        if x is None:
            return kind == "VOID"
        if isinstance(x, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(x))
        if isinstance(x, str):
            return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(x))
        return kind.rlike(_NUMERIC) & (F.try_variant_get(v, "$", "double") == F.lit(float(x)))

    def _extras(self, v: Column, path, declared: list[str], patterns: list[str], there: Column):
        members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        unknown = F.filter(members, lambda e: functools.reduce(lambda x, y: x & y, [~e["key"].rlike(formats.java_pattern(p)) for p in patterns], ~e["key"].isin(declared) if declared else F.lit(True)))
        found = F.transform(unknown, lambda e: self.error(path, e["value"], F.concat(F.lit("PropertyNotAllowed<"), e["key"], F.lit(">"))))
        there = F.coalesce(there, F.lit(False))
        return ~there | (F.size(unknown) == 0), F.when(there, found).otherwise(F.array().cast(ERRORS))

    def _own(self, s: dict, v: Column, path, is_kind: dict) -> tuple[list[Column], list[Column]]:
        """The keywords of strings, numbers, arrays and objects; each holds for values of other kinds."""
        from pactum.compiler import child, item, utf16_length

        oks, errors = [], []
        none = lambda: F.array().cast(ERRORS)

        def add(kind: str, ok: Column, made: Column | None) -> None:
            here = F.coalesce(is_kind[kind], F.lit(False))
            oks.append(~here | F.coalesce(ok, F.lit(False)))
            if made is not None:
                errors.append(F.when(here, made).otherwise(none()))

        def test(kind: str, ok: Column, code: str, value: Column = v, at=path) -> None:
            ok = F.coalesce(ok, F.lit(False))
            add(kind, ok, F.when(ok, none()).otherwise(F.array(self.error(at, value, code))))

        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        if "minLength" in s:
            test("string", utf16_length(text) >= s["minLength"], f"MinLength<{s['minLength']}>")
        if "maxLength" in s:
            test("string", utf16_length(text) <= s["maxLength"], f"MaxLength<{s['maxLength']}>")
        if "pattern" in s:
            test("string", (utf16_length(text) <= formats.LONGEST_SUBJECT) & text.rlike(formats.java_pattern(s["pattern"])), f"Pattern<{s['pattern']}>")
        if "format" in s:
            test("string", formats.format_column(s["format"], text), f"Format<{s['format']}>")
        for key, code, broken in _bounds(s):
            n = s[key]
            q = number / float(n) if n else None
            holds = {"<": number >= n, "<=": number > n, ">": number <= n, ">=": number < n}.get(broken)
            if broken == "multiple":
                holds = (F.abs(q) == float("inf")) | (F.abs(q - F.rint(q)) <= 1e-8 * F.greatest(F.lit(1.0), F.abs(q))) if n else F.lit(False)
            test("number", holds, f"{code}<{n}>")
        items = F.try_variant_get(v, "$", "array<variant>")
        first, rest = _items(s)
        for i, sub in enumerate(first):
            x = F.get(items, F.lit(i))
            ok, made = self.node(sub, x, item(path, i))
            add("array", x.isNull() | ok, None if made is None else F.when(x.isNull(), none()).otherwise(made))
        if rest is False:
            over = F.size(items) - len(first)
            add("array", over <= 0, F.transform(F.slice(items, len(first) + 1, F.greatest(over, F.lit(0))), lambda x, i: self.error(F.concat(item(path, i + len(first))), x, F.concat(F.lit("AdditionalItem<"), (i + len(first)).cast("string"), F.lit(">")))))
        elif rest is not None and rest is not True:
            tail = F.slice(items, len(first) + 1, F.greatest(F.size(items) - len(first), F.lit(0))) if first else items
            _, made = self.node(rest, F.lit(None).cast("variant"), path)
            add("array", F.forall(tail, lambda x: F.coalesce(self.node(rest, x, "")[0], F.lit(False))), None if made is None else F.flatten(F.transform(tail, lambda x, i: self.node(rest, x, item(path, i + len(first)))[1])))
        if "contains" in s:
            count, least = F.size(F.filter(items, lambda x: F.coalesce(self.node(s["contains"], x, "")[0], F.lit(False)))), s.get("minContains", 1)
            test("array", count >= least, f"Contains<min:{least}>")
            if "maxContains" in s:
                test("array", count <= s["maxContains"], f"Contains<max:{s['maxContains']}>")
        if "minItems" in s:
            test("array", F.size(items) >= s["minItems"], f"MinItems<{s['minItems']}>")
        if "maxItems" in s:
            test("array", F.size(items) <= s["maxItems"], f"MaxItems<{s['maxItems']}>")
        declared, patterns, required = s.get("properties", {}), s.get("patternProperties", {}), s.get("required", ())
        member = lambda k: F.try_variant_get(v, f'$["{k}"]', "variant")
        absent = lambda k, code: self.error(child(path, k), F.lit(None).cast("variant"), code)
        members = F.try_variant_get(v, "$", "map<string,variant>")
        for k, sub in declared.items():
            x = member(k)
            ok, made = self.node(sub, x, child(path, k))
            if k in required:
                add("object", x.isNotNull() & ok, F.when(x.isNull(), F.array(absent(k, _missing(k, sub)))).otherwise(none() if made is None else made))
            elif sub is not True:
                add("object", x.isNull() | ok, None if made is None else F.when(x.isNull(), none()).otherwise(made))
        for k in required:
            if k not in declared:
                x = F.try_element_at(members, F.lit(k))
                add("object", x.isNotNull(), F.when(x.isNull(), F.array(absent(k, f"Required<{k}>"))).otherwise(none()))
        if "propertyNames" in s:
            named = lambda k, at: self.node(s["propertyNames"], k.cast("variant"), at)
            made = lambda k: named(k, child(path, k))[1]
            probe = named(F.lit(""), path)[1]
            add("object", F.forall(F.map_keys(members), lambda k: F.coalesce(named(k, "")[0], F.lit(False))), None if probe is None else F.flatten(F.transform(F.map_keys(members), lambda k: F.transform(made(k), lambda e: F.struct(child(path, k).alias("path"), F.to_json(k.cast("variant")).alias("value"), e["error"].alias("error"), F.lit(None).cast(f"array<{_ISSUE}>").alias("issues"))))))
        for source, sub in patterns.items():
            named = functools.partial(lambda pattern, e: e["key"].rlike(pattern), formats.java_pattern(source))
            self._each(add, F.filter(F.map_entries(members), lambda e: named(e)), sub, path)  # noqa: B023
        if is_closed(s) or s.get("additionalProperties") is False:
            if self.mode == "strict":
                ok, made = self._extras(v, path, list(declared), list(patterns), is_kind["object"])
                add("object", ok, made)
        elif isinstance(s.get("additionalProperties"), dict):
            other = F.filter(F.map_entries(members), lambda e: functools.reduce(lambda x, y: x & y, [~e["key"].rlike(formats.java_pattern(p)) for p in patterns], ~e["key"].isin(list(declared)) if declared else F.lit(True)))
            self._each(add, other, s["additionalProperties"], path)
        if "minProperties" in s:
            test("object", F.size(members) >= s["minProperties"], f"MinProperties<{s['minProperties']}>")
        if "maxProperties" in s:
            test("object", F.size(members) <= s["maxProperties"], f"MaxProperties<{s['maxProperties']}>")
        for k, need in _dependent(s):
            there = F.try_element_at(members, F.lit(k)).isNotNull()
            if isinstance(need, list):
                for d in need:
                    missing = there & F.try_element_at(members, F.lit(d)).isNull()
                    add("object", ~missing, F.when(missing, F.array(absent(d, f"Required<{d}>"))).otherwise(none()))
            else:
                ok, made = self.node(need, v, path)
                add("object", ~there | ok, None if made is None else F.when(there, made).otherwise(none()))
        return oks, errors

    def _each(self, add, entries: Column, sub, path) -> None:
        from pactum.compiler import child

        probe = self.node(sub, F.lit(None).cast("variant"), path)[1]
        ok = F.forall(entries, lambda e: F.coalesce(self.node(sub, e["value"], "")[0], F.lit(False)))
        add("object", ok, None if probe is None else F.flatten(F.transform(entries, lambda e: self.node(sub, e["value"], child(path, e["key"]))[1])))


# --- schemas from contracts -----------------------------------------------------------------------------------------

_KEYWORDS = {"MinLength": "minLength", "MaxLength": "maxLength", "Pattern": "pattern", "Format": "format", "Minimum": "minimum", "Maximum": "maximum", "ExclusiveMinimum": "exclusiveMinimum", "ExclusiveMaximum": "exclusiveMaximum", "MultipleOf": "multipleOf", "MinItems": "minItems", "MaxItems": "maxItems", "MinProperties": "minProperties", "MaxProperties": "maxProperties"}
_SPECIAL = {"date": "Date", "bigint": "bigint", "regexp": "RegExp", "binary": "Buffer"}


#: From this product of uses and complexity on an object moves to $defs.
HOIST = 128


def complexity(t: Type) -> int:
    """The number of types in a type, itself included; constraints don't count."""
    return 1 + sum(map(complexity, t.items)) + sum(complexity(f) for _, f in t.fields)


def json_schema(t: Type) -> dict | bool:
    """The JSON Schema of a contract; objects that stand in several places and are complex stand once, under $defs."""
    uses: dict[Type, int] = {}

    def count(x: Type) -> None:
        if x.kind == "object":
            base = _bare(x)
            uses[base] = uses.get(base, 0) + 1
        for sub in (*x.items, *(f for _, f in x.fields)):
            count(sub)

    count(t)
    hoisted = {x: f"Type{k}" for k, x in enumerate((x for x, n in uses.items() if n > 1 and n * complexity(x) >= HOIST and x != _bare(t)), 1)}
    out = _emit(t, hoisted)
    if hoisted and isinstance(out, dict):
        out["$defs"] = {name: _emit(x, hoisted, True) for x, name in hoisted.items()}
    return out


def _bare(t: Type) -> Type:
    """An object without what belongs to the place where it stands."""
    from dataclasses import replace

    return replace(t, optional=False, nullable=False, has_default=False, default=None, tags=(), brand=None, message=None, transforms=())


def _emit(t: Type, hoisted: dict, whole: bool = False) -> dict | bool:
    """What JSON has no type for is named by x-typescript-type."""
    json_schema = lambda x: _emit(x, hoisted)
    if not whole and t.kind == "object" and hoisted and (name := hoisted.get(_bare(t))):
        out = {"$ref": f"#/$defs/{name}"}
        if t.has_default:
            out["default"] = t.default
        return {"anyOf": [out, {"type": "null"}]} if t.nullable else out
    k = t.kind
    if k == "any":
        out: dict = {}
    elif k == "never":
        return False
    elif k in ("string", "number", "integer", "boolean", "null"):
        out = {"type": k}
    elif k in _SPECIAL:
        out = {"x-typescript-type": _SPECIAL[k]}
    elif k == "literal":
        out = {"type": kind_of(t.value), "const": t.value}
    elif k == "template":
        from pactum.compiler import _part

        out = {"type": "string", "pattern": "^" + "".join(_part(p) for p in t.items) + "$"}
    elif k == "array":
        out = {"type": "array", "items": json_schema(t.items[0])}
    elif k == "set":
        out = {"x-typescript-type": "Set", "items": json_schema(t.items[0])}
    elif k == "map":
        out = {"x-typescript-type": "Map", "key": json_schema(t.items[0]), "value": json_schema(t.items[1])}
    elif k == "tuple":
        out = {"type": "array", "items": [json_schema(i) for i in t.items], "minItems": len(t.items), "maxItems": len(t.items)}
    elif k == "record":
        out = {"type": "object", "additionalProperties": json_schema(t.items[1])}
    elif k == "union" and {True, False} == {i.value for i in t.items if i.kind == "literal" and isinstance(i.value, bool)} and len(t.items) == 2:
        out = {"type": "boolean"}
    elif k == "union":
        out = {"anyOf": [json_schema(i) for i in t.items]}
    elif k == "all":
        out = {"allOf": [json_schema(i) for i in t.items]}
    elif k == "object":
        out = {"type": "object", "properties": {n: json_schema(f) for n, f in t.fields}, "additionalProperties": json_schema(t.value) if t.value else False}
        required = [n for n, f in t.fields if not f.optional]
        if required:
            out["required"] = required
    else:
        raise ContractError(f"{k} has no JSON Schema")
    for check in t.checks:
        if check.name in _KEYWORDS:
            out[_KEYWORDS[check.name]] = check.args[0]
        elif check.name == "UniqueItems":
            out["uniqueItems"] = True
        elif check.name == "Contains":
            out["contains"] = json_schema(check.args[0])
            out |= {"minContains": check.args[1]} if check.args[1] != 1 else {}
            out |= {"maxContains": check.args[2]} if check.args[2] is not None else {}
        elif check.name == "PropertyNames":
            out["propertyNames"] = json_schema(check.args[0])
        elif check.name == "Requires":
            out["requires"] = list(check.args[0])
    if t.has_default:
        out["default"] = t.default
    if t.tags:
        out["x-tags"] = list(t.tags)
    return {"anyOf": [out, {"type": "null"}]} if t.nullable else out


def to_struct_type(t: Type):
    """The Spark type a contract's values have."""
    from pyspark.sql import types as S

    simple = {"string": S.StringType, "template": S.StringType, "number": S.DoubleType, "integer": S.LongType, "boolean": S.BooleanType, "date": S.TimestampType, "binary": S.BinaryType, "null": S.NullType}
    if t.kind in simple:
        return simple[t.kind]()
    if t.kind == "bigint":
        return S.DecimalType(38, 0)
    if t.kind == "literal":
        return S.BooleanType() if isinstance(t.value, bool) else S.StringType() if isinstance(t.value, str) else S.DoubleType()
    if t.kind in ("array", "set"):
        return S.ArrayType(to_struct_type(t.items[0]))
    if t.kind in ("record", "map"):
        return S.MapType(to_struct_type(t.items[0]), to_struct_type(t.items[1]))
    if t.kind == "tuple":
        return S.StructType([S.StructField(f"_{i}", to_struct_type(x)) for i, x in enumerate(t.items)])
    if t.kind == "object":
        return S.StructType([S.StructField(n, to_struct_type(f), f.optional or f.nullable, {"x-tags": list(f.tags)} if f.tags else None) for n, f in t.fields])
    kinds = {str(to_struct_type(i)): to_struct_type(i) for i in t.items} if t.kind == "union" else {}
    return next(iter(kinds.values())) if len(kinds) == 1 else S.VariantType()


def from_struct_type(kind) -> Type:
    from pyspark.sql import types as S

    from pactum import types as T

    if isinstance(kind, S.StructType):
        return Type("object", fields=tuple((f.name, from_struct_type(f.dataType).nullish() if f.nullable else from_struct_type(f.dataType)) for f in kind.fields))
    if isinstance(kind, S.ArrayType):
        return T.array(from_struct_type(kind.elementType).null() if kind.containsNull else from_struct_type(kind.elementType))
    if isinstance(kind, S.MapType):
        return T.record(from_struct_type(kind.valueType))
    for base, t in ((S.StringType, T.string), (S.BooleanType, T.boolean), (S.IntegralType, T.integer), (S.NumericType, T.number), (S.BinaryType, T.binary), ((S.TimestampType, S.TimestampNTZType, S.DateType), T.date)):
        if isinstance(kind, base):
            return t
    return T.anything


# --- diagnostics when a contract is made ----------------------------------------------------------------------------


def diagnostics(t: Type, path: str = "") -> list[str]:
    """Defaults and literals that break their own constraints: 'Value v does not satisfy Minimum<n>'."""
    from pactum.types import code

    out = []
    values = ([t.default] if t.has_default else []) + ([t.value] if t.kind == "literal" else [])
    base = json_schema(Type(t.kind, fields=t.fields, items=t.items, value=t.value)) if t.checks else {}
    for v in values:
        for check in t.checks:
            if check.name in ("Custom", "Requires"):
                continue
            one = json_schema(Type("any", checks=(check,)))
            if isinstance(one, dict) and base is not None and Schema(one).errors(v):
                out.append(f"{path + ': ' if path else ''}Value {json.dumps(v)} does not satisfy {code(check)}")
    for n, f in t.fields:
        out += diagnostics(f, f"{path}.{n}" if path else n)
    for f in t.items:
        out += diagnostics(f, path)
    return out
