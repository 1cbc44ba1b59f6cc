"""Wire texts to typed values, through VARIANT: JSON by Spark's parser, flat query strings by built-in functions, those
with brackets by a small parser in an Arrow-batched UDF, which gets only these."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum.api import compile_column
from pactum.compiler import has_udf, let
from pactum.serialize import quoted
from pactum.types import ContractError, Type

_DROPPED = ("__proto__", "constructor", "prototype")


def _decode(text: str) -> str:
    text = text.replace("+", " ")
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return text
    try:
        return unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return text


class _Items(dict):
    """A list in the making, by position."""


def parse_query(text: str) -> dict:
    """Nested values of a query string. A leading ? is an error; a bare key is true; repeated keys make a list.

    A position that a list leaves out is not filled: a[1]=x is a list of one.
    """
    if text.startswith("?"):
        raise ValueError("Invalid query")
    out: dict = {}
    for pair in text.split("&"):
        if pair:
            key, eq, value = pair.partition("=")
            _put(out, _decode(key).replace("][", "[").removesuffix("]").split("["), _decode(value) if eq else True)
    return _plain(out)


def _top(at: dict) -> int:
    return max((k for k in at if isinstance(k, int)), default=-1)


def _put(at: dict, parts: list[str], value) -> None:
    holder, name = None, None
    for k, part in enumerate(parts):
        if part in _DROPPED:
            return
        last = k + 1 == len(parts)
        if part == "":
            # The last item takes the key unless it has it already.
            part = _top(at)
            below = at.get(part)
            part += part < 0 or last or (isinstance(below, dict) and _key(parts[k + 1]) in below)
        part = _key(part)
        if isinstance(at, _Items) and isinstance(part, str):
            at = holder[name] = dict(at)
        if last:
            old = at.get(part)
            if part not in at:
                at[part] = value
            elif isinstance(old, dict):
                old[_top(old) + 1] = value
            else:
                at[part] = _Items({0: old, 1: value})
            return
        if at.get(part, "") == "":
            at[part] = _Items() if parts[k + 1] == "" or isinstance(_key(parts[k + 1]), int) else {}
        if not isinstance(at[part], dict):
            raise ValueError("Invalid query")
        holder, name, at = at, part, at[part]


def _key(part):
    return int(part) if isinstance(part, str) and re.fullmatch("[0-9]+", part) else part


def _plain(v):
    if isinstance(v, _Items):
        return [_plain(v[i]) for i in sorted(v)]
    if isinstance(v, dict):
        return {str(k): _plain(v[k]) for k in sorted(v, key=lambda k: (isinstance(k, str), k if isinstance(k, int) else 0))}
    return v


def _decoded(c: Column) -> Column:
    """Percent signs and plus signs undone; a text that has a wrong percent sign keeps all of them."""
    raw, text = F.replace(c, F.lit("+"), F.lit(" ")), F.try_url_decode(c)
    return F.when(~c.contains("%"), raw).when(text.isNull() | text.contains("�"), raw).otherwise(text)


def query_to_json(c: Column) -> Column:
    """JSON of query strings; null where the text is no query."""
    pair = lambda p: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("k"),
        F.when(p.contains("="), quoted(_decoded(F.substr(p, F.instr(p, "=") + 1)))).otherwise("true").alias("v"),
    )
    value = lambda vs: F.when(F.size(vs) == 1, vs[0]).otherwise(F.concat(F.lit("["), F.array_join(vs, ", "), F.lit("]")))
    of = lambda entries, k: let(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"]), value)
    names = lambda entries: F.filter(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda k: ~k.isin(*_DROPPED))
    members = lambda entries: F.array_join(F.transform(names(entries), lambda k: F.concat(quoted(k), F.lit(": "), of(entries, k))), ", ")
    flat = F.concat(F.lit("{"), let(F.transform(F.filter(F.split(c, "&"), lambda p: p != ""), pair), members), F.lit("}"))
    # Brackets, numbers as keys, empty keys, and the sign that marks bytes that are no text.
    special = c.rlike(r"[\[\]]|%5[BbDd]|\x{FFFD}|%[Ee][Ff]%[Bb][Ff]%[Bb][Dd]|(?:\A|&)(?:[0-9]|%3[0-9])*=|(?:\A|&)(?:[0-9]|%3[0-9])+(?:&|\z)")

    @F.pandas_udf("string")
    def nested(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else json.dumps(parse_query(text), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return F.when(c.startswith("?"), F.lit(None)).when(special, nested(F.when(special, c))).otherwise(flat)


def is_json(c: Column) -> Column:
    """Whether a whole text is one JSON value; the parser alone would ignore what follows the first."""
    whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(',"e":1}')))
    one = lambda w: F.try_variant_get(w, "$[1]", "variant").isNull() & F.try_variant_get(w, "$[0]", "variant").isNotNull()
    # A text that ends as an object or list does, and has neither's end elsewhere, can't go on behind its value.
    plain = c.rlike(r"\A\s*(?:\{[^{}\[\]]*\}|\[[^{}\[\]]*\])\s*\z")
    return F.coalesce(F.try_parse_json(c).isNotNull() & (plain | (one(whole) & F.try_variant_get(inside, "$.e", "int").isNotNull())), F.lit(False))


#: What a reviver or replacer returns for a member that goes.
ABSENT = object()


class WalkError(Exception):
    def __init__(self, path: str, cause: Exception):
        super().__init__(str(cause))
        self.path = path


def revive(value, reviver, key: str = "", path: str = ""):
    """The value after reviver(key, value) on every member, inner ones first; ABSENT takes a member out."""
    if isinstance(value, list):
        made = [revive(x, reviver, str(i), f"{path}[{i}]") for i, x in enumerate(value)]
        value = [None if x is ABSENT else x for x in made]
    elif isinstance(value, dict):
        made = {k: revive(x, reviver, k, f"{path}.{k}" if path else k) for k, x in value.items()}
        value = {k: x for k, x in made.items() if x is not ABSENT}
    try:
        return reviver(key, value)
    except Exception as e:
        raise WalkError(path, e) from e


def _revived(c: Column, reviver) -> Column:
    """struct(json, path, message): JSON texts after the reviver, or where and why it failed."""

    @F.pandas_udf("json string, path string, message string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                made = None if text is None else revive(json.loads(text), reviver)
                rows.append((None if text is None or made is ABSENT else json.dumps(made, ensure_ascii=False), None, None))
            except WalkError as e:
                rows.append((None, e.path, str(e)))
            except ValueError:
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["json", "path", "message"])

    return run(c)


def parse(c: Column, t: Type, from_: str = "json", mode: str = "strip", transform=None, reviver=None) -> Column:
    """STRUCT<ok, data, error STRUCT<path, message>>: the first error only.

    from_: json, query, or string for one scalar. Values keep their kind: a JSON number is no string. Unknown keys follow
    the mode; relaxed keeps them in a map under compiler.REST. reviver(key, value) sees every member of a JSON or query
    value before it is checked, in an Arrow-batched UDF.
    """
    if from_ == "string":
        if t.kind in ("object", "record", "map", "array", "set", "tuple"):
            raise ContractError("from 'string' takes one scalar")
        value = compile_column(c, S.StringType(), t, mode=mode, from_="string", transform=transform, wire=True)
        value.plain = True
        return _outcome(value, c.isNotNull(), "Type<string>", None)
    source = query_to_json(c) if from_ == "query" else c
    revived = None
    if reviver is not None:
        revived = _revived(source if from_ == "query" else F.when(is_json(source), source), reviver)

    def checked(text: Column, v: Column, walked: Column | None) -> Column:
        good, refused = (text.isNotNull(), "Invalid query") if from_ == "query" else (is_json(text), "Invalid JSON")
        value = compile_column(v, S.VariantType(), t, mode=mode, from_=from_, transform=transform, wire=True)
        value.plain = transform is not None or has_udf(t)
        return _outcome(value, good, refused, walked)

    if transform is not None or has_udf(t):
        return checked(source, F.try_parse_json(source if revived is None else revived["json"]), revived)
    # What a text is parsed to is worked out once, for all its fields.
    if revived is None:
        return let(source, lambda text: let(F.try_parse_json(text), lambda v: checked(text, v, None)))
    both = F.struct(source.alias("text"), revived.alias("walked"))
    return let(both, lambda b: let(F.try_parse_json(b["walked"]["json"]), lambda v: checked(b["text"], v, b["walked"])))


def _outcome(value, good: Column, refused: str, walked: Column | None) -> Column:
    """ok, the data, or the first error. Whether it is ok is worked out once; the errors only where it isn't."""
    wrong = F.when(~good, F.struct(F.lit("").alias("path"), F.lit(refused).alias("message")))
    ok = good & F.coalesce(value.ok, F.lit(False))
    if walked is not None:
        broken = walked["message"].isNotNull()
        wrong, ok = wrong.when(broken, F.struct(walked["path"].alias("path"), walked["message"].alias("message"))), ok & ~broken
    first = let(F.get(value.errors, F.lit(0)), lambda e: F.struct(e["path"].alias("path"), e["error"].alias("message")))
    made = lambda ok: F.struct(ok.alias("ok"), F.when(ok, value.data).alias("data"), F.when(~ok, wrong.otherwise(first)).alias("error"))
    return made(ok) if value.plain else let(ok, made)
