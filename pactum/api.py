"""validate, is_valid, assert_valid and what is made from their errors; for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum.compiler import ERROR, Compiled, Options, compile_type, error, none
from pactum.jsonschema import diagnostics
from pactum.types import ContractCompileError, Type


def _compile(df: DataFrame, t: Type, on: str | None, **options) -> Compiled:
    if on is None:
        names = df.columns
        root, kind = F.struct(*(F.col(f"`{n}`") for n in names)), df.schema
    else:
        root, kind = F.col(f"`{on}`"), df.schema[on].dataType
    return _made(root, kind, t, "", options)


def _made(root: Column, kind: S.DataType, t: Type, path: str, options: dict) -> Compiled:
    faults = diagnostics(t)
    if faults:
        raise ContractCompileError(faults)
    made = compile_type(t, root, kind, path, Options(root=root, root_type=kind, **options))
    if made.errors is None:
        made.errors = none()
    return made


def compile_column(c: Column, kind: S.DataType, t: Type, path: str = "", **options) -> Compiled:
    return _made(c, kind, t, path, options)


def validate(df: DataFrame, t: Type, mode: str = "strict", from_=None, on: str | None = None, transform=None) -> DataFrame:
    """df with _success, _data (null unless it succeeds) and _errors (path, value, error, issues), all errors in order.

    The errors are worked out only for rows that fail.
    """
    made = _compile(df, t, on, mode=mode, from_=from_, transform=transform)
    ok = F.coalesce(made.ok, F.lit(False))
    return df.withColumns({"_success": ok, "_data": F.when(ok, made.data), "_errors": F.when(ok, none()).otherwise(made.errors)})


def is_valid(df: DataFrame, t: Type, mode: str = "strict", from_=None, on: str | None = None) -> Column:
    """A bare predicate for filter(): its conjuncts reach the scan. A root scalar that coercion rewrites is not valid."""
    return _compile(df, t, on, mode=mode, from_=None if on is not None and t.kind != "object" else from_).ok


def split(df: DataFrame, t: Type, mode: str = "strict", from_=None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with _errors); an addition of this library. Each side is a filter over the scan of its own."""
    made = _compile(df, t, None, mode=mode, from_=from_)
    broken = ~F.coalesce(made.ok, F.lit(False))
    return df.where(made.ok), df.where(broken).withColumn("_errors", made.errors)


def message(errors: Column) -> Column:
    one = lambda e: F.when(e["path"] == "", e["error"]).otherwise(F.concat(e["path"], F.lit(": "), e["error"]))
    return F.concat(F.lit("Validation Error: "), F.array_join(F.transform(errors, one), ", "))


def assert_valid(df: DataFrame, t: Type, mode: str = "strict", from_=None, on: str | None = None, error_factory=None) -> DataFrame:
    """df; a row that fails ends the query with its message.

    error_factory: a function of a row's errors, as a list of dictionaries, that makes the exception; the table is then
    read at once, up to the first row that fails.
    """
    made = _compile(df, t, on, mode=mode, from_=from_)
    return _guarded(df, F.coalesce(made.ok, F.lit(False)), made.errors, error_factory)


def _guarded(df: DataFrame, ok: Column, errors: Column, error_factory) -> DataFrame:
    if error_factory is not None:
        first = df.where(~ok).select(errors.alias("e")).head()
        if first is not None:
            raise error_factory([e.asDict(recursive=True) for e in first.e])
        return df
    return df.where(F.when(~ok, F.raise_error(message(errors)).cast("boolean")).otherwise(F.lit(True)))


def assert_guard(df: DataFrame, t: Type, mode: str = "strict", from_=None, on: str | None = None, error_factory=None) -> DataFrame:
    """As assert_valid, but the values stay as they are: a root that coercion, a transform or a default would replace
    fails with its own errors or, where it has none, with RootNotRewritable. Containers are rewritten in place, so
    only a scalar in a column `on` can be such a root."""
    made = _compile(df, t, on, mode=mode, from_=from_)
    ok, errors = F.coalesce(made.ok, F.lit(False)), made.errors
    if on is not None and t.kind not in ("object", "record", "array", "set", "map", "tuple", "any"):
        c, kind = F.col(f"`{on}`"), df.schema[on].dataType
        same = made.data.eqNullSafe(c) if made.kind == kind else F.lit(False)
        plain = _compile(df, t, on, mode=mode)
        again = F.when(F.coalesce(plain.ok, F.lit(False)), error("", c, kind, "RootNotRewritable")).otherwise(plain.errors)
        ok, errors = ok & same, F.when(ok, again).otherwise(errors)
    return _guarded(df, ok, errors, error_factory)


_FLAT = "array<struct<path:string,value:string,error:string>>"


def flat(errors: Column) -> Column:
    """Errors, each followed by the issues of the arms of its union."""
    one = lambda e: F.struct(e["path"].alias("path"), e["value"].alias("value"), e["error"].alias("error"))
    return F.flatten(F.transform(errors, lambda e: F.concat(F.array(one(e)), F.coalesce(e["issues"], F.array().cast(_FLAT)))))


def group_errors_by_path(errors: Column) -> Column:
    """A row's errors and their issues as map of path to (first value, distinct codes)."""
    errors = flat(errors.cast(ERROR))
    paths = F.array_distinct(F.transform(errors, lambda e: e["path"]))
    at = lambda p: F.filter(errors, lambda e: e["path"] == p)
    return F.map_from_entries(F.transform(paths, lambda p: F.struct(p, F.struct(at(p)[0]["value"].alias("value"), F.array_distinct(F.transform(at(p), lambda e: e["error"])).alias("errors")))))


def errors_by_path(checked: DataFrame) -> DataFrame:
    """Violations of a whole table by path and code; counted before the shuffle."""
    return checked.select(F.explode("_errors").alias("e")).groupBy(F.col("e.path").alias("path"), F.col("e.error").alias("error")).agg(F.count("*").alias("n"))


def zod_issues(errors: Column) -> Column:
    """Errors and their issues as issues: code, path in parts, message, received."""
    parts = lambda p: F.filter(F.split(F.regexp_replace(p, r"\[([^\[\]]*)\]", r".$1"), r"\."), lambda x: x != "")
    return F.transform(flat(errors.cast(ERROR)), lambda e: F.struct(F.lit("custom").alias("code"), parts(e["path"]).alias("path"), e["error"].alias("message"), e["value"].alias("received")))


class ZodError(Exception):
    name = "ZodError"

    def __init__(self, issues: list):
        super().__init__("; ".join(f"{'.'.join(i['path'])}: {i['message']}" for i in issues))
        self.issues = issues
