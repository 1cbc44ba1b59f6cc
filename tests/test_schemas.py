import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum import api, casing, formats, jsonschema, parse, queries, serialize
from pactum import types as T


@pytest.mark.parametrize("name", sorted(queries._FORMATS))
def test_formats_of_the_interpreter(name):
    fmt, good, bad = queries._FORMATS[name]
    assert [v for v in good if not formats.has_format(fmt, v)] == [] and [v for v in bad if formats.has_format(fmt, v)] == []


def _values(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 3 else 5)
    if kind < 5:
        return rnd.choice([None, True, False, 0, 1, 7, -3, 2.5, 1e300, "", "a", "abc", "é😀", "12"])
    if kind == 5:
        return [_values(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {k: _values(rnd, depth + 1) for k in rnd.sample(["a", "b", "c d", "x1"], rnd.randrange(4))}


def _schemas(rnd, depth=0):
    s = {}
    for _ in range(rnd.randrange(1, 4)):
        k = rnd.randrange(20 if depth < 2 else 9)
        sub = lambda: rnd.choice([True, False]) if rnd.random() < 0.1 else _schemas(rnd, depth + 1)
        s |= [
            lambda: {"type": rnd.choice(["string", "number", "integer", "boolean", "null", "array", "object", ["string", "null"]])}, lambda: {"minLength": rnd.randrange(4)}, lambda: {"maximum": rnd.randrange(5)},
            lambda: {"exclusiveMinimum": rnd.randrange(3)}, lambda: {"multipleOf": rnd.choice([2, 0.5])}, lambda: {"enum": [_values(rnd, 1), "a", 1]}, lambda: {"const": _values(rnd, 1)}, lambda: {"pattern": "^a"}, lambda: {"maxProperties": 1, "minItems": 1},
            lambda: {"properties": {"a": sub(), "b": sub()}}, lambda: {"properties": {"a": sub()}, "required": ["a", "b"]}, lambda: {"additionalProperties": sub(), "properties": {"a": True}}, lambda: {"patternProperties": {"^x": sub()}, "propertyNames": {"maxLength": 2}},
            lambda: {"items": sub()}, lambda: {"prefixItems": [sub()], "items": sub()}, lambda: {"contains": sub(), "maxContains": 1}, lambda: {rnd.choice(["anyOf", "oneOf", "allOf"]): [sub(), sub()]}, lambda: {"not": sub()}, lambda: {"if": sub(), "then": sub(), "else": sub()},
            lambda: {"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"b": sub()}},
        ][k]()
    return s


def test_columns_agree_with_the_interpreter(spark):
    rnd = random.Random(5)
    texts = [json.dumps(_values(rnd)) for _ in range(60)] + ["{", "1 2", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "j string").coalesce(1).cache()
    for _ in range(40):
        schema = _schemas(rnd)
        columns = jsonschema.schema_columns(F.col("j"), schema)
        assert columns is not None
        slow = jsonschema._interpreted(F.col("j"), schema, "strict", None)
        said = lambda e: F.array_sort(F.transform(e, lambda x: F.concat_ws(" ", x["path"], x["error"])))
        for r in rows.select("j", columns[0].alias("ok"), said(columns[1]).alias("fast"), said(slow).alias("slow")).collect():
            assert r.ok == (not r.slow), (schema, r)
            assert r.fast == r.slow, (schema, r)


def test_wide_and_deep_schemas_are_quick(spark):
    rows = spark.createDataFrame([(json.dumps(f"v{k}"),) for k in (0, 79, 99)], "j string")
    wide = {"anyOf": [{"const": f"v{k}"} for k in range(80)]}
    deep = {"type": "string"}
    for _ in range(25):
        deep = {"allOf": [deep]}
    spark.range(1).collect()
    for schema, want in ((wide, [True, True, False]), (deep, [True] * 3)):
        began = time.time()
        made = jsonschema.Schema(schema)
        assert not made.errors("v1") and bool(made.errors("v99")) != want[2]
        assert time.time() - began < 2
        assert [r[0] for r in rows.select(jsonschema.is_schema(F.col("j"), schema)).collect()] == want


def test_closed_members_and_types():
    closed = lambda **p: {"type": "object", "properties": p, "required": list(p), "additionalProperties": False}
    both = {"allOf": [closed(a={"type": "string"}), closed(b={"type": "number"})]}
    assert jsonschema.Schema(both).errors({"a": "x", "b": 2}) == []
    assert [e[2] for e in jsonschema.Schema(both).errors({"a": "x", "b": 2, "c": 1})] == ["PropertyNotAllowed<c>"]
    assert jsonschema.Schema(both, "relaxed").errors({"a": "x", "b": 2, "c": 1}) == []
    with pytest.raises(T.ContractError, match="Unsupported x-typescript-type: Nope"):
        jsonschema.Schema({"x-typescript-type": "Nope"})
    date = {"x-typescript-type": "Date"}
    assert [e[2] for e in jsonschema.Schema(date).errors("2024-01-01")] == ["Type<Date>"] and not jsonschema.Schema(date, from_="json").errors("2024-01-01")
    union = jsonschema.Schema({"anyOf": [{"type": "string"}, {"minimum": 5}]}).check({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 1, "").errors
    assert [e[2] for e in union[0][3]] == ["Type<string>", "Minimum<5>"]


def test_validate_assert_and_guard_schema(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "string", "default": "x"}}, "required": ["a"]}
    rows = spark.createDataFrame([('{"a":"1","z":0}',), ('{"a":"q"}',), ("5",), (None,)], "j string")
    got = [(r._success, r._data, [e.error for e in r._errors]) for r in jsonschema.validate_schema(rows, "j", schema, "strip", "query").collect()]
    assert got == [(True, '{"a":1,"b":"x"}', []), (False, None, ["Type<integer>"]), (False, None, ["Type<object>"]), (False, None, ["Invalid JSON"])]
    good = rows.limit(1)
    assert jsonschema.assert_schema(good, "j", schema, "strip", "query").first().j == '{"a":1,"b":"x"}'
    with pytest.raises(Exception, match="Validation Error: a: Type<integer>"):
        jsonschema.assert_schema(good, "j", schema, "strip").collect()
    assert jsonschema.assert_guard_schema(good, "j", schema, "strip", "query").first().j == '{"a":"1","z":0}'
    number = spark.createDataFrame([('"5"',)], "j string")
    with pytest.raises(Exception, match="Type<number>"):
        jsonschema.assert_guard_schema(number, "j", {"type": "number"}, from_="query").collect()
    with pytest.raises(KeyError, match="Type<number>"):
        jsonschema.assert_schema(number, "j", {"type": "number"}, error_factory=lambda es: KeyError(es[0]["error"]))


def test_guards_of_contracts(spark):
    df = spark.createDataFrame([("5",), ("7",)], "v string")
    assert api.assert_guard(df, T.string, on="v").count() == 2
    with pytest.raises(Exception, match="Validation Error: Type<number>"):
        api.assert_guard(df, T.number, from_="query", on="v").collect()
    with pytest.raises(Exception, match="RootNotRewritable"):
        api.assert_guard(spark.createDataFrame([(" x ",)], "v string"), T.string.trim(), on="v").collect()
    with pytest.raises(LookupError, match="v: MinLength<9>"):
        api.assert_valid(df, T.obj(v=T.string.min_length(9)), error_factory=lambda es: LookupError(f"{es[0]['path']}: {es[0]['error']}"))


def test_contracts_that_break_themselves_do_not_compile(spark):
    with pytest.raises(T.ContractCompileError) as e:
        api.validate(spark.range(1), T.obj(a=T.number.minimum(5).with_default(1), b=T.string.max_length(1).with_default("xy")))
    assert e.value.diagnostics == ["a: Value 1 does not satisfy Minimum<5>", 'b: Value "xy" does not satisfy MaxLength<1>']


def test_objects_used_often_are_hoisted():
    small, big = T.obj(a=T.string), T.obj(**{f"k{k}": T.number for k in range(70)})
    out = jsonschema.json_schema(T.obj(x=big, y=T.array(big.null()), z=small, w=small))
    assert list(out["$defs"]) == ["Type1"] and out["properties"]["x"] == {"$ref": "#/$defs/Type1"} and out["properties"]["z"] == out["properties"]["w"] != {"$ref": "#/$defs/Type2"}
    assert jsonschema.Schema(out).errors({"x": {f"k{k}": k for k in range(70)}, "y": [None], "z": {"a": ""}, "w": {"a": ""}}) == []
    assert jsonschema.json_schema(T.intersection(T.string.min_length(1), T.string.pattern("^a"))) == {"allOf": [{"type": "string", "minLength": 1}, {"type": "string", "pattern": "^a"}]}


def test_serialization_errors(spark):
    df = spark.createDataFrame([((float("nan"), None),)], "v struct<n: double, s: string>")
    kind = df.schema["v"].dataType
    with pytest.raises(Exception, match='Serialization error at "n": Type<number>'):
        df.select(serialize.json_text(F.col("v"), kind)).collect()
    with pytest.raises(Exception, match='Serialization error at "s": Type<string>'):
        df.select(serialize.json_text(F.col("v"), kind, T.obj(s=T.string))).collect()
    with pytest.raises(Exception, match="PropertyNotAllowed<n>"):
        df.select(serialize.json_text(F.col("v"), kind, T.obj(s=T.string.null()), "strict")).collect()
    assert df.select(serialize.json_text(F.col("v"), kind, T.obj(s=T.string.null()))).first()[0] == '{"s":null}'
    inf = spark.createDataFrame([(float("inf"), float("-inf"))], "a double, b double")
    assert inf.select(serialize.json_text(F.struct("a", "b"), inf.schema)).first()[0] == '{"a":Infinity,"b":-Infinity}'


def test_casing_of_names_and_json(spark):
    assert casing.convert("A1B-C", "camelCase") == "a1BC" and casing.convert("a.é_b", "camelCase") == "a_éB" and casing.convert("--", "camelCase") == "--"
    with pytest.raises(Exception, match="collision"):
        spark.createDataFrame([('{"a_b":1,"aB":2}',)], "j string").select(casing.convert_json(F.col("j"), "camelCase")).collect()


def test_query_strings_agree(spark):
    """Built-in functions and the parser of bracketed keys."""
    texts = ["", "a=1", "a=1&a=2&a=3", "a", "a=", "&&a=b&", "a=%41+b", "a=%zz", "a=%C3%A9", "a=%C3", "x=\"y\"\\", "__proto__=1&b=2", "a=b=c", "=v", "1=a&b=c", "a[]=1&a[]=2", "a[b]=1", "a]=1", "?a=1", "é=ü&日=本"]
    rows = spark.createDataFrame([(t,) for t in texts], "q string")
    for r in rows.select("q", parse.query_to_json(F.col("q")).alias("j")).collect():
        if r.q.startswith("?"):
            assert r.j is None
        else:
            assert json.loads(r.j) == parse.parse_query(r.q), r.q


def test_checks_one_by_one(spark):
    from pactum import checks

    df = spark.createDataFrame([("ab", 4.0, ["a", "a"], {"k": 1}), (None, None, None, None), ("abcd", 7.5, ["b"], {})], "s string, n double, l array<string>, m map<string,int>")
    m = df.schema["m"].dataType
    got = df.select(
        checks.min_length(F.col("s"), 3), checks.max_length(F.col("s"), 3), checks.pattern(F.col("s"), "b$"), checks.format(F.col("s"), "byte"), checks.minimum(F.col("n"), 5), checks.maximum(F.col("n"), 5), checks.exclusive_minimum(F.col("n"), 4),
        checks.exclusive_maximum(F.col("n"), 4), checks.multiple_of(F.col("n"), 2), checks.min_items(F.col("l"), 2), checks.max_items(F.col("l"), 1), checks.unique_items(F.col("l")), checks.contains(F.col("l"), T.literal("b")),
        checks.min_properties(F.col("m"), 1, m), checks.max_properties(F.col("m"), 0, m), checks.property_names(F.col("m"), T.string.max_length(0), m), checks.literal(F.col("s"), S.StringType(), "ab"), checks.union(F.col("s"), S.StringType(), T.literal("x"), T.string.min_length(4)),
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, True, True, False, False, True, False, False, True, True, False, False, False, True, False, False, True, False), (None,) * 18,
        (True, False, False, True, True, False, True, False, False, False, True, True, True, False, True, True, False, True),
    ]


def test_boolean_unions_are_booleans():
    assert jsonschema.json_schema(T.union(True, False)) == {"type": "boolean"} and "anyOf" in jsonschema.json_schema(T.union(True, "x"))


def test_output_types_follow_defaults():
    t = T.obj(a=T.string.with_default("x"), b=T.string.opt())
    assert [f.nullable for f in jsonschema.to_struct_type(T.resolve_defaults(t)).fields] == [False, True]
    assert isinstance(jsonschema.to_struct_type(T.union(T.string, T.number)), S.VariantType)
