import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pactum import api, casing, formats, jsonschema, parse, serialize
from pactum import types as T
from pactum.compiler import to_boolean, to_number


def run(spark, rows, ddl, contract, **options):
    checked = api.validate(spark.createDataFrame(rows, ddl), contract, **options)
    return [(r._success, json.loads(r.d) if r.d else None, [(e.path, e.error) for e in r._errors]) for r in checked.withColumn("d", F.to_json("_data")).collect()]


USER = T.obj(name=T.string.trim().min_length(2), age=T.number.minimum(18), role=T.string.with_default("guest"))


def test_user(spark):
    rows = [("  ab  ", 20.0, None), ("x", 20.0, "r"), ("ab", 10.0, "r"), (None, 20.0, "r")]
    got = run(spark, rows, "name string, age double, role string", USER, mode="strip")
    assert got[0] == (True, {"name": "ab", "age": 20, "role": "guest"}, [])
    assert [g[2] for g in got[1:]] == [[("name", "MinLength<2>")], [("age", "Minimum<18>")], [("name", "Type<string>")]]


def test_unknown_keys(spark):
    rows, ddl = [("ab", 20.0, 1)], "name string, age double, noise int"
    assert run(spark, rows, ddl, USER)[0][2] == [("", "PropertyNotAllowed<noise>")]
    assert run(spark, rows, ddl, USER, mode="strip")[0][1] == {"name": "ab", "age": 20, "role": "guest"}
    assert run(spark, rows, ddl, USER, mode="relaxed")[0][1]["noise"] == 1


def test_nested_paths(spark):
    t = T.obj(user=T.obj(profile=T.obj(email=T.string.format("email"), age=T.number.maximum(120))), tags=T.array(T.string.max_length(3)).min_items(1).unique_items())
    ddl = "user struct<profile: struct<email: string, age: double>>, tags array<string>"
    got = run(spark, [((("a@b.org", 5.0),), ["a"]), ((("not-an-email", 200.0),), ["a", "a", "long"]), ((("a@b.org", 5.0),), [])], ddl, t)
    assert got[0][0]
    assert got[1][2] == [("user.profile.email", "Format<email>"), ("user.profile.age", "Maximum<120>"), ("tags[2]", "MaxLength<3>"), ("tags", "UniqueItems")]
    assert got[2][2] == [("tags", "MinItems<1>")]


def test_wrong_types_and_coercion(spark):
    t = T.obj(q=T.string.trim().min_length(1), page=T.number.minimum(1), active=T.boolean)
    ddl = "q string, page string, active string"
    rows = [("hi", "2", "off"), ("  ", "0", "maybe"), ("hi", "abc", "1")]
    assert [g[2] for g in run(spark, rows, ddl, t)][0] == [("page", "Type<number>"), ("active", "Type<boolean>")]
    got = run(spark, rows, ddl, t, from_="query")
    assert got[0][1] == {"q": "hi", "page": 2, "active": False}
    assert [g[2] for g in got[1:]] == [[("q", "MinLength<1>"), ("page", "Minimum<1>"), ("active", "Type<boolean>")], [("page", "Type<number>")]]


def test_unions(spark):
    shape = T.union(T.obj(kind=T.literal("circle"), r=T.number.minimum(0)), T.obj(kind=T.literal("square"), s=T.number.minimum(0)))
    assert shape.value == "kind"
    ddl = "v struct<kind: string, r: double, s: double>"
    got = run(spark, [(("circle", -1.0, None),), (("square", None, 3.0),), (("blob", None, None),)], ddl, T.obj(v=shape))
    assert [g[0] for g in got] == [False, True, False] and got[0][2] == [("v.r", "Minimum<0>")]
    assert T.union("a", None).nullable


def test_maps_tuples_requires(spark):
    got = run(spark, [({"a": 1.0, "B": 2.0},)], "m map<string, double>", T.obj(m=T.record(T.number.maximum(1)).property_names(T.string.pattern("^[a-z]+$"))))
    assert got[0][2] == [("m.B", "Maximum<1>"), ("m.B", "Pattern<^[a-z]+$>")]
    got = run(spark, [(("a", 1.0),)], "p struct<_0: string, _1: double>", T.obj(p=T.tuple_of(T.string, T.number.minimum(2))))
    assert got[0][2] == [("p[1]", "Minimum<2>")]
    got = run(spark, [(1.0, None), (None, None)], "a double, b double", T.obj(a=T.number.opt().requires("b"), b=T.number.opt()))
    assert got[0][2] == [("a", "Requires<b>")] and got[1][0]


def test_predicate_agrees_and_is_pushed_down(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit("x").alias("b")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    t = T.obj(a=T.number.maximum(45).multiple_of(5), b=T.enum("x"))
    assert df.where(api.is_valid(df, t)).count() == api.validate(df, t).where("_success").count() == 10
    plan = df.where(api.is_valid(df, t))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(a,45.0)" in plan and "Python" not in plan and "Exchange" not in plan


def test_assert_valid(spark):
    df = spark.createDataFrame([(1.0,), (9.0,)], "a double")
    with pytest.raises(Exception, match="Validation Error: a: Maximum<5>"):
        api.assert_valid(df, T.obj(a=T.number.maximum(5))).collect()


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("email", "a.b@c-d.org", "a..b@c.org"), ("email", "a@b.org", "a@b"), ("date", "2024-02-29", "2024-02-31"), ("date-time", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00"),
        ("ipv4", "001.2.3.255", "1.2.3.256"), ("ipv6", "fe80::1%eth0", "1::2::3"), ("hostname", "localhost", "-a.b"), ("byte", "QQ==", "QQ="), ("duration", "P1W2D", "P"),
        ("uuid", "00000000-0000-0000-0000-000000000000", "0f8fad5b-d9cb-069f-a165-70867728950e"), ("time", "23:59:59.5+01:00", "24:00:00Z"), ("regex", "^a[b]$", "(a+)+"), ("objectId", "507f1f77bcf86cd799439011", "x"), ("none", None, "x"),
    ],
)
def test_formats_agree(spark, name, good, bad):
    for value, want in ((good, True), (bad, False)):
        if value is not None:
            assert formats.has_format(name, value) is want
            assert spark.createDataFrame([(value,)], "v string").select(formats.format_column(name, F.col("v"))).first()[0] is want


def test_casing(spark):
    want = {"snake_case": "user_id", "SNAKE_CASE": "USER_ID", "kebab-case": "user-id", "dot.case": "user.id", "camelCase": "userId", "camelCaseID": "userID", "PascalCase": "UserId", "PascalCaseID": "UserID", "odd": "user_id"}
    assert {k: casing.convert("user_id", k) for k in want} == want
    assert casing.convert("__SOME_CONSTANT$", "camelCase") == "__someConstant$" and casing.convert("_a_b", "camelCase", False) == "aB"
    df = spark.createDataFrame([((1,), [(2,)], {"keep_me": 3})], "outer_key struct<inner_key: int>, list_key array<struct<x_y: int>>, a_map map<string, int>")
    assert casing.convert_casing(df, "camelCase").schema.simpleString() == "struct<outerKey:struct<innerKey:int>,listKey:array<struct<xY:int>>,aMap:map<string,int>>"
    with pytest.raises(ValueError, match="collision"):
        casing.convert_casing(spark.createDataFrame([(1, 2)], "a_b int, aB int"), "camelCase")


def test_coercions(spark):
    rows = spark.createDataFrame([(x,) for x in ("1", " 1.5e1 ", "0x10", "NaN", "1d", "", "yes", "OFF", "y")], "v string")
    got = rows.select(to_number(F.col("v")).alias("n"), to_boolean(F.col("v")).alias("b")).collect()
    assert [r.n for r in got] == [1, 15, None, None, None, None, None, None, None]
    assert [r.b for r in got] == [True, None, None, None, None, None, True, False, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a=1&b=x+y", {"a": "1", "b": "x y"}), ("a=1&a=2", {"a": ["1", "2"]}), ("flag", {"flag": True}), ("a=%ZZ&b=ok", {"a": "%ZZ", "b": "ok"}), ("a[b][c]=1", {"a": {"b": {"c": "1"}}}),
        ("a[]=1&a[]=2", {"a": ["1", "2"]}), ("a[0]=x&a[1]=y", {"a": ["x", "y"]}), ("mix[0]=a&mix[name]=b", {"mix": {"0": "a", "name": "b"}}), ("__proto__[x]=1", {}),
        ("a[][name]=A&a[][role]=r&a[][name]=B&a[][role]=s", {"a": [{"name": "A", "role": "r"}, {"name": "B", "role": "s"}]}),
    ],
)
def test_query_strings(text, want):
    assert parse.parse_query(text) == want
    with pytest.raises(ValueError):
        parse.parse_query("?a=1")


def test_json_texts(spark):
    good, bad = ['{"a":1}', " [1] ", "1", '"x"', "null", "{}"], ['{"a":1} x', '{"a":1}{"b":2}', "", "{", "1,2", "]["]
    rows = spark.createDataFrame([(x,) for x in good + bad], "v string")
    assert [r[0] for r in rows.select(parse.is_json(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)


def errors(schema, value, mode="strict"):
    return [(p, e) for p, _, e in jsonschema.compile_schema(schema, mode).errors(value)]


def test_schema_keywords():
    closed = {"type": "object", "properties": {"a": {"type": "number"}}}
    assert errors(closed, {"a": 1, "b": 2}) == [("", "PropertyNotAllowed<b>")] and errors(closed, {"a": 1, "b": 2}, "strip") == []
    assert errors({"allOf": [{"properties": {"a": True}}, {"properties": {"b": True}}], "unevaluatedProperties": False}, {"a": 1, "c": 2}) == [("", "UnevaluatedProperty<c>")]
    node = {"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"v": {"type": "number"}, "next": {"$ref": "#/$defs/n"}}}}}
    assert errors(node, {"v": 1, "next": {"v": 2, "next": {"v": "x"}}}) == [("next.next.v", "Type<number>")]
    assert errors({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3) == [("", "Type<OneOf:multiple>")]
    assert errors({"multipleOf": 0.1}, 0.3) == [] and errors({"multipleOf": 0}, 3) == [("", "MultipleOf<0>")]
    assert errors({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2, "a": 1.0}]) == [("", "UniqueItems")]
    assert errors({"const": 1}, 1.0) == [] and errors({"enum": ["a"]}, "b") == [("", 'Enum<"a">')]
    with pytest.raises(T.ContractError):
        errors({"type": "thing"}, 1)
    with pytest.raises(T.ContractError):
        errors({"$ref": "https://x.org/s"}, 1)


def test_schema_of_contract_round_trip():
    t = T.obj(a=T.string.min_length(2).tag("b", "a"), b=T.array(T.number).unique_items().opt(), c=T.enum("x", "y"), d=T.date)
    made = jsonschema.json_schema(t)
    assert made["required"] == ["a", "c", "d"] and made["properties"]["a"]["x-tags"] == ["a", "b"] and made["properties"]["d"] == {"x-typescript-type": "Date"}
    del made["properties"]["d"]
    made["required"].remove("d")
    assert errors(made, {"a": "ab", "b": [1, 1], "c": "z"}) == [("b", "UniqueItems"), ("c", "Type<Union>")]
    kind = jsonschema.to_struct_type(T.obj(a=T.string, b=T.number.opt()))
    assert jsonschema.to_struct_type(jsonschema.from_struct_type(kind)) == kind == S.StructType([S.StructField("a", S.StringType(), False), S.StructField("b", S.DoubleType())])


def test_diagnostics_and_modifiers():
    t = T.obj(a=T.number.minimum(5).with_default(1), b=T.obj(c=T.string))
    assert jsonschema.diagnostics(t) == ["a: Value 1 does not satisfy Minimum<5>"]
    t = T.with_modifiers(t, {"b.c": lambda f: f.min_length(3)})
    assert dict(dict(t.fields)["b"].fields)["c"].checks[0].args == (3,)
    assert not dict(T.resolve_defaults(t).fields)["a"].optional


def test_stringify(spark):
    df = spark.createDataFrame([('q"\n', None, [1.0, 2.5], {"k": True}, b"ab")], "s string, n double, l array<double>, m map<string, boolean>, b binary")
    text = df.select(serialize.json_text(F.struct(*df.columns), df.schema)).first()[0]
    assert text == '{"s":"q\\"\\n","n":null,"l":[1,2.5],"m":{"k":true},"b":"YWI="}'
    q = spark.createDataFrame([("a b'!", None)], "k string, z int")
    assert q.select(serialize.query_text(F.struct("k", "z"), q.schema)).first()[0] == "k=a%20b'!&z="


def test_entry_points_without_llm(spark):
    from pactum import queries

    assert queries.QUERIES.keys() == queries.SQL.keys()
    assert queries.QUERIES["is_lineitem"](spark, "/root/testdata/sf0.001").count() > 0
