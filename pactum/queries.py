"""Queries of the contract engine over the tables, and the SQL that gives the same rows.

Most queries give key columns, ok (does the row satisfy the contract) and errors (sorted codes joined by |).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import api, casing, jsonschema, parse, serialize
from pactum import types as T
from pactum.shared import delete, shared_root

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(errors: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(errors, lambda e: e["error"])), "|")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _check(name: str, table: str, keys: list[str], column, contract: T.Type, sql_tests: list[tuple[str, str]], where: str = "", sql_value: str | None = None, from_=None) -> None:
    """A query of one contract on one value: sql_tests are (code, SQL condition that breaks it)."""

    def run(spark, sf_dir):
        df = _table(spark, sf_dir, table)
        value = F.col(column) if isinstance(column, str) else column()
        rows = df.select(*keys, value.alias("v"))
        made = api.compile_column(F.col("v"), rows.schema["v"].dataType, contract, from_=from_)
        return rows.select(*keys, F.coalesce(made.ok, F.lit(False)).alias("ok"), codes(made.errors).alias("errors"))

    QUERIES[name] = run
    v = sql_value or column
    parts = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in sorted(sql_tests))
    SQL[name] = f"""SELECT {', '.join(keys)}, NOT ({' OR '.join(f'({c})' for _, c in sql_tests)}) AS ok, concat_ws('|', {parts}) AS errors
        FROM (SELECT {', '.join(keys)}, {v} AS v FROM {table})"""


_Q = "l_orderkey", "l_linenumber"
LINEITEM = T.obj(
    T.anything, l_quantity=T.number.minimum(1).maximum(45), l_discount=T.number.exclusive_maximum(0.09), l_tax=T.number.exclusive_minimum(0.01),
    l_returnflag=T.enum("A", "N"), l_linestatus=T.string.pattern("^[OF]$"), l_extendedprice=T.number.minimum(1000),
)
_LINE_SQL = {"Minimum<1>": "l_quantity < 1", "Maximum<45>": "l_quantity > 45", "ExclusiveMaximum<0.09>": "l_discount >= 0.09", "ExclusiveMinimum<0.01>": "l_tax <= 0.01", "Type<'A'|'N'>": "l_returnflag NOT IN ('A','N')", "Pattern<^[OF]$>": "NOT regexp_matches(l_linestatus, '^[OF]$')", "Minimum<1000>": "l_extendedprice < 1000"}
_LINE_CODES = ", ".join("CASE WHEN {} THEN '{}' END".format(c, k.replace("'", "''")) for k, c in sorted(_LINE_SQL.items()))
_LINE_OK = "NOT (" + " OR ".join(_LINE_SQL.values()) + ")"


@query("validate_lineitem", f"SELECT l_orderkey, l_linenumber, {_LINE_OK} AS is_valid, concat_ws('|', {_LINE_CODES}) AS errors FROM lineitem")
def validate_lineitem(spark, sf_dir):
    checked = api.validate(_table(spark, sf_dir, "lineitem"), LINEITEM)
    return checked.select(*_Q, F.col("_success").alias("is_valid"), codes(F.col("_errors")).alias("errors"))


@query("is_lineitem", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_LINE_OK}")
def is_lineitem(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    return df.where(api.is_valid(df, LINEITEM)).select(*_Q, "l_quantity")


@query("quarantine_lineitem", f"SELECT l_orderkey, l_linenumber, concat_ws('|', {_LINE_CODES}) AS errors FROM lineitem WHERE NOT ({_LINE_OK})")
def quarantine_lineitem(spark, sf_dir):
    return api.split(_table(spark, sf_dir, "lineitem"), LINEITEM)[1].select(*_Q, codes(F.col("_errors")).alias("errors"))


@query("errors_by_path_dataset", " UNION ALL ".join("SELECT '{}' AS path, '{}' AS error, count(*) AS n FROM lineitem WHERE {} HAVING count(*) > 0".format(c.split("(", 1)[1].split(",")[0] if "regexp" in c else c.split()[0], k.replace("'", "''"), c) for k, c in _LINE_SQL.items()))
def errors_by_path_dataset(spark, sf_dir):
    return api.errors_by_path(api.validate(_table(spark, sf_dir, "lineitem"), LINEITEM))


@query("zod_issues", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS path, 'Maximum<45>' AS message, 'custom' AS code FROM lineitem WHERE l_quantity > 45")
def zod_issues(spark, sf_dir):
    checked = api.validate(_table(spark, sf_dir, "lineitem"), T.obj(T.anything, l_quantity=T.number.maximum(45)))
    issues = checked.select(*_Q, F.explode(api.zod_issues(F.col("_errors"))).alias("i"))
    return issues.select(*_Q, F.array_join("i.path", ".").alias("path"), F.col("i.message").alias("message"), F.col("i.code").alias("code"))


@query("errors_by_path", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS path, 'Maximum<10>|MultipleOf<7>' AS errors FROM lineitem WHERE l_quantity > 10 AND l_quantity % 7 <> 0")
def errors_by_path(spark, sf_dir):
    checked = api.validate(_table(spark, sf_dir, "lineitem"), T.obj(T.anything, l_quantity=T.number.maximum(10).multiple_of(7)))
    grouped = checked.select(*_Q, F.explode(api.group_errors_by_path(F.col("_errors"))).alias("path", "g"))
    return grouped.select(*_Q, "path", F.array_join("g.errors", "|").alias("errors")).where(F.size(F.split("errors", r"\|")) == 2)


_check("min_length", "documents", ["doc_id"], "text", T.string.min_length(500), [("MinLength<500>", "length(v) < 500")])
_check("max_length", "documents", ["doc_id"], "text", T.string.max_length(3000), [("MaxLength<3000>", "length(v) > 3000")])
_check("length_range", "part", ["p_partkey"], "p_name", T.string.length(6, 9), [("MinLength<6>", "length(v) < 6"), ("MaxLength<9>", "length(v) > 9")])
_check("pattern", "part", ["p_partkey"], "p_brand", T.string.pattern("^Brand#[1-3][0-9]$"), [("Pattern<^Brand#[1-3][0-9]$>", "NOT regexp_matches(v, '^Brand#[1-3][0-9]$')")])
_check("pattern_long_subject", "documents", ["doc_id"], "text", T.string.pattern("the"), [("Pattern<the>", "length(v) > 10000 OR NOT regexp_matches(v, 'the')")])
_check("minimum", "orders", ["o_orderkey"], "o_totalprice", T.number.minimum(50000), [("Minimum<50000>", "v < 50000")])
_check("maximum", "orders", ["o_orderkey"], "o_totalprice", T.number.maximum(200000), [("Maximum<200000>", "v > 200000")])
_check("exclusive_minimum", "part", ["p_partkey"], "p_size", T.number.exclusive_minimum(10), [("ExclusiveMinimum<10>", "v <= 10")])
_check("exclusive_maximum", "part", ["p_partkey"], "p_size", T.number.exclusive_maximum(40), [("ExclusiveMaximum<40>", "v >= 40")])
_check("range", "customer", ["c_custkey"], "c_acctbal", T.number.range(0, 5000), [("Minimum<0>", "v < 0"), ("Maximum<5000>", "v > 5000")])
_check("multiple_of", "lineitem", list(_Q), "l_quantity", T.number.multiple_of(7), [("MultipleOf<7>", "v % 7 <> 0")])
_check("multiple_of_decimal", "part", ["p_partkey"], "p_retailprice", T.number.multiple_of(0.25), [("MultipleOf<0.25>", "abs(v / 0.25 - round(v / 0.25)) > 1e-8 * greatest(1, abs(v / 0.25))")])
_check("min_items", "embeddings", ["vec_id"], "embedding", T.array(T.number).min_items(100), [("MinItems<100>", "len(v) < 100")])
_check("max_items", "embeddings", ["vec_id"], "embedding", T.array(T.number).max_items(10), [("MaxItems<10>", "len(v) > 10")])
_check("contains", "embeddings", ["vec_id"], "embedding", T.array(T.number).contains(T.number.minimum(0.2)), [("Contains<min:1>", "len(list_filter(v, lambda x: x >= 0.2)) < 1")])
_check("min_max_contains", "embeddings", ["vec_id"], "embedding", T.array(T.number).contains(T.number.minimum(0.05), 10, 20), [("Contains<min:10>", "len(list_filter(v, lambda x: x >= 0.05)) < 10"), ("Contains<max:20>", "len(list_filter(v, lambda x: x >= 0.05)) > 20")])
_check("unique_items", "events", ["event_id"], lambda: F.array("user_id", F.col("event_id") % 50), T.array(T.integer).unique_items(), [("UniqueItems", "v[1] = v[2]")], sql_value="[user_id, event_id % 50]")
_check("custom_constraint", "lineitem", list(_Q), "l_quantity", T.number.custom(lambda c: c % 2 == 0, "must be even"), [("must be even", "v % 2 <> 0")])
_check("message_override", "lineitem", list(_Q), "l_quantity", T.number.minimum(5, "too few").maximum(40).fallback_message("bad"), [("too few", "v < 5"), ("bad", "v > 40")])
_check("literal", "events", ["event_id"], "event_type", T.literal("click"), [("Literal<''click''>", "v <> 'click'")])
_check("enum", "orders", ["o_orderkey"], "o_orderstatus", T.enum("F", "O"), [("Type<''F''|''O''>", "v NOT IN ('F','O')")])
_check("template_literal", "customer", ["c_custkey"], "c_name", T.template("Customer#", T.number), [("`Customer#${number}`", "NOT regexp_full_match(v, 'Customer#[0-9]+(\\.[0-9]+)?')")])
_check("tuple", "orders", ["o_orderkey"], lambda: F.struct(F.col("o_orderstatus").alias("_0"), F.col("o_totalprice").alias("_1")), T.tuple_of(T.enum("O", "F"), T.number.minimum(50000)), [("Type<''O''|''F''>", "v[1] NOT IN ('O','F')"), ("Minimum<50000>", "v[2]::double < 50000")], sql_value="[o_orderstatus, o_totalprice::varchar]")
_check("record", "events", ["event_id"], lambda: F.create_map(F.lit("value"), "value"), T.record(T.number.minimum(20)), [("Minimum<20>", "v < 20")], sql_value="value")
_check("property_names", "events", ["event_id"], lambda: F.create_map("event_type", "value"), T.record(T.number).property_names(T.string.max_length(5)), [("MaxLength<5>", "length(v) > 5")], sql_value="event_type")
_check("min_max_properties", "events", ["event_id"], lambda: F.from_json("props", "map<string,double>"), T.record(T.number).properties_range(2, 3), [("MinProperties<2>", "len(json_keys(v)) < 2"), ("MaxProperties<3>", "len(json_keys(v)) > 3")], sql_value="props")
_check("set", "orders", ["o_orderkey"], lambda: F.array("o_orderstatus", F.lit("F")), T.set_of(T.enum("F", "O")), [("Type<''F''|''O''>", "v NOT IN ('F','O')")], sql_value="o_orderstatus")
_check("intersection", "orders", ["o_orderkey"], lambda: F.struct("o_orderstatus", "o_totalprice"), T.intersection(T.obj(o_orderstatus=T.string), T.obj(o_totalprice=T.number.maximum(200000))), [("Maximum<200000>", "v > 200000")], sql_value="o_totalprice")
_check("requires", "events", ["event_id"], lambda: F.struct(F.col("event_type").alias("a"), F.when(F.col("value") > 50, F.col("value")).alias("b")), T.obj(a=T.string.requires("b"), b=T.number.opt()), [("Requires<b>", "v <= 50")], sql_value="value")
_check("nullish", "events", ["event_id"], lambda: F.when(F.col("value") > 50, F.col("value")), T.number.nullish().maximum(80), [("Maximum<80>", "v > 50 AND v > 80")], sql_value="value")
_check("not_nullable", "events", ["event_id"], lambda: F.when(F.col("value") > 50, F.col("value")), T.number.maximum(80), [("Maximum<80>", "v > 80"), ("Type<number>", "v <= 50")], sql_value="value")
_check("mode_strict", "events", ["event_id"], lambda: F.struct("event_id", F.when(F.col("value") > 50, F.col("value")).alias("noise")), T.obj(event_id=T.integer), [("PropertyNotAllowed<noise>", "v > 50")], sql_value="value")
_check("union", "events", ["event_id"], "event_type", T.union("click", T.string.max_length(4)), [("Type<''click''|string>", "v <> 'click' AND length(v) > 4")])
_check("tagged_union", "events", ["event_id"], lambda: F.struct("event_type", "value"), T.union(*(T.obj(event_type=T.literal(k), value=T.number.maximum(m)) for k, m in (("click", 50), ("view", 20), ("signup", 70), ("error", 90), ("purchase", 10)))), [(f"Maximum<{m}>", f"v[1] = '{k}' AND v[2]::double > {m}") for k, m in (("click", 50), ("view", 20), ("signup", 70), ("error", 90), ("purchase", 10))], sql_value="[event_type, value::varchar]")

# Formats: for each the texts that have it and those that don't, dealt over the rows.
_FORMATS = {
    "fmt_email": ("email", ["a@b.co", "first.last+tag@sub.host-1.org", "x!#$%&'*+/=?^_`{|}~-@d.io", "A@B.CO"], ["a", "@b.co", "a@", "a@b", "a..b@c.de", ".a@b.co", "a.@b.co", "a@@b.co", "a@-b.co", "a@b-.co", "a@b.c", "a@b.c1", "a b@c.de", "é@b.co"]),
    "fmt_idn_email": ("idn-email", ["é@é.org", "用户@例子.广告", "a1@b2.co"], ["é", "é@", "é..a@é.org", ".é@é.org", "é@-é.org", "é@é.o", "é@é.1a"]),
    "fmt_uuid": ("uuid", ["0f8fad5b-d9cb-469f-a165-70867728950e", "0F8FAD5B-D9CB-869F-B165-70867728950E", "00000000-0000-0000-0000-000000000000"], ["0f8fad5b-d9cb-969f-a165-70867728950e", "0f8fad5b-d9cb-469f-c165-70867728950e", "0f8fad5bd9cb469fa16570867728950e", "0f8fad5b-d9cb-069f-a165-70867728950e", ""]),
    "fmt_url": ("url", ["http://ab", "HTTPS://host.org/p?q#f", "ftp://x.y", "http://a b", "https://é1"], ["http://a", "http://", "mailto:x@y.z", "http:///ab", "http://.ab", "http://?ab", "http://#ab", "http://ab c", "//ab.org", " http://ab"]),
    "fmt_ipv4": ("ipv4", ["0.0.0.0", "255.255.255.255", "1.2.3.4", "01.002.3.4"], ["256.1.1.1", "1.2.3", "1.2.3.4.5", "1.2.3.a", "1.2.3.4 ", "0001.2.3.4"]),
    "fmt_ipv6": ("ipv6", ["1:2:3:4:5:6:7:8", "::", "::1", "1::", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "fe80::1%eth0", "fe80:%a", "::1.2.3.4", "::ffff:1.2.3.4", "::ffff:0:1.2.3.4", "64:ff9b::192.0.2.33", "ABCD::"], ["FE80::1%eth0", "::FFFF:1.2.3.4", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", ":::", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7::8", "::1.2.3.256", "1:2:3:4:5::1.2.3.4", ":1", "1:", "fe80::1%", ""]),
    "fmt_date": ("date", ["2024-02-29", "2023-12-31", "0001-01-01"], ["2023-02-29", "2024-13-01", "2024-00-10", "2024-04-31", "24-01-01", "2024-1-1", "2024-02-29T00:00:00Z"]),
    "fmt_date_time": ("date-time", ["2024-02-29T10:00:00Z", "2023-01-01t23:59:59.123+01:00", "2023-01-01T00:00:00z"], ["2023-02-29T10:00:00Z", "2023-01-01T24:00:00Z", "2023-01-01T10:00:00", "2023-01-01 10:00:00Z", "2023-01-01"]),
    "fmt_time": ("time", ["10:00:00Z", "23:59:59.5+01:00", "00:00:00-23:59"], ["24:00:00Z", "10:60:00Z", "10:00:00", "1:00:00Z"]),
    "fmt_duration": ("duration", ["P1Y", "P1Y2M3DT4H5M6S", "PT1H", "P2W", "P1DT1H"], ["P", "PT", "P1DT", "1D", "P1H", "P-1D", "P1D2Y"]),
    "fmt_byte": ("byte", ["", "QUJD", "QUI=", "QQ=="], ["QQ=", "QQ", "Q===", "QU-D", "QUJD\n"]),
    "fmt_object_id": ("objectId", ["507f1f77bcf86cd799439011", "507F1F77BCF86CD799439011"], ["507f1f77bcf86cd79943901", "507f1f77bcf86cd79943901g", ""]),
    "fmt_hostname": ("hostname", ["localhost", "LocalHost", "a.bc", "x-1.host.org", "1.2.ab"], ["a", "192.168.0.1", "-a.org", "a-.org", "a..org", "a.b", "a.b1", "a_b.org", "", "a.org."]),
    "fmt_idn_hostname": ("idn-hostname", ["localhost", "é.org", "例子.广告", "a-é.éa"], ["é", "-é.org", "é-.org", "é.o", "é.1a", ""]),
    "fmt_uri": ("uri", ["http://a", "urn:x", "mailto:a@b.c", "http://é.org", "a:%zz", "x:", "file:", "x+1.-:a"], ["http:", "https:", "ws:", "noscheme", "1a:b", "x:a b", "x:a<b", "x:a|b", "x:^", "", ":a"]),
    "fmt_uri_reference": ("uri-reference", ["", "é", "/p", "a/b?c#d", "//host/p", "urn:x", "../x", "http:", "?q", "//u@h.org:80/x", "//[::1]/"], ["/p q", "a<b", "a{b}", "//", "https:", "//:80", "a\\b", "//h:port", "a^b"]),
    "fmt_iri": ("iri", ["x:é", "x:a/b", "http://é.org/ü", "a:<>", "http:x"], ["é", "x:", "x:a b", "1:a", "", "x:\u007fa"]),
    "fmt_iri_reference": ("iri-reference", ["", "é", "é<4", "/é|ü", "x:é", "//é.org/<a>", "//"], ["é ü", "a\tb", "//h<x/", "a\u007fb"]),
    "fmt_uri_template": ("uri-template", ["/p/{id}", "a'b", "{?a,b*,c:3}", "{+x.y}", "é{%41}", "plain"], ["", "/p/{id", "/p/id}", "{}", "{a b}", "{a:0}", "{{a}}", "a b", "{a..b}", "{a:12345}"]),
    "fmt_unknown": ("no-such-format", [], ["a", ""]),
    "fmt_password": ("password", ["a", "", "a b"], []),
    "fmt_regex": ("regex", ["(a)1", "((a+))+", "((a|b))+", "a+b*", "[(+]+", "(a+)?", "a{2}"], ["(a+)+", "(a+){2}", "(a{2})+", "(a|b){3}", "(a|b)*", "((a)+)+", "(a)\\1", "(", "a)", "["]),
}


def _format(name: str, fmt: str, good: list[str], bad: list[str]) -> None:
    values = good + bad

    def run(spark, sf_dir):
        texts = F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", texts.alias("v"))
        c = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.string.format(fmt))
        return rows.select("o_orderkey", "v", F.coalesce(c.ok, F.lit(False)).alias("ok"), codes(c.errors).alias("errors"))

    def texts(items):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"][o_orderkey % {len(items)} + 1]"

    QUERIES[name] = run
    ok = f"(o_orderkey % {len(values)} < {len(good)})"
    SQL[name] = f"SELECT o_orderkey, {texts(values)} AS v, {ok} AS ok, CASE WHEN {ok} THEN '' ELSE 'Format<{fmt}>' END AS errors FROM orders"


for _name, _row in _FORMATS.items():
    _format(_name, *_row)


def _rewrite(name: str, value: str, contract: T.Type, sql: str, from_=None) -> None:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(value).alias("v"))
        c = api.compile_column(F.col("v"), rows.schema["v"].dataType, contract, from_=from_)
        return rows.select("o_orderkey", c.data.cast("string").alias("v"))

    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, {sql} AS v FROM orders"


_rewrite("trim", "concat(' \t', o_orderpriority, '\n ')", T.string.trim(), "o_orderpriority")
_rewrite("lower", "o_orderpriority", T.string.lower(), "lower(o_orderpriority)")
_rewrite("upper", "concat('straße ', o_orderpriority)", T.string.upper(), "'STRASSE ' || upper(o_orderpriority)")
_rewrite("capitalize", "concat('ab', o_orderpriority)", T.string.capitalize(), "'Ab' || o_orderpriority")
_rewrite("transform_custom", "o_orderpriority", T.string.map(lambda c: F.concat(F.lit("web_"), c)), "'web_' || o_orderpriority")
_rewrite("transform_pipe", "concat('  ', o_orderpriority)", T.string.trim().lower().capitalize(), "upper(o_orderpriority[1]) || lower(o_orderpriority[2:])")
_rewrite("default", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END", T.string.with_default("guest"), "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'guest' END")
_rewrite("to_number", "CASE WHEN o_orderkey % 2 = 0 THEN concat(' ', o_orderkey, '.5 ') ELSE '0x10' END", T.number.to_number().opt(), "CASE WHEN o_orderkey % 2 = 0 THEN concat(o_orderkey, '.5') END")
_rewrite("to_boolean", "element_at(array('yes','OFF','1','maybe'), CAST(o_orderkey % 4 AS int) + 1)", T.boolean.to_boolean().opt(), "['true','false','true',NULL][o_orderkey % 4 + 1]")
_rewrite("to_date", "CASE WHEN o_orderkey % 2 = 0 THEN '2024-03-01T10:00:00Z' ELSE 'March' END", T.date.to_date().opt(), "CASE WHEN o_orderkey % 2 = 0 THEN '2024-03-01 10:00:00' END")
_rewrite("coerce_query_number", "concat(o_orderkey, 'e0')", T.number.to_number(), "concat(o_orderkey, '.0')")

_CASES = {"snake_case": "home_address", "SNAKE_CASE": "HOME_ADDRESS", "kebab-case": "home-address", "dot.case": "home.address", "camelCase": "homeAddress", "camelCaseID": "homeAddress", "PascalCase": "HomeAddress", "PascalCaseID": "HomeAddress"}
_IDS = {"snake_case": "cust_id", "SNAKE_CASE": "CUST_ID", "kebab-case": "cust-id", "dot.case": "cust.id", "camelCase": "custId", "camelCaseID": "custID", "PascalCase": "CustId", "PascalCaseID": "CustID"}


def _case(target: str) -> None:
    def run(spark, sf_dir):
        df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custId"), F.col("c_name").alias("home_Address"))
        return casing.convert_casing(df, target)

    name = "case_" + {"SNAKE_CASE": "upper_snake"}.get(target, target.replace("-", "_").replace(".", "_").replace("_case", "").replace("Case", "").lower())
    QUERIES[name], SQL[name] = run, f'SELECT c_custkey AS "{_IDS[target]}", c_name AS "{_CASES[target]}" FROM customer'


for _target in _CASES:
    _case(_target)


@query("case_preserve_ends", 'SELECT c_custkey AS "custKey", c_name AS "cName" FROM customer')
def case_preserve_ends(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_cust_key$"), F.col("c_name").alias("__c_name"))
    return casing.convert_casing(df, "camelCase", preserve_ends=False)


def _first_error(p: Column) -> list[Column]:
    return [p["ok"].alias("ok"), p["error"]["path"].alias("path"), p["error"]["message"].alias("message")]


@query("array_paths", """SELECT vec_id, list_filter(generate_series(0, len(embedding) - 1), lambda i: embedding[i + 1] > 0.2).list_transform(lambda i: concat('v[', i, ']')).list_aggregate('string_agg', '|') AS paths FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) > 0""")
def array_paths(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    made = api.compile_column(F.struct("v"), rows.select("v").schema, T.obj(v=T.array(T.number.maximum(0.2))))
    return rows.select("vec_id", made.errors.alias("e")).where(F.size("e") > 0).select("vec_id", F.array_join(F.transform("e", lambda x: x["path"]), "|").alias("paths"))


@query("requires_relative", "SELECT o_orderkey, o_orderkey % 3 = 0 AS ok, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a.b: Requires<.c>|a.b: Requires<..d>' END AS errors FROM orders")
def requires_relative(spark, sf_dir):
    """.c stands beside the value, ..d beside the object around it; e.f leads from the root."""
    there = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    a = F.struct(F.col("o_orderkey").alias("b"), there.alias("c"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(a.alias("a"), there.alias("d"), F.struct(F.col("o_orderkey").alias("f")).alias("e")).alias("v"))
    t = T.obj(a=T.obj(b=T.integer.requires(".c", "..d", "e.f"), c=T.string.opt()), d=T.string.opt(), e=T.anything)
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, t)
    said = F.array_join(F.transform(made.errors, lambda e: F.concat(e["path"], F.lit(": "), e["error"])), "|")
    return rows.select("o_orderkey", F.coalesce(made.ok, F.lit(False)).alias("ok"), said.alias("errors"))


@query("map", "SELECT event_id, event_id % 2 = 0 AND value <= 50 AS ok, concat_ws('|', CASE WHEN event_id % 2 <> 0 THEN 'm.key(' || event_id || '): MultipleOf<2>' END, CASE WHEN value > 50 THEN 'm[' || event_id || ']: Maximum<50>' END) AS errors FROM events")
def map_query(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.create_map("event_id", "value").alias("m"))
    made = api.compile_column(F.struct("m"), rows.select("m").schema, T.obj(m=T.map_of(T.integer.multiple_of(2), T.number.maximum(50))))
    said = F.array_join(F.transform(made.errors, lambda e: F.concat(e["path"], F.lit(": "), e["error"])), "|")
    return rows.select("event_id", F.coalesce(made.ok, F.lit(False)).alias("ok"), said.alias("errors"))


#: A value that is left out, null, right or wrong, as JSON.
_ABSENT = """CASE CAST(event_id % 4 AS int) WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"a":1,"b":null}' WHEN 2 THEN '{"a":1,"b":"x"}' ELSE '{"a":1,"b":7}' END"""


def _presence(name: str, b: T.Type, good: str) -> None:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.expr(_ABSENT)).alias("v"))
        made = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.obj(a=T.number, b=b))
        return rows.select("event_id", F.coalesce(made.ok, F.lit(False)).alias("ok"), F.get(made.errors, F.lit(0))["error"].alias("error"))

    QUERIES[name] = run
    SQL[name] = f"SELECT event_id, event_id % 4 IN ({good}) AS ok, CASE WHEN event_id % 4 NOT IN ({good}) THEN 'Type<string>' END AS error FROM events"


_presence("optional", T.string.opt(), "0, 2")
_presence("nullable", T.string.null(), "1, 2")
_presence("nullish_json", T.string.nullish(), "0, 1, 2")


def _parsed(name: str, values: list[tuple[str, str | None, str | None, str | None]], t: T.Type, show=None, **options) -> None:
    """Texts, each with what parse() makes of it: (text, data as text, error path, error message)."""

    def run(spark, sf_dir):
        texts = F.element_at(F.array(*(F.lit(v[0]) for v in values)), (F.col("event_id") % len(values) + 1).cast("int"))
        p = _table(spark, sf_dir, "events").select("event_id", parse.parse(texts, t, **options).alias("p"))
        return p.select("event_id", *_first_error(F.col("p")), (show or F.to_json)(F.col("p.data")).alias("data"))

    def pick(k):
        return "[" + ", ".join("NULL" if v[k] is None else "'" + v[k].replace("'", "''") + "'" for v in values) + f"][event_id % {len(values)} + 1]"

    QUERIES[name] = run
    SQL[name] = f"SELECT event_id, {pick(3)} IS NULL AS ok, {pick(2)} AS path, {pick(3)} AS message, {pick(1)} AS data FROM events"


_parsed("parse_kinds", [
    ('{"s":"x","n":1,"b":true,"l":["a"]}', '{"s":"x","n":1.0,"b":true,"l":["a"]}', None, None), ('{"s":5,"n":1,"b":true,"l":[]}', None, "s", "Type<string>"),
    ('{"s":true,"n":1,"b":true,"l":[]}', None, "s", "Type<string>"), ('{"s":{"x":1},"n":1,"b":true,"l":[]}', None, "s", "Type<string>"), ('{"s":null,"n":1,"b":true,"l":[]}', None, "s", "Type<string>"),
    ('{"s":"x","n":"1","b":true,"l":[]}', None, "n", "Type<number>"), ('{"s":"x","n":1,"b":"true","l":[]}', None, "b", "Type<boolean>"), ('{"s":"x","n":1,"b":true,"l":"a"}', None, "l", "Type<Array>"),
    ('{"s":"x","n":1,"b":true,"l":["a",2]}', None, "l[1]", "Type<string>"), ('{"n":1,"b":true,"l":[]}', None, "s", "Type<string>"), ("[]", None, "", "Type<Object>"), ("null", None, "", "Type<Object>"), ('{"s":', None, "", "Invalid JSON"),
], T.obj(s=T.string, n=T.number, b=T.boolean, l=T.array(T.string)))
_parsed("parse_strict", [('{"a":"x"}', '{"a":"x"}', None, None), ('{"a":"x","z":1}', None, "", "PropertyNotAllowed<z>"), ('{"a":1,"z":1}', None, "a", "Type<string>")], T.obj(a=T.string), mode="strict")
_parsed("parse_strip", [('{"a":"x"}', '{"a":"x"}', None, None), ('{"a":"x","z":1}', '{"a":"x"}', None, None)], T.obj(a=T.string), mode="strip")
_parsed("parse_relaxed", [('{"a":"x"}', '{"a":"x","_rest":{}}', None, None), ('{"a":"x","z":[1]}', '{"a":"x","_rest":{"z":[1]}}', None, None)], T.obj(a=T.string), mode="relaxed")
_parsed("parse_union", [('{"v":"x"}', '{"v":"x"}', None, None), ('{"v":5}', '{"v":5.0}', None, None), ('{"v":true}', None, "v", "Type<string|number>"), ("{}", None, "v", "Type<string|number>")], T.obj(v=T.union(T.string, T.number)))
_parsed("parse_tagged", [('{"k":"a","x":1,"y":2}', '{"k":"a","x":1.0}', None, None), ('{"k":"b","y":" q "}', '{"k":"b","y":"q"}', None, None), ('{"k":"c"}', None, "", "Type<Object|Object>"), ('{"k":"a","x":"1"}', None, "x", "Type<number>")], T.union(T.obj(k=T.literal("a"), x=T.number), T.obj(k=T.literal("b"), y=T.string.trim())))
_parsed("parse_scalar", [("5", "5.0", None, None), ("-2.5", "-2.5", None, None), ('"5"', None, "", "Type<number>"), ("5 6", None, "", "Invalid JSON"), ("3", None, "", "Minimum<5>")][:4] + [("-7", "-7.0", None, None)], T.number, show=lambda c: c.cast("string"))
_parsed("parse_query_dupes", [
    ("n=1&t=x&t=y&b=on", '{"n":1.0,"t":["x","y"],"b":true}', None, None), ("n=0x10&t=x&b=", '{"n":16.0,"t":["x"],"b":true}', None, None), ("n=1&b", '{"n":1.0,"t":[],"b":true}', None, None),
    ("n=1&n=2&b=no", None, "n", "Type<number>"), ("n=1&b=maybe", None, "b", "Type<boolean>"), ("?n=1", None, "", "Invalid query"), ("n=%31&t=a%2Bb&t=a+b&t=%zz&b=0", '{"n":1.0,"t":["a+b","a b","%zz"],"b":false}', None, None),
    ("n=1&t[]=x&t[]=y&b=1", '{"n":1.0,"t":["x","y"],"b":true}', None, None),
], T.obj(n=T.number, t=T.array(T.string), b=T.boolean), from_="query")
_parsed("parse_query_record", [("m[a]=1&m[b]=2", '{"m":{"a":1.0,"b":2.0}}', None, None), ("m[a]=x", None, "m.a", "Type<number>"), ("m=1", None, "m", "Type<Object>")], T.obj(m=T.record(T.number)), from_="query")
_parsed("parse_regexp", [('{"r":"/a+/gi"}', '{"r":{"source":"a+","flags":"gi"}}', None, None), ('{"r":{"source":"b"}}', '{"r":{"source":"b","flags":""}}', None, None), ('{"r":"a"}', None, "r", "Type<RegExp>"), ('{"r":"/(/"}', None, "r", "Type<RegExp>")], T.obj(r=T.regexp))


_parsed("parse_own_rules", [
    ('{"p":"b","z":3,"o":{"k":1},"g":"5"}', '{"p":"b","z":3.0,"o":{"k":1.0},"g":5}', None, None), ('{"p":"a","z":3,"o":{"k":1},"g":"5"}', None, "p", "Pattern<'^b'>"), ('{"p":"b","z":3,"o":{},"g":"5"}', None, "o", "Requires<k>"),
], T.obj(p=T.string.pattern("^b"), z=T.number.multiple_of(0), o=T.obj(k=T.number.opt()).requires("k"), g=T.bigint.minimum(9)))


@query("parse_reviver", "SELECT event_id, event_id % 3 <> 2 AS ok, CASE WHEN event_id % 3 = 2 THEN 'a.b' END AS path, CASE WHEN event_id % 3 = 2 THEN 'no' END AS message, CASE WHEN event_id % 3 <> 2 THEN '{\"a\":{\"b\":' || (event_id + 1) || '.0}}' END AS data FROM events")
def parse_reviver(spark, sf_dir):
    """Numbers grow by one, members named gone go, a text raises."""

    def reviver(key, value):
        if isinstance(value, str):
            raise ValueError("no")
        return parse.ABSENT if key == "gone" else value + 1 if isinstance(value, int) and not isinstance(value, bool) else value

    text = F.when(F.col("event_id") % 3 == 2, F.lit('{"a":{"b":"x"}}')).otherwise(F.concat(F.lit('{"a":{"b":'), "event_id", F.lit(',"gone":[1]}}')))
    p = _table(spark, sf_dir, "events").select("event_id", parse.parse(text, T.obj(a=T.obj(b=T.number)), mode="strict", reviver=reviver).alias("p"))
    return p.select("event_id", *_first_error(F.col("p")), F.to_json("p.data").alias("data"))


@query("union_issues", "SELECT event_id, 'Type<''click''|string>' AS error, 'Literal<''click''>|MaxLength<4>' AS issues, 'Type<''click''|string>|Literal<''click''>|MaxLength<4>' AS grouped FROM events WHERE event_type <> 'click' AND length(event_type) > 4")
def union_issues(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("v"))
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.union("click", T.string.max_length(4)))
    e = rows.select("event_id", made.errors.alias("e")).where(F.size("e") > 0)
    grouped = F.array_join(F.map_values(api.group_errors_by_path(F.col("e")))[0]["errors"], "|")
    return e.select("event_id", F.col("e")[0]["error"].alias("error"), F.array_join(F.transform(F.col("e")[0]["issues"], lambda x: x["error"]), "|").alias("issues"), grouped.alias("grouped"))


@query("tagged_union_data", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('{\"k\":\"a\",\"x\":\"', lower(o_orderstatus), '\"}') ELSE '{\"k\":\"b\",\"y\":\"none\"}' END AS data FROM orders")
def tagged_union_data(spark, sf_dir):
    """Each arm's own fields, transforms and defaults; the other arm's fields are stripped."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("k"), F.col("o_orderstatus").alias("x"), F.lit(None).cast("string").alias("y")).alias("v"))
    t = T.union(T.obj(k=T.literal("a"), x=T.string.lower()), T.obj(k=T.literal("b"), y=T.string.with_default("none")))
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, t, mode="strip")
    return rows.select("o_orderkey", F.to_json(made.data).alias("data"))


@query("from_callback", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::double ELSE -1.0 END AS v FROM orders")
def from_callback(spark, sf_dir):
    """The callback sees only values that aren't of the type: here NaN."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("double")).otherwise(F.lit(float("nan"))).alias("v"))
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.number, from_=lambda c, ctx: F.lit(-1.0))
    return rows.select("o_orderkey", made.data.alias("v"))


@query("transform_list", "SELECT o_orderkey, o_orderstatus || '-string' || '!' AS v FROM orders")
def transform_list(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("s")).alias("v"))
    steps = [lambda c, ctx: F.concat(c, F.lit("-" + ctx["type"])), lambda c, ctx: F.concat(c, F.lit("!"))]
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.obj(s=T.string), transform=steps)
    return rows.select("o_orderkey", made.data["s"].alias("v"))


@query("custom_context", "SELECT o_orderkey, o_totalprice < 200000 OR o_orderstatus = 'F' AS ok FROM orders")
def custom_context(spark, sf_dir):
    """A constraint that looks at the value beside its own."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderstatus").alias("v"))
    t = T.obj(o_totalprice=T.number.custom(lambda c, ctx: (c < 200000) | (ctx["parent"]["o_orderstatus"] == "F")), o_orderstatus=T.string)
    return rows.select("o_orderkey", api.compile_column(F.col("v"), rows.schema["v"].dataType, t).ok.alias("ok"))


@query("intersection_generic", "SELECT o_orderkey, length(o_orderpriority) >= 6 AND o_orderpriority LIKE '1%' AS ok, concat_ws('|', CASE WHEN length(o_orderpriority) < 6 THEN 'MinLength<6>' END, CASE WHEN NOT o_orderpriority LIKE '1%' THEN 'Pattern<^1>' END) AS errors FROM orders")
def intersection_generic(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    made = api.compile_column(F.col("v"), rows.schema["v"].dataType, T.intersection(T.string.min_length(6), T.string.pattern("^1")))
    return rows.select("o_orderkey", F.coalesce(made.ok, F.lit(False)).alias("ok"), codes(made.errors).alias("errors"))


#: Doubles and how they are written.
_NUMBERS = {"1e20": "100000000000000000000", "1e21": "1e+21", "1.5e300": "1.5e+300", "0.0001": "0.0001", "0.000001": "0.000001", "1e-7": "1e-7", "-1.25e-9": "-1.25e-9", "123.456": "123.456", "-0.0": "0", "1e7": "10000000", "12345678.9": "12345678.9", "-3.0": "-3", "5e-324": "5e-324"}


@query("stringify_numbers", "SELECT o_orderkey, [" + ", ".join(f"'{x}'" for x in _NUMBERS.values()) + f"][o_orderkey % {len(_NUMBERS)} + 1] AS json FROM orders")
def stringify_numbers(spark, sf_dir):
    value = F.element_at(F.array(*(F.lit(float(x)) for x in _NUMBERS)), (F.col("o_orderkey") % len(_NUMBERS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", serialize.json_text(F.col("v"), rows.schema["v"].dataType).alias("json"))


@query("stringify_query_nested", "SELECT o_orderkey, concat('t%5B0%5D=a&t%5B1%5D=', o_orderkey, '&m%5Bx%5D=', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '&o=1' ELSE '' END, '&d%5Be%5D=&d%5Bp%5D%5B%5D=1') AS q FROM orders")
def stringify_query_nested(spark, sf_dir):
    """A VARIANT holds the keys of its objects in order."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.struct(F.lit("a").alias("_0"), F.col("o_orderkey").alias("_1")).alias("t"), F.create_map(F.lit("x"), "o_orderkey").alias("m"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("o"), F.parse_json(F.lit('{"p":[1],"e":{}}')).alias("d")).alias("v"))
    t = T.obj(t=T.tuple_of(T.string, T.integer), m=T.record(T.integer), o=T.integer.opt(), d=T.anything)
    return rows.select("o_orderkey", serialize.query_text(F.col("v"), rows.schema["v"].dataType, t).alias("q"))


@query("stringify_union", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"k\":\"a\",\"x\":1}' ELSE '{\"k\":\"b\",\"y\":[\"z\",2]}' END AS json FROM orders")
def stringify_union(spark, sf_dir):
    """Only the fields of the arm that the tag names; a tuple is a list."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("k"), F.lit(1).alias("x"), F.struct(F.lit("z").alias("_0"), F.lit(2).alias("_1")).alias("y")).alias("v"))
    t = T.union(T.obj(k=T.literal("a"), x=T.integer), T.obj(k=T.literal("b"), y=T.tuple_of(T.string, T.integer)))
    return rows.select("o_orderkey", serialize.json_text(F.col("v"), rows.schema["v"].dataType, t).alias("json"))


@query("stringify_replacer", "SELECT n_nationkey, concat('{\"n_name\":\"', lower(n_name), '\"}') AS json FROM nation")
def stringify_replacer(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    write = serialize.serializer(df.schema, replacer=lambda k, v: parse.ABSENT if k == "n_nationkey" else v.lower() if isinstance(v, str) else v)
    return df.select("n_nationkey", write(F.struct(*df.columns)).alias("json"))


@query("case_json", """SELECT o_orderkey, concat('{"orderKey":', o_orderkey, ',"a1BC":[{"userID":1}],"someConst":null}') AS json FROM orders""")
def case_json(spark, sf_dir):
    text = F.concat(F.lit('{"order_key":'), "o_orderkey", F.lit(',"A1B-C":[{"user_id":1}],"SOME_CONST":null}'))
    return _table(spark, sf_dir, "orders").select("o_orderkey", casing.convert_json(text, "camelCaseID").alias("json"))


# JSON Schema, on JSON made from rows.
_ORDER_JSON = "to_json(named_struct('id', o_orderkey, 'status', o_orderstatus, 'total', o_totalprice, 'note', CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'tags', array(o_orderstatus, 'F', CAST(o_orderkey % 4 AS string))))"
_SCHEMAS = {
    "all_of": ({"allOf": [{"type": "object", "properties": {"total": {"minimum": 50000}}, "additionalProperties": True}, {"properties": {"status": {"enum": ["F", "O"]}}}]}, "o_totalprice >= 50000 AND o_orderstatus IN ('F','O')"),
    "any_of": ({"anyOf": [{"properties": {"total": {"maximum": 50000}}}, {"properties": {"status": {"const": "F"}}}]}, "o_totalprice <= 50000 OR o_orderstatus = 'F'"),
    "one_of": ({"oneOf": [{"properties": {"total": {"maximum": 50000}}}, {"properties": {"status": {"const": "F"}}}]}, "(o_totalprice <= 50000) <> (o_orderstatus = 'F')"),
    "not": ({"not": {"properties": {"status": {"const": "F"}}}}, "o_orderstatus <> 'F'"),
    "if_then_else": ({"if": {"properties": {"status": {"const": "F"}}}, "then": {"properties": {"total": {"minimum": 100000}}}, "else": {"properties": {"total": {"maximum": 100000}}}}, "CASE WHEN o_orderstatus = 'F' THEN o_totalprice >= 100000 ELSE o_totalprice <= 100000 END"),
    "pattern_properties": ({"patternProperties": {"^to": {"maximum": 100000}}}, "o_totalprice <= 100000"),
    "additional_properties": ({"type": "object", "properties": {"id": True, "status": True, "total": True, "tags": True}}, "o_orderkey % 3 <> 0"),
    "additional_properties_schema": ({"properties": {"id": True, "total": True, "tags": True, "status": True}, "additionalProperties": {"pattern": "^1"}}, "o_orderkey % 3 <> 0 OR o_orderpriority LIKE '1%'"),
    "dependent_required": ({"dependentRequired": {"note": ["reason"]}}, "o_orderkey % 3 <> 0"),
    "dependent_schemas": ({"dependentSchemas": {"note": {"properties": {"total": {"maximum": 100000}}}}}, "o_orderkey % 3 <> 0 OR o_totalprice <= 100000"),
    "dependencies": ({"dependencies": {"note": ["total"], "status": {"properties": {"total": {"maximum": 100000}}}}}, "o_totalprice <= 100000"),
    "prefix_items": ({"properties": {"tags": {"prefixItems": [{"const": "F"}, True], "items": {"type": "number", "maximum": 2}}}}, "false"),
    "additional_items": ({"properties": {"tags": {"items": [{"enum": ["F", "O"]}, {"type": "string"}], "additionalItems": {"type": "string", "pattern": "^[0-2]$"}}}}, "o_orderstatus IN ('F','O') AND o_orderkey % 4 <= 2"),
    "items_false": ({"properties": {"tags": {"prefixItems": [True, True], "items": False}}}, "false"),
    "unevaluated_properties": ({"allOf": [{"properties": {"id": True, "status": True}}, {"properties": {"total": True, "tags": True}}], "unevaluatedProperties": False}, "o_orderkey % 3 <> 0"),
    "unevaluated_items": ({"properties": {"tags": {"anyOf": [{"prefixItems": [{"const": "F"}, True, True]}, {"prefixItems": [True, True]}], "unevaluatedItems": False}}}, "o_orderstatus = 'F'"),
    "contains_schema": ({"properties": {"tags": {"contains": {"const": "F"}, "minContains": 2}}}, "o_orderstatus = 'F'"),
    "ref": ({"$defs": {"money": {"minimum": 50000}}, "properties": {"total": {"$ref": "#/$defs/money"}}}, "o_totalprice >= 50000"),
    "anchor": ({"$defs": {"m": {"$anchor": "money", "minimum": 50000}}, "properties": {"total": {"$ref": "#money"}}}, "o_totalprice >= 50000"),
    "recursive_ref": ({"anyOf": [{"type": ["string", "number", "null"]}, {"type": "array", "items": {"$recursiveRef": "#"}}, {"properties": {"total": {"maximum": 100000}}, "additionalProperties": {"$ref": "#"}, "type": "object"}]}, "o_totalprice <= 100000"),
    "dynamic_ref": ({"$dynamicAnchor": "node", "properties": {"total": {"maximum": 100000}, "tags": {"items": {"$dynamicRef": "#node"}}}}, "o_totalprice <= 100000"),
    "type_array": ({"properties": {"note": {"type": ["null", "number"]}}}, "o_orderkey % 3 <> 0"),
    "typeless": ({"minProperties": 5, "minLength": 99, "minimum": 9}, "o_orderkey % 3 = 0"),
    "draft4_exclusive": ({"properties": {"id": {"minimum": 100, "exclusiveMinimum": True}}}, "o_orderkey > 100"),
    "bool_schema": ({"properties": {"note": False}}, "o_orderkey % 3 <> 0"),
    "const_deep": ({"properties": {"tags": {"const": ["F", "F", "1"]}}}, "o_orderstatus = 'F' AND o_orderkey % 4 = 1"),
    "property_names_schema": ({"propertyNames": {"maxLength": 4}}, "false"),
    "required": ({"required": ["note"]}, "o_orderkey % 3 = 0"),
}


def _schema(name: str, schema, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_JSON).alias("j"))
        return rows.select("o_orderkey", jsonschema.is_schema(F.col("j"), schema).alias("ok"))

    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, {sql} AS ok FROM orders"


def _said(errors: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(errors, lambda e: F.concat(e["path"], F.lit(": "), e["error"]))), "|")


def _schema_errors(name: str, schema, tests: list[tuple[str, str]], mode: str = "strict") -> None:
    """tests: (path: code, SQL condition that breaks it), in the order of their texts."""

    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_JSON).alias("j"))
        return rows.select("o_orderkey", _said(jsonschema.schema_errors(F.col("j"), schema, mode)).alias("errors"))

    parts = ", ".join("CASE WHEN {} THEN '{}' END".format(c, k.replace("'", "''")) for k, c in sorted(tests))
    QUERIES[name], SQL[name] = run, f"SELECT o_orderkey, concat_ws('|', {parts}) AS errors FROM orders"


_schema_errors("schema_codes", {"type": "object", "properties": {"id": {"multipleOf": 2}, "status": {"enum": ["F", "O"]}, "total": {"type": "number", "minimum": 50000, "exclusiveMaximum": 200000}, "note": {"type": "string", "pattern": "^1", "maxLength": 8}, "tags": {"items": {"type": "string", "maxLength": 0}, "maxItems": 2, "contains": {"const": "P"}}, "more": {"type": "string"}}, "required": ["note", "more", "last"]}, [
    ("id: MultipleOf<2>", "o_orderkey % 2 <> 0"), ('status: Enum<"F"|"O">', "o_orderstatus NOT IN ('F','O')"), ("total: Minimum<50000>", "o_totalprice < 50000"), ("total: ExclusiveMaximum<200000>", "o_totalprice >= 200000"),
    ("note: Type<string>", "o_orderkey % 3 <> 0"), ("note: Pattern<^1>", "o_orderkey % 3 = 0 AND NOT o_orderpriority LIKE '1%'"), ("note: MaxLength<8>", "o_orderkey % 3 = 0 AND length(o_orderpriority) > 8"),
    ("tags: MaxItems<2>", "true"), ("tags: Contains<min:1>", "o_orderstatus <> 'P'"), ("tags[0]: MaxLength<0>", "true"), ("tags[1]: MaxLength<0>", "true"), ("tags[2]: MaxLength<0>", "true"), ("more: Type<string>", "true"), ("last: Required<last>", "true"),
])
_CLOSED = {"allOf": [{"type": "object", "properties": {"id": {"type": "number"}, "status": {"const": "F"}, "tags": True}}, {"type": "object", "properties": {"total": {"maximum": 100000}}, "patternProperties": {"^n": {"maxLength": 3}}, "required": ["note"], "additionalProperties": False}]}
_schema_errors("all_of_closed", _CLOSED, [('status: Const<"F">', "o_orderstatus <> 'F'"), ("total: Maximum<100000>", "o_totalprice > 100000"), ("note: Required<note>", "o_orderkey % 3 <> 0"), ("note: MaxLength<3>", "o_orderkey % 3 = 0")])
_schema_errors("all_of_closed_unknown", {"allOf": [{"type": "object", "properties": {"id": True, "status": True}}, {"type": "object", "properties": {"total": True}}]}, [(": PropertyNotAllowed<tags>", "true"), (": PropertyNotAllowed<note>", "o_orderkey % 3 = 0")])
_schema_errors("all_of_closed_strip", {"allOf": [{"type": "object", "properties": {"id": True}}, {"type": "object", "properties": {"total": {"maximum": 100000}}}]}, [("total: Maximum<100000>", "o_totalprice > 100000")], mode="strip")
_schema_errors("unevaluated_codes", {"allOf": [{"properties": {"id": True, "status": True}}], "properties": {"tags": {"prefixItems": [True], "unevaluatedItems": {"maxLength": 0}}}, "unevaluatedProperties": False}, [
    (": UnevaluatedProperty<total>", "true"), (": UnevaluatedProperty<note>", "o_orderkey % 3 = 0"), ("tags[1]: MaxLength<0>", "true"), ("tags[2]: MaxLength<0>", "true"),
])
_schema_errors("typescript_types", {"properties": {"status": {"x-typescript-type": "Date"}, "tags": {"x-typescript-type": "Set"}, "id": {"x-typescript-type": "bigint"}}}, [("status: Type<Date>", "true"), ("tags: Type<Set>", "true"), ("id: Type<bigint>", "true")])


@query("schema_union_issues", "SELECT o_orderkey, 'Type<Union>' AS error, 'total: Maximum<50000>|status: Const<\"F\">' AS issues FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'F'")
def schema_union_issues(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER_JSON).alias("j"))
    e = rows.select("o_orderkey", F.get(jsonschema.schema_errors(F.col("j"), _SCHEMAS["any_of"][0]), F.lit(0)).alias("e")).where("e IS NOT NULL")
    return e.select("o_orderkey", F.col("e.error").alias("error"), F.array_join(F.transform("e.issues", lambda x: F.concat(x["path"], F.lit(": "), x["error"])), "|").alias("issues"))


@query("validate_schema", """SELECT o_orderkey, o_totalprice <= 200000 AS ok, CASE WHEN o_totalprice <= 200000 THEN concat('{"id":', o_orderkey, ',"status":"', o_orderstatus, '","n":', o_orderkey % 4, ',"l":["x"],"kind":"order"}') END AS data FROM orders""")
def validate_schema(spark, sf_dir):
    """Coercion from query texts, a default, and unknown keys stripped."""
    text = "to_json(named_struct('id', CAST(o_orderkey AS string), 'status', o_orderstatus, 'n', CAST(o_orderkey % 4 AS string), 'l', 'x', 'total', o_totalprice))"
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "status": {"type": "string"}, "n": {"type": "number"}, "l": {"type": "array", "items": {"type": "string"}}, "kind": {"type": "string", "default": "order"}}, "not": {"properties": {"total": {"exclusiveMinimum": 200000}}, "required": ["total"]}}
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("j"))
    got = jsonschema.validate_schema(rows, "j", schema, mode="strip", from_="query")
    return got.select("o_orderkey", F.col("_success").alias("ok"), F.col("_data").alias("data"))


for _name, (_s, _sql) in _SCHEMAS.items():
    _schema(_name, _s, _sql)


@query("content_encoding", "SELECT event_id, json_extract(props, '$.k')::double >= 50 AS ok FROM events")
def content_encoding(spark, sf_dir):
    schema = {"contentEncoding": "base64", "contentMediaType": "application/json", "contentSchema": {"properties": {"k": {"minimum": 50}}}}
    return _table(spark, sf_dir, "events").select("event_id", jsonschema.is_schema(F.concat(F.lit('"'), F.base64(F.col("props").cast("binary")), F.lit('"')), schema).alias("ok"))


@query("json_schema_emit", """SELECT '{"type": "object", "properties": {"a": {"type": "string", "minLength": 2}, "b": {"type": "number"}}, "additionalProperties": false, "required": ["a"]}' AS schema""")
def json_schema_emit(spark, sf_dir):
    import json

    return spark.range(1).select(F.lit(json.dumps(jsonschema.json_schema(T.obj(a=T.string.min_length(2), b=T.number.opt())))).alias("schema"))


@query("json_schema_defs", """SELECT '["Type1"]' AS names, '#/$defs/Type1' AS x, '{"anyOf": [{"$ref": "#/$defs/Type1"}, {"type": "null"}]}' AS y, 70 AS properties, 'object' AS z""")
def json_schema_defs(spark, sf_dir):
    """An object of 71 types that stands twice is hoisted, a small one isn't."""
    import json

    small, big = T.obj(a=T.string), T.obj(**{f"k{k}": T.number for k in range(70)})
    out = jsonschema.json_schema(T.obj(x=big, y=big.null(), z=small, w=small))
    parts = {"names": json.dumps(list(out["$defs"])), "x": out["properties"]["x"]["$ref"], "y": json.dumps(out["properties"]["y"]), "z": out["properties"]["z"]["type"]}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in parts.items()), F.lit(len(out["$defs"]["Type1"]["properties"])).alias("properties"))


@query("parse_json", "SELECT event_id, json_extract(props, '$.k')::double <= 50 AS ok, CASE WHEN json_extract(props, '$.k')::double <= 50 THEN json_extract(props, '$.k')::double END AS k FROM events")
def parse_json(spark, sf_dir):
    got = _table(spark, sf_dir, "events").select("event_id", parse.parse(F.col("props"), T.obj(k=T.number.maximum(50))).alias("p"))
    return got.select("event_id", "p.ok", F.col("p.data.k").alias("k"))


@query("parse_json_invalid", "SELECT event_id, event_id % 3 <> 0 AS ok, CASE WHEN event_id % 3 = 0 THEN 'Invalid JSON' END AS message FROM events")
def parse_json_invalid(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(" {}"))).otherwise(F.col("props"))
    got = _table(spark, sf_dir, "events").select("event_id", parse.parse(text, T.obj(k=T.number)).alias("p"))
    return got.select("event_id", "p.ok", F.col("p.error.message").alias("message"))


@query("parse_string", "SELECT o_orderkey, o_orderkey % 2 = 0 AS ok, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::double END AS v FROM orders")
def parse_string(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("x")).alias("s"))
    return rows.select("o_orderkey", parse.parse(F.col("s"), T.number, "string").alias("p")).select("o_orderkey", "p.ok", F.col("p.data").alias("v"))


@query("parse_query", "SELECT o_orderkey, o_orderkey::double AS page, concat('a b', o_orderkey) AS q, 'x,y' AS tags FROM orders")
def parse_query(spark, sf_dir):
    text = F.concat(F.lit("q=a+b"), "o_orderkey", F.lit("&page="), "o_orderkey", F.lit("&tags=x&tags=y"))
    t = T.obj(q=T.string.trim().min_length(1), page=T.number.minimum(0), tags=T.array(T.string).opt())
    got = _table(spark, sf_dir, "orders").select("o_orderkey", parse.parse(text, t, "query").alias("p"))
    return got.select("o_orderkey", F.col("p.data.page").alias("page"), F.col("p.data.q").alias("q"), F.array_join("p.data.tags", ",").alias("tags"))


@query("parse_query_brackets", """SELECT o_orderkey, concat('{"a": [{"n": "x", "r": "', o_orderkey, '"}, {"n": "y"}], "b": {"c": "1"}}') AS json FROM orders""")
def parse_query_brackets(spark, sf_dir):
    text = F.concat(F.lit("a[][n]=x&a[][r]="), "o_orderkey", F.lit("&a[][n]=y&b[c]=1&__proto__[z]=1"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", parse.query_to_json(text).alias("json"))


@query("stringify_json", """SELECT n_nationkey, concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS json FROM nation""")
def stringify_json(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return df.select("n_nationkey", serialize.json_text(F.struct(*df.columns), df.schema).alias("json"))


@query("stringify_query", "SELECT n_nationkey, concat('n_name=', replace(n_name, ' ', '%20'), '&r%5Bid%5D=', n_regionkey, '&l%5B%5D=1&l%5B%5D=', n_nationkey) AS q FROM nation")
def stringify_query(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("id")).alias("r"), F.array(F.lit(1), F.col("n_nationkey")).alias("l"))
    kind = df.drop("n_nationkey").schema
    return df.select("n_nationkey", serialize.query_text(F.struct("n_name", "r", "l"), kind).alias("q"))


@query("stringify_modes", """SELECT n_nationkey, concat('{"n_name":"', n_name, '"}') AS strip, concat('{"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS relaxed FROM nation""")
def stringify_modes(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    kind, t, c = df.select("n_name", "n_regionkey").schema, T.obj(n_name=T.string), F.struct("n_name", "n_regionkey")
    return df.select("n_nationkey", serialize.json_text(c, kind, t).alias("strip"), serialize.json_text(c, kind, t, "relaxed").alias("relaxed"))


@query("roundtrip", "SELECT o_orderkey, true AS same FROM orders")
def roundtrip(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = T.obj(o_orderkey=T.integer, o_totalprice=T.number, o_orderstatus=T.string)
    back = df.select("*", parse.parse(serialize.json_text(F.struct(*df.columns), df.schema, t), t).alias("p"))
    return back.select("o_orderkey", ((F.col("p.data.o_totalprice") == F.col("o_totalprice")) & (F.col("p.data.o_orderstatus") == F.col("o_orderstatus"))).alias("same"))


def _mode(mode: str) -> None:
    def run(spark, sf_dir):
        df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        checked = api.validate(df, T.obj(n_name=T.string.lower()), mode=mode)
        return checked.select("n_nationkey", F.to_json("_data").alias("data"))

    QUERIES[f"mode_{mode}"] = run
    tail = """, '"}'""" if mode == "strip" else """, '","n_nationkey":', n_nationkey, '}'"""
    SQL[f"mode_{mode}"] = f"""SELECT n_nationkey, concat('{{"n_name":"', lower(n_name){tail}) AS data FROM nation"""


_mode("strip")
_mode("relaxed")


@query("stream_validate", "SELECT event_id, value <= 60 AS ok FROM events")
def stream_validate(spark, sf_dir):
    """The same expressions on a file stream, run to its end into a table of the shared folder."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    checked = api.validate(stream, T.obj(T.anything, value=T.number.maximum(60))).select("event_id", F.col("_success").alias("ok"))
    run = checked.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    delete(spark, f"{root}/state")
    return spark.read.schema("event_id long, ok boolean").parquet(f"{root}/out")
