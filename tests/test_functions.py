import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlake.functions import names, predicates, render
from objectlake.schema import Config, InvalidName, InvalidRequest
from objectlake.sources import documents

LIKES = [
    # anchored at both ends
    ("harbour", "harbour", False, True), ("harbour", "harbours", False, False), ("arbour", "harbour", True, False), ("", "", True, True), ("", "x", True, False),
    # any run, also none, and line feeds
    ("%", "", False, True), ("%", "a\nb", False, True), ("old %", "old mill", False, True), ("old %", "older mill", False, False), ("%mill", "windmill", False, True), ("%l%w%", "yellow", False, True), ("%w%l%", "yellow", False, False), ("a%z", "a\n\nz", True, True),
    # one code point
    ("m_ll", "mill", False, True), ("m_ll", "mull", False, True), ("m_ll", "mll", False, False), ("m_ll", "maill", False, False), ("_", "😀", True, True), ("_", "😀", False, True), ("__", "😀", True, False),
    # letter case
    ("%WIND%", "old windmill", True, True), ("%WIND%", "old windmill", False, False), ("Ö%", "öde", True, True), ("s", "ſ", True, True),
    # signs of regular expressions, and no escapes
    ("m.ll", "mill", True, False), ("[m]ill", "mill", True, False), ("(a|b)", "a", True, False), ("^a$", "^A$", True, True), ("c\\d", "c\\d", False, True), ("c\\d", "c\\d", True, True), ("c\\%d", "c%d", False, False), ("c\\%d", "c\\xyd", True, True),
    # a line feed at the end counts
    ("end", "end\n", False, False), ("end", "end\n", True, False),
]


def test_like(spark):
    df = spark.createDataFrame([(i, s) for i, (_, s, _, _) in enumerate(LIKES)], "i int, s string")
    for i, (pattern, _, ci, want) in enumerate(LIKES):
        assert df.where(F.col("i") == i).select(predicates.matches(df.s, pattern, ci)).first()[0] == want, LIKES[i]


NUMBERS = [(100.0, "100"), (1e7, "10000000"), (123456789.25, "123456789.25"), (0.05, "0.05"), (1e21, "1" + "0" * 21), (1e-7, "0.0000001"), (1.5e-9, "0.0000000015"), (-0.0, "-0"), (0.0, "0"), (-2.5, "-2.5"), (-1e20, "-1" + "0" * 20), (1.25e10, "12500000000"), (12345678.5, "12345678.5"), (float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (5e-324, None), (999999999999999.9, "999999999999999.9"), (1e15, "1000000000000000")]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x, _ in NUMBERS], "x double")
    for (x, want), r in zip(NUMBERS, df.select(render.render_double(df.x).alias("t")).collect(), strict=True):
        assert want is None or r.t == want, x


def test_typed_and_nested(spark):
    df = spark.createDataFrame([(True, 7, "t", None, [1.0, 2.5], {"b": 1.0, "a": 2.0})], "b boolean, i long, s string, n double, l array<double>, m map<string,double>")
    got = df.select([render.render(df[f.name], f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(got) == ("true", "7", "t", None, "[1 2.5]", "map[a:2 b:1]")


@pytest.mark.parametrize(("value", "want"), [([1.0, "a"], "[1 a]"), ({"k": None, "a": [True]}, "map[a:[true] k:<nil>]"), (1e21, "1e+21"), (1e-5, "1e-05"), (123456789.0, "123456789"), (0.1, "0.1"), (1.5e300, "1.5e+300")])
def test_nested_text(value, want):
    assert render.nested_text(value) == want


DOC = '{"title":"The Windmill","lot":"K7","price":250.0,"dots.in.name":"yes","none":null,"tags":[2,"oil",null],"deep":{"y":false,"x":{"z":1.5}},"wide":4e2,"sold":true,"text":"2.5e2","id":31}'
MATCHES = [
    # texts: any letter case unless asked otherwise
    ({"eq.lot": "K7"}, True), ({"eq.lot": "k7"}, True), ({"eq.lot": "k7", "ci": "false"}, False), ({"eq.lot": "k7", "ci": "0"}, False), ({"eq.lot": "k7", "ci": "off"}, True), ({"eq.lot": "K8"}, False), ({"eq.title": "the windmill"}, True),
    # numbers by their shortest form, texts as they are
    ({"eq.price": "250"}, True), ({"eq.price": "250.0"}, False), ({"eq.price": "2.5e2"}, False), ({"eq.wide": "400"}, True), ({"eq.text": "250"}, False), ({"eq.text": "2.5E2"}, True), ({"like.price": "25_"}, True),
    # booleans, null, lists and objects
    ({"eq.sold": "TRUE"}, True), ({"eq.none": ""}, False), ({"like.none": "%"}, False), ({"eq.tags": "[2 oil <nil>]"}, True), ({"eq.deep": "map[x:map[z:1.5] y:false]"}, True), ({"eq.deep": "MAP[x:map[z:1.5] y:false]"}, True), ({"like.tags": "%oil%"}, True),
    # names: dots belong to them; one that is missing never matches
    ({"eq.dots.in.name": "yes"}, True), ({"eq.absent": "yes"}, False), ({"like.absent": "%"}, False),
    # several are all needed; of repeated ones the first counts; others say nothing
    ({"eq.lot": "k7", "like.title": "%mill"}, True), ({"eq.lot": "k7", "like.title": "%mine"}, False), ({"eq.lot": ["k7", "k8"]}, True), ({"eq.lot": ["k8", "k7"]}, False), ({"eq.": "x", "like.": "y", "sort": "lot", "eq.lot": "k7"}, True),
]


def test_matcher(spark):
    df = spark.createDataFrame([(DOC,), ("[1]",), ("{",), (None,)], "t string")
    fields = predicates.json_fields("t")
    for params, want in MATCHES:
        assert df.where(predicates.parse_filters(params, fields)).count() == want, params
    assert predicates.parse_filters({"limit": "10", "eq.": "x"}, fields) is None


@pytest.mark.parametrize(("text", "value", "want"), [
    ("6.9e1", "69", True), ("690E-1", "69", True), ("68.99999999999999999999", "69", True), ("0.69", "69", False), ('"6\\u0039"', "69", True), ('"69"', "69", True), ('"169"', "69", False), ('"İK"', "ik", True), ('"K"', "k", True), ('"a\\"b"', 'a"b', True), ('"tab\\t"', "TAB\t", True), ("1e21", "1000000000000000000000", True), ('"Éa"', "éA", True),
])
def test_forms_of_a_value(spark, text, value, want):
    df = spark.createDataFrame([(f'{{"k": {text}, "other": "69 k"}}',)], "t string")
    assert bool(df.where(predicates.parse_filters({"eq.k": value}, predicates.json_fields("t"))).count()) == want


def test_scalar_filters_need_no_python(spark):
    """And parse a text once."""
    df = spark.createDataFrame([(DOC,)], "t string")
    fields = predicates.json_fields("t")
    for params in ({"eq.price": "250"}, {"eq.lot": "k7", "like.title": "The%"}):
        plan = df.where(predicates.parse_filters(params, fields))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and plan.lower().count("parse_json") + plan.count("parseJson") <= len(params), plan


@pytest.mark.parametrize(("value", "kind", "want"), [("17", "double", True), ("17.0", "double", False), ("0", "double", False), ("-0", "double", True), ("1e3", "double", False), ("17", "int", True), ("017", "int", False), ("17", "string", True)])
def test_typed_equality(spark, value, kind, want):
    df = spark.sql(f"SELECT CAST(x AS {kind}) AS x FROM VALUES ('17'), ('-0'), ('1000') AS t(x)") if kind != "int" else spark.sql("SELECT x FROM VALUES (17), (0), (1000) AS t(x)")
    assert bool(df.where(predicates.parse_filters({"eq.x": value}, predicates.typed_fields(df))).count()) == want


def test_numbers_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = df.where(predicates.parse_filters({"eq.l_quantity": "17"}, predicates.typed_fields(df)))._jdf.queryExecution().toString()
    assert "EqualTo(l_quantity,17.0)" in plan


def test_json_sources(spark):
    df = spark.createDataFrame([(1, '{"a":1,"é\\"":[null]}'), (2, "null"), (3, "[1]"), (4, "{bad"), (5, None), (6, '{"id":9,"b":{"y":1,"x":2}}')], "k long, t string")
    docs = documents.read_json(df, "t", "k")
    assert {r.k for r in docs.where("doc is not null").collect()} == {1, 6}
    out = {r.k: r.json for r in documents.write_json(docs.where("doc is not null"), "k").collect()}
    assert out == {1: '{"a":1,"id":1,"é\\"":[null]}', 6: '{"b":{"x":2,"y":1},"id":6}'}
    items = documents.read_arrays(spark.createDataFrame([("[{},1,{}]",)], "t string"), "t").collect()
    assert [r.pos for r in items] == [0, 1, 2]
    for bad in ("null", "[1]", "{", '{"a":1e999}', '{"a":NaN}'):
        with pytest.raises(InvalidRequest):
            documents.parse_object(bad)
    assert documents.parse_object('{"a":1,"a":2,"id":7}') == {"a": 2.0}
    with pytest.raises(InvalidRequest):
        documents.parse_bulk("[" + ",".join(["{}"] * 10_001) + "]")


def test_names():
    for bad in ("", "bad name!", "x" * 129, "a\n", "é", None):
        with pytest.raises(InvalidName):
            names.check_name(bad)
    assert names.check_name("A-z_0.9") and names.check_project(" p ") == "p" and names.check_project(None) == ""
    assert names.parse_id("12") == 12 and names.int_or("x", 4) == 4 and names.int_or("-1", 4) == -1
    for bad in ("abc", "0", "-1", "", "9223372036854775808", "1.0"):
        with pytest.raises(InvalidRequest):
            names.parse_id(bad)


def test_name_column(spark):
    df = spark.createDataFrame([("ok",), ("ok\n",), ("",), ("x" * 128,), ("x" * 129,)], "n string")
    assert [r[0] for r in df.select(names.valid_name(df.n)).collect()] == [True, False, False, True, False]


def test_lower(spark):
    pairs = [("ΟΔΟΣ", "οδοσ"), ("İ", "i"), ("ÉA", "éa"), ("İZ", "iz"), ("K", "k")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] for r in df.select(predicates.lower(df.a) == df.b).collect())
    assert all(df.where(df.a == a).select(predicates.same(df.a, b)).first()[0] for a, b in pairs)


def test_config(tmp_path):
    assert Config.load(f"{tmp_path}/none.yaml") == Config()
    (tmp_path / "c.yaml").write_text("# c\ndata_dir: '/x' # here\ncheckpoint_seconds: 9\n")
    assert Config.load(f"{tmp_path}/c.yaml") == Config(data_dir="/x", checkpoint_seconds=9)
    (tmp_path / "d.yaml").write_text("checkpoint_seconds: 0\n")
    with pytest.raises(InvalidRequest):
        Config.load(f"{tmp_path}/d.yaml")


def test_prefix_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = df.where(predicates.matches(df.o_orderpriority, "5%", False))._jdf.queryExecution().toString()
    assert "StringStartsWith(o_orderpriority,5)" in plan
    assert isinstance(df.schema["o_orderkey"].dataType, T.LongType)
