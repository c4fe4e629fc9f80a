"""Golden values for the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tabloom.functions import canon, convert, geometry, literals, prepare, text
from tabloom.model import Canon, kind_of

S = T.StringType()


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """One-row jobs spend their time compiling; the queries cover compiled code."""
    fast = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in fast}
    for k, value in fast.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def one(spark, value, dtype, fn):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dtype)]))
    return df.select(fn(F.col("x")).alias("r")).first().r


def many(spark, values, dtype, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", dtype)]))
    return [r.r for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


def test_float_text(spark):
    values = [20.0, 144449.04, 1234567.5, 1e6, 1e20, 1e-4, 1.5e-4, 1e-5, -0.5, 999999.0, 12345678.9, float("nan"), 0.1]
    want = ["20", "144449.04", "1.2345675e+06", "1e+06", "1e+20", "0.0001", "0.00015", "1e-05", "-0.5", "999999",
            "1.23456789e+07", "NaN", "0.1"]
    assert many(spark, values, T.DoubleType(), text.float_text) == want
    assert many(spark, [0.1, 16777216.0], T.FloatType(), text.float_text) == ["0.1", "1.6777216e+07"]


def test_plain_float(spark):
    values = [1e20, 1.5e-7, 12345678.9, 0.25, -2.5e10, 3.0]
    assert many(spark, values, T.DoubleType(), text.plain_float) == [
        "100000000000000000000", "0.00000015", "12345678.9", "0.25", "-25000000000", "3"]


def test_time_text(spark):
    n = T.TimestampNTZType()
    moment = dt.datetime(2024, 2, 29, 13, 45, 59, 120000)
    assert one(spark, moment, n, lambda c: text.time_text(c, n)) == "2024-02-29 13:45:59.12"
    assert one(spark, dt.datetime(2024, 2, 29), n, lambda c: text.time_text(c, n)) == "2024-02-29 00:00:00"
    z = T.TimestampType()
    assert one(spark, moment, z, lambda c: text.time_text(c, z)).endswith("13:45:59.12+00:00")
    assert one(spark, moment, n, lambda c: text.time_text(c, "time")) == "13:45:59.12"


def test_tsv_escapes(spark):
    raw = ["a\tb", "line\nbreak\r", "back\\slash", "\\t", "\\\\n", "plain", ""]
    escaped = many(spark, raw, S, text.tsv_escape)
    assert escaped[0] == "a\\tb" and escaped[3] == "\\\\t"
    assert many(spark, escaped, S, text.tsv_unescape) == raw


def test_excel_time(spark):
    assert many(spark, [45351.0, 45351.5, 0.25], T.DoubleType(), text.excel_time) == [
        "2024-02-29", "2024-02-29 12:00:00", "06:00:00"]


def test_preview_keeps_whole_characters(spark):
    long = "é" * 140_000 + "x"
    r = one(spark, "a" + long, S, lambda c: text.preview(c, S))
    assert r.cut and r.size == 280_002 and r.head == "a" + "é" * 131_071
    assert one(spark, "short", S, lambda c: text.preview(c, S)).head == "short"
    b = one(spark, bytes(70_000), T.BinaryType(), lambda c: text.preview(c, T.BinaryType()))
    assert b.cut and b.size == 70_000


def test_cell_size(spark):
    arr = T.ArrayType(T.StringType())
    assert one(spark, ["ab", "c"], arr, lambda c: text.cell_size(c, arr)) == 11
    assert one(spark, "é", S, lambda c: text.cell_size(c, S)) == 2
    assert one(spark, 5, T.IntegerType(), lambda c: text.cell_size(c, T.IntegerType())) == 8


def test_people_texts(spark):
    assert many(spark, [5, 2048, 5 << 20, 3 << 30], T.LongType(), text.bytes_text) == [
        "5 bytes", "2 KB", "5.0 MB", "3.0 GB"]
    assert many(spark, [0, 999, 1500, 61_000, 3_723_000], T.LongType(), text.duration_text) == [
        "1 ms", "999 ms", "1.5 s", "1m1s", "1h2m3s"]


PREPARE = [
    ("", "string", {}, ""), ("", "string", {"empty_as_null": True}, None), ("", "int", {}, None),
    ("\\N", "string", {"null_text": "\\N"}, None), (" 42 ", "int", {}, "42"), ("Yes", "bool", {}, "true"),
    ("off", "bool", {}, "false"), ("0x00FF", "binary", {}, "00FF"), ("\\x0a", "binary", {}, "0A"),
    ("zz", "binary", {}, "7A7A"),
]


@pytest.mark.parametrize("value,kind,options,want", PREPARE)
def test_prepare(spark, value, kind, options, want):
    r = one(spark, value, S, lambda c: prepare.prepare(c, kind, **options))
    assert (r.value, r.error) == (want, None)


def test_prepare_rejects(spark):
    r = one(spark, "maybe", S, lambda c: prepare.prepare(c, "bool"))
    assert r.error == 'cannot read "maybe" as true or false'


@pytest.mark.parametrize("json,kind,want", [
    ('{"$oid": "65f0"}', "string", "65f0"), ('{"a": [1.0]}', "json", '{"a":[1]}'), ("true", "bool", "true"),
    ("0", "bool", "false"), ("12.50", "decimal", "12.5"), ("null", "int", None), ('"Yes"', "bool", "true"),
    ('{"$date": "2024-01-01T00:00:00Z"}', "timestamp", "2024-01-01T00:00:00Z"), ("[1,2]", "json", "[1,2]"),
    ('{"$binary": {"base64": "AP8="}}', "binary", "00FF"),
])
def test_prepare_json(spark, json, kind, want):
    r = one(spark, json, S, lambda c: prepare.prepare_json(F.parse_json(c), kind))
    assert (r.value, r.error) == (want, None)


C = Canon
SAME = [
    ("decimal", S, "-123456789.125", "-123456789.1250"), ("decimal", S, "$12.34", "12.34"), ("int", S, "7", "007"),
    ("timestamptz", S, "2024-02-29 12:00:00+03:00", "2024-02-29 09:00:00"),
    ("timestamptz", S, "2024-02-29T09:00:00.000Z", "2024-02-29 09:00:00+00:00"),
    ("datetime", S, "2024-02-29 00:00:00", "2024-02-29"), ("time", S, "13:45:59.123", "13:45:59.123000"),
    ("json", S, '{"b": 1.50, "a": [1, 2]}', '{"a":[1,2],"b":1.5}'), ("array", S, "{1,2,3}", "[1, 2, 3]"),
    ("uuid", S, "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "{a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11}"),
    ("char", S, "ab   ", "ab"), ("varchar", S, "", None), ("binary", S, "0x", None), ("blob", S, "0xDEAD", "0xdead"),
    ("interval", S, "+01 02:03:04.000000", "1 day 02:03:04"), ("interval", S, "P1DT2H3M4S", "1 day 02:03:04"),
    ("interval", S, "+01-02", "1 year 2 mons"), ("interval", S, "-00 00:00:30.500000", "-00:00:30.5"),
    ("geometry", S, '{"type":"Point","coordinates":[24.71360000001,46.6753]}', "POINT (24.7136 46.6753)"),
    ("geometry", S, "SRID=4326;POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))",
     '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'),
]


@pytest.mark.parametrize("t,dtype,a,b", SAME)
def test_normalize_same(spark, t, dtype, a, b):
    x, y = many(spark, [a, b], dtype, lambda c: canon.normalize(c, dtype, C(t)))
    assert x == y


@pytest.mark.parametrize("t,a,b", [
    ("decimal", "1.25", "1.2"), ("datetime", "2024-02-29 23:59:59.999999", "2024-03-01 00:00:00"),
    ("text", "héllo", "hello"), ("geometry", "POINT (24.7136 46.6753)", "POINT (46.6753 24.7136)"),
    ("geometry", "POINT (1 2)", None), ("bool", "true", "false"),
])
def test_normalize_differ(spark, t, a, b):
    x, y = many(spark, [a, b], S, lambda c: canon.normalize(c, S, C(t)))
    assert x != y


def test_normalize_across_types(spark):
    f64 = one(spark, 3.141592653589793, T.DoubleType(), lambda c: canon.normalize(c, T.DoubleType(), C("float", 64)))
    assert f64 == one(spark, "3.14159265358979", S, lambda c: canon.normalize(c, S, C("float", 64)))
    f32 = one(spark, 1.5, T.FloatType(), lambda c: canon.normalize(c, T.FloatType(), C("float", 32)))
    assert f32 == one(spark, "1.5", S, lambda c: canon.normalize(c, S, C("float", 32)))
    assert one(spark, 1, T.LongType(), lambda c: canon.normalize(c, T.LongType(), C("bool"))) == \
        one(spark, True, T.BooleanType(), lambda c: canon.normalize(c, T.BooleanType(), C("bool")))
    assert one(spark, b"\xde\xad", T.BinaryType(), lambda c: canon.normalize(c, T.BinaryType(), C("blob"))) == "dead"
    assert one(spark, b"", T.BinaryType(), lambda c: canon.normalize(c, T.BinaryType(), C("blob"))) is None
    d = T.DecimalType(10, 2)
    assert one(spark, Decimal("12.50"), d, lambda c: canon.normalize(c, d, C("decimal"))) == "12.5"
    assert one(spark, 1e20, T.DoubleType(), lambda c: canon.normalize(c, T.DoubleType(), C("decimal"))) == "1" + "0" * 20


def cv(spark, value, dtype, src, dst):
    return one(spark, value, dtype, lambda c: convert.convert(c, dtype, src, dst).cast("string"))


@pytest.mark.parametrize("value,dtype,src,dst,want", [
    (1, T.LongType(), C("bool"), C("bool"), "true"),
    (True, T.BooleanType(), C("bool"), C("int"), "1"),
    ("2024-02-29 12:00:00+03:00", S, C("timestamptz"), C("datetime"), "2024-02-29 09:00:00"),
    ("2024-02-29 23:59:59.999999", S, C("datetime"), C("timestamptz"), "2024-02-29 23:59:59.999999"),
    ("13:45:59+03", S, C("time"), C("time"), "13:45:59"),
    ("2024-02-29 13:45:59.5", S, C("datetime"), C("time"), "13:45:59.5"),
    ("{1,2,3}", S, C("array"), C("json"), "[1,2,3]"),
    ("POINT (4.9 52.4)", S, C("geometry"), C("json"), '{"type":"Point","coordinates":[4.9,52.4]}'),
    ("SRID=4326;POINT (24.7136 46.6753)", S, C("geometry"), C("geometry"),
     '{"type":"Point","coordinates":[24.7136,46.6753]}'),
    ("$1,234.50", S, C("decimal", money=True), C("decimal", p=10, s=2), "1234.50"),
    ("ab   ", S, C("char"), C("varchar"), "ab"), (5, T.LongType(), C("int"), C("varchar"), "5"),
    ("plain", S, C("text"), C("json"), '"plain"'), ('say "hi"', S, C("text"), C("json"), '"say \\"hi\\""'),
    (12.5, T.DoubleType(), C("decimal"), C("decimal", p=10, s=1), "12.5"),
    (b"\x00\xff", T.BinaryType(), C("blob"), C("text"), "0x00FF"),
    (0.1, T.FloatType(), C("float", 32), C("float", 64), "0.1"),
])
def test_convert(spark, value, dtype, src, dst, want):
    assert cv(spark, value, dtype, src, dst) == want


def test_convert_fails_on_bad_value(spark):
    with pytest.raises(Exception, match="is not true or false"):
        cv(spark, "maybe", S, C("text"), C("bool"))


def test_pg_array(spark):
    got = many(spark, ['{1,2,NULL,"a b",{3,4},t}', "{}", "{1,2", '{"q\\"x"}', "{a b,c}"], S, convert.pg_array)
    assert got == ['[1,2,null,"a b",[3,4],true]', "[]", None, None, '["a b","c"]']


def test_parse_time(spark):
    got = many(spark, ["2024-02-29 12:00:00+03:00", "2024-02-29T12:00:00.5Z", "2024-02-29 12:00", "2024-02-29",
                       "2024-02-29 12:00:00+03", "noon", "2024"], S, prepare.parse_time)
    assert [r.has_offset for r in got] == [True, True, False, False, True, None, None]
    assert got[0].utc == dt.datetime(2024, 2, 29, 9) and got[0].wall == dt.datetime(2024, 2, 29, 12)
    assert got[4].utc == dt.datetime(2024, 2, 29, 9) and got[5].wall is None


LITERALS = [
    ("mysql", S, "string", "it's a \\ test", "'it\\'s a \\\\ test'"), ("postgresql", S, "string", "it's", "'it''s'"),
    ("postgresql", S, "int", "12abc", "'12abc'"), ("postgresql", S, "decimal", "12.50", "12.50"),
    ("oracle", S, "date", "2024-02-29", "TO_DATE('2024-02-29', 'YYYY-MM-DD')"),
    ("oracle", S, "timestamp", "2024-02-29 10:00:00.5+03:00",
     "TO_TIMESTAMP_TZ('2024-02-29 10:00:00.5+03:00', 'YYYY-MM-DD HH24:MI:SS.FFTZH:TZM')"),
    ("mssql", S, "string", "x", "N'x'"), ("mssql", T.BooleanType(), "bool", True, "1"),
    ("postgresql", T.BinaryType(), "binary", b"\x00\xff", "'\\x00FF'::bytea"),
    ("mssql", T.BinaryType(), "binary", b"\x00\xff", "0x00FF"),
    ("oracle", T.BinaryType(), "binary", b"\x00\xff", "HEXTORAW('00FF')"),
    ("bigquery", T.BinaryType(), "binary", b"\x00\xff", "FROM_BASE64('AP8=')"),
    ("mysql", T.BinaryType(), "binary", b"\x00\xff", "X'00FF'"),
    ("mysql", S, "string", "a\nb", "'a\\nb'"), ("sqlite", S, "string", None, "NULL"),
    ("mysql", T.DoubleType(), "float", 12.0, "12"), ("mysql", T.DoubleType(), "float", float("nan"), "'NaN'"),
]


@pytest.mark.parametrize("dialect,dtype,kind,value,want", LITERALS)
def test_literals(spark, dialect, dtype, kind, value, want):
    assert one(spark, value, dtype, lambda c: literals.literal(dialect, c, dtype, kind)) == want


def test_oracle_long_values(spark):
    got = one(spark, "é" * 3000, S, lambda c: literals.literal("oracle", c, S, "text"))
    assert got.startswith("TO_CLOB('") and got.count("TO_CLOB") == 3 and got.count("é") == 3000
    big = bytes(3000)
    assert one(spark, big, T.BinaryType(), lambda c: literals.literal("oracle", c, T.BinaryType())) == "NULL"
    assert one(spark, big, T.BinaryType(), lambda c: literals.too_large("oracle", c, T.BinaryType()))


def test_shapes(spark):
    wkts = ["SRID=4326;POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", "MULTIPOINT ((1 2), (3 4))",
            "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))", "not a shape"]
    assert many(spark, wkts, S, geometry.srid) == [4326, 0, 0, 0, 0]
    js = many(spark, wkts, S, geometry.geojson)
    assert js[0] == '{"type":"Point","coordinates":[1,2]}'
    assert js[2] == '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}' and js[4] is None
    assert many(spark, wkts, S, lambda c: F.size(geometry.vertices(geometry.parse_shape(c))))[:4] == [1, 3, 2, 8]
    b = many(spark, wkts, S, lambda c: geometry.bounds(geometry.parse_shape(c)))[3]
    assert (b.min_x, b.min_y, b.max_x, b.max_y) == (0, 0, 6, 6)
    canon_text = many(spark, wkts, S, geometry.geo_canon)
    assert canon_text[3] == "MY(Y(0 0,1 1,0 1,0 0);Y(5 5,6 6,5 6,5 5))" and canon_text[4] == "not a shape"


def test_kind_of():
    assert kind_of(T.LongType()) == "int" and kind_of("VARCHAR(20)") == "string" and kind_of("text[]") == "array"
    assert kind_of("timestamp with time zone") == "timestamp" and kind_of("whatever") == "other"


def test_interval_steps_stand_once(spark):
    """No step of an interval is spelled out again where its result is used."""
    shown = str(canon.canon_interval(F.col("x")))
    assert shown.count("regexp_extract_all(") == 2 and shown.count("lower(x") <= 1
