from pyspark.sql import functions as F

from tabloom.operators import shaping as s


def docs(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n long, doc string").coalesce(1)


def test_infer_fields(spark):
    df = docs(spark, '{"b":1,"a":"x","_id":1}', '{"a":2,"c":null}', '{"b":3000000000,"d":{"$oid":"65"}}',
              '{"g":{"type":"Point","coordinates":[1,2]},"e":[1],"f":{"x":1},"h":1.5}')
    rows = {r.field: r for r in s.infer_fields(df, "doc", order=F.col("n")).collect()}
    assert list(rows) == ["_id", "b", "a", "c", "d", "g", "e", "f", "h"]
    assert rows["a"].type == "mixed(int,string)" and rows["b"].type == "mixed(int,long)" and rows["c"].type == "null"
    assert rows["d"].type == "objectId" and rows["g"].type == "geojson" and rows["e"].type == "array"
    assert rows["f"].type == "object" and rows["h"].type == "double"
    assert not rows["_id"].nullable and rows["b"].nullable and rows["b"].percent == 50


def test_docs_to_rows_overflow(spark):
    df = docs(spark, '{"a":1,"x":{"y":[1,2]}}', '{"a":null}', '{"z":"q"}')
    rows = s.docs_to_rows(df, "doc", {"a": "int"}, keep=["n"]).orderBy("n").collect()
    assert [r.a for r in rows] == [1, None, None]
    assert [r["…"] for r in rows] == ['{"x":{"y":[1,2]}}', None, '{"z":"q"}']


def test_hits_order(spark):
    df = docs(spark, '{"b":1,"a":2}', '{"c":1,"0":5}')
    assert s.hits_to_rows(df, "doc", "n", order=F.col("n")).columns == ["_id", "a", "b", "0", "c"]


def test_item_types(spark):
    df = docs(spark, '{"z":{"S":"k"},"n":{"NULL":true},"m":{"N":"1"}}', '{"z":{"S":"l"},"n":{"N":"5"},"m":{"S":"x"},"q":{"NULL":true}}')
    assert [(r.field, r.type) for r in s.item_columns(df, "doc", ["z"]).collect()] == [
        ("z", "S"), ("m", "mixed"), ("n", "N"), ("q", "NULL")]
    rows = s.items_to_rows(df, "doc", ["z"]).orderBy("z").collect()
    assert [tuple(r) for r in rows] == [("k", "1", None, None), ("l", "x", "5", None)]


def test_glob():
    import re

    for glob, yes, no in (("user:*", "user:1", "users"), ("a?c", "abc", "ac"), ("[ab]x", "bx", "cx"), ("a\\*", "a*", "ab"),
                          ("a.c", "a.c", "abc"), ("[^a]x", "bx", "ax")):
        assert re.match(s.glob_regex(glob), yes) and not re.match(s.glob_regex(glob), no)


def test_fields_set_and_unset(spark):
    df = docs(spark, '{"a":1,"b":2}').select(F.from_json("doc", s.FIELD_MAP).alias("m"))
    out = df.select(F.to_json(s.fields_set(F.col("m"), {"c": F.parse_json(F.lit("3"))}, ["a"]))).first()[0]
    assert out == '{"b":2,"c":3}'


def test_unreadable_and_repeated(spark):
    df = docs(spark, '{"a":1,"a":2,"b":1}', "no json", '[1]', None, '{"a":3}')
    rows = {r.field: r for r in s.infer_fields(df, "doc", order=F.col("n")).collect()}
    assert rows["a"].seen == 2 and rows["a"].percent == 40 and rows["b"].seen == 1
    out = s.docs_to_rows(df.where("n > 0"), "doc", {"a": "int"}, keep=["n"]).orderBy("n").collect()
    assert [r.a for r in out] == [None, None, None, 3]
    assert [r["…"] for r in out] == ['{"$unreadable":"no json"}', '{"$unreadable":"[1]"}', None, None]


def test_odd_field_names(spark):
    df = docs(spark, '{"a.b":1,"it\'s":2,"q\\"x":3,"$":4," ":5,"b\\\\c":6}')
    names = {"a.b": "int", "it's": "int", 'q"x': "int", "$": "int", " ": "int", "b\\c": "int"}
    assert tuple(s.docs_to_rows(df, "doc", names).first()) == (1, 2, 3, 4, 5, 6, None)


def test_fields_by_hash_aggregate(spark):
    plan = s.infer_fields(docs(spark, '{"a":1}'), "doc", order=F.col("n"))._jdf.queryExecution().executedPlan().toString()
    by_type = plan[plan.rindex("partial_count"):]
    assert "SortAggregate" not in by_type
