import pytest
from pyspark.sql import functions as F

from tabloom import Filter, Sort, TableMeta
from tabloom.operators import browse as b, flavours as v, sqlview


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Apple", 5.0, True), (2, "banana", None, False), (3, None, 7.5, None), (4, "", 1.0, True), (5, "a%b_c", 2.0, False)],
        "id long, name string, price double, ok boolean")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("f,want", [
    (Filter("price", "=", 5), [1]), (Filter("price", "!=", 5), [3, 4, 5]), (Filter("price", ">=", "2"), [1, 3, 5]),
    (Filter("name", "like", "%AN%"), [2]), (Filter("name", "notlike", "a%"), [2, 4]), (Filter("name", "contains", "%B"), [5]),
    (Filter("name", "contains", "_"), [5]), (Filter("name", "startswith", "AP"), [1]), (Filter("name", "endswith", "NA"), [2]),
    (Filter("name", "in", values=["Apple", "banana"]), [1, 2]), (Filter("name", "notin", values=["Apple"]), [2, 4, 5]),
    (Filter("name", "in"), []), (Filter("name", "notin"), [1, 2, 3, 4, 5]), (Filter("name", "null"), [3]),
    (Filter("name", "notnull"), [1, 2, 4, 5]), (Filter("name", "empty"), [3, 4]), (Filter("name", "regexp", "^[aA]"), [1, 5]),
    (Filter("price", "between", values=[1, 5]), [1, 4, 5]), (Filter("ok", "=", "true"), [1, 4]), (Filter("ok", "=", "1"), [1, 4]),
    (Filter("price", "empty"), [2]),
])
def test_relational(rows, f, want):
    assert ids(b.narrow(rows, [f])) == want


def test_errors(rows):
    for bad in (Filter("nope", "=", 1), Filter("id", "~", 1), Filter("id", "between", values=[1])):
        with pytest.raises(ValueError):
            b.narrow(rows, [bad])
    with pytest.raises(ValueError, match="unknown sort column"):
        b.sort(rows, [Sort("nope")])


def test_search_skips_floats_and_booleans(rows):
    assert ids(b.narrow(rows, search="7.5")) == []
    assert ids(b.narrow(rows, search="APPLE")) == [1]
    assert ids(b.narrow(rows, search="3")) == [3]


def test_page_limits_and_flags(spark):
    df = spark.range(1000)
    page = b.page(df, 10, 5, [F.col("id")])
    assert [r.id for r in page.rows.collect()] == [10, 11, 12, 13, 14] and page.info.first().truncated
    last = b.page(df, 995, 0, [F.col("id")])
    assert last.rows.count() == 5 and not last.info.first().truncated and last.info.first().limit == 200
    assert b.page_limit(None) == b.page_limit(0) == 200 and b.page_limit(150_000) == 150_000


def test_page_after_walks_everything(spark):
    df = spark.range(25).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    seen, last = [], None
    while True:
        rows = [(r.a, r.b) for r in b.page_after(df, ["a", "b"], last, 7).collect()]
        if not rows:
            break
        seen += rows
        last = rows[-1]
    assert seen == sorted((i % 3, i) for i in range(25))


def test_default_order_and_views(rows):
    meta = TableMeta.of(rows, "t", ["id"])
    assert "Sort" in b.sort(rows, [], meta)._jdf.queryExecution().executedPlan().toString()
    view = TableMeta("v", meta.columns, ("id",), is_view=True)
    assert b.sort(rows, [], view) is rows


def test_filters_reach_the_reader(spark, sf):
    df = b.project(b.narrow(spark.read.parquet(f"{sf}/orders.parquet"), [
        Filter("o_orderstatus", "contains", "f"), Filter("o_totalprice", "between", values=[1, 2]), Filter("o_orderkey", "in", values=[1, 2])]),
        ["o_orderkey"])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in plan and "In(o_orderkey" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_snapshot_halves(spark):
    df = spark.range(400).select("id", F.lit("x" * 50).alias("t"))
    rows = b.snapshot(df, [F.col("id")], 8_000).collect()
    assert len(rows) == 100 and max(r.id for r in rows) == 99
    assert b.snapshot(df, [F.col("id")], 10).count() == 0


def test_clip_stops_after_budget(spark):
    df = spark.range(100).select("id", F.lit("x" * 92).alias("t"))
    assert b.clip(df, 50, [F.col("id")], 950).count() == 10


def test_sort_text(spark):
    nums = spark.createDataFrame([("10",), ("9",), ("1e1",)], "t string")
    assert [r.t for r in b.sort_text(nums, "t", ties=["t"]).collect()] == ["9", "10", "1e1"]
    mixed = spark.createDataFrame([("10",), ("9",), ("x",)], "t string")
    assert [r.t for r in b.sort_text(mixed, "t").collect()] == ["10", "9", "x"]


def test_sort_in_partition_refuses(spark):
    df = spark.createDataFrame([(1, 2, 3)], "p long, c1 long, c2 long")
    clustering = [Sort("c1", True), Sort("c2")]
    for part, sorts in (({}, [Sort("c1")]), ({"p": 1}, [Sort("c2")]), ({"p": 1}, [Sort("c1"), Sort("c2")])):
        with pytest.raises(ValueError):
            b.sort_in_partition(df, part, clustering, sorts)
    b.sort_in_partition(df, {"p": 1}, clustering, [Sort("c1"), Sort("c2", True)])


def test_stream_ids_sort_as_numbers(spark):
    df = spark.createDataFrame([("10-2",), ("9-1",), ("10-10",)], "id string")
    assert [r.id for r in b.sort_elements(df, "stream").collect()] == ["9-1", "10-2", "10-10"]


# ---- flavours: one row per rule for missing values -----------------------------


@pytest.mark.parametrize("op,value,values,relational,document,search,item", [
    ("=", "Apple", (), [1], [1], [1], [1]),
    ("!=", "Apple", (), [2, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5]),
    ("notin", None, ("Apple",), [2, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5]),
    ("startswith", "a", (), [1, 5], [1, 5], [1, 5], [5]),
    ("contains", "AN", (), [2], [2], [2], []),
    ("null", None, (), [3], [3], [3], [3]),
])
def test_flavour_truth_table(rows, op, value, values, relational, document, search, item):
    f = Filter("name", op, value, values)
    got = [ids(b.narrow(rows, [f], compile_filter=rule)) for rule in
           (b.predicate, v.document_filter, v.search_index_filter, v.item_filter)]
    assert got == [relational, document, search, item]


def test_document_in_with_null(rows):
    assert ids(b.narrow(rows, [Filter("name", "in", values=[None, "Apple"])], compile_filter=v.document_filter)) == [1, 3]
    assert ids(b.narrow(rows, [Filter("name", "notin", values=[None, "Apple"])], compile_filter=v.document_filter)) == [2, 4, 5]


def test_key_value_compares_numbers_then_text(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, "abc"), (4, "")], "id long, value string")
    rule = v.key_value_filter
    assert ids(b.narrow(df, [Filter("value", "<", "9.5")], compile_filter=rule)) == [2, 4]
    assert ids(b.narrow(df, [Filter("value", "=", "10.0")], compile_filter=rule)) == [1]
    assert ids(b.narrow(df, [Filter("value", ">", "ab")], compile_filter=rule)) == [3]
    assert ids(b.narrow(df, [Filter("value", "null")], compile_filter=rule)) == []


def test_flavour_errors(rows):
    text = v.as_text_field(rows, "name")
    with pytest.raises(ValueError, match="analysed text"):
        b.narrow(text, [Filter("name", "endswith", "x")], compile_filter=v.search_index_filter)
    with pytest.raises(ValueError, match="1 to 100"):
        b.narrow(rows, [Filter("id", "in")], compile_filter=v.item_filter)
    with pytest.raises(ValueError):
        b.narrow(rows, [Filter("name", "contains", "x")], compile_filter=v.wide_column_filter)
    with pytest.raises(ValueError):
        b.narrow(rows, search="x", compile_filter=v.wide_column_filter, compile_search=v.wide_column_search)


def test_text_field_matches_words(spark):
    df = v.as_text_field(spark.createDataFrame([(1, "The quick-brown Fox"), (2, "quicker brown")], "id long, t string"), "t")
    rule = v.search_index_filter
    assert ids(b.narrow(df, [Filter("t", "contains", "Quick brown")], compile_filter=rule)) == [1]
    assert ids(b.narrow(df, [Filter("t", "startswith", "quick")], compile_filter=rule)) == [1, 2]


# ---- console -------------------------------------------------------------------


@pytest.mark.parametrize("text", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SHOW TABLES", "SET a=b", "", "SELECT 1; DROP TABLE t"])
def test_console_refuses_writes(spark, text):
    with pytest.raises(sqlview.ReadOnlyError):
        sqlview.check_read_only(spark, text)


def test_console_reads(spark):
    out = sqlview.sql(spark, "WITH x AS (SELECT id FROM t) SELECT * FROM x ORDER BY id;", {"t": spark.range(5000)}, 10)
    assert out.rows.count() == 10 and out.info.first().truncated


def test_values_that_a_column_cannot_hold(spark):
    df = spark.range(8, 13).select("id", F.col("id").cast("decimal(12,2)").alias("d"), F.col("id").cast("int").alias("i"))
    ids = lambda f: [r.id for r in b.narrow(df, [f]).orderBy("id").collect()]
    for c in ("id", "i"):
        assert ids(Filter(c, "=", 10.5)) == [] and ids(Filter(c, "!=", "10.5")) == [8, 9, 10, 11, 12]
        assert ids(Filter(c, "<", 10.5)) == [8, 9, 10] == ids(Filter(c, "<=", "10.5")) and ids(Filter(c, ">", 10.5)) == [11, 12] == ids(Filter(c, ">=", 10.5))
        assert ids(Filter(c, "in", values=[10.5, 9])) == [9] and ids(Filter(c, "notin", values=[10.5])) == [8, 9, 10, 11, 12]
        assert ids(Filter(c, "between", values=[8.5, 10.5])) == [9, 10]
        assert ids(Filter(c, "<", 10**30)) == [8, 9, 10, 11, 12] and ids(Filter(c, ">", "1e30")) == [] and ids(Filter(c, ">", -10**30)) != []
        assert ids(Filter(c, "<", float("inf"))) == [8, 9, 10, 11, 12]
    assert ids(Filter("d", "<", "9.005")) == [8, 9] and ids(Filter("d", "=", "9.005")) == [] and ids(Filter("d", "=", "9.00")) == [9]


def test_fractions_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    plan = b.narrow(spark.read.parquet(path), [Filter("id", "<", 10.5)])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,10)" in plan


def test_backslash_in_patterns(spark):
    df = spark.createDataFrame([("a\\b",), ("a%b",), ("axb",)], "t string")
    found = lambda p: sorted(r.t for r in b.narrow(df, [Filter("t", "like", p)]).collect())
    assert found("a\\b") == ["a\\b"] and found("a\\%b") == ["a%b"] and found("a_b") == ["a%b", "a\\b", "axb"] and found("%\\") == []


def test_descending_pages_reach_null_keys(spark):
    df = spark.createDataFrame([(3, 1), (2, None), (2, 5), (1, 1), (None, 2), (None, None)], "k int, n int")
    for desc in (True, False):
        seen, last = [], None
        while rows := [tuple(r) for r in b.page_after(df, ["k", "n"], last, 1, desc).collect()]:
            seen += rows
            last = rows[-1]
        assert seen == [tuple(r) for r in df.orderBy(*b.order_columns(df, [Sort("k", desc), Sort("n", desc)])).collect()] and len(seen) == 6


def test_rows_asked_for(spark):
    from tabloom.operators import sqlview
    views = {"many": spark.range(400_000)}
    assert sqlview.sql(spark, "SELECT * FROM many", views, 300_000).rows.count() == 300_000
    assert sqlview.sql(spark, "SELECT * FROM many", views).rows.count() == 400_000
    assert b.page(spark.range(200_000), 0, 150_000, [F.col("id")]).rows.count() == 150_000


def test_sorts_are_in_order(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,), (" 2",)], "t string")
    assert [r.t for r in b.sort_text(df, "t").collect()] == [None, " 2", "9", "10"]
    assert [r.t for r in b.sort_text(df.union(spark.createDataFrame([("x",)], "t string")).where("t is not null"), "t").collect()] == [" 2", "10", "9", "x"]
    ids = spark.createDataFrame([("9-2",), ("10-1",), ("9-10",), ("9",)], "id string")
    assert [r.id for r in b.sort_elements(ids, "stream").collect()] == ["9", "9-2", "9-10", "10-1"]
