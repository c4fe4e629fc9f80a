"""Browse: project, filter, search, sort, page, count."""

from pyspark.sql import functions as F

from tabloom.model import Filter, Sort, TableMeta
from tabloom.operators import browse as b, describe, ranges, sqlview
from tabloom.workloads.registry import query

REQUEST = b.Browse(
    columns=["o_orderkey", "o_totalprice", "o_orderdate"],
    filters=[Filter("o_orderstatus", "=", "F"), Filter("o_totalprice", "between", values=[1000, 50000])],
    search="3-", sort=[Sort("o_totalprice", True), Sort("o_orderkey")], limit=100)

_MATCH = """o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000
  AND (CAST(o_orderkey AS VARCHAR) LIKE '%3-%' OR CAST(o_custkey AS VARCHAR) LIKE '%3-%'
       OR lower(o_orderstatus) LIKE '%3-%' OR lower(o_orderpriority) LIKE '%3-%')"""


@query("browse_page", f"""SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE {_MATCH}
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def browse_page(t):
    return b.browse(t.orders, REQUEST, TableMeta.of(t.orders, "orders", ["o_orderkey"])).rows


@query("browse_page_info", f"""SELECT 0::BIGINT AS "offset", 100::BIGINT AS "limit", least(count(*), 100) AS rows,
  count(*) > 100 AS truncated FROM orders WHERE {_MATCH}""")
def browse_page_info(t):
    return b.browse(t.orders, REQUEST).info


@query("browse_export", f"SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE {_MATCH}")
def browse_export(t):
    return b.browse_all(t.orders, REQUEST)


@query("project_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def project_columns(t):
    return b.project(t.orders, ["o_totalprice", "no_such_column", "o_orderkey"])


def _counts(df, filters, compile_filter=b.predicate):
    """How many rows each filter keeps, in one scan."""
    return df.agg(*[F.count_if(compile_filter(df, f)).alias(n) for n, f in filters.items()])


@query("filter_comparisons", """SELECT count(*) FILTER (WHERE l_quantity = 17) AS eq, count(*) FILTER (WHERE l_quantity <> 17) AS ne,
  count(*) FILTER (WHERE l_quantity < 17) AS lt, count(*) FILTER (WHERE l_quantity <= 17) AS le, count(*) FILTER (WHERE l_quantity > 17) AS gt,
  count(*) FILTER (WHERE l_quantity >= 17) AS ge, count(*) FILTER (WHERE l_returnflag = 'R') AS flag,
  count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS early FROM lineitem""")
def filter_comparisons(t):
    ops = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    filters = {n: Filter("l_quantity", op, 17) for n, op in ops.items()}
    filters["flag"] = Filter("l_returnflag", "=", "R")
    filters["early"] = Filter("l_shipdate", "<", "1998-01-01")
    return _counts(t.lineitem, filters)


@query("filter_text", """SELECT count(*) FILTER (WHERE lower(p_name) LIKE '%bo_t%') AS likes, count(*) FILTER (WHERE NOT lower(p_name) LIKE 'large%') AS notlikes,
  count(*) FILTER (WHERE contains(lower(p_name), 'widget')) AS holds, count(*) FILTER (WHERE starts_with(lower(p_brand), 'brand#1')) AS starts,
  count(*) FILTER (WHERE ends_with(lower(p_brand), '3')) AS ends, count(*) FILTER (WHERE p_name IS NULL OR p_name = '') AS empties,
  count(*) FILTER (WHERE regexp_matches(p_name, '^s.*t$')) AS matches, count(*) FILTER (WHERE contains(CAST(p_size AS VARCHAR), '4')) AS number_text FROM part""")
def filter_text(t):
    return _counts(t.part, {
        "likes": Filter("p_name", "like", "%BO_T%"), "notlikes": Filter("p_name", "notlike", "LARGE%"),
        "holds": Filter("p_name", "contains", "Widget"), "starts": Filter("p_brand", "startswith", "bRAND#1"),
        "ends": Filter("p_brand", "endswith", "3"), "empties": Filter("p_name", "empty"),
        "matches": Filter("p_name", "regexp", "^s.*t$"), "number_text": Filter("p_size", "contains", "4")})


@query("filter_sets", """SELECT count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS ins, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS notins,
  count(*) FILTER (WHERE false) AS in_empty, count(*) FILTER (WHERE true) AS notin_empty, count(*) FILTER (WHERE o_orderpriority IS NULL) AS nulls,
  count(*) FILTER (WHERE o_orderpriority IS NOT NULL) AS notnulls, count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 90000) AS betweens FROM orders""")
def filter_sets(t):
    return _counts(t.orders, {
        "ins": Filter("o_orderstatus", "in", values=["F", "P"]), "notins": Filter("o_orderstatus", "notin", values=["F", "P"]),
        "in_empty": Filter("o_orderstatus", "in"), "notin_empty": Filter("o_orderstatus", "notin"),
        "nulls": Filter("o_orderpriority", "null"), "notnulls": Filter("o_orderpriority", "notnull"),
        "betweens": Filter("o_totalprice", "between", values=["1000", "90000"])})


@query("filter_rows", """SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1999-06-01'
  AND l_discount BETWEEN 0.02 AND 0.05 AND contains(CAST(l_orderkey AS VARCHAR), '7')""")
def filter_rows(t):
    return b.narrow(t.lineitem, [
        Filter("l_orderkey", "contains", "7"), Filter("l_returnflag", "in", values=["A", "R"]),
        Filter("l_shipdate", ">=", "1999-06-01"), Filter("l_discount", "between", values=[0.02, 0.05])])


@query("quick_search", """SELECT * FROM part WHERE lower(p_name) LIKE '%bolt%' OR lower(p_brand) LIKE '%bolt%'
  OR lower(p_type) LIKE '%bolt%' OR CAST(p_partkey AS VARCHAR) LIKE '%bolt%' OR CAST(p_size AS VARCHAR) LIKE '%bolt%'""")
def quick_search(t):
    return b.narrow(t.part, search=" BOLT ")


@query("quick_search_number", """SELECT s_suppkey, s_name FROM supplier WHERE CAST(s_suppkey AS VARCHAR) LIKE '%7%'
  OR lower(s_name) LIKE '%7%' OR CAST(s_nationkey AS VARCHAR) LIKE '%7%'""")
def quick_search_number(t):
    return b.project(b.narrow(t.supplier, search="7"), ["s_suppkey", "s_name"])


@query("raw_condition", "SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND (c_acctbal * 2 > 9000 OR c_nationkey % 7 = 3)")
def raw_condition(t):
    return b.narrow(t.customer, [Filter("c_mktsegment", "=", "MACHINERY")], where="c_acctbal * 2 > 9000 OR c_nationkey % 7 = 3")


@query("count_exact", """SELECT count(*) AS rows, true AS exact FROM lineitem WHERE l_returnflag = 'R'
  AND (lower(l_returnflag) LIKE '%r%' OR lower(l_linestatus) LIKE '%r%' OR CAST(l_orderkey AS VARCHAR) LIKE '%r%')""")
def count_exact(t):
    return b.count(t.lineitem, [Filter("l_returnflag", "=", "R")], search="r")


@query("count_estimate", """SELECT count(*) AS rows, false AS exact FROM lineitem UNION ALL SELECT count(*), true FROM lineitem WHERE l_quantity > 10.5""")
def count_estimate(t):
    known = b.count_estimate(t.lineitem, describe.footer_rows(t.spark, t.path("lineitem")), exact=False)
    # A filter leaves no estimate.
    return known.unionByName(b.count_estimate(t.lineitem, describe.footer_rows(t.spark, t.path("lineitem")), [Filter("l_quantity", ">", 10.5)], exact=False))


@query("page_deep", """(SELECT 'line' AS place, * FROM lineitem ORDER BY l_orderkey, l_linenumber OFFSET (SELECT count(*) * 3 // 4 FROM lineitem) LIMIT 100)""")
def page_deep(t):
    """A page three quarters down, found by an index of key ranges."""
    key = ["l_orderkey", "l_linenumber"]
    index = ranges.range_index(t.lineitem, key, 32)
    rows = t.lineitem.count()
    return ranges.page_at(t.lineitem, key, rows * 3 // 4, 100, index).select(F.lit("line").alias("place"), "*")


@query("sort_keys", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal")
def sort_keys(t):
    return b.sort(b.project(t.supplier, ["s_suppkey", "s_nationkey", "s_acctbal"]), [Sort("s_nationkey", True), Sort("s_acctbal")])


@query("sort_default", "SELECT * FROM customer ORDER BY c_custkey")
def sort_default(t):
    return b.sort(t.customer, [], TableMeta.of(t.customer, "customer", ["c_custkey"]))


@query("page_offset", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 400")
def page_offset(t):
    return b.page(t.orders, 400, None, b.order_columns(t.orders, [Sort("o_orderdate"), Sort("o_orderkey")])).rows


@query("page_after_key", """SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'
  OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 150""")
def page_after_key(t):
    rows = b.project(t.orders, ["o_orderdate", "o_orderkey", "o_totalprice"])
    return b.page_after(rows, ["o_orderdate", "o_orderkey"], ["1998-06-01", 100], 150)


@query("row_keys", "SELECT l_orderkey, l_linenumber, (row_number() OVER () - 1)::BIGINT AS row FROM lineitem")
def row_keys(t):
    return b.with_row_key(t.lineitem).select("l_orderkey", "l_linenumber", F.col("__row_key.row").alias("row"))


@query("row_keys_hidden", "SELECT * FROM nation")
def row_keys_hidden(t):
    return b.browse_all(b.with_row_key(t.nation), b.Browse())


@query("head_rows", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def head_rows(t):
    return b.head(b.project(t.documents, ["doc_id", "lang", "n_chars"]), 50, [F.col("n_chars").desc(), F.col("doc_id")])


@query("clipped_page", """WITH p AS (SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 1000),
  s AS (SELECT *, (8 + strlen(text) + strlen(lang) + strlen(source) + 8)::BIGINT AS size FROM p),
  r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT doc_id, text, lang, source, n_chars FROM r WHERE before <= 300000""")
def clipped_page(t):
    return b.clip(t.documents, 1000, [F.col("doc_id")], 300_000)


@query("snapshot_rows", """WITH j AS (SELECT *, strlen(CAST(json_object('page_id', page_id, 'url', url, 'html', html) AS VARCHAR)) AS size FROM pages ORDER BY page_id LIMIT 500),
  r AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n, count(*) OVER () AS have, sum(size) OVER (ORDER BY page_id) AS run FROM j),
  k AS (SELECT max(n) AS keep FROM r, range(0, 10) AS h(i) WHERE n = have // CAST(pow(2, i) AS BIGINT) AND run <= 200000)
  SELECT page_id, url, html FROM r, k WHERE n <= keep""")
def snapshot_rows(t):
    return b.snapshot(t.pages, [F.col("page_id")], 200_000)


@query("row_cap_rows", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 500")
def row_cap_rows(t):
    return b.row_cap(t.events.select("event_id", "value"), 500, [F.col("event_id")]).rows


@query("row_cap_info", "SELECT count(*) AS total, least(count(*), 500) AS written, count(*) > 500 AS truncated FROM events")
def row_cap_info(t):
    return b.row_cap(t.events, 500).info


@query("sort_text_as_numbers", "SELECT conv_id, turn, CAST(turn AS VARCHAR) AS turn_text FROM conversations ORDER BY turn, conv_id")
def sort_text_as_numbers(t):
    df = t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("turn_text"))
    return b.sort_text(df, "turn_text", ties=["conv_id"])


@query("sort_list_elements", """SELECT conv_id, turn AS "index", text AS value FROM conversations ORDER BY turn""")
def sort_list_elements(t):
    return b.sort_elements(t.conversations.select("conv_id", F.col("turn").alias("index"), F.col("text").alias("value")), "list")


@query("sort_scored_members", "SELECT p_name || '/' || CAST(p_partkey AS VARCHAR) AS member, p_retailprice AS score FROM part ORDER BY 2 DESC, 1 DESC")
def sort_scored_members(t):
    members = t.part.select(F.concat_ws("/", "p_name", "p_partkey").alias("member"), F.col("p_retailprice").alias("score"))
    return b.sort_elements(members, "zset", desc=True)


@query("sort_in_partition", "SELECT * FROM orders WHERE o_custkey = 13 ORDER BY o_orderdate, o_orderkey DESC")
def sort_in_partition(t):
    return b.sort_in_partition(t.orders, {"o_custkey": 13}, [Sort("o_orderdate", True), Sort("o_orderkey")],
                               [Sort("o_orderdate"), Sort("o_orderkey", True)])


@query("top_k_ties", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def top_k_ties(t):
    from tabloom.operators.aggregates import top

    return top(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n", "o_custkey", 20)


_CONSOLE = """SELECT n_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  rank() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS place
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY n_name, c_mktsegment"""


@query("sql_console", _CONSOLE)
def sql_console(t):
    views = {n: getattr(t, n) for n in ("orders", "customer", "nation")}
    return sqlview.sql(t.spark, _CONSOLE, views).rows.withColumn("place", F.col("place").cast("bigint"))


@query("sql_console_cube", """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
  GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def sql_console_cube(t):
    return sqlview.sql(t.spark, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, "
                                "o_orderpriority WITH CUBE", {"orders": t.orders}).rows


@query("sql_console_info", "SELECT least(count(*), 1000) AS rows, count(*) > 1000 AS truncated FROM events")
def sql_console_info(t):
    return sqlview.sql(t.spark, "SELECT * FROM events;", {"events": t.events}, 1000).info
