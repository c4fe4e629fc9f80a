"""Aggregates, newest versions, and the joins that feed them."""

from pyspark.sql import functions as F

from tabloom.operators import aggregates as a, checks, joins as j, setops
from tabloom.workloads.registry import query


def money(col):
    """Cents are exact as decimals; the sum is shown as a double."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def _sum(col):
    return f"CAST(sum(CAST({col} AS DECIMAL(18,2))) AS DOUBLE)"


@query("terms_buckets", f"""SELECT l_returnflag AS key, count(*) AS doc_count, max(l_discount) AS max_discount, {_sum("l_quantity")} AS quantity,
  {_sum("l_extendedprice")} AS revenue FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1""")
def terms_buckets(t):
    return a.terms(t.lineitem, "l_returnflag", {"revenue": money("l_extendedprice"), "quantity": money("l_quantity"),
                                                "max_discount": F.max("l_discount")})


@query("terms_keyed", "SELECT event_type AS key, count(*) AS doc_count, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 1")
def terms_keyed(t):
    return a.terms(t.events, "event_type", {"users": F.count_distinct("user_id")}, None, keyed=True)


@query("metrics_row", f"""SELECT {_sum("value")} AS total, max(value) AS highest, min(value) AS lowest, count(*) AS n,
  CAST(round(sum(CAST(value AS DECIMAL(18,2))) / count(*), 6) AS DOUBLE) AS mean FROM events""")
def metrics_row(t):
    return a.metrics(t.events, {
        "total": money("value"), "highest": F.max("value"), "lowest": F.min("value"), "n": F.count(F.lit(1)),
        "mean": F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 6)})


@query("group_by_status", f"""SELECT o_orderstatus, count(*) AS n, {_sum("o_totalprice")} AS revenue FROM orders GROUP BY 1 ORDER BY 2 DESC""")
def group_by_status(t):
    return a.group(t.orders, ["o_orderstatus"], {"n": F.count(F.lit(1)), "revenue": money("o_totalprice")}, by="n")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 100000")
def distinct_values(t):
    return a.distinct_values(t.orders, "o_orderpriority", F.col("o_totalprice") > 100000)


@query("distinct_elements", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS words FROM part")
def distinct_elements(t):
    return a.distinct_values(t.part.select(F.split("p_name", " ").alias("words")), "words")


@query("distinct_count_exact", """SELECT event_type, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1""")
def distinct_count_exact(t):
    return a.distinct_count(t.events, ["event_type"], "user_id", "visitors")


@query("distinct_count_approx", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def distinct_count_approx(t):
    near = a.distinct_count(t.lineitem, ["l_returnflag"], "l_partkey", "about", approx=True)
    return a.distinct_count(t.lineitem, ["l_returnflag"], "l_partkey", "parts").join(near, "l_returnflag").select(
        "l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) < 0.1 * F.col("parts")).alias("near"))


@query("page_views", """SELECT event_type, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events
  WHERE event_type IN ('view', 'click') GROUP BY 1""")
def page_views(t):
    kept = t.events.where(F.col("event_type").isin("view", "click"))
    visitors = a.distinct_count(kept, ["event_type"], "user_id", "visitors")
    views = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("views"))
    return views.join(visitors, "event_type").select("event_type", "views", "visitors")


@query("daily_summary", f"""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, {_sum("value")} AS revenue FROM events GROUP BY 1, 2""")
def daily_summary(t):
    return a.summary_by_day(t.events, "ts", {"n": F.count(F.lit(1)), "revenue": money("value")}, ["event_type"])


@query("daily_sales", f"""SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, {_sum("o_totalprice")} AS revenue FROM orders GROUP BY 1""")
def daily_sales(t):
    return a.summary_by_day(t.orders, "o_orderdate", {"orders": F.count(F.lit(1)), "revenue": money("o_totalprice")})


@query("compact_sums", """SELECT o_orderstatus, o_orderpriority, sum(n)::BIGINT AS n, CAST(sum(total) AS DOUBLE) AS total FROM (
  SELECT o_orderstatus, o_orderpriority, o_custkey % 10 AS part, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def compact_sums(t):
    parts = t.orders.groupBy("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 10).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")).drop("part")
    return a.compact_sums(parts, ["o_orderstatus", "o_orderpriority"]).withColumn("total", F.col("total").cast("double"))


@query("ratio_per_parent", """SELECT r_regionkey, r_name, count(c_custkey) AS customers,
  CASE WHEN coalesce(sum(CAST(c_acctbal * 100 AS BIGINT)), 0) = 0 THEN NULL ELSE
  round(count(c_custkey) * 10000.0::DOUBLE / (sum(round(c_acctbal * 100)::BIGINT) / 100.0::DOUBLE), 2) END AS per_10k
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def ratio_per_parent(t):
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint"))
    by_nation = t.customer.groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"), cents.alias("cents"))
    by_region = j.join_summary(t.nation, "n_nationkey", by_nation, "c_nationkey",
                               {"n": F.sum("n"), "cents": F.sum("cents")})
    out = j.join_summary(t.region, "r_regionkey", by_region, "n_regionkey", {"n": F.sum("n"), "cents": F.sum("cents")})
    return out.select("r_regionkey", "r_name", F.coalesce("n", F.lit(0)).alias("customers"),
                      a.ratio(F.coalesce("n", F.lit(0)).cast("double"), F.col("cents") / F.lit(100.0), 10000.0).alias("per_10k"))


def _versions(t):
    later = t.orders.where(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return t.orders.withColumn("version", F.lit(1)).unionByName(later.withColumn("version", F.lit(2)))


@query("latest_version", """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM orders""")
def latest_version(t):
    return a.latest(_versions(t), ["o_orderkey"], "version")


@query("latest_event_per_user", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def latest_event_per_user(t):
    return a.latest(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("first_per_key", "SELECT DISTINCT conv_id FROM conversations")
def first_per_key(t):
    repeats = t.conversations.select("conv_id")
    return a.first_per_key(repeats.unionByName(repeats), ["conv_id"])


@query("customer_revenue", f"""SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS orders, coalesce({_sum("o_totalprice")}, 0) AS revenue
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3""")
def customer_revenue(t):
    out = j.join_summary(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", t.orders, "o_custkey",
                         {"orders": F.count("o_orderkey"), "revenue": money("o_totalprice")}, F.col("o_orderstatus").isin("F", "O"))
    return out.withColumn("orders", F.coalesce("orders", F.lit(0))).withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))


@query("revenue_by_segment", f"""SELECT c_mktsegment, count(*) AS orders, {_sum("o_totalprice")} AS revenue
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def revenue_by_segment(t):
    # Summed per customer before the join, then per segment.
    cents = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    per_customer = j.join_summary(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", t.orders, "o_custkey",
                                  {"n": F.count(F.lit(1)), "total": cents}, how="inner")
    return per_customer.groupBy("c_mktsegment").agg(F.sum("n").alias("orders"), F.sum("total").cast("double").alias("revenue"))


@query("payments_by_region", """SELECT o_orderkey AS id, o_custkey AS customer_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'transfer' ELSE 'wallet' END AS method, o_totalprice AS amount,
  o_orderdate AS paid_at, CASE WHEN o_orderkey % 5 = 0 THEN 'phone' ELSE 'web' END AS channel, lower(r_name) AS region
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderdate < TIMESTAMP '1999-01-01'""")
def payments_by_region(t):
    # The dimensions meet first, so orders are joined once.
    home = (t.customer.select("c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.lower("r_name").alias("region")))
    key = F.col("o_orderkey")
    return t.orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).join(
        home, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), F.col("o_custkey").alias("customer_id"),
        F.when(key % 3 == 0, "card").when(key % 3 == 1, "transfer").otherwise("wallet").alias("method"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("paid_at"),
        F.when(key % 5 == 0, "phone").otherwise("web").alias("channel"), "region")


@query("update_from_join", """SELECT l_orderkey, l_partkey, l_linenumber, coalesce(p_retailprice, l_extendedprice) AS l_extendedprice
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def update_from_join(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return j.update_from(rows, ["l_partkey"], t.part.select("p_partkey", "p_retailprice"), ["p_partkey"],
                         {"l_extendedprice": F.col("src_p_retailprice")})


@query("update_from_aggregate", f"""SELECT o_orderkey, o_custkey, coalesce(s, o_totalprice) AS o_totalprice FROM orders LEFT JOIN
  (SELECT l_orderkey, {_sum("l_extendedprice")} AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def update_from_aggregate(t):
    totals = t.lineitem.groupBy("l_orderkey").agg(money("l_extendedprice").alias("s"))
    return j.update_from(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], totals, ["l_orderkey"],
                         {"o_totalprice": F.col("src_s")})


@query("dictionary_lookup", """SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def dictionary_lookup(t):
    return j.lookup(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), t.nation, {"s_nationkey": "n_nationkey"},
                    ["n_name"]).drop("s_nationkey")


@query("orphan_keys", """SELECT doc_id, count(*) AS rows FROM documents d WHERE NOT EXISTS
  (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1""")
def orphan_keys(t):
    return j.orphan_keys(t.documents, ["doc_id"], t.labels, ["doc_id"])


@query("orphan_rows", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS
  (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)""")
def orphan_rows(t):
    return j.orphan_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"],
                         t.part.where("p_size < 40"), ["p_partkey"])


@query("append_rows", """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT s_suppkey::INTEGER, s_name, s_nationkey FROM supplier""")
def append_rows(t):
    return setops.add_rows(t.nation, t.supplier.select("s_suppkey", "s_name", "s_nationkey"))


@query("replace_rows", "SELECT s_suppkey::INTEGER AS n_nationkey, s_name AS n_name, s_nationkey AS n_regionkey FROM supplier")
def replace_rows(t):
    return setops.add_rows(t.nation, t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "replace")


@query("rows_as_union", """SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'MOON' UNION ALL SELECT 101, NULL""")
def rows_as_union(t):
    return setops.rows_as_union(t.region, [(100, "MOON"), (101, None)], ["int", "string"])


@query("stack_new_fields", """SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL
  SELECT s_suppkey, s_acctbal, s_name FROM supplier""")
def stack_new_fields(t):
    return setops.stack([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
                         t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"),
                                           F.col("s_name").alias("name"))])


@query("not_null_violations", """SELECT unnest(['quality', 'toxic', 'doc_id']) AS "column",
  unnest([count(*) FILTER (WHERE quality IS NULL), count(*) FILTER (WHERE toxic IS NULL), count(*) FILTER (WHERE d.doc_id IS NULL)]) AS violations
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def not_null_violations(t):
    return checks.not_null(t.documents.join(t.labels, "doc_id", "left"), ["quality", "toxic", "doc_id"])


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t):
    return checks.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("check_violations", "SELECT * FROM lineitem WHERE NOT (l_quantity > 2 AND l_discount <= 0.09)")
def check_violations(t):
    return checks.check(t.lineitem, "l_quantity > 2 AND l_discount <= 0.09")


@query("enum_violations", "SELECT o_orderstatus AS value, count(*) AS rows FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def enum_violations(t):
    return checks.enum_values(t.orders, "o_orderstatus", ["F", "O"])


@query("foreign_key_violations", """SELECT l_partkey, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN
  (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY 1""")
def foreign_key_violations(t):
    return checks.foreign_key(t.lineitem, ["l_partkey"], t.part.where("p_size > 3"), ["p_partkey"])


@query("overflow_violations", """SELECT unnest(['text', 'n_chars', 'lang']) AS "column",
  unnest([count(*) FILTER (WHERE length(text) > 200), count(*) FILTER (WHERE n_chars > 127), count(*) FILTER (WHERE length(lang) > 1)]) AS violations FROM documents""")
def overflow_violations(t):
    from pyspark.sql import types as T

    return checks.fits(t.documents, {"text": T.VarcharType(200), "n_chars": T.ByteType(), "lang": T.CharType(1)})


@query("table_rules", """SELECT 'orders' AS "table", * FROM (
  SELECT 'not null' AS rule, 'o_custkey' AS name, count(*) FILTER (WHERE o_custkey IS NULL) AS violations FROM orders
  UNION ALL SELECT 'check', 'cheap', count(*) FILTER (WHERE NOT o_totalprice < 400000) FROM orders
  UNION ALL SELECT 'enum', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'primary key', 'o_orderkey', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
  UNION ALL SELECT 'foreign key', 'o_custkey -> customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)))""")
def table_rules(t):
    from tabloom.model import ColumnMeta, ForeignKey, TableMeta

    meta = TableMeta("orders", (ColumnMeta("o_custkey", "int", nullable=False), ColumnMeta("o_orderstatus", enum=("F", "O"))),
                     ("o_orderkey",), foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
                     checks=(("cheap", "o_totalprice < 400000"),))
    return checks.check_table(t.orders, meta, {"customer": t.customer})
