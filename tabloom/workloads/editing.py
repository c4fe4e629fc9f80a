"""Batches of changes and restructured tables."""

from pyspark.sql import functions as F

from tabloom.operators import edits as e
from tabloom.session import work_path
from tabloom.sinks.edit import edit_loaded
from tabloom.sinks.load import load
from tabloom.workloads.registry import query

KEY = ["o_orderkey"]


def order_changes(t):
    """Updates, deletes and inserts derived from the orders themselves.

    Every 50th order costs one more, the one after it is deleted, and the
    one after that comes back under a new key.
    """
    k = F.col("o_orderkey")
    top = t.orders.agg(F.max("o_orderkey")).scalar()
    op = F.when(k % 50 == 0, "update").when(k % 50 == 1, "delete").when(k % 50 == 2, "insert")
    cols = []
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        value = F.when(op == "update", F.col(c) + 1).otherwise(F.col(c)) if c == "o_totalprice" else F.col(c)
        cols += [value.alias(f"set_{c}"), ((op == "insert") | (F.lit(c == "o_totalprice") & (op == "update"))).alias(f"has_{c}")]
    return t.orders.withColumn("__op", op).where(F.col("__op").isNotNull()).select(
        k.alias("change_id"), F.col("__op").alias("op"),
        F.when(op == "insert", top + 1 + k).otherwise(k).alias("key_o_orderkey"), *cols)


_EDITED = """SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
  FROM orders WHERE o_orderkey % 50 <> 1 UNION ALL
  SELECT * REPLACE ((SELECT max(o_orderkey) FROM orders) + 1 + o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 50 = 2"""


@query("apply_edits", _EDITED)
def apply_edits(t):
    return e.apply_edits(t.orders, order_changes(t), KEY).table


@query("edit_loaded_files", """SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 AND o_orderkey <= 2000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
  FROM orders WHERE NOT (o_orderkey % 50 = 1 AND o_orderkey <= 2000) UNION ALL
  SELECT * REPLACE ((SELECT max(o_orderkey) FROM orders) + 1 + o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 50 = 2 AND o_orderkey <= 2000""")
def edit_loaded_files(t):
    """Changes of few keys in a table of many files."""
    path = work_path(t.spark, "files")
    load(t.orders.repartitionByRange(24, "o_orderkey"), path)
    return edit_loaded(t.spark, path, order_changes(t).where("change_id <= 2000"), KEY).table


@query("edited_rows", _EDITED)
def edited_rows(t):
    return e.edited(t.orders, order_changes(t), KEY)


@query("edited_rows_by_shuffle", _EDITED)
def edited_rows_by_shuffle(t):
    return e.edited(t.orders, order_changes(t), KEY, small=False)


def _bad_changes(t):
    """Keys that match no order, one order, or (by customer) many."""
    return t.orders.where("o_orderkey % 40 = 0").select(
        F.col("o_orderkey").alias("change_id"), F.lit("delete").alias("op"), F.col("o_custkey").alias("key_o_custkey"))


@query("edit_match_counts", """SELECT o_orderkey AS change_id, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey) AS rows
  FROM orders a WHERE o_orderkey % 40 = 0""")
def edit_match_counts(t):
    return e.match_counts(t.orders, _bad_changes(t), ["o_custkey"])


@query("edit_match_counts_by_shuffle", """SELECT o_orderkey AS change_id, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey) AS rows
  FROM orders a WHERE o_orderkey % 40 = 0""")
def edit_match_counts_by_shuffle(t):
    return e.match_counts(t.orders, _bad_changes(t), ["o_custkey"], small=False)


@query("insert_conflicts", """SELECT o_orderkey AS change_id FROM orders WHERE o_orderkey % 20 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  UNION SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 20 = 0 GROUP BY o_custkey HAVING count(*) > 1""")
def insert_conflicts(t):
    changes = t.orders.where("o_orderkey % 20 = 0").select(
        F.col("o_orderkey").alias("change_id"), F.lit("insert").alias("op"), F.col("o_custkey").alias("key_c_custkey"))
    return e.insert_conflicts(t.customer.where("c_acctbal > 0"), changes, ["c_custkey"])


@query("stale_changes", "SELECT o_orderkey AS change_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def stale_changes(t):
    stored = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("version"))
    changes = t.orders.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("change_id"), F.lit("update").alias("op"), F.col("o_orderkey").alias("key_o_orderkey"),
        F.lit(1).alias("seen_version"))
    return e.stale_changes(stored, changes, KEY, "version")


@query("edits_by_all_columns", """SELECT s_suppkey, s_name, s_nationkey FROM (SELECT *, row_number() OVER () AS n FROM supplier) WHERE s_nationkey % 2 = 0""")
def edits_by_all_columns(t):
    """A table without a key: rows are named by all comparable columns."""
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    changes = s.where("s_nationkey % 2 = 1").select(
        F.col("s_suppkey").alias("change_id"), F.lit("delete").alias("op"), *[F.col(c).alias(f"key_{c}") for c in s.columns])
    e.validate(s, changes, s.columns)
    return e.edited(s, changes, s.columns)


@query("restructure", """SELECT c_name AS name, c_custkey::INTEGER AS id, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, 'new' AS state,
  upper(c_mktsegment) || '!' AS label, c_mktsegment FROM customer""")
def restructure(t):
    return e.restructure(t.customer, [
        e.ColumnDef("name", "c_name"), e.ColumnDef("id", "c_custkey", "int"), e.ColumnDef("balance", "c_acctbal", "decimal(12,2)"),
        e.ColumnDef("state", type="string", default="'new'::character varying"),
        e.ColumnDef("label", generated="upper(c_mktsegment) || '!'"), e.ColumnDef("c_mktsegment", "c_mktsegment")])


