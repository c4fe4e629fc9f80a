"""Imports and migrations."""

from pyspark.sql import functions as F

from tabloom.model import ColumnMeta, ForeignKey, TableMeta
from tabloom.operators import ranges
from tabloom.plans import imports as im, migration as mg, types as ty
from tabloom.session import work_path
from tabloom.sinks import files as out
from tabloom.sources import files as src
from tabloom.workloads.registry import query

ORDERS = TableMeta("orders", (
    ColumnMeta("o_orderkey", "int", False), ColumnMeta("o_custkey", "int"), ColumnMeta("o_orderstatus", "string"),
    ColumnMeta("o_totalprice", "float"), ColumnMeta("o_orderdate", "datetime"), ColumnMeta("o_orderpriority", "string")),
    ("o_orderkey",))


def _order_file(t):
    path = work_path(t.spark, "import")
    renamed = t.orders.toDF("O Orderkey", "O Custkey", "O OrderStatus", "O TotalPrice", "O OrderDate", "O OrderPriority")
    out.write_delimited(renamed, path, "|")
    return path


@query("import_rows", "SELECT * FROM orders")
def import_rows(t):
    records = src.read_delimited(t.spark, _order_file(t), multiline=False, position=True)
    mapping = im.auto_map([c for c in records.columns if c != src.POSITION], [c.name for c in ORDERS.columns])
    return im.import_rows(records, mapping, ORDERS)


@query("import_errors", """SELECT o_orderpriority AS value, count(*) AS rows, 'o_custkey' AS "column" FROM orders WHERE o_orderkey % 10 = 3 GROUP BY 1""")
def import_errors(t):
    path = work_path(t.spark, "bad")
    bad = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderpriority")).otherwise(
        F.col("o_custkey").cast("string")))
    out.write_tsv(bad, path)
    records = src.read_tsv(t.spark, path, position=True)
    errors = im.import_errors(records, im.check_mapping(t.orders.columns, {c: c for c in t.orders.columns}, ORDERS))
    return errors.groupBy(F.regexp_extract("reason", '^"(.*)" does not fit', 1).alias("value"), "column").agg(
        F.count(F.lit(1)).alias("rows"))


@query("import_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def import_json(t):
    path = work_path(t.spark, "ndjson")
    out.write_ndjson(t.events, path)
    records = src.read_ndjson(t.spark, path, as_variant=True, position=True)
    meta = TableMeta("events", (ColumnMeta("event_id", "int"), ColumnMeta("ts", "datetime"), ColumnMeta("user_id", "int"), ColumnMeta("event_type"),
                                ColumnMeta("value", "float"), ColumnMeta("props")))
    return im.import_rows(records, {c.name: c.name for c in meta.columns}, meta)


@query("import_preview", """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS text, lang, source, n_chars
  FROM documents ORDER BY doc_id LIMIT 20""")
def import_preview(t):
    return im.import_preview(t.documents.orderBy("doc_id"))


@query("propose_types", """SELECT position, "column", canon, declared, proposed FROM (VALUES (1, 'o_orderkey', 'int', 'BIGINT'), (2, 'o_custkey', 'int', 'BIGINT'),
  (3, 'o_orderstatus', 'text', 'STRING'), (4, 'o_totalprice', 'float', 'DOUBLE'), (5, 'o_orderdate', 'datetime', 'TIMESTAMP_NTZ'), (6, 'o_orderpriority', 'text', 'STRING'))
  v(position, "column", canon, declared), LATERAL (SELECT CASE "column" WHEN 'o_orderkey' THEN (SELECT CASE WHEN max(o_orderkey) < 128 THEN 'TINYINT'
  WHEN max(o_orderkey) < 32768 THEN 'SMALLINT' WHEN max(o_orderkey) < 2147483648 THEN 'INT' ELSE 'BIGINT' END FROM orders)
  WHEN 'o_custkey' THEN (SELECT CASE WHEN max(o_custkey) < 128 THEN 'TINYINT' WHEN max(o_custkey) < 32768 THEN 'SMALLINT' WHEN max(o_custkey) < 2147483648 THEN 'INT'
  ELSE 'BIGINT' END FROM orders) ELSE declared END AS proposed) p""")
def propose_types(t):
    return ty.propose_types(t.orders).select("position", "column", "canon", "declared", "proposed")


@query("fit_report", """SELECT 'l_extendedprice' AS "column", count(*) FILTER (WHERE l_extendedprice <> floor(l_extendedprice)) AS changed, 0::BIGINT AS too_long,
  0::BIGINT AS unconvertible FROM lineitem UNION ALL
  SELECT 'l_orderkey', 0, 0, count(*) FILTER (WHERE l_orderkey > 127) FROM lineitem UNION ALL
  SELECT 'l_linestatus', 0, 0, 0 FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) GROUP BY 1""")
def fit_report(t):
    return ty.fit_report(t.lineitem, {"l_extendedprice": "int", "l_orderkey": "tinyint", "l_linestatus": "varchar(1)"}).select(
        "column", "changed", "too_long", "unconvertible")


@query("copy_table", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  '{"o_orderpriority":"' || o_orderpriority || '"}' AS rest FROM orders""")
def copy_table(t):
    from dataclasses import replace

    p = mg.plan_table(t.orders, ORDERS)
    p = replace(p, columns=p.columns[:-1], fold_rest="rest")
    return mg.copy_table(t.orders, p, work_path(t.spark, "copy"))[0]


@query("copy_verified", """SELECT 'customer' AS "table", count(*) AS source_rows, count(*) AS target_rows, 'match' AS counts, 'match' AS contents, '' AS columns FROM customer""")
def copy_verified(t):
    p = mg.plan_table(t.customer, TableMeta.of(t.customer, "customer", ["c_custkey"]))
    target, seen = mg.copy_table(t.customer, p, work_path(t.spark, "copy"))
    return mg.verify_digest(t.spark, seen, target, p).withColumn("columns", F.array_join("columns", ","))


@query("fold_rest", """SELECT p_partkey, p_name, '{"p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || '}' AS rest FROM part""")
def fold_rest(t):
    p = t.part.drop("p_retailprice")
    return p.select("p_partkey", "p_name", mg.fold_rest(p, ["p_partkey", "p_name"]).alias("rest"))


@query("migrate_tables", """SELECT position::INTEGER AS position, "table", 'done' AS status, rows, 'match' AS verdict FROM (
  SELECT 1 AS position, 'region' AS "table", count(*) AS rows FROM region UNION ALL SELECT 2, 'nation', count(*) FROM nation
  UNION ALL SELECT 3, 'customer', count(*) FROM customer UNION ALL SELECT 4, 'orders', count(*) FROM orders)""")
def migrate_tables(t):
    fk = {"nation": ("n_regionkey", "region", "r_regionkey"), "customer": ("c_nationkey", "nation", "n_nationkey"),
          "orders": ("o_custkey", "customer", "c_custkey")}
    tables = {}
    for name in ("orders", "customer", "nation", "region"):
        df = getattr(t, name)
        links = tuple(ForeignKey((c,), parent, (pc,)) for c, parent, pc in ([fk[name]] if name in fk else []))
        tables[name] = (df, TableMeta.of(df, name, [df.columns[0]], foreign_keys=links))
    return mg.Migration(tables, work_path(t.spark, "migration")).run().drop("notes")


@query("verify_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' ELSE 'changed' END AS change,
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'o_totalprice' ELSE 'o_custkey,o_orderstatus' END AS columns
  FROM orders WHERE o_orderkey % 997 = 5 UNION ALL SELECT -o_orderkey, 'extra', '' FROM orders WHERE o_orderkey % 997 = 5""")
def verify_rows(t):
    """A copy with rows left out, changed and added."""
    hit, kind = F.col("o_orderkey") % 997 == 5, F.col("o_orderkey") % 4
    copy = t.orders.where(~(hit & (kind == 0))).withColumns({
        "o_totalprice": F.when(hit & (kind == 1), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_custkey": F.when(hit & (kind > 1), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
        "o_orderstatus": F.when(hit & (kind > 1), "X").otherwise(F.col("o_orderstatus"))})
    copy = copy.unionByName(t.orders.where(hit).withColumn("o_orderkey", -F.col("o_orderkey")))
    path = work_path(t.spark, "copy")
    copy.write.parquet(path)
    return ranges.verify_rows(t.orders, t.spark.read.parquet(path), ["o_orderkey"]).withColumn("columns", F.array_join("columns", ","))
