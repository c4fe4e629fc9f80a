"""Schema on read, and what tables are."""

from pyspark.sql import functions as F

from tabloom.operators import describe as d, shaping as s
from tabloom.workloads.registry import query


def _documents(t):
    """Events as JSON documents: a field some lack, one of two types, one NULL."""
    e = t.events
    even = F.col("event_id") % 11 != 0
    fields = [
        F.concat(F.lit('"event_type":"'), "event_type", F.lit('"')),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit('"user":'), "user_id")),
        F.concat(F.lit('"_id":'), "event_id"),
        F.when(even, F.concat(F.lit('"k":'), F.get_json_object("props", "$.k"))).otherwise(
            F.concat(F.lit('"k":"'), F.get_json_object("props", "$.k"), F.lit('"'))),
        F.concat(F.lit('"flag":'), F.when(F.col("event_id") % 5 == 0, "null").otherwise("true")),
        F.concat(F.lit('"props":'), "props"),
    ]
    return e.select("event_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("doc"))


@query("infer_fields", """WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 7 <> 0) AS users FROM events)
  SELECT field, type, nullable, seen, total, CAST(floor(seen * 100 / total) AS INTEGER) AS percent FROM (
  SELECT '_id' AS field, 'int' AS type, false AS nullable, total AS seen, total FROM n
  UNION ALL SELECT 'event_type', 'string', false, total, total FROM n
  UNION ALL SELECT 'k', 'mixed(int,string)', false, total, total FROM n
  UNION ALL SELECT 'flag', 'bool', true, total, total FROM n
  UNION ALL SELECT 'props', 'object', false, total, total FROM n
  UNION ALL SELECT 'user', 'int', true, users, total FROM n)""")
def infer_fields(t):
    return s.infer_fields(_documents(t), "doc", order=F.col("event_id"))


@query("documents_to_rows", """SELECT event_id, event_id AS _id, event_type,
  CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') ELSE '"' || json_extract_string(props, '$.k') || '"' END AS k,
  '{"flag":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE 'true' END || ',"props":' || replace(props, ' ', '')
  || CASE WHEN event_id % 7 <> 0 THEN ',"user":' || user_id ELSE '' END || '}' AS "…" FROM events""")
def documents_to_rows(t):
    rows = s.docs_to_rows(_documents(t), "doc", {"_id": "int", "event_type": "string", "k": "mixed"}, keep=["event_id"])
    # Key order inside the overflow object is not kept: compare it sorted.
    return rows.withColumn("…", F.to_json(F.parse_json("…")))


@query("documents_inferred", """SELECT event_id AS _id, event_type, CASE WHEN event_id % 7 <> 0 THEN user_id END AS "user",
  CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') ELSE '"' || json_extract_string(props, '$.k') || '"' END AS k,
  CASE WHEN event_id % 5 <> 0 THEN true END AS flag, replace(props, ' ', '') AS props, NULL::VARCHAR AS "…" FROM events""")
def documents_inferred(t):
    return s.docs_to_rows(_documents(t), "doc")


@query("hits_to_rows", """SELECT CAST(event_id AS VARCHAR) AS _id, event_type,
  CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') ELSE '"' || json_extract_string(props, '$.k') || '"' END AS k,
  CASE WHEN event_id % 5 <> 0 THEN true END AS flag, replace(props, ' ', '') AS props,
  CASE WHEN event_id % 7 <> 0 THEN user_id END AS "user" FROM events""")
def hits_to_rows(t):
    return s.hits_to_rows(_documents(t), "doc", "event_id", order=F.col("event_id"))


def _items(t):
    """Customers as typed-attribute items."""
    return t.customer.select(F.concat(
        F.lit('{"name":{"S":"'), "c_name", F.lit('"},"id":{"N":"'), "c_custkey", F.lit('"},"active":{"BOOL":'),
        (F.col("c_acctbal") > 0).cast("string"), F.lit('},"tags":{"SS":["'), "c_mktsegment", F.lit('","all"]}'),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(',"note":{"NULL":true}')).when(
            F.col("c_custkey") % 4 == 1, F.concat(F.lit(',"note":{"N":"'), "c_nationkey", F.lit('"}'))).when(
            F.col("c_custkey") % 4 == 2, F.lit(',"note":{"S":"x"}')).otherwise(""), F.lit("}")).alias("item"))


@query("item_columns", """SELECT * FROM (VALUES ('id', 'N'), ('active', 'BOOL'), ('name', 'S'), ('note', 'mixed'), ('tags', 'SS')) v(field, type)
  WHERE (SELECT count(*) FROM customer) > 2""")
def item_columns(t):
    return s.item_columns(_items(t), "item", ["id"])


@query("items_to_rows", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal > 0 AS active, c_name AS name,
  CASE c_custkey % 4 WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'x' END AS note, c_mktsegment || ',all' AS tags FROM customer""")
def items_to_rows(t):
    return s.items_to_rows(_items(t), "item", ["id"]).withColumn("tags", F.array_join("tags", ","))


def _kv(t):
    """Records of every type, each derived from one row of a table."""
    def record(df, prefix, key, kind, payload):
        return df.select(F.concat(F.lit(prefix), key).alias("key"), F.lit(kind).alias("type"), payload.alias("payload"))

    entry = F.array(F.struct(F.concat("turn", F.lit("-0")).alias("id"), F.create_map(F.lit("role"), "role").alias("fields")))
    parts = [
        record(t.events, "event:", "event_id", "hash", F.col("props")),
        record(t.customer, "customer:", "c_custkey", "string", F.col("c_name")),
        record(t.documents, "doc:", "doc_id", "list", F.to_json(F.split("text", "\n", -1))),
        record(t.conversations, "log:", "conv_id", "stream", F.to_json(entry)),
        record(t.part, "part:", "p_partkey", "set", F.to_json(F.array_distinct(F.split("p_name", " ")))),
        record(t.part, "price:", "p_partkey", "zset", F.to_json(F.create_map("p_name", "p_retailprice"))),
        record(t.nation, "nation:", "n_nationkey", "json", F.to_json(F.struct("n_name", "n_regionkey"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("explode_hash", """SELECT 'event:' || event_id AS key, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events""")
def explode_hash(t):
    return s.explode_kv(_kv(t), "hash")


@query("explode_string", "SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer")
def explode_string(t):
    return s.explode_kv(_kv(t), "string")


@query("explode_list", """SELECT 'doc:' || doc_id AS key, generate_subscripts(lines, 1) - 1 AS "index", unnest(lines) AS value
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def explode_list(t):
    return s.explode_kv(_kv(t), "list")


@query("explode_set", "SELECT DISTINCT 'part:' || p_partkey AS key, unnest(string_split(p_name, ' ')) AS member FROM part")
def explode_set(t):
    return s.explode_kv(_kv(t), "set")


@query("explode_zset", "SELECT 'price:' || p_partkey AS key, p_name AS member, p_retailprice AS score FROM part")
def explode_zset(t):
    return s.explode_kv(_kv(t), "zset")


@query("explode_stream", """SELECT 'log:' || conv_id AS key, turn || '-0' AS id, role FROM conversations""")
def explode_stream(t):
    return s.explode_kv(_kv(t), "stream").select("key", "id", F.col("fields")["role"].alias("role"))


@query("explode_json", """SELECT 'nation:' || n_nationkey AS key, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def explode_json(t):
    return s.explode_kv(_kv(t), "json")


@query("match_keys", """SELECT name, kind, rows FROM (
  SELECT 'event:' || event_id AS name, 'hash' AS kind, 1::BIGINT AS rows FROM events
  UNION ALL SELECT 'doc:' || doc_id, 'list', len(string_split(text, chr(10))) FROM documents)
  WHERE regexp_full_match(name, '[ed].*:.*7[13]') ORDER BY name""")
def match_keys(t):
    return s.match_keys(_kv(t).where(F.col("type").isin("hash", "list")), "[ed]*:*7[13]")


@query("document_set_unset", """SELECT event_id, '{"event_type":"seen","k":' || CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k')
  ELSE '"' || json_extract_string(props, '$.k') || '"' END || ',"props":' || replace(props, ' ', '') || CASE WHEN event_id % 7 <> 0
  THEN ',"user":' || user_id ELSE '' END || '}' AS doc FROM events""")
def document_set_unset(t):
    fields = F.from_json("doc", s.FIELD_MAP)
    changed = s.fields_set(fields, {"event_type": F.parse_json(F.lit('"seen"'))}, ["flag", "_id"])
    return _documents(t).select("event_id", F.to_json(F.to_variant_object(changed)).alias("doc"))


@query("describe_table", """SELECT position, "column", type, kind, true AS nullable, "column" = 'o_orderkey' AS primary_key,
  (SELECT count(*) FROM orders) AS rows, 0::BIGINT AS nulls FROM (VALUES (1, 'o_orderkey', 'bigint', 'int'), (2, 'o_custkey', 'bigint', 'int'),
  (3, 'o_orderstatus', 'string', 'string'), (4, 'o_totalprice', 'double', 'float'), (5, 'o_orderdate', 'timestamp_ntz', 'datetime'),
  (6, 'o_orderpriority', 'string', 'string')) v(position, "column", type, kind)""")
def describe_table(t):
    from tabloom.model import TableMeta

    return d.describe(t.orders, TableMeta.of(t.orders, "orders", ["o_orderkey"]))


@query("lake_facts", "SELECT 1::BIGINT AS files, count(*) AS rows, true AS has_bytes, true AS has_change FROM lineitem")
def lake_facts(t):
    return d.lake_facts(t.spark, t.path("lineitem")).select(
        "files", "rows", (F.col("bytes") > F.col("rows")).alias("has_bytes"), (F.col("last_change") < F.now()).alias("has_change"))


@query("list_objects", """SELECT name, rows, 1::BIGINT AS files, true AS has_size FROM (SELECT 'lineitem' AS name, count(*) AS rows FROM lineitem UNION ALL
  SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'nation', count(*) FROM nation)""")
def list_objects(t):
    found = d.list_objects(t.spark, {n: t.path(n) for n in ("lineitem", "orders", "documents", "nation")})
    return found.select("name", "rows", "files", (F.col("size").isNotNull() & (F.col("bytes") > 0)).alias("has_size"))


@query("column_bounds", """SELECT * FROM (VALUES (1, 'l_orderkey', 'bigint', (SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem), (SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem)),
  (2, 'l_partkey', 'bigint', (SELECT CAST(min(l_partkey) AS VARCHAR) FROM lineitem), (SELECT CAST(max(l_partkey) AS VARCHAR) FROM lineitem)),
  (3, 'l_suppkey', 'bigint', (SELECT CAST(min(l_suppkey) AS VARCHAR) FROM lineitem), (SELECT CAST(max(l_suppkey) AS VARCHAR) FROM lineitem)),
  (4, 'l_linenumber', 'int', (SELECT CAST(min(l_linenumber) AS VARCHAR) FROM lineitem), (SELECT CAST(max(l_linenumber) AS VARCHAR) FROM lineitem)))
  v(position, "column", type, low, high)""")
def column_bounds(t):
    return d.column_bounds(t.spark, t.path("lineitem")).where("type in ('bigint', 'int')")
