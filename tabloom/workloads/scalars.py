"""Scalar functions over table columns, digests and verdicts."""

from pyspark.sql import functions as F, types as T

from tabloom.functions import canon as c, convert as cv, literals as lit, prepare as pr, text as tx
from tabloom.model import Canon, Sort
from tabloom.operators import ranges, verify as v
from tabloom.workloads.registry import query

S = T.StringType()


@query("text_of_cells", """SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS ordered, CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END AS big,
  '0x' || hex(o_orderstatus::BLOB) AS packed FROM orders""")
def text_of_cells(t):
    df = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ordered"),
                         (F.col("o_totalprice") > 200000).alias("big"), F.col("o_orderstatus").cast("binary").alias("packed"))
    return df.select("o_orderkey", *tx.text_columns(df)[1:])


@query("preview_cells", """SELECT doc_id, text AS head, strlen(text)::BIGINT AS size, false AS cut FROM documents WHERE strlen(text) <= 262144
  UNION ALL SELECT doc_id, NULL, strlen(text)::BIGINT, true FROM documents WHERE strlen(text) > 262144""")
def preview_cells(t):
    seen = t.documents.select("doc_id", tx.preview(F.col("text"), S).alias("p"))
    return seen.select("doc_id", F.when(~F.col("p.cut"), F.col("p.head")).alias("head"), "p.size", "p.cut")


@query("cell_sizes", """SELECT vec_id, 8 + 8 * len(embedding) + 8 AS nested, 8 AS scalar FROM embeddings""")
def cell_sizes(t):
    df = t.embeddings
    return df.select("vec_id", (tx.cell_size(F.col("embedding"), df.schema["embedding"].dataType) + 8).cast("bigint").alias("nested"),
                     tx.cell_size(F.col("label"), T.IntegerType()).alias("scalar"))


@query("format_times", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, regexp_replace(regexp_replace(strftime(ts, '%H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS clock,
  regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS moment,
  regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', '') || '+00:00' AS zoned FROM events""")
def format_times(t):
    ts = F.col("ts")
    return t.events.select("event_id", tx.time_text(ts, "date").alias("day"), tx.time_text(ts, "time").alias("clock"),
                           tx.time_text(ts, "datetime").alias("moment"), tx.time_text(ts.cast("timestamp"), "timestamp").alias("zoned"))


@query("prepare_values", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS number, event_id % 2 = 0 AS flag,
  NULLIF(event_type, 'view') AS word, value AS amount FROM events""")
def prepare_values(t):
    e = t.events.select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(" "), "user_id")).otherwise("").alias("number"),
        F.when(F.col("event_id") % 2 == 0, " Yes").otherwise("off").alias("flag"), F.col("event_type").alias("word"),
        F.col("value").cast("string").alias("amount"))
    made = {"number": ("int", "bigint"), "flag": ("bool", "boolean"), "word": ("string", "string"), "amount": ("float", "double")}
    return e.select("event_id", *[pr.typed(pr.prepare(F.col(n), kind, null_text="view")["value"], ty).alias(n)
                                  for n, (kind, ty) in made.items()])


@query("prepare_errors", """SELECT event_id, 'cannot read "' || event_type || '" as true or false' AS error FROM events""")
def prepare_errors(t):
    return t.events.select("event_id", pr.prepare(F.col("event_type"), "bool")["error"].alias("error"))


@query("to_bool_words", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true END AS flag
  FROM orders""")
def to_bool_words(t):
    words = F.array(*[F.lit(w) for w in ("TRUE", " y", "0", "Off", "on", "maybe")])
    return t.orders.select("o_orderkey", pr.to_bool(F.get(words, (F.col("o_orderkey") % 6).cast("int"))).alias("flag"))


@query("parse_times", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN date_trunc('minute', ts) ELSE ts END AS wall,
  CASE event_id % 3 WHEN 0 THEN ts - INTERVAL '3 hours' WHEN 1 THEN ts ELSE date_trunc('minute', ts) END AS utc,
  event_id % 3 = 0 AS has_offset FROM events""")
def parse_times(t):
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(base, F.lit("+03:00")))
            .when(F.col("event_id") % 3 == 1, F.replace(base, F.lit(" "), F.lit("T")))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm")))
    return t.events.select("event_id", pr.parse_time(text).alias("p")).select("event_id", "p.wall", "p.utc", "p.has_offset")


@query("convert_values", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS flag_int,
  CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderdate - INTERVAL '2 hours' AS moment, '"' || o_orderpriority || '"' AS as_json,
  o_orderstatus AS status, '[' || o_orderkey || ',' || o_custkey || ']' AS pair FROM orders""")
def convert_values(t):
    o = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") > 200000).alias("flag"),
        F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2)).alias("money"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")).alias("zoned"),
        "o_orderpriority", F.concat("o_orderstatus", F.lit("   ")).alias("padded"),
        F.concat(F.lit("{"), "o_orderkey", F.lit(","), "o_custkey", F.lit("}")).alias("arr"))
    K = Canon
    return o.select(
        "o_orderkey", cv.convert(F.col("flag"), T.BooleanType(), K("bool"), K("int", 32)).alias("flag_int"),
        cv.convert(F.col("money"), S, K("decimal", money=True), K("decimal", p=12, s=2)).alias("price"),
        cv.convert(F.col("zoned"), S, K("timestamptz"), K("datetime")).alias("moment"),
        cv.convert(F.col("o_orderpriority"), S, K("text"), K("json")).alias("as_json"),
        cv.convert(F.col("padded"), S, K("char"), K("varchar")).alias("status"),
        cv.convert(F.col("arr"), S, K("array"), K("json")).alias("pair"))


@query("sql_literals", """SELECT doc_id, '''' || replace(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r') || '''' AS mysql,
  '''' || replace(text, '''', '''''') || '''' AS postgresql, 'N''' || replace(text, '''', '''''') || '''' AS mssql,
  CAST(n_chars AS VARCHAR) AS number, '''\\x' || hex(lang::BLOB) || '''::bytea' AS bytea FROM documents""")
def sql_literals(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", *[lit.literal(d, x, S, "text").alias(d) for d in ("mysql", "postgresql", "mssql")],
        lit.literal("mysql", F.col("n_chars"), T.LongType()).alias("number"),
        lit.literal("postgresql", F.col("lang").cast("binary"), T.BinaryType()).alias("bytea"))


_PLAIN_DIALECTS = [d for d in lit.DIALECTS if d not in ("mssql", "oracle")]
_PRICE_SQL, _WHEN_SQL = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')", "strftime(o_orderdate, '%Y-%m-%d 00:00:00')"


@query("sql_literals_by_dialect", "SELECT o_orderkey, " + ", ".join(
    [f"{_PRICE_SQL} AS {d}_o_totalprice" for d in lit.DIALECTS]
    + [f"chr(39) || {_WHEN_SQL} || chr(39) AS {d}_o_orderdate, chr(39) || o_orderpriority || chr(39) AS {d}_o_orderpriority" for d in _PLAIN_DIALECTS]
    + [f"'N' || chr(39) || {_WHEN_SQL} || chr(39) AS mssql_o_orderdate, 'N' || chr(39) || o_orderpriority || chr(39) AS mssql_o_orderpriority",
       f"'TO_TIMESTAMP(' || chr(39) || {_WHEN_SQL} || chr(39) || ', ' || chr(39) || 'YYYY-MM-DD HH24:MI:SS' || chr(39) || ')' AS oracle_o_orderdate, "
       "chr(39) || o_orderpriority || chr(39) AS oracle_o_orderpriority"]) + " FROM orders")
def sql_literals_by_dialect(t):
    o = t.orders
    kinds = {"o_orderdate": "datetime"}
    return o.select("o_orderkey", *[
        lit.literal(d, F.col(f.name), f.dataType, kinds.get(f.name)).alias(f"{d}_{f.name}")
        for d in lit.DIALECTS for f in o.schema.fields if f.name in ("o_orderpriority", "o_orderdate", "o_totalprice")])


@query("canon_numbers", """SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain,
  regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS money FROM orders""")
def canon_numbers(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", c.number_cell(price, T.DoubleType()).alias("plain"),
                           c.canon_number(F.concat(F.lit("$"), F.format_number(price.cast("decimal(18,4)"), 4))).alias("money"))


@query("canon_floats", """SELECT event_id, CAST(value AS VARCHAR) AS wide, CAST(CAST(value AS FLOAT) AS VARCHAR) AS narrow FROM events""")
def canon_floats(t):
    x = F.col("value")
    return t.events.select("event_id", c.canon_float(x, T.DoubleType()).alias("wide"),
                           c.canon_float(x, T.DoubleType(), 32).alias("narrow"))


@query("canon_times", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate - INTERVAL '90 minutes', '%Y-%m-%d %H:%M:%S') AS zoned FROM orders""")
def canon_times(t):
    zoned = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    return t.orders.select("o_orderkey", c.canon_time(F.col("o_orderdate"), T.TimestampNTZType()).alias("day"),
                           c.canon_time(zoned, S).alias("zoned"))


@query("canon_intervals", """SELECT l_orderkey, l_linenumber, same, form FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 28 AS d, l_linenumber AS h,
  '0m' || (l_orderkey % 28) * 86400 + l_linenumber * 3600 || '.000000s' AS form, true AS same FROM lineitem)""")
def canon_intervals(t):
    d, h = (F.col("l_orderkey") % 28).cast("int"), F.col("l_linenumber")
    words = c.canon_interval(F.format_string("%d days %02d:00:00", d, h))
    iso = c.canon_interval(F.format_string("P%dDT%dH", d, h))
    clock = c.canon_interval(F.format_string("+%02d %02d:00:00.000", d, h))
    forms = t.lineitem.select("l_orderkey", "l_linenumber", F.array(words, iso, clock).alias("forms"))
    return forms.select("l_orderkey", "l_linenumber", (F.size(F.array_distinct("forms")) == 1).alias("same"), F.col("forms")[0].alias("form"))


@query("canon_json_text", """SELECT event_id, '{"a":' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ',"props":' || replace(props, ' ', '') || '}' AS doc FROM events""")
def canon_json_text(t):
    doc = F.concat(F.lit('{"props": '), "props", F.lit(', "a": '), F.col("value").cast("decimal(18,4)").cast("string"), F.lit("}"))
    return t.events.select("event_id", c.canon_json(doc).alias("doc"))


@query("canon_identifiers", """SELECT doc_id, substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) AS id, lower(hex(lang::BLOB)) AS packed,
  NULLIF(rtrim(lang || '  '), '') AS code FROM documents""")
def canon_identifiers(t):
    h = F.upper(F.md5("text"))
    return t.documents.select(
        "doc_id", c.canon_uuid(F.concat(F.lit("{"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("}"))).alias("id"),
        c.canon_binary(F.col("lang").cast("binary"), T.BinaryType()).alias("packed"),
        c.canon_text(F.concat("lang", F.lit("  ")), S, is_char=True).alias("code"))


@query("array_literals", """SELECT p_partkey, '[' || p_partkey || ',"' || p_name || '",null,[' || p_size || ',true]]' AS arr FROM part""")
def array_literals(t):
    text = F.concat(F.lit("{"), "p_partkey", F.lit(',"'), "p_name", F.lit('",NULL,{'), "p_size", F.lit(",t}}"))
    return t.part.select("p_partkey", cv.pg_array(text).alias("arr"))


@query("tsv_escapes", """SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS escaped, true AS back FROM documents""")
def tsv_escapes(t):
    escaped = tx.tsv_escape(F.col("text"))
    return t.documents.select("doc_id", escaped.alias("escaped"), (tx.tsv_unescape(escaped) == F.col("text")).alias("back"))


@query("excel_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || ' 18:00:00' AS evening FROM orders""")
def excel_dates(t):
    serial = F.date_diff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("double")
    return t.orders.select("o_orderkey", tx.excel_time(serial).alias("day"), tx.excel_time(serial + 0.75).alias("evening"))


@query("human_sizes", """SELECT doc_id, CASE WHEN n_chars * 4096 >= 1048576 THEN printf('%.1f MB', n_chars * 4096 / 1048576.0::DOUBLE)
  ELSE printf('%.0f KB', n_chars * 4.0::DOUBLE) END AS size, CASE WHEN n_chars < 1000 THEN greatest(n_chars, 1) || ' ms' ELSE NULL END AS took FROM documents""")
def human_sizes(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", tx.bytes_text(n * 4096).alias("size"),
                              F.when(n < 1000, tx.duration_text(n)).alias("took"))


@query("variant_types", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'double' WHEN 2 THEN 'string' WHEN 3 THEN 'object' ELSE 'null' END AS type FROM events""")
def variant_types(t):
    from tabloom.operators.shaping import type_name_of

    text = (F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string"))
            .when(F.col("event_id") % 5 == 1, F.concat("event_id", F.lit(".5")))
            .when(F.col("event_id") % 5 == 2, F.concat(F.lit('"'), "event_type", F.lit('"')))
            .when(F.col("event_id") % 5 == 3, F.col("props")).otherwise("null"))
    return t.events.select("event_id", type_name_of(F.parse_json(text)).alias("type"))


def _h(expr):
    return f"CAST(sum(CAST('0x' || substr(md5(coalesce({expr}, chr(0))), 1, 15) AS BIGINT)) AS DECIMAL(38,0))"


_INT = "CAST({} AS VARCHAR)"
_FLT = "CAST({} AS VARCHAR)"
_DAY = "strftime({}, '%Y-%m-%d')"


@query("digest_orders", f"""SELECT count(*) AS rows, {_h(_INT.format("o_orderkey"))} AS sum_o_orderkey, {_h(_INT.format("o_custkey"))} AS sum_o_custkey,
  {_h("o_orderstatus")} AS sum_o_orderstatus, {_h(_FLT.format("o_totalprice"))} AS sum_o_totalprice, {_h(_DAY.format("o_orderdate"))} AS sum_o_orderdate,
  {_h("o_orderpriority")} AS sum_o_orderpriority FROM orders""")
def digest_orders(t):
    return v.digest(t.orders)


@query("digest_lineitem", "SELECT count(*) AS rows, " + ", ".join(
    [f"{_h(_INT.format(c))} AS sum_{c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [f"{_h(_FLT.format(c))} AS sum_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [f"{_h(_DAY.format('l_shipdate'))} AS sum_l_shipdate",
       f"{_h('l_returnflag')} AS sum_l_returnflag", f"{_h('l_linestatus')} AS sum_l_linestatus"]) + " FROM lineitem")
def digest_lineitem(t):
    return v.digest(t.lineitem)


_CUSTOMER_CELLS = [_INT.format("c_custkey"), "c_name", _INT.format("c_nationkey"), _FLT.format("c_acctbal"), "c_mktsegment"]


@query("digest_row_hash", "SELECT count(*) AS rows, " + ", ".join(
    f"{_h(cell)} AS sum_{name}" for cell, name in zip(_CUSTOMER_CELLS, ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
    + f", {_h(' || chr(31) || '.join(_CUSTOMER_CELLS))} AS sum_row FROM customer")
def digest_row_hash(t):
    return v.digest(t.customer, row_hash=True)


@query("fingerprint_result", """WITH d AS (SELECT md5(concat_ws(chr(31), chr(1) || o_orderkey, chr(1) || o_custkey, chr(1) || o_orderstatus,
    chr(1) || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', ''), chr(1) || strftime(o_orderdate, '%Y-%m-%d 00:00:00'), chr(1) || o_orderpriority)) AS d FROM orders),
  s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(d, 17, 15) AS BIGINT)) AS b FROM d)
  SELECT n AS rows, sha256(concat_ws(chr(31), 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority') || chr(31) || chr(30)
    || chr(30) || 'o_orderkey asc' || chr(30) || n || chr(30) || a || chr(30) || b) AS hash FROM s""")
def fingerprint_result(t):
    return v.fingerprint(t.orders, [Sort("o_orderkey")])


@query("fingerprint_sequence", """WITH d AS (SELECT md5(concat_ws(chr(31), chr(1) || o_orderkey, chr(1) || o_custkey, chr(1) || o_orderstatus, chr(1) || o_orderpriority)) AS d,
    o_totalprice, o_orderkey, o_custkey FROM orders),
  p AS (SELECT md5((row_number() OVER (ORDER BY o_totalprice DESC, o_custkey, d) - 1) || ':' || d) AS h FROM d),
  s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS b FROM p)
  SELECT n AS rows, sha256(concat_ws(chr(31), 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority') || chr(31) || chr(30)
    || chr(30) || n || chr(30) || a || chr(30) || b) AS hash FROM s""")
def fingerprint_sequence(t):
    return ranges.sequence_fingerprint(t.orders, [Sort("o_totalprice", True), Sort("o_custkey")],
                                       ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("normalized_cells", f"""SELECT l_orderkey, l_linenumber, {_FLT.format("l_tax")} AS tax, {_DAY.format("l_shipdate")} AS shipped, l_returnflag AS flag FROM lineitem""")
def normalized_cells(t):
    li = t.lineitem
    return li.select("l_orderkey", "l_linenumber",
                     c.normalize(F.col("l_tax"), T.DoubleType(), Canon("float", 64)).alias("tax"),
                     c.normalize(F.col("l_shipdate"), T.TimestampNTZType(), Canon("datetime")).alias("shipped"),
                     c.normalize(F.col("l_returnflag"), S, Canon("char")).alias("flag"))


@query("verify_equal", """SELECT count(*) AS source_rows, count(*) AS target_rows, 'match' AS counts, 'match' AS contents, '' AS columns, '' AS note FROM lineitem""")
def verify_equal(t):
    return v.verify(t.lineitem, t.lineitem.hint("rebalance")).withColumn("columns", F.array_join("columns", ","))


@query("verify_changed", """SELECT count(*) AS source_rows, count(*) AS target_rows, 'match' AS counts, 'differ' AS contents, 'l_tax' AS columns, '' AS note FROM lineitem""")
def verify_changed(t):
    other = t.lineitem.withColumn("l_tax", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_tax") + 0.5).otherwise(F.col("l_tax")))
    return v.verify(t.lineitem, other).withColumn("columns", F.array_join("columns", ","))


@query("verify_counts", """SELECT count(*) AS source_rows, count(*) FILTER (WHERE o_orderkey % 50 <> 1) AS target_rows, 'differ' AS counts, 'skipped' AS contents,
  '' AS columns, 'unequal counts: contents left unread' AS note FROM orders""")
def verify_counts(t):
    return v.verify(t.orders, t.orders.where("o_orderkey % 50 <> 1")).withColumn("columns", F.array_join("columns", ","))
