"""Files: written by the sinks and read back by the sources."""

from pyspark.sql import functions as F

from tabloom.model import TableMeta
from tabloom.operators import describe
from tabloom.session import work_path
from tabloom.sinks import files as out, load as ld
from tabloom.sources import files as src
from tabloom.workloads.registry import query


@query("csv_round_trip", "SELECT page_id, url, html FROM pages")
def csv_round_trip(t):
    path = work_path(t.spark, "csv")
    out.write_delimited(t.pages, path, ";", null_text="\\N", bom=True)
    return src.read_delimited(t.spark, path).withColumn("page_id", F.col("page_id").cast("bigint"))


@query("csv_single_line_round_trip", "SELECT * FROM orders")
def csv_single_line_round_trip(t):
    path = work_path(t.spark, "csv")
    out.write_delimited(t.orders, path, gzip=True)
    rows = src.read_delimited(t.spark, path)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in t.orders.schema.fields])


@query("csv_one_column_round_trip", "SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents")
def csv_one_column_round_trip(t):
    path = work_path(t.spark, "csv")
    out.write_delimited(t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("text")).alias("text")), path)
    return src.read_delimited(t.spark, path)


@query("tsv_blank_round_trip", "SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS a, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END AS b FROM documents")
def tsv_blank_round_trip(t):
    path = work_path(t.spark, "tsv")
    blank = F.col("doc_id") % 3 == 0
    out.write_tsv(t.documents.select(F.when(blank, "").otherwise(F.col("lang")).alias("a"), F.when(blank, " ").otherwise(F.col("source")).alias("b")), path)
    return src.read_tsv(t.spark, path)


@query("tsv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def tsv_round_trip(t):
    path = work_path(t.spark, "tsv")
    out.write_tsv(t.documents, path)
    return src.read_tsv(t.spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn(
        "n_chars", F.col("n_chars").cast("bigint"))


@query("ndjson_round_trip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def ndjson_round_trip(t):
    path = work_path(t.spark, "ndjson")
    out.write_ndjson(t.events, path)
    rows = src.read_ndjson(t.spark, path)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in t.events.schema.fields])


@query("json_array_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_array_round_trip(t):
    path = work_path(t.spark, "json")
    out.write_json_array(t.conversations, path)
    rows = src.read_json_array(t.spark, path)
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")


@query("documents_round_trip", """SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS source, CASE WHEN doc_id % 5 = 0 THEN n_chars END AS n_chars FROM documents""")
def documents_round_trip(t):
    path = work_path(t.spark, "docs")
    d = t.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"),
                           F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"n_chars":'), "n_chars", F.lit("}"))).alias("…"))
    out.write_docs(d, path)
    from tabloom.operators.shaping import docs_to_rows

    lines = t.spark.read.text(path)
    return docs_to_rows(lines, "value", {"doc_id": "int", "lang": "string", "source": "string", "n_chars": "int"}).drop("…")


@query("csv_lines", """SELECT o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') || ','
  || strftime(o_orderdate, '%Y-%m-%d 00:00:00') || ',' || o_orderpriority AS value FROM orders""")
def csv_lines(t):
    return out.csv_lines(t.orders)


@query("csv_quoting", """SELECT CASE WHEN text LIKE '%,%' OR text LIKE '%"%' OR contains(text, chr(10)) OR contains(text, chr(13)) OR regexp_matches(text, '^\\s')
  THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang AS value FROM documents""")
def csv_quoting(t):
    return out.csv_lines(t.documents.select("text", "lang"))


@query("tsv_lines", """SELECT conv_id || chr(9) || turn || chr(9) || replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') AS value FROM conversations""")
def tsv_lines(t):
    return out.tsv_lines(t.conversations.select("conv_id", "turn", "text"))


@query("ndjson_lines", """SELECT '{"doc_id":' || doc_id || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null') || ',"lang":"' || lang || '"}' AS value
  FROM documents LEFT JOIN labels USING (doc_id)""")
def ndjson_lines(t):
    return out.json_lines(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "lang"))


@query("document_lines", """SELECT '{"_id":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"seg":"' || c_mktsegment || '"' ELSE '' END
  || ',"x":' || c_nationkey || '}' AS value FROM customer""")
def document_lines(t):
    return out.doc_lines(t.customer.select(
        F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("seg"),
        F.concat(F.lit('{"x":'), "c_nationkey", F.lit("}")).alias("…")))


@query("insert_rows_oracle", """SELECT 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES' || chr(10) || '  (' || n_nationkey || ', ''' || n_name || ''', '
  || n_regionkey || ');' AS value FROM nation""")
def insert_rows_oracle(t):
    return out.insert_statements(t.nation, "oracle", "nation")


@query("insert_batches", """SELECT 'orders' AS "table", count(*) AS rows FROM orders""")
def insert_batches(t):
    text = out.insert_statements(t.orders, "postgresql", "orders", 100)
    per = F.size(F.split("value", "\n")) - 1
    return text.agg(F.sum(per).alias("rows"), F.max(per).alias("most")).select(
        F.when(F.col("most") <= 100, "orders").alias("table"), "rows")


@query("dump_tables", """SELECT 'region' AS "table", count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def dump_tables(t):
    root = work_path(t.spark, "dump")
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey"}
    out.dump_tables({n: (getattr(t, n), TableMeta.of(getattr(t, n), n, [k])) for n, k in keys.items()}, root, "mysql")
    found = t.spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return found.where(F.col("value").startswith("  (")).groupBy(name.alias("table")).agg(F.count(F.lit(1)).alias("rows"))


@query("too_large_literals", """SELECT count(*) AS rows, count(*) FILTER (WHERE strlen(text) > 2000) AS too_large FROM documents""")
def too_large_literals(t):
    return out.too_large_count(t.documents.select(F.col("text").cast("binary").alias("raw")), "oracle")


@query("lake_orc_partitions", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def lake_orc_partitions(t):
    path = work_path(t.spark, "orc")
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").orc(path)
    return src.read_lake(t.spark, path, "orc").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("lake_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def lake_csv(t):
    path = work_path(t.spark, "lakecsv")
    t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")
                    ).write.option("header", "true").csv(path)
    return src.read_lake(t.spark, path, "csv")


@query("lake_files", "SELECT count(*) AS rows, 3::BIGINT AS files FROM customer")
def lake_files(t):
    path = work_path(t.spark, "lake")
    t.customer.repartition(3).write.parquet(path)
    return describe.lake_facts(t.spark, path).select("rows", "files")


@query("lake_files_orc", "SELECT count(*) AS rows, 2::BIGINT AS files FROM orders")
def lake_files_orc(t):
    path = work_path(t.spark, "lake")
    t.orders.repartition(2).write.orc(path)
    return describe.lake_facts(t.spark, path, "orc").select("rows", "files")


@query("tsv_header_rows", """SELECT CAST(c_custkey AS VARCHAR) AS a, c_name AS b FROM customer UNION ALL SELECT 'a', 'b' FROM customer WHERE c_custkey % 10 = 3""")
def tsv_header_rows(t):
    """Files with and without the header, some with rows that look like it."""
    path = work_path(t.spark, "tsv")
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"), F.col("c_custkey") % 10 == 3)
    rows = rows.select("a", "b").unionByName(rows.where(rows[2]).select(F.lit("a").alias("a"), F.lit("b").alias("b")))
    out.write_tsv(rows.repartition(3), f"{path}/with")
    out.write_tsv(rows.limit(0).coalesce(1), f"{path}/empty")
    return src.read_tsv(t.spark, f"{path}/with")


@query("load_append", "SELECT * FROM nation UNION ALL SELECT * FROM nation")
def load_append(t):
    path = work_path(t.spark, "target")
    ld.load(t.nation, path)
    return ld.load(t.nation, path, "append")


@query("load_replace", "SELECT * FROM customer WHERE c_acctbal > 0")
def load_replace(t):
    path = work_path(t.spark, "target")
    ld.load(t.customer, path)
    return ld.load(t.customer.where("c_acctbal > 0"), path, "replace")


@query("load_chunked", "SELECT * FROM orders")
def load_chunked(t):
    path = work_path(t.spark, "chunked")
    report = ld.load_chunked(t.orders, path, commit_every=20_000, files_per_commit=4)
    if report.failed:
        raise RuntimeError(report.failed)
    return t.spark.read.parquet(path).drop("chunk")

@query("load_versions", """SELECT 1 AS version, count(*) AS rows FROM customer UNION ALL SELECT 2, 2 * count(*) FROM customer
  UNION ALL SELECT 3, count(*) FROM customer WHERE c_acctbal > 0""")
def load_versions(t):
    """Each version of a target that was loaded, appended to and replaced."""
    path = work_path(t.spark, "target")
    ld.load(t.customer, path)
    ld.load(t.customer, path)
    ld.load(t.customer.where("c_acctbal > 0"), path, "replace")
    counts = [ld.read_loaded(t.spark, path, version=v).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(v).alias("version"), "rows")
              for v in ld.versions(t.spark, path)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
