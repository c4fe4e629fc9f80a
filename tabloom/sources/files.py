"""Reading files: delimited text, TSV, JSON and lake tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.text import quoted, tsv_unescape
from tabloom.model import detect_format, header_names, numbered_names
from tabloom.sources import records

# The delimiters tried, in order of preference, and how much of
# a file is looked at to find the delimiter and the header.
DELIMITERS = (",", ";", "\t", "|")
PEEK_BYTES = 64 * 1024

# No file holds this text, so it makes every empty field stay a text.
_NO_NULL = "\x00\x01no null\x01\x00"

POSITION = "__position"
_ODD = "__odd_record"
_ORDER = "__order"


def positioned(df: DataFrame) -> DataFrame:
    """Add where each record stands: file, block and a rising row id.

    Sorts as the files are read, and costs neither a shuffle nor a count.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("row")).alias(POSITION))


def record_number(df: DataFrame, position) -> int:
    """The number of one record, from 1 in file order: a count of those before it."""
    here = F.struct(F.lit(position["file"]).alias("file"), F.lit(position["block"]).alias("block"),
                    F.lit(position["row"]).alias("row"))
    return df.where(F.col(POSITION) <= here).count()


def first_bytes(spark: SparkSession, path: str, size: int = PEEK_BYTES) -> bytes:
    """The beginning of the first file with content below ``path``; nothing else is read.

    A compressed file without content has bytes of its own, so it is only
    known when it is opened.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length").where("length > 0").orderBy("path"))
    for row in rows.toLocalIterator():
        hadoop_path = jvm.org.apache.hadoop.fs.Path(row.path)
        stream = hadoop_path.getFileSystem(conf).open(hadoop_path)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hadoop_path)
            source = codec.createInputStream(stream) if codec is not None else stream
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
                jvm.org.apache.commons.io.input.BoundedInputStream(source, size)))
        finally:
            stream.close()
        if head:
            return head
    return b""


def detect_delimiter(head: str) -> str:
    """The separator most frequent outside quotes on the first line."""
    outside = []
    for i, part in enumerate(head.split('"')):
        if i % 2 == 0:
            line, newline, _ = part.partition("\n")
            outside.append(line)
            if newline:
                break
    counts = {d: sum(p.count(d) for p in outside) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])  # the first of equals
    return best if counts[best] else ","


def _split_first_record(head: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(head, newline=""), delimiter=delimiter), [])


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c).alias(n) for c, n in zip(df.columns, names)])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True,
                   multiline: bool | None = None, position: bool = False) -> DataFrame:
    """CSV as text columns.

    Short rows are padded with NULL, long rows cut to the header's width,
    empty fields stay empty text.  Files split, and so do those whose fields
    hold line breaks: what quotes each block leaves open is found first, and
    blocks are cut into records knowing it.  ``multiline=False`` spares that
    look where it is known that no field holds a line break.
    """
    head = first_bytes(spark, path).decode("utf-8", "replace").removeprefix("\ufeff")
    if delimiter == "\\t":
        delimiter = "\t"
    if delimiter is not None and len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    sep = delimiter or detect_delimiter(head)
    first = _split_first_record(head, sep)
    names = header_names(first, len(first)) if header else numbered_names(len(first))
    raw = [f"c{i}" for i in range(len(names))]
    # Rows of another width come with their raw text, which tells how many
    # fields they had; the reader gives NULL for empty and for missing ones.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*raw, _ODD]])
    options = {"columnNameOfCorruptRecord": _ODD, "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "nullValue": _NO_NULL, "emptyValue": "", "maxCharsPerColumn": "-1"}
    found = None if multiline is False or not raw else records.quoted_records(spark, path, sep)
    if found is None:
        df = spark.read.schema(schema).options(**options).option("header", str(header).lower()).option(
            "enforceSchema", "true").option("encoding", "UTF-8").csv(path)
        if position:
            df = positioned(df)
    else:
        if header:
            found = found.where(~F.col(records.FIRST))
        here = F.struct(F.col(records.FILE).alias("file"), F.col(records.BLOCK).alias("block"), F.col(records.ROW).alias("row"))
        parsed = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), {**options, "multiLine": "true"})
        df = found.select(parsed.alias("r"), here.alias(POSITION)).select("r.*", POSITION)
    outside = F.regexp_replace(F.col(_ODD), '"(?:[^"]|"")*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit(""))) + 1
    cols = []
    for i, (c, n) in enumerate(zip(raw, names)):
        col = F.when(quoted(c).isNotNull(), quoted(c)).when(F.col(_ODD).isNull() | (fields > i), "")
        if i == 0 and not header:
            col = F.regexp_replace(col, "^\ufeff", "")
        cols.append(col.alias(n))
    return df.select(*cols, *([F.col(POSITION)] if position else []))


def read_tsv(spark: SparkSession, path: str, header: bool = True, position: bool = False) -> DataFrame:
    """Tab-separated text with backslash escapes; one record per line, splittable."""
    head = first_bytes(spark, path).decode("utf-8", "replace").removeprefix("\ufeff")
    line = head.split("\n", 1)[0].removesuffix("\r")
    first = [_unescape(p) for p in line.split("\t")] if head else []
    names = header_names(first, len(first)) if header else numbered_names(len(first))
    # Read as lines: a delimited reader would pass over lines of blanks only.
    df = spark.read.text(path, lineSep="\n")
    if position:
        df = positioned(df)
    if header:
        df = _without_first_lines(df, head.split("\n", 1)[0])
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    shown = []
    for i, n in enumerate(names):
        cell = F.get("__cells", F.lit(i))
        shown.append(tsv_unescape(F.regexp_replace(cell, "^\ufeff", "") if i == 0 and not header else cell).alias(n))
    return df.select(cells.alias("__cells"), *([F.col(POSITION)] if position else [])).select(
        *shown, *([F.col(POSITION)] if position else []))


def _without_first_lines(lines: DataFrame, first: str) -> DataFrame:
    """Lines of files without each file's first line, if that is the header ``first``.

    The same line further down is a record.  The join has one row for each file.
    """
    head = F.regexp_replace("value", "^\ufeff|\r$", "") == first.removesuffix("\r")
    placed = lines.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__line"))
    tops = placed.where(F.col("_metadata.file_block_start") == 0).groupBy("__file").agg(F.min("__line").alias("__top"))
    tops = tops.withColumnRenamed("__file", "__of")
    return placed.join(tops, (F.col("__file") == F.col("__of")) & (F.col("__line") == F.col("__top")) & head, "left_anti").drop("__file", "__line")


def _unescape(text: str) -> str:
    return "\\".join(p.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r") for p in text.split("\\\\"))


def _first_seen_fields(lines: DataFrame, column: str, sample: int | None) -> list[str]:
    """Field names by the record that first had them, then by their place in it.

    Records stand in the order of ``_ORDER`` if the lines have it, else as they are read.
    """
    head = lines.limit(sample) if sample else lines
    order = F.col(_ORDER) if _ORDER in lines.columns else F.struct(F.monotonically_increasing_id().alias("n"))
    parts = [order[f.name].alias(f"__o{i}") for i, f in enumerate(head.select(order.alias("o")).schema["o"].dataType.fields)]
    keys = [f"__o{i}" for i in range(len(parts))]
    fields = head.select(*parts, F.posexplode(F.json_object_keys(quoted(column))).alias("pos", "field")).groupBy("field").agg(
        F.min(F.struct(*keys, "pos")).alias("first")).orderBy("first", "field")
    return [r.field for r in fields.collect()]


def _lay_out(lines: DataFrame, column: str, fields: Sequence[str], as_variant: bool) -> DataFrame:
    """A column for each field, by position: names may differ in case alone or hold any character."""
    kept = [POSITION] if POSITION in lines.columns else []
    schema = T.StructType([T.StructField(f, T.VariantType()) for f in fields])
    raw = [f"__c{i}" for i in range(len(fields))]
    if not fields:
        return lines.select(*kept)
    parsed = lines.select(F.from_json(quoted(column), schema, {"mode": "FAILFAST"}).alias("__r"), *kept)
    flat = parsed.select("__r.*", *kept).toDF(*raw, *kept)
    cells = []
    for c, f in zip(raw, fields):
        value = F.col(c)
        if not as_variant:
            value = F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        cells.append(value.alias(f))
    return flat.select(*cells, *kept)


def read_ndjson(spark: SparkSession, path: str, sample: int | None = None, as_variant: bool = False,
                position: bool = False) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    Fields stand in the order first seen in all records.  With ``sample`` only
    the first records teach the names, and fields that appear later are
    ignored.
    """
    lines = spark.read.text(path)
    if position:
        lines = positioned(lines)
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    return _lay_out(lines, "value", _first_seen_fields(lines, "value", sample), as_variant)


def read_json_array(spark: SparkSession, path: str, sample: int | None = None, as_variant: bool = False,
                    position: bool = False) -> DataFrame:
    """Files that each hold an array of objects: ``[ {…}, {…} ]``.

    Files split at closing braces; how deep a block begins is found first.
    Fields are those of all records, or with ``sample`` of the first ones.
    """
    head = first_bytes(spark, path, 4096).decode("utf-8", "replace").removeprefix("\ufeff").lstrip()
    if head and not head.startswith("["):
        raise ValueError("a JSON file needs an array of objects at its top")
    found = records.array_records(spark, path)
    if sample:
        found = found.orderBy(records.FILE, records.BLOCK, records.ROW).limit(sample)
    if found.where(~F.col("value").startswith("{")).limit(1).collect():
        raise ValueError("a record of the JSON array is not a JSON object")
    fields = _first_seen_fields(found.withColumn(_ORDER, F.struct(records.FILE, records.BLOCK, records.ROW)), "value", None)
    lines = found if not sample else records.array_records(spark, path)
    here = F.struct(F.col(records.FILE).alias("file"), F.col(records.BLOCK).alias("block"), F.col(records.ROW).alias("row"))
    return _lay_out(lines.select("value", *([here.alias(POSITION)] if position else [])), "value", fields, as_variant)


def read_lake(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, Avro or CSV tables; partition columns come from directories."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("escape", '"')
    return reader.format(fmt).load(path)


def read_file(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A file in the format its name tells."""
    fmt = fmt or detect_format(path)
    readers = {"csv": read_delimited, "tsv": read_tsv, "json": read_json_array, "ndjson": read_ndjson}
    if fmt not in readers:
        raise ValueError(f"no reader makes a table of {fmt!r} files")
    return readers[fmt](spark, path, **options)
