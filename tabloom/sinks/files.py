"""Writing tables and results: CSV, TSV, JSON, documents, INSERT scripts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.literals import MAX_ROWS, check_dialect, insert_prefix, literal, too_large
from tabloom.functions.text import plain_json_cell, quoted, text_of, tsv_escape
from tabloom.model import OVERFLOW, TableMeta, kind_of
from tabloom.operators.browse import hide_row_key

BOM = "﻿"
_LINE = T.StructType([T.StructField("value", T.StringType())])


def check_delimiter(delimiter: str) -> str:
    delimiter = "\t" if delimiter == "\\t" else delimiter
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError("use one single character as delimiter, and neither a quote nor a line end")
    return delimiter


def csv_cell(text: Column, delimiter: str) -> Column:
    """Quoted when it holds the delimiter, a quote, a line break, or starts with a space."""
    special = text.contains(delimiter) | text.rlike(r'["\r\n]|(?U)^\s') | (text == "\\.")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, delimiter: str = ",", null_text: str = "") -> DataFrame:
    """Rows as CSV text, one line (or quoted lines) each."""
    cells = [csv_cell(F.coalesce(text_of(quoted(f.name), f.dataType), F.lit(null_text)), delimiter)
             for f in df.schema.fields]
    line = F.concat_ws(delimiter, *cells)
    if len(cells) == 1:
        # Readers skip an empty line, so an only cell that is empty is quoted.
        line = F.when(line == "", '""').otherwise(line)
    return df.select(line.alias("value"))


def tsv_lines(df: DataFrame, null_text: str = "") -> DataFrame:
    cells = [tsv_escape(F.coalesce(text_of(quoted(f.name), f.dataType), F.lit(null_text))) for f in df.schema.fields]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def _with_head(lines: DataFrame, head: str) -> DataFrame:
    """``head`` in front of the first row of every part file.

    Numbers of rows restart in each task's range of ids, so the first row is
    known without a shuffle and without leaving the JVM.
    """
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return lines.select(F.when(first, F.concat(F.lit(head), F.col("value"))).otherwise(F.col("value")).alias("value"))


def _headed(df: DataFrame, lines: DataFrame, head: str, path: str, mode: str, gzip: bool) -> None:
    """Write lines below a head line; a table without rows is its head line."""
    _text(_with_head(lines, head + "\n"), path, mode, gzip)
    if df.sparkSession.read.text(path).limit(1).count() == 0:
        _text(df.sparkSession.range(0, 1, 1, 1).select(F.lit(head).alias("value")), path, "overwrite", gzip)


def _text(lines: DataFrame, path: str, mode: str, gzip: bool) -> None:
    writer = lines.write.mode(mode)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.text(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, null_text: str = "",
                    bom: bool = False, mode: str = "errorifexists", gzip: bool = False) -> None:
    """CSV with minimal quoting; every part file with rows has its own header."""
    delimiter = check_delimiter(delimiter)
    df = hide_row_key(df)
    lines = csv_lines(df, delimiter, null_text)
    if header or bom:
        names = [n.replace('"', '""') for n in df.columns]
        quoted_names = [f'"{n}"' if any(ch in n for ch in (delimiter, '"', "\r", "\n")) or n[:1].isspace() else n for n in names]
        head = delimiter.join(quoted_names)
        if header:
            _headed(df, lines, (BOM if bom else "") + head, path, mode, gzip)
            return
        lines = _with_head(lines, BOM)
    _text(lines, path, mode, gzip)


def write_tsv(df: DataFrame, path: str, header: bool = True, null_text: str = "", mode: str = "errorifexists",
              gzip: bool = False) -> None:
    df = hide_row_key(df)
    lines = tsv_lines(df, null_text)
    if header:
        escapes = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
        names = []
        for n in df.columns:
            for raw, written in escapes:
                n = n.replace(raw, written)
            names.append(n)
        _headed(df, lines, "\t".join(names), path, mode, gzip)
        return
    _text(lines, path, mode, gzip)


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON objects: columns in order, NULL written as null."""
    cells = [plain_json_cell(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    _text(json_lines(hide_row_key(df)), path, mode, gzip)


def write_json_array(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists",
                     gzip: bool = False) -> None:
    """Every part file is one valid JSON array.

    ``single_file`` funnels all rows through one task and is for small results.
    """
    # Functions sent to workers are nested, so workers need no copy of this package.
    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = False
        yield pd.DataFrame({"value": ["["]})
        for batch in batches:
            if not len(batch):
                continue
            # A comma goes before all rows but the first.
            values = "  ," + batch["value"]
            if not started:
                values.iloc[0] = "  " + batch["value"].iloc[0]
                started = True
            yield pd.DataFrame({"value": values})
        yield pd.DataFrame({"value": ["]"]})

    lines = json_lines(hide_row_key(df))
    if single_file:
        lines = lines.coalesce(1)
    _text(lines.mapInPandas(frame, _LINE), path, mode, gzip)
    if single_file and df.sparkSession.read.text(path).limit(1).count() == 0:
        # Without rows there was no task to write the brackets.
        _text(df.sparkSession.range(0, 1, 1, 1).select(F.lit("[]").alias("value")), path, "overwrite", gzip)


def doc_lines(df: DataFrame, json_columns: Sequence[str] = ()) -> DataFrame:
    """Rows as documents: absent fields left out, the ``…`` object merged in.

    ``json_columns`` hold JSON text that goes in as it is, such as extended
    types; binary becomes ``$binary``.
    """
    pairs = []
    for f in df.schema.fields:
        col = quoted(f.name)
        if f.name == OVERFLOW:
            continue
        if f.name in json_columns:
            value = F.try_parse_json(col)
        elif isinstance(f.dataType, T.BinaryType):
            value = F.to_variant_object(F.struct(F.struct(F.base64(col).alias("base64"), F.lit("00").alias("subType")).alias("$binary")))
        elif isinstance(f.dataType, T.VariantType):
            value = col
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.parse_json(F.concat(F.lit('"'), plain_json_cell(col, f.dataType), F.lit('"')))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            value = F.to_variant_object(col)
        else:
            value = F.parse_json(_json_text(col))
        pairs.append(F.struct(F.lit(f.name).alias("key"), F.when(col.isNotNull(), value).alias("value")))
    present = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()) if pairs else None
    fields = F.map_from_entries(present)
    if OVERFLOW in df.columns:
        rest = F.from_json(quoted(OVERFLOW), "map<string,variant>")
        fields = F.map_concat(fields, F.coalesce(rest, F.create_map().cast("map<string,variant>")))
    return df.select(F.to_json(fields).alias("value"))


def _json_text(col: Column) -> Column:
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def write_docs(df: DataFrame, path: str, json_columns: Sequence[str] = (), mode: str = "errorifexists",
               gzip: bool = False) -> None:
    _text(doc_lines(df, json_columns), path, mode, gzip)


def insert_statements(df: DataFrame, dialect: str, table: str, batch_rows: int = 100,
                      kinds: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """INSERT statements of up to ``batch_rows`` rows.

    Rows are batched where they are: neighbours in a partition share a
    statement, and nothing is shuffled.
    """
    check_dialect(dialect)
    if not table:
        raise ValueError("INSERT statements need a table")
    df = hide_row_key(df)
    size = min(batch_rows if batch_rows > 0 else 100, MAX_ROWS.get(dialect, 1 << 30))
    kinds = kinds or {}
    cells = [literal(dialect, quoted(f.name), f.dataType, kinds.get(f.name) or f.metadata.get("kind") or kind_of(f.dataType))
             for f in df.schema.fields]
    rows = (df.orderBy(*[quoted(o) for o in order]) if order else df).select(
        F.concat(F.lit("  ("), F.concat_ws(", ", *cells), F.lit(")")).alias("value"))
    prefix = insert_prefix(dialect, table, df.columns) + "\n"

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held.extend(batch["value"])
            full = len(held) - len(held) % size
            if full:
                yield pd.DataFrame({"value": [prefix + ",\n".join(held[i:i + size]) + ";" for i in range(0, full, size)]})
                held = held[full:]
        if held:
            yield pd.DataFrame({"value": [prefix + ",\n".join(held) + ";"]})

    return rows.mapInPandas(join, _LINE)


def too_large_count(df: DataFrame, dialect: str) -> DataFrame:
    """How many values are written as NULL because no literal can hold them."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        total = total + F.count_if(too_large(dialect, quoted(f.name), f.dataType))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("too_large"))


def write_inserts(df: DataFrame, path: str, dialect: str, table: str, batch_rows: int = 100,
                  kinds: Mapping[str, str] | None = None, order: Sequence[str] = (), mode: str = "errorifexists",
                  gzip: bool = False) -> None:
    _text(insert_statements(df, dialect, table, batch_rows, kinds, order), path, mode, gzip)


def dump_tables(tables: Mapping[str, tuple[DataFrame, TableMeta]], root: str, dialect: str, batch_rows: int = 100) -> list[str]:
    """The data of many tables as INSERT scripts, rows in key order, one folder each.

    Computed columns are left out, and tables that only hold partitions of
    others (views here) are skipped.
    """
    written = []
    for name, (df, meta) in tables.items():
        if meta.is_view:
            continue
        generated = {c.name for c in meta.columns if c.generated}
        kept = [c for c in df.columns if c not in generated]
        if not kept:
            continue
        path = f"{root.rstrip('/')}/{name}"
        write_inserts(df.select(*[quoted(c) for c in kept]), path, dialect, name, batch_rows,
                      {c.name: c.kind for c in meta.columns}, [k for k in meta.primary_key if k in kept])
        written.append(path)
    return written
