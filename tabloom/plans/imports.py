"""Importing file records into a described table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.prepare import prepare, prepare_json, typed
from tabloom.functions.text import quoted
from tabloom.model import ColumnMeta, TableMeta, norm_name
from tabloom.sources.files import POSITION, record_number

# Records shown before an import, and where their texts are cut.
PREVIEW_ROWS, PREVIEW_TEXT = 20, 300


class RecordError(ValueError):
    """A record that cannot be imported; nothing was loaded."""

    def __init__(self, record: int, column: str, reason: str):
        super().__init__(f"record {record}, column {column}: {reason}")
        self.record, self.column, self.reason = record, column, reason


@dataclass(frozen=True)
class ImportOptions:
    null_text: str | None = None
    empty_as_null: bool = False
    types: Mapping[str, str] = field(default_factory=dict)  # target column to Spark type


def auto_map(file_columns: Sequence[str], table_columns: Sequence[str]) -> dict[str, str]:
    """File column to table column, by letters and digits alone."""
    by_norm = {norm_name(c): c for c in reversed(table_columns)}
    return {f: by_norm[norm_name(f)] for f in file_columns if norm_name(f) in by_norm}


def check_mapping(file_columns: Sequence[str], mapping: Mapping[str, str], meta: TableMeta) -> dict[str, ColumnMeta]:
    """The mapped columns, or an error naming what is wrong."""
    out: dict[str, ColumnMeta] = {}
    used: set[str] = set()
    for source, target in mapping.items():
        if not target:
            continue
        if source not in file_columns:
            raise ValueError(f"{source!r} is not among the file's columns")
        column = meta.column(target)
        if column is None:
            raise ValueError(f"{target!r} is not among the table's columns")
        if column.generated:
            raise ValueError(f"{target} takes its values from an expression, not from a file")
        if target in used:
            raise ValueError(f"two file columns go to {target}")
        used.add(target)
        out[source] = column
    if not out:
        raise ValueError("no file column goes to any table column")
    return out


# The Spark type a kind is stored as unless the options say otherwise.
KIND_TYPES = {"int": "bigint", "float": "double", "decimal": "decimal(38,9)", "bool": "boolean", "binary": "binary",
              "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp"}


def _prepared(records: DataFrame, mapping: Mapping[str, ColumnMeta], options: ImportOptions) -> tuple[DataFrame, list[tuple[str, str]]]:
    types = {f.name: f.dataType for f in records.schema.fields}
    cells, targets = [], []
    for i, (source, column) in enumerate(mapping.items()):
        make = prepare_json if isinstance(types[source], T.VariantType) else prepare
        cells.append(make(quoted(source), column.kind, options.null_text, options.empty_as_null).alias(f"p{i}"))
        targets.append((column.name, options.types.get(column.name) or KIND_TYPES.get(column.kind, "string")))
    blank = F.lit(True)
    for source in mapping:
        col = quoted(source)
        empty = F.coalesce(F.try_variant_get(col, "$", "string") == "", F.is_variant_null(col)) \
            if isinstance(types[source], T.VariantType) else col == ""
        blank = blank & (col.isNull() | F.coalesce(empty, F.lit(False)))
    kept = [F.col(POSITION)] if POSITION in records.columns else []
    return records.where(~blank).select(*cells, *kept), targets


def _is_bad(i: int, type_name: str) -> Column:
    """Whether one prepared cell cannot become a value of its column."""
    cell = F.col(f"p{i}")
    unfit = F.lit(False) if type_name == "string" else cell["value"].isNotNull() & typed(cell["value"], type_name).isNull()
    return cell["error"].isNotNull() | unfit


def import_errors(records: DataFrame, mapping: Mapping[str, ColumnMeta], options: ImportOptions = ImportOptions()) -> DataFrame:
    """Every record with a bad value, with the first such column and the reason.

    The scan only looks for the number of the first bad column; words are
    made for the records that have one.
    """
    ready, targets = _prepared(records, mapping, options)
    first = F.coalesce(*[F.when(_is_bad(i, t), i) for i, (_, t) in enumerate(targets)])
    kept = [F.col(POSITION)] if POSITION in records.columns else []
    bad = ready.withColumn("__bad", first).where(F.col("__bad").isNotNull())
    name, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (column, type_name) in enumerate(targets):
        cell = F.col(f"p{i}")
        name = F.when(F.col("__bad") == i, column).otherwise(name)
        reason = F.when(F.col("__bad") == i, F.coalesce(cell["error"], F.concat(
            F.lit('"'), cell["value"], F.lit(f'" does not fit {type_name}')))).otherwise(reason)
    return bad.select(*kept, name.alias("column"), reason.alias("reason"))


def import_rows(records: DataFrame, mapping: Mapping[str, str], meta: TableMeta,
                options: ImportOptions = ImportOptions(), check: bool = True) -> DataFrame:
    """File records as typed rows of the table.

    Blank records are passed over.  With ``check`` the first bad value in file
    order stops the import with its record number and column.
    """
    columns = check_mapping([c for c in records.columns if c != POSITION], mapping, meta)
    if check:
        bad = import_errors(records, columns, options)
        first = (bad.orderBy(POSITION) if POSITION in records.columns else bad).limit(1).collect()
        if first:
            number = record_number(records, first[0][POSITION]) if POSITION in records.columns else 0
            raise RecordError(number, first[0]["column"], first[0]["reason"])
    ready, targets = _prepared(records, columns, options)
    return ready.select(*[typed(F.col(f"p{i}")["value"], t).alias(n) for i, (n, t) in enumerate(targets)])


def import_preview(records: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first records, long texts cut."""
    cells = []
    for f in records.schema.fields:
        col = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            col = F.when(F.length(col) > PREVIEW_TEXT, F.concat(F.substring(col, 1, PREVIEW_TEXT), F.lit("…"))).otherwise(col)
        cells.append(col.alias(f.name))
    return records.limit(n).select(*cells)
