"""Metadata: tables, columns, filters, sorts and engine-neutral types."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, types as T

# The kinds a column can have.
KINDS = (
    "int", "float", "decimal", "bool", "string", "text", "enum", "uuid", "binary", "date",
    "time", "datetime", "timestamp", "interval", "json", "object", "array", "geometry", "other",
)

# Kinds the quick search looks into, and kinds that cannot serve as a key.
SEARCHABLE = frozenset({"string", "text", "enum", "json", "uuid", "int", "decimal"})
NOT_COMPARABLE = frozenset({"text", "binary", "json", "geometry", "array", "object"})

# The column that holds fields outside the inferred ones.
OVERFLOW = "…"
# The synthetic row identifier added by browse for tables without a key.
ROW_KEY = "__row_key"


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    kind: str = "string"
    nullable: bool = True
    default: str | None = None
    generated: str | None = None
    enum: tuple[str, ...] = ()
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    srid: int = 0


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[ColumnMeta, ...] = ()
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()  # (name, SQL condition)
    is_view: bool = False

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name == name), None)

    @classmethod
    def of(cls, df: DataFrame, name: str = "", primary_key: Iterable[str] = (), **extra) -> "TableMeta":
        """Describe a DataFrame's columns."""
        cols = tuple(
            ColumnMeta(f.name, f.metadata.get("kind") or kind_of(f.dataType), f.nullable,
                       srid=f.metadata.get("srid", 0))
            for f in df.schema.fields
        )
        return cls(name, cols, tuple(primary_key), **extra)


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None
    values: Sequence[Any] = ()


@dataclass(frozen=True)
class Sort:
    column: str
    desc: bool = False


@dataclass(frozen=True)
class Canon:
    """An engine-neutral column type.  -1 means the bound is not set."""

    t: str
    bits: int = 0
    unsigned: bool = False
    p: int = -1
    s: int = -1
    n: int = -1
    frac: int = -1
    values: tuple[str, ...] = ()
    srid: int = 0
    money: bool = False
    note: str = ""

    def with_(self, **changes) -> "Canon":
        return replace(self, **changes)


_SPARK_KINDS = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType), "float"),
    ((T.DecimalType,), "decimal"),
    ((T.BooleanType,), "bool"),
    ((T.BinaryType,), "binary"),
    ((T.DateType,), "date"),
    ((T.TimestampNTZType,), "datetime"),
    ((T.TimestampType,), "timestamp"),
    ((T.DayTimeIntervalType, T.YearMonthIntervalType), "interval"),
    ((T.ArrayType,), "array"),
    ((T.StructType, T.MapType), "object"),
    ((T.VariantType,), "json"),
    ((T.StringType, T.VarcharType, T.CharType), "string"),
)

# Type names as engines write them, by kind.
_NAME_KINDS = {
    "int": "tinyint smallint mediumint int integer bigint int2 int4 int8 serial bigserial long short byte "
           "int16 int32 int64 uint8 uint16 uint32 uint64 year",
    "float": "float double real float4 float8 float32 float64 binary_float binary_double",
    "decimal": "decimal numeric number money smallmoney dec bignumeric varint",
    "bool": "bool boolean bit",
    "string": "char varchar nchar nvarchar character string bpchar varchar2 nvarchar2 fixedstring",
    "text": "text tinytext mediumtext longtext clob nclob ntext xml",
    "enum": "enum set enum8 enum16",
    "uuid": "uuid uniqueidentifier timeuuid",
    "binary": "binary varbinary blob tinyblob mediumblob longblob bytea raw image bytes rowversion",
    "date": "date date32",
    "time": "time timetz",
    "datetime": "datetime datetime2 smalldatetime timestamp_ntz datetime64",
    "timestamp": "timestamp timestamptz datetimeoffset timestamp_ltz timestamp_tz",
    "interval": "interval",
    "json": "json jsonb variant",
    "object": "object map struct row document tuple",
    "array": "array list",
    "geometry": "geometry geography point linestring polygon multipoint multilinestring multipolygon "
                "geometrycollection sdo_geometry",
}
_BY_NAME = {word: kind for kind, words in _NAME_KINDS.items() for word in words.split()}


def kind_of(data_type: T.DataType | str) -> str:
    """The kind of a Spark type or of a type name."""
    if isinstance(data_type, str):
        name = data_type.strip().lower()
        if name.endswith("[]"):
            return "array"
        base = re.split(r"[(<\s]", name, maxsplit=1)[0]
        return _BY_NAME.get(base, "other")
    for classes, kind in _SPARK_KINDS:
        if isinstance(data_type, classes):
            return kind
    if type(data_type).__name__ == "TimeType":
        return "time"
    return "other"


def norm_name(name: str) -> str:
    """Lower case, letters and digits only: how file columns find table columns."""
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def apply_case(name: str, mode: str) -> str:
    return {"lower": name.lower(), "upper": name.upper()}.get(mode, name)


# The longest identifier per engine.
MAX_IDENT = {"postgresql": 63, "mysql": 64, "oracle": 128, "snowflake": 255, "cassandra": 48}


def clip_ident(engine: str, name: str) -> str:
    return name[: MAX_IDENT.get(engine, 128)]


def header_names(first: Sequence[str | None] | None, width: int) -> list[str]:
    """Column names from a header record; blanks are numbered, repeats counted."""
    names: list[str] = []
    used: dict[str, int] = {}
    for i in range(width):
        raw = first[i] if first and i < len(first) and first[i] else ""
        name = raw.strip() or f"Column {i + 1}"
        used[name] = used.get(name, 0) + 1
        names.append(name if used[name] == 1 else f"{name} ({used[name]})")
    return names


def numbered_names(width: int) -> list[str]:
    return [f"Column {i + 1}" for i in range(width)]


# File extension to format.
_FORMATS = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "ndjson": "ndjson", "jsonl": "ndjson",
            "json": "json", "xlsx": "xlsx", "sql": "sql", "js": "sql"}


def detect_format(file_name: str) -> str:
    name = file_name.lower().removesuffix(".gz")
    return _FORMATS.get(name.rpartition(".")[2] if "." in name else "", "csv")


@dataclass(frozen=True)
class RowKey:
    columns: tuple[str, ...]
    how: str  # primary, unique, rowid, all


def choose_row_key(meta: TableMeta, has_row_id: bool = False) -> RowKey | None:
    """How rows are identified for editing; None for views."""
    if meta.primary_key:
        return RowKey(meta.primary_key, "primary")
    nullable = {c.name: c.nullable for c in meta.columns}
    for cols in meta.unique:
        if cols and all(not nullable.get(c, True) for c in cols):
            return RowKey(tuple(cols), "unique")
    if meta.is_view:
        return None
    if has_row_id:
        return RowKey((ROW_KEY,), "rowid")
    return RowKey(tuple(c.name for c in meta.columns if c.kind not in NOT_COMPARABLE), "all")


def relationships(tables: Iterable[TableMeta]) -> list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]:
    """Foreign-key edges: (child, columns, parent, parent columns)."""
    return [(t.name, fk.columns, fk.parent, fk.parent_columns) for t in tables for fk in t.foreign_keys]


def parents_first(tables: Sequence[TableMeta]) -> list[TableMeta]:
    """Referenced tables before the tables that refer to them.

    Tables are taken in the given order; a table waits only for parents that
    are not already waiting for it, so cycles keep their order.
    """
    by_name = {t.name: t for t in tables}
    done: list[TableMeta] = []
    started: set[str] = set()
    for root in tables:
        stack = [(root, iter(root.foreign_keys))] if root.name not in started else []
        started.add(root.name)
        while stack:
            table, keys = stack[-1]
            parent = next((by_name[k.parent] for k in keys
                           if k.parent in by_name and k.parent not in started), None)
            if parent is None:
                done.append(table)
                stack.pop()
            else:
                started.add(parent.name)
                stack.append((parent, iter(parent.foreign_keys)))
    return done


@dataclass
class Report:
    """What a job did to one table."""

    table: str
    status: str
    rows: int = 0
    notes: list[str] = field(default_factory=list)
    verdict: str = ""
