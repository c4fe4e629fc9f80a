"""Column types: reading, proposing and checking them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.convert import spark_type_of
from tabloom.functions.text import quoted
from tabloom.model import Canon, ColumnMeta

_INT_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def canon_of(field: T.StructField) -> Canon:
    """The canonical type of a Spark column; its metadata may refine text."""
    dtype, meta = field.dataType, field.metadata or {}
    if meta.get("canon"):
        return Canon(meta["canon"], srid=meta.get("srid", 0), values=tuple(meta.get("enum", ())))
    if type(dtype) in _INT_BITS:
        return Canon("int", _INT_BITS[type(dtype)])
    if isinstance(dtype, T.FloatType):
        return Canon("float", 32)
    if isinstance(dtype, T.DoubleType):
        return Canon("float", 64)
    if isinstance(dtype, T.DecimalType):
        return Canon("decimal", p=dtype.precision, s=dtype.scale)
    if isinstance(dtype, T.BooleanType):
        return Canon("bool")
    if isinstance(dtype, T.VarcharType):
        return Canon("varchar", n=dtype.length)
    if isinstance(dtype, T.CharType):
        return Canon("char", n=dtype.length)
    if isinstance(dtype, T.StringType):
        return Canon("text")
    if isinstance(dtype, T.BinaryType):
        return Canon("blob")
    if isinstance(dtype, T.DateType):
        return Canon("date")
    if isinstance(dtype, T.TimestampNTZType):
        return Canon("datetime", frac=6)
    if isinstance(dtype, T.TimestampType):
        return Canon("timestamptz", frac=6)
    if isinstance(dtype, T.VariantType):
        return Canon("json")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return Canon("object")
    return Canon("text", note=f"text holds what {dtype.simpleString()} held")


def canon_of_name(type_name: str, column: ColumnMeta | None = None) -> Canon:
    """The canonical type of a lake type as a catalog writes it."""
    name = type_name.strip().lower()
    base = re.split(r"[(<\s]", name, maxsplit=1)[0]
    numbers = [int(x) for x in re.findall(r"-?\d+", name.partition("(")[2])]
    length = (column.length if column and column.length else None) or (numbers[0] if numbers else -1)
    fixed = {
        "string": Canon("text"), "tinyint": Canon("int", 8), "byte": Canon("int", 8), "smallint": Canon("int", 16),
        "short": Canon("int", 16), "int": Canon("int", 32), "integer": Canon("int", 32), "bigint": Canon("int", 64),
        "long": Canon("int", 64), "float": Canon("float", 32), "real": Canon("float", 32), "double": Canon("float", 64),
        "boolean": Canon("bool"), "date": Canon("date"), "timestamp": Canon("timestamptz", frac=6),
        "timestamp_ltz": Canon("timestamptz", frac=6), "timestamp_ntz": Canon("datetime", frac=6),
        "binary": Canon("blob"), "variant": Canon("json"), "array": Canon("object"), "map": Canon("object"),
        "struct": Canon("object"),
    }
    if base in fixed:
        return fixed[base]
    if base in ("varchar", "char"):
        return Canon(base, n=length) if length > 0 else Canon("text")
    if base in ("decimal", "dec", "numeric"):
        p = column.precision if column and column.precision else (numbers[0] if numbers else -1)
        s = column.scale if column and column.scale is not None else (numbers[1] if len(numbers) > 1 else 0 if numbers else -1)
        return Canon("decimal", p=p, s=s)
    return Canon("text", note=f"text holds what {type_name} held")


@dataclass(frozen=True)
class LakeType:
    type: str
    canon: Canon
    notes: tuple[str, ...] = ()
    lossy: bool = False


# How the lake spells the Spark types that hold a column.
_LAKE_NAMES = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "float": "FLOAT",
               "double": "DOUBLE", "boolean": "BOOLEAN", "binary": "BINARY", "date": "DATE", "string": "STRING",
               "timestamp_ntz": "TIMESTAMP_NTZ", "timestamp": "TIMESTAMP"}


def lake_type(canon: Canon) -> LakeType:
    """The lake column type for a canonical type, with what may get lost."""
    notes, lossy, held = [], False, canon
    if canon.note:
        notes.append(canon.note)
    if canon.t in ("json", "object", "array"):
        return LakeType("VARIANT", canon, tuple(notes))
    spelled = spark_type_of(canon).simpleString()
    name = _LAKE_NAMES.get(spelled, spelled.upper())
    if canon.t == "int" and canon.bits == 0:
        name = "BIGINT"
    if canon.t == "decimal":
        if canon.p <= 0:
            notes.append("no precision given: taken as DECIMAL(38,9)")
            lossy = True
        elif canon.p > 38:
            notes.append("lake decimals hold 38 digits")
            lossy = True
    if canon.t in ("time", "interval"):
        notes.append("copied as text")
    if canon.t == "enum":
        notes.append("the lake has no enums; any text is accepted unless a CHECK constraint says otherwise")
    if canon.t in ("datetime", "timestamptz") and canon.frac > 6:
        notes.append("times finer than a microsecond lose the rest")
        lossy = True
    if canon.t == "geometry":
        held = Canon("json")
        notes.append("shapes become GeoJSON")
    return LakeType(name, held, tuple(notes), lossy)


def _profile(df: DataFrame) -> list:
    """The aggregates behind a proposal: lengths, digits and ranges per column."""
    out = []
    for i, f in enumerate(df.schema.fields):
        col = quoted(f.name)
        none = F.lit(None)
        length, whole, frac, low, high = none.cast("bigint"), none.cast("int"), none.cast("int"), none.cast("string"), none.cast("string")
        if isinstance(f.dataType, T.StringType):
            length = F.max(F.length(col)).cast("bigint")
        elif isinstance(f.dataType, T.BinaryType):
            length = F.max(F.octet_length(col)).cast("bigint")
        if isinstance(f.dataType, (T.DecimalType, T.IntegralType)):
            text = F.abs(col).cast("string")
            whole = F.max(F.length(F.regexp_replace(F.regexp_extract(text, r"^(\d*)", 1), "^0+", "")))
            frac = F.max(F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d*)$", 1), "0+$", "")))
        if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            low, high = F.min(col).cast("string"), F.max(col).cast("string")
        out.append(F.struct(F.count(col).alias("values"), length.alias("max_length"), whole.alias("whole_digits"),
                            frac.alias("fraction_digits"), low.alias("low"), high.alias("high")).alias(f"p{i}"))
    return out


def propose_types(df: DataFrame, narrow: bool = True) -> DataFrame:
    """Per column: canonical type, proposed lake type, notes and lossy flag.

    One aggregate over the data gives lengths, digits and ranges.  With
    ``narrow`` an integer column that fits a smaller type is offered it.
    """
    row = df.agg(*_profile(df))
    cells = []
    for i, f in enumerate(df.schema.fields):
        canon = canon_of(f)
        kind = lake_type(canon)
        seen = F.col(f"p{i}")
        proposed = F.lit(kind.type)
        if narrow and canon.t == "int":
            low, high = seen["low"].cast("bigint"), seen["high"].cast("bigint")
            for name, bits in (("INT", 32), ("SMALLINT", 16), ("TINYINT", 8)):
                if bits < canon.bits:
                    proposed = F.when((low >= -(1 << bits - 1)) & (high < (1 << bits - 1)), name).otherwise(proposed)
        if narrow and canon.t == "decimal":
            proposed = F.when(seen["values"] > 0, F.format_string(
                "DECIMAL(%d,%d)", F.greatest(seen["whole_digits"] + seen["fraction_digits"], F.lit(1)),
                seen["fraction_digits"])).otherwise(proposed)
        cells.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(canon.t).alias("canon"),
            F.lit(kind.type).alias("declared"), proposed.alias("proposed"), F.lit("; ".join(kind.notes)).alias("notes"),
            F.lit(kind.lossy).alias("lossy"), seen["max_length"].alias("max_length"), seen["low"].alias("low"),
            seen["high"].alias("high")))
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


# The bounds of the integer types.
INT_BOUNDS = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31, T.LongType: 1 << 63}


def conversion_loss(col: Column, src: T.DataType, dtype: T.DataType) -> tuple[Column, Column]:
    """(lost, altered): a value does not convert, or converts to another number.

    Numbers are compared with the bounds of their target, which is cheaper
    than a cast that fails.
    """
    no = F.lit(False)
    if isinstance(dtype, (T.VarcharType, T.CharType, T.StringType)) or src == dtype:
        return no, no
    numbers = isinstance(src, T.NumericType) and isinstance(dtype, T.NumericType)
    if numbers and type(dtype) in INT_BOUNDS:
        bound = INT_BOUNDS[type(dtype)]
        if isinstance(src, T.IntegralType):
            if INT_BOUNDS[type(src)] <= bound:
                return no, no
            return F.coalesce(~col.between(-bound, bound - 1), no), no
        edge = float(bound) if not isinstance(src, T.DecimalType) else F.lit(str(bound)).cast("decimal(38,0)")
        whole = F.floor(F.abs(col)) * F.signum(col) if isinstance(src, T.DecimalType) else F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
        inside = (col < edge) & (col > -edge - 1 if isinstance(src, T.DecimalType) else col > -edge)
        return F.coalesce(~inside | F.isnan(col.cast("double")), no), F.coalesce(inside & (whole != col), no)
    if numbers and isinstance(dtype, T.DoubleType) and not isinstance(src, T.DecimalType) and src != T.LongType():
        return no, no
    cast = col.try_cast(dtype)
    lost = col.isNotNull() & cast.isNull()
    if numbers:
        return lost, F.coalesce(cast.try_cast(src) != col, no)
    if isinstance(src, T.StringType) and isinstance(dtype, T.NumericType):
        wide = F.trim(col).try_cast("decimal(38,18)")
        return lost, F.coalesce(cast.try_cast("decimal(38,18)") != wide, no)
    return lost, no


def fit_report(df: DataFrame, targets: Mapping[str, T.DataType | str]) -> DataFrame:
    """What a change of types would lose: one row per column with counts of
    values that do not convert, change when converted back, are too long, or
    carry fractions finer than microseconds."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs, cells = [], []
    for i, (name, target) in enumerate(targets.items()):
        dtype = T._parse_datatype_string(target) if isinstance(target, str) else target
        col, src = quoted(name), types[name]
        length = getattr(dtype, "length", None) if isinstance(dtype, (T.VarcharType, T.CharType)) else None
        lost, altered = conversion_loss(col, src, dtype)
        bad, changed = F.count_if(lost), F.count_if(altered)
        long = F.count_if(F.length(col.cast("string")) > length) if length else F.lit(0).cast("bigint")
        fine = F.count_if(col.rlike(r"\.\d{6}\d*[1-9]")) if isinstance(src, T.StringType) and isinstance(
            dtype, (T.TimestampType, T.TimestampNTZType)) else F.lit(0).cast("bigint")
        for label, agg in (("b", bad), ("c", changed), ("l", long), ("f", fine)):
            aggs.append(agg.alias(f"{label}{i}"))
        cells.append(F.struct(
            F.lit(name).alias("column"), F.lit(src.simpleString()).alias("from_type"), F.lit(dtype.simpleString()).alias("to_type"),
            F.col(f"b{i}").alias("unconvertible"), F.col(f"c{i}").alias("changed"), F.col(f"l{i}").alias("too_long"),
            F.col(f"f{i}").alias("too_fine")))
    return df.agg(F.count(F.lit(1)).alias("__rows"), *aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")
