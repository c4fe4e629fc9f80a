"""Cell conversion between column types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tabloom.functions import geometry
from tabloom.functions.prepare import OFFSET_END, parse_time, to_bool
from tabloom.functions.text import float_text, hex_text, json_string, plain_float, time_text, text_of
from tabloom.model import Canon

_NUMERIC = T.NumericType


def pg_array(text: Column) -> Column:
    """A plain array literal such as ``{1,"a b",NULL,{2,3}}`` as JSON text.

    Literals with backslash escapes, or with braces or commas inside quotes,
    give NULL: those need a parser.
    """
    s = F.trim(text)
    plain = s.rlike(r'^\{.*\}$') & ~s.contains("\\") & ~s.rlike(r'"[^",{}]*[{},][^"]*"')
    # One bare word at a time: quoted parts are matched first and kept.
    words = F.regexp_replace(s, r'("[^"]*")|\s*([^\s{},"](?:[^{},"]*[^\s{},"])?)\s*', '$1\u0001$2\u0001')
    words = F.regexp_replace(words, "\u0001\u0001", "")
    for pattern, value in (
        (r"\u0001(?i:null)\u0001", "null"),
        (r"\u0001t\u0001", "true"),
        (r"\u0001f\u0001", "false"),
        (r"\u0001([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\u0001", "$1"),
        (r"\u0001([^\u0001]*)\u0001", '"$1"'),
    ):
        words = F.regexp_replace(words, pattern, value)
    json = F.translate(words, "{}", "[]")
    return F.when(plain & F.try_parse_json(json).isNotNull(), json)


def spark_type_of(canon: Canon) -> T.DataType:
    """The Spark type that holds a canonical type."""
    t = canon.t
    if t == "bool":
        return T.BooleanType()
    if t == "int":
        if canon.bits == 64 and canon.unsigned:
            return T.DecimalType(20, 0)
        bits = canon.bits + 1 if canon.unsigned and canon.bits else canon.bits
        if 0 < bits <= 8:
            return T.ByteType()
        if 0 < bits <= 16:
            return T.ShortType()
        if 0 < bits <= 32:
            return T.IntegerType()
        return T.LongType()
    if t == "decimal":
        if canon.p <= 0:
            return T.DecimalType(38, 9)
        return T.DecimalType(min(canon.p, 38), min(max(canon.s, 0), 37 if canon.p > 38 else 38))
    if t == "float":
        return T.FloatType() if canon.bits == 32 else T.DoubleType()
    if t in ("binary", "varbinary", "blob"):
        return T.BinaryType()
    if t == "date":
        return T.DateType()
    if t == "datetime":
        return T.TimestampNTZType()
    if t == "timestamptz":
        return T.TimestampType()
    return T.StringType()


def _fail(col: Column, words: str) -> Column:
    return F.raise_error(F.concat(F.coalesce(col.cast("string"), F.lit("NULL")), F.lit(f" is not {words}")))


def convert(col: Column, dtype: T.DataType, src: Canon, dst: Canon) -> Column:
    """``col`` of Spark type ``dtype`` and type ``src`` as a value of ``dst``.

    A value that cannot be converted fails the job, as nothing may be lost on
    the way; ``fit_report`` counts such values beforehand.
    """
    t = dst.t
    textual = isinstance(dtype, T.StringType)
    target = spark_type_of(dst)
    if src.t == "geometry" and textual:
        return F.coalesce(geometry.geojson(col), col)
    if t == "bool":
        if isinstance(dtype, T.BooleanType):
            return col
        if isinstance(dtype, _NUMERIC):
            return col != 0
        word = to_bool(col)
        return F.when(col.isNotNull() & word.isNull(), _fail(col, "true or false").cast("boolean")).otherwise(word)
    if t in ("int", "decimal", "float"):
        if isinstance(dtype, T.BooleanType):
            return F.when(col, 1).when(~col, 0).cast(target)
        if textual:
            text = F.regexp_replace(col, r"[^0-9.\-]", "") if src.money else F.trim(col)
            return text.cast(target)
        if isinstance(dtype, T.FloatType) and t == "float" and dst.bits != 32:
            return col.cast("string").cast("double")  # 0.1f stays 0.1
        if isinstance(dtype, (T.FloatType, T.DoubleType)) and t == "decimal":
            return plain_float(col).cast(target)
        return col.cast(target)
    if t == "array":
        return col
    if t in ("json", "object"):
        return _to_json(col, dtype, src)
    if t in ("timestamptz", "datetime", "date"):
        return _to_moment(col, dtype, t)
    if t == "time":
        return _to_clock(col, dtype)
    if t in ("binary", "varbinary", "blob"):
        return col if isinstance(dtype, T.BinaryType) else col.cast("binary")
    if textual:
        return F.rtrim(col) if src.t == "char" else col
    if isinstance(dtype, T.BinaryType):
        return hex_text(col)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(col)
    return text_of(col, dtype)


def _to_json(col: Column, dtype: T.DataType, src: Canon) -> Column:
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(col)
    if isinstance(dtype, T.StringType):
        if src.t == "array":
            return F.when(col.startswith("{"), F.coalesce(pg_array(col), col)).otherwise(col)
        if src.t in ("json", "object"):
            return col
        return json_string(col)
    if isinstance(dtype, T.BinaryType):
        return json_string(hex_text(col))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return json_string(time_text(col, dtype))
    return text_of(col, dtype)


def _to_moment(col: Column, dtype: T.DataType, t: str) -> Column:
    if not isinstance(dtype, T.StringType):
        if t == "timestamptz":
            return col.cast("timestamp")
        return col.cast("timestamp_ntz" if t == "datetime" else "date")
    read = parse_time(col)
    unread = col.isNotNull() & read["wall"].isNull()
    if t == "date":
        value, name = read["wall"].cast("date"), "date"
    elif t == "timestamptz":
        value, name = read["utc"].cast("timestamp"), "timestamp"
    else:
        value, name = read["utc"], "timestamp_ntz"
    return F.when(unread, _fail(col, "a date and time").cast(name)).otherwise(value)


def _to_clock(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return time_text(col, "time")
    if not isinstance(dtype, T.StringType):
        return col.cast("string")
    moment = parse_time(col)["wall"]
    return (
        F.when(moment.isNotNull() & col.rlike(r"^\s*\d{4}-"), time_text(moment, "time"))
        .when(col.rlike(r"^[^+\-Z]+" + OFFSET_END), F.regexp_replace(col, OFFSET_END, ""))
        .otherwise(col)
    )
