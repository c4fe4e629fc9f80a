"""Cells as text: display form, sizes, previews, escapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# How much of a long cell a preview keeps, in bytes.
TEXT_PREVIEW = 256 * 1024
BINARY_PREVIEW = 64 * 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once.

    Long expressions that name their input many times would otherwise repeat
    it in the plan.
    """
    return F.transform(F.array(value), body)[0]


def _exponent_parts(java: Column) -> tuple[Column, Column]:
    """Digits and decimal exponent of a double's scientific text (d.ddE±x)."""
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1)
    return mantissa, F.when(exponent != "", exponent).cast("int")


def float_text(x: Column) -> Column:
    """Shortest decimal text: exponent form below 1e-4 and from 1e6 on."""
    java = x.cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    mantissa, exponent = _exponent_parts(java)
    plain = F.regexp_replace(java, r"\.0$", "")
    # Seven-digit numbers are written out by the cast and need an exponent here.
    whole = F.regexp_extract(java, r"^-?(\d{7})\.(\d+)$", 1)
    digits = F.regexp_replace(F.concat(whole, F.regexp_extract(java, r"^-?\d{7}\.(\d+)$", 1)), "0+$", "")
    million = F.concat(
        sign, F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 40))).otherwise(""),
        F.lit("e+06"))
    power = F.concat(sign, mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
                     F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    tenth = F.concat(sign, F.lit("0.000"), F.regexp_replace(mantissa, r"\.", ""))
    return (
        F.when(java == "NaN", "NaN")
        .when(java == "Infinity", "+Inf")
        .when(java == "-Infinity", "-Inf")
        .when(exponent == -4, tenth)
        .when(exponent.isNotNull(), power)
        .when(whole != "", million)
        .otherwise(plain)
    )


def plain_float(x: Column) -> Column:
    """Decimal text of a double without exponent and trailing zeros."""
    java = x.cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    mantissa, exponent = _exponent_parts(java)
    digits = F.regexp_replace(mantissa, r"\.", "")
    frac = F.length(digits) - 1
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), "0")
    large = F.concat(
        sign, F.substring(padded, F.lit(1), exponent + 1),
        F.when(frac > exponent, F.concat(F.lit("."), F.substring(padded, exponent + 2, F.lit(40)))).otherwise(""))
    return (
        F.when(exponent.isNull(), F.regexp_replace(java, r"\.0$", ""))
        .when(exponent < 0, small)
        .otherwise(large)
    )


def hex_text(x: Column) -> Column:
    """Binary as 0x and upper-case hex digits."""
    return F.concat(F.lit("0x"), F.hex(x))


def json_string(x: Column) -> Column:
    """A text as a JSON string, quotes included."""
    wrapped = F.to_json(F.array(x))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def trim_json_numbers(x: Column) -> Column:
    """Drop trailing zeros of fractions in JSON text, leaving strings alone."""
    shorter = F.regexp_replace(x, r'("(?:[^"\\]|\\.)*")|(\.\d*?)0+(?=[,\]}\s]|$)', "$1$2")
    return F.regexp_replace(shorter, r'("(?:[^"\\]|\\.)*")|\.(?=[,\]}\s]|$)', "$1")


def plain_json_cell(col: Column, dtype: T.DataType) -> Column:
    """A cell ready for JSON output: binary becomes 0x text, times keep their text form."""
    if isinstance(dtype, T.BinaryType):
        return hex_text(col)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time_text(col, dtype)
    return col


def text_of(col: Column, dtype: T.DataType) -> Column:
    """The text a cell has in CSV files, alerts and fingerprints; NULL stays NULL."""
    if isinstance(dtype, T.FloatType):
        # A single-precision number shows its own shortest digits.
        return float_text(col)
    if isinstance(dtype, T.DoubleType):
        return float_text(col)
    if isinstance(dtype, T.BinaryType):
        return hex_text(col)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time_text(col, dtype)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return trim_json_numbers(F.to_json(col))
    return col.cast("string")


def text_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df`` as text, under its own name."""
    return [text_of(F.col(_q(f.name)), f.dataType).alias(f.name) for f in df.schema.fields]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(_q(name))


def time_text(col: Column, dtype: T.DataType | str) -> Column:
    """Date, time or timestamp text; zero fractions are trimmed, as casts do."""
    kind = dtype if isinstance(dtype, str) else {
        T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "datetime"}[type(dtype)]
    if kind == "date":
        return col.cast("date").cast("string")
    if kind == "time":
        return F.substring(col.cast("string"), 12, 15)
    if kind == "timestamp":
        return F.concat(col.cast("string"), F.date_format(col, "xxx"))
    return col.cast("string")


def preview(col: Column, dtype: T.DataType) -> Column:
    """The leading part of a long cell, with its full size in bytes.

    Text keeps whole characters within 256 KiB, binary 64 KiB as base64.
    """
    if isinstance(dtype, T.BinaryType):
        return F.struct(F.base64(F.substring(col, 1, BINARY_PREVIEW)).alias("head"),
                        F.octet_length(col).cast("bigint").alias("size"),
                        (F.octet_length(col) > BINARY_PREVIEW).alias("cut"))
    size = F.octet_length(col)
    # Cut in bytes, then drop a character split by the cut.
    cut = F.substring(col.cast("binary"), 1, TEXT_PREVIEW)
    head = F.when(size <= TEXT_PREVIEW, col).otherwise(
        F.regexp_replace(F.decode(_whole_characters(cut), "UTF-8"), "\x00$", ""))
    return F.struct(head.alias("head"), size.cast("bigint").alias("size"), (size > TEXT_PREVIEW).alias("cut"))


def _whole_characters(cut: Column) -> Column:
    """Bytes up to the last complete UTF-8 character."""
    tail = [F.conv(F.hex(F.substring(cut, TEXT_PREVIEW - i, 1)), 16, 10).cast("int") for i in range(4)]
    # i bytes from the end: the lead byte of a sequence that needs more bytes than are left.
    drop = (
        F.when(tail[0] >= 0xC0, 1)
        .when((tail[0] >= 0x80) & (tail[1] >= 0xE0), 2)
        .when((tail[0] >= 0x80) & (tail[1] >= 0x80) & (tail[1] < 0xC0) & (tail[2] >= 0xF0), 3)
        .otherwise(0)
    )
    return F.substring(cut, F.lit(1), F.lit(TEXT_PREVIEW) - drop)


def cell_size(col: Column, dtype: T.DataType) -> Column:
    """Estimated bytes a cell adds to a response."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        size = F.octet_length(col)
    elif isinstance(dtype, T.BinaryType):
        size = F.floor(F.octet_length(col) * 4 / 3).cast("int")
    elif isinstance(dtype, T.ArrayType):
        size = F.lit(8) + F.aggregate(col, F.lit(0), lambda acc, x: acc + cell_size(x, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        size = F.lit(8) + F.aggregate(
            F.map_entries(col), F.lit(0),
            lambda acc, e: acc + cell_size(e["key"], dtype.keyType) + cell_size(e["value"], dtype.valueType))
    elif isinstance(dtype, T.StructType):
        size = F.lit(8)
        for f in dtype.fields:
            size = size + F.lit(len(f.name)) + cell_size(col[f.name], f.dataType)
    elif isinstance(dtype, T.VariantType):
        size = F.octet_length(F.to_json(col))
    elif isinstance(dtype, (T.BooleanType, T.IntegralType, T.FractionalType)) and not isinstance(dtype, T.DecimalType):
        return F.lit(8)
    elif isinstance(dtype, T.DecimalType):
        size = F.length(col.cast("string"))
    elif isinstance(dtype, T.DateType):
        size = F.lit(10)
    else:
        size = F.length(text_of(col, dtype))
    return F.coalesce(size, F.lit(8))


def row_size(df: DataFrame) -> Column:
    """The sum of a row's cell sizes."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        total = total + cell_size(quoted(f.name), f.dataType)
    return total


def tsv_escape(text: Column) -> Column:
    """Backslash, tab and line breaks as two-character escapes."""
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def tsv_unescape(text: Column) -> Column:
    """The reverse of ``tsv_escape``; other backslashes stay as they are."""
    # Between escaped backslashes every remaining escape stands alone.
    def piece(part: Column) -> Column:
        for escaped, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            part = F.replace(part, F.lit(escaped), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def excel_time(serial: Column) -> Column:
    """A 1900-system serial number as date, time of day or both."""
    days = F.floor(serial)
    secs = F.round((serial - days) * 86400).cast("int")
    moment = F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), secs)
    return (
        F.when((days == 0) & (secs > 0), F.date_format(moment, "HH:mm:ss"))
        .when(secs == 0, F.date_format(moment, "yyyy-MM-dd"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    )


def bytes_text(n: Column) -> Column:
    """A byte count for people."""
    gib, mib, kib = 1 << 30, 1 << 20, 1 << 10
    return (
        F.when(n >= gib, F.format_string("%.1f GB", F.bround(n.cast("double") / gib, 1)))
        .when(n >= mib, F.format_string("%.1f MB", F.bround(n.cast("double") / mib, 1)))
        .when(n >= kib, F.format_string("%.0f KB", F.bround(n.cast("double") / kib, 0)))
        .otherwise(F.format_string("%d bytes", n.cast("bigint")))
    )


def duration_text(ms: Column) -> Column:
    """A duration in milliseconds for people."""
    total = F.round(ms / 1000).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    long = F.when(h > 0, F.format_string("%dh%dm%ds", h, m, s)).otherwise(F.format_string("%dm%ds", m, s))
    return (
        F.when(ms < 1000, F.format_string("%d ms", F.greatest(ms, F.lit(1)).cast("bigint")))
        .when(ms < 60000, F.format_string("%.1f s", ms.cast("double") / 1000))
        .otherwise(long)
    )
