"""File text to column values, and the readers of booleans and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# The words read as true and false, in any case.
TRUE_WORDS = ("1", "t", "true", "y", "yes", "on")
FALSE_WORDS = ("0", "f", "false", "n", "no", "off")

# The scalar wrappers of extended JSON, and those holding a date.
SCALAR_WRAPPERS = ("$oid", "$numberDecimal", "$numberLong", "$numberInt", "$numberDouble", "$uuid")

# Datetime text with an offset (date, time, offset) and without one.
WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})| \d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2})$"
WITHOUT_OFFSET = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?| \d{2}:\d{2})?$"
# What stands behind the clock's last digit: Z, or hours with or without minutes.
OFFSET_END = r"(?<=\d)(Z|[-+]\d\d(?:\d\d|:\d\d)?)$"


def to_bool(text: Column) -> Column:
    """Yes/no words to BOOLEAN; anything else is NULL."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_time(text: Column) -> Column:
    """Datetime text as (instant, wall, has_offset); all NULL when it is none.

    ``wall`` is the clock as written, ``instant`` the moment in UTC; text
    without an offset is taken as UTC.
    """
    s = F.trim(text)
    plain, offset = s.rlike(WITHOUT_OFFSET), s.rlike(WITH_OFFSET)
    # Built without higher-order functions: a caller that takes one field
    # pays for that field only.
    wall = F.when(plain, s).when(offset, F.regexp_replace(s, OFFSET_END, "")).try_cast("timestamp_ntz")
    shift = F.regexp_extract(s, OFFSET_END, 1)
    minutes = F.when(shift == "Z", 0).otherwise(
        F.when(shift.startswith("-"), -1).otherwise(1)
        * (F.substring(shift, 2, 2).try_cast("int") * 60
           + F.coalesce(F.regexp_extract(shift, r"^...:?(\d{2})$", 1).try_cast("int"), F.lit(0))))
    utc = F.when(plain, wall).when(offset, wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    return F.struct(utc.alias("utc"), wall.alias("wall"), F.when(wall.isNotNull(), ~plain).alias("has_offset"))


def prepare(text: Column, kind: str, null_text: str | None = None, empty_as_null: bool = False) -> Column:
    """One file value for a column of ``kind``: struct(value, error).

    The value stays text (BOOLEAN and BINARY are written as ``true``/``false``
    and hex digits) so that one expression serves every target; ``typed``
    finishes it.
    """
    value = _prepared(text, kind, empty_as_null)
    blank_null = kind not in ("string", "text", "enum") or empty_as_null
    is_null = text.isNull()
    if null_text:
        is_null = is_null | (text == null_text)
    if blank_null:
        is_null = is_null | (text == "")
    error = F.lit(None).cast("string")
    if kind == "bool":
        error = F.when(~is_null & (text != "") & value.isNull(),
                       F.format_string('cannot read "%s" as true or false', text))
    return F.struct(F.when(is_null, F.lit(None)).otherwise(value).alias("value"), error.alias("error"))


def _prepared(text: Column, kind: str, empty_as_null: bool) -> Column:
    if kind == "bool":
        return to_bool(text).cast("string")
    if kind in ("int", "float", "decimal"):
        return F.trim(text)
    if kind == "binary":
        digits = F.regexp_extract(text, r"^(?:0[xX]|\\x)((?:[0-9A-Fa-f]{2})*)$", 1)
        marked = text.rlike(r"^(?:0[xX]|\\x)(?:[0-9A-Fa-f]{2})*$")
        return F.when(marked, F.upper(digits)).otherwise(F.hex(text.cast("binary")))
    return text


def prepare_json(value: Column, kind: str, null_text: str | None = None, empty_as_null: bool = False) -> Column:
    """Like ``prepare`` for a VARIANT value from a JSON file."""
    shape = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    wrapped = F.coalesce(*[F.try_variant_get(value, f"$['{k}']", "string") for k in SCALAR_WRAPPERS])
    moment = F.try_variant_get(value, "$['$date']", "string")
    packed = F.try_variant_get(value, "$['$binary']['base64']", "string")
    is_object = shape.startswith("OBJECT")
    from_text = prepare(F.when(is_object, wrapped).otherwise(as_text), kind, null_text, empty_as_null)
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    direct = (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
        .when(is_object & moment.isNotNull(), moment)
        .when(is_object & packed.isNotNull(), F.hex(F.unbase64(packed)))
        .when((is_object & wrapped.isNull()) | shape.startswith("ARRAY"), F.to_json(value))
    )
    if kind == "bool":
        direct = direct.when(number, (as_text != "0").cast("string"))
    else:
        direct = direct.when(number, F.to_json(value))
    plain = number | shape.startswith("ARRAY") | (is_object & wrapped.isNull()) | value.isNull() | F.is_variant_null(value)
    return F.struct(F.when(plain, direct).otherwise(from_text["value"]).alias("value"),
                    F.when(~plain, from_text["error"]).alias("error"))


def typed(value: Column, data_type) -> Column:
    """Prepared text as the column's Spark type; NULL when it does not fit."""
    name = data_type if isinstance(data_type, str) else data_type.simpleString()
    if name == "binary":
        return F.unhex(value)
    if name == "timestamp_ntz":
        return parse_time(value)["wall"]
    if name == "timestamp":
        return parse_time(value)["utc"].cast("timestamp")
    if name == "date":
        return parse_time(value)["wall"].cast("date")
    if name == "string":
        return value
    return value.try_cast(name)
