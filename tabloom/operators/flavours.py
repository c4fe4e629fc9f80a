"""Filters with the semantics of other stores.

Each flavour is one compile function with its own rule for missing values.
They plug into ``browse.narrow`` as ``compile_filter``.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.text import plain_float, quoted
from tabloom.model import Filter
from tabloom.operators.browse import COMPARE, among, compare, field_of, plain_text

_TEXT = T.StringType


def _need_two(f: Filter) -> None:
    if len(f.values) != 2:
        raise ValueError(f"{f.column}: a range takes a lower and an upper value")


def _between(col: Column, f: Filter, dtype: T.DataType) -> Column:
    return compare(">=", col, f.values[0], dtype) & compare("<=", col, f.values[1], dtype)


def _holds(col: Column, value, dtype: T.DataType) -> Column:
    """Whether an array has an element equal to ``value``."""
    return F.exists(col, lambda x: compare("=", x, value, dtype))


def _or_missing(test: Column) -> Column:
    return F.coalesce(test, F.lit(True))


def like_regex(pattern: str, flags: str = "is") -> str:
    """A LIKE pattern as an anchored regular expression."""
    body = "".join(".*" if ch == "%" else "." if ch == "_" else _quote(ch) for ch in pattern)
    return f"(?{flags})^{body}$"


def _quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


# ---- documents -----------------------------------------------------------------


def document_filter(df: DataFrame, f: Filter) -> Column:
    """Document stores: negations match a missing field, text ignores case."""
    dtype = field_of(df, f.column).dataType
    col = quoted(f.column)
    text = plain_text(col, dtype)
    wanted = str(f.value)
    if f.op in ("=", "!="):
        if f.value is None:
            return col.isNull() if f.op == "=" else col.isNotNull()
        test = compare("=", col, f.value, dtype)
        return test if f.op == "=" else _or_missing(~test)
    if f.op in COMPARE:
        return compare(f.op, col, f.value, dtype)
    if f.op == "contains":
        return F.lower(text).contains(wanted.lower())
    if f.op == "startswith":
        return F.lower(text).startswith(wanted.lower())
    if f.op == "endswith":
        return F.lower(text).endswith(wanted.lower())
    if f.op == "like":
        return text.rlike(like_regex(wanted, "i"))
    if f.op == "notlike":
        return _or_missing(~text.rlike(like_regex(wanted, "i")))
    if f.op == "regexp":
        return text.rlike("(?i)" + wanted)
    if f.op in ("in", "notin"):
        values = [v for v in f.values if v is not None]
        found = F.coalesce(among(col, values, dtype), F.lit(False)) if values else F.lit(False)
        if len(values) < len(f.values):
            found = found | col.isNull()
        return found if f.op == "in" else ~found
    if f.op == "null":
        return col.isNull()
    if f.op == "notnull":
        return col.isNotNull()
    if f.op == "empty":
        return (col.isNull() | (col == "")) if isinstance(dtype, _TEXT) else col.isNull()
    if f.op == "between":
        _need_two(f)
        return _between(col, f, dtype)
    raise ValueError(f"{f.op!r} is no filter of documents")


def document_search(df: DataFrame, words: str) -> Column | None:
    """Only text fields are searched."""
    needle = words.strip().lower()
    tests = [F.lower(quoted(x.name)).contains(needle) for x in df.schema.fields if isinstance(x.dataType, _TEXT)]
    return reduce(or_, tests) if tests and needle else None


# ---- search index --------------------------------------------------------------


def words_of(text: Column) -> Column:
    """Lower-case words with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _needle_words(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def _is_text(field: T.StructField) -> bool:
    return field.metadata.get("kind") == "text"


def as_text_field(df: DataFrame, *names: str) -> DataFrame:
    """Mark columns as analysed text, searched by words instead of by value."""
    for n in names:
        df = df.withMetadata(n, {**field_of(df, n).metadata, "kind": "text"})
    return df


def _wildcard(value: str, op: str) -> str:
    """The value with * and ? taken literally, wrapped as the operator asks."""
    if op == "contains":
        return "(?is)^.*" + _quote(value) + ".*$"
    if op == "startswith":
        return "(?is)^" + _quote(value) + ".*$"
    if op == "endswith":
        return "(?is)^.*" + _quote(value) + "$"
    return like_regex(value)


def search_index_filter(df: DataFrame, f: Filter) -> Column:
    """Search indexes: terms on keywords, phrases on text."""
    field = field_of(df, f.column, "field")
    dtype, col = field.dataType, quoted(f.column)
    wanted = str(f.value)
    if f.op in ("=", "!="):
        test = words_of(col).contains(f" {_needle_words(wanted)} ") if _is_text(field) else compare("=", col, f.value, dtype)
        return test if f.op == "=" else _or_missing(~test)
    if f.op in COMPARE:
        return compare(f.op, col, f.value, dtype)
    if f.op == "between":
        _need_two(f)
        return _between(col, f, dtype)
    if f.op in ("in", "notin"):
        found = among(col, f.values, dtype) if f.values else F.lit(False)
        return found if f.op == "in" else _or_missing(~found)
    if f.op in ("contains", "startswith", "endswith", "like", "notlike"):
        if _is_text(field):
            if f.op in ("endswith", "like", "notlike"):
                raise ValueError(f"{f.column}: analysed text is matched by contains and startswith alone")
            end = "" if f.op == "startswith" else " "
            return words_of(col).contains(f" {_needle_words(wanted)}{end}")
        test = plain_text(col, dtype).rlike(_wildcard(wanted, f.op))
        return _or_missing(~test) if f.op == "notlike" else test
    if f.op == "regexp":
        return plain_text(col, dtype).rlike(f"^(?:{wanted})$")
    if f.op == "null":
        return col.isNull()
    if f.op == "notnull":
        return col.isNotNull()
    raise ValueError(f"{f.column}: {f.op!r} is no filter of indexes")


def search_index_search(df: DataFrame, words: str) -> Column | None:
    """Every word must occur in some field: as a word of text, or as a keyword."""
    tests = []
    for word in words.split():
        hits = []
        for x in df.schema.fields:
            if not isinstance(x.dataType, _TEXT):
                continue
            hits.append(words_of(quoted(x.name)).contains(f" {_needle_words(word)} ") if _is_text(x)
                        else quoted(x.name) == word)
        tests.append(F.coalesce(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False)))
    return reduce(and_, tests) if tests else None


# ---- items ---------------------------------------------------------------------


def item_filter(df: DataFrame, f: Filter) -> Column:
    """Item stores: case-sensitive text, two-valued logic, sets by element."""
    dtype = field_of(df, f.column).dataType
    col = quoted(f.column)
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    if f.op in COMPARE:
        # An item without the attribute differs from every value.
        test = ~F.coalesce(compare("=", col, f.value, dtype), F.lit(False)) if f.op == "!=" else compare(f.op, col, f.value, dtype)
    elif f.op == "between":
        _need_two(f)
        test = _between(col, f, dtype)
    elif f.op in ("in", "notin"):
        if not 1 <= len(f.values) <= 100:
            raise ValueError(f"{f.column}: a list of values has 1 to 100 of them")
        test = F.coalesce(among(col, f.values, dtype), F.lit(False))
        test = test if f.op == "in" else ~test
    elif f.op == "startswith":
        test = col.startswith(str(f.value))
    elif f.op == "contains":
        test = _holds(col, f.value, element) if isinstance(dtype, T.ArrayType) \
            else plain_text(col, dtype).contains(str(f.value))
    elif f.op == "null":
        test = col.isNull()
    elif f.op == "notnull":
        test = col.isNotNull()
    else:
        raise ValueError(f"{f.column}: items filter with =, !=, <, <=, >, >=, between, in, startswith, contains, null")
    return F.coalesce(test, F.lit(False))


def item_search(df: DataFrame, words: str) -> Column | None:
    """Text attributes contain the words; sets of text hold them as an element."""
    needle = words.strip()
    tests = []
    for x in df.schema.fields:
        if isinstance(x.dataType, _TEXT):
            tests.append(F.coalesce(quoted(x.name).contains(needle), F.lit(False)))
        elif isinstance(x.dataType, T.ArrayType) and isinstance(x.dataType.elementType, _TEXT):
            tests.append(F.coalesce(F.array_contains(quoted(x.name), needle), F.lit(False)))
    if not tests:
        raise ValueError("the items have no attribute that holds text")
    return reduce(or_, tests)


# ---- wide columns --------------------------------------------------------------


def wide_column_filter(df: DataFrame, f: Filter) -> Column:
    """Wide-column stores: equality, ranges, and elements of collections."""
    dtype = field_of(df, f.column).dataType
    col = quoted(f.column)
    if f.op in ("=", "<", "<=", ">", ">="):
        return compare(f.op, col, f.value, dtype)
    if f.op == "between":
        _need_two(f)
        return _between(col, f, dtype)
    if f.op == "in":
        if not f.values:
            raise ValueError(f"{f.column}: an empty list matches nothing")
        return among(col, f.values, dtype)
    if f.op == "contains":
        if isinstance(dtype, T.ArrayType):
            return _holds(col, f.value, dtype.elementType)
        if isinstance(dtype, T.MapType):
            return _holds(F.map_values(col), f.value, dtype.valueType)
        raise ValueError(f"{f.column}: only whole values and ranges can be looked up here")
    raise ValueError(f"{f.column}: filters are =, <, <=, >, >=, between, in and (for collections) contains")


def wide_column_search(df: DataFrame, words: str) -> Column | None:
    raise ValueError("every column cannot be searched here; filter on a column instead")


# ---- key-value -----------------------------------------------------------------


def _kv_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return plain_float(col)
    return plain_text(col, dtype)


def _number(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


def _kv_compare(col: Column, dtype: T.DataType, op: str, wanted: str) -> Column:
    """As numbers when both sides are numbers, else as text."""
    text = _kv_text(col, dtype)
    by_text = COMPARE[op](text, F.lit(wanted))
    limit = _number(wanted)
    if limit is None:
        return by_text
    number = col.cast("double") if isinstance(dtype, T.NumericType) else F.trim(text).try_cast("double")
    return F.when(number.isNotNull(), COMPARE[op](number, F.lit(limit))).otherwise(by_text)


def key_value_filter(df: DataFrame, f: Filter) -> Column:
    """Key-value stores: values are never NULL."""
    dtype = field_of(df, f.column).dataType
    col = quoted(f.column)
    text = _kv_text(col, dtype)
    wanted = "" if f.value is None else str(f.value)
    if f.op in COMPARE:
        return _kv_compare(col, dtype, f.op, wanted)
    if f.op == "between":
        _need_two(f)
        return (_kv_compare(col, dtype, ">=", str(f.values[0]))
                & _kv_compare(col, dtype, "<=", str(f.values[1])))
    if f.op == "contains":
        return F.lower(text).contains(wanted.lower())
    if f.op == "startswith":
        return F.lower(text).startswith(wanted.lower())
    if f.op == "endswith":
        return F.lower(text).endswith(wanted.lower())
    if f.op in ("in", "notin"):
        found = text.isin(*[str(v) for v in f.values]) if f.values else F.lit(False)
        return found if f.op == "in" else ~found
    if f.op in ("like", "notlike"):
        hit = text.rlike(like_regex(wanted))
        return hit if f.op == "like" else ~hit
    if f.op == "regexp":
        return text.rlike(wanted)
    if f.op == "empty":
        return text == ""
    if f.op in ("null", "notnull"):
        return F.lit(f.op == "notnull")
    raise ValueError(f"filter {f.op!r} is not available for key-value data")


def key_value_search(df: DataFrame, words: str) -> Column | None:
    needle = words.strip().lower()
    return reduce(or_, [F.lower(_kv_text(quoted(x.name), x.dataType)).contains(needle) for x in df.schema.fields])


FLAVOURS = {
    "document": (document_filter, document_search),
    "search": (search_index_filter, search_index_search),
    "item": (item_filter, item_search),
    "wide": (wide_column_filter, wide_column_search),
    "kv": (key_value_filter, key_value_search),
}
