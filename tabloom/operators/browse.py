"""Browsing one table: project, filter, search, sort, page, count."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.text import quoted, row_size
from tabloom.model import ROW_KEY, SEARCHABLE, Filter, Sort, TableMeta, kind_of

# Page size when none is asked for, and the cell bytes after
# which a page or a console result stops.
DEFAULT_PAGE = 200
PAGE_BUDGET, CONSOLE_BUDGET = 48 << 20, 128 << 20

COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def field_of(df: DataFrame, name: str, what: str = "column") -> T.StructField:
    field = next((f for f in df.schema.fields if f.name == name), None)
    if field is None:
        raise ValueError(f"unknown {what} {name!r}")
    return field


def plain_text(col: Column, dtype: T.DataType) -> Column:
    """A column's text form in filters: a plain cast, JSON for nested values."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def argument(value, dtype: T.DataType) -> Column:
    """A filter value in the column's type.

    Catalyst folds the cast, so comparisons still reach the file reader.
    """
    if isinstance(dtype, T.BooleanType) and isinstance(value, str):
        value = value == "1" or value.lower() == "true"
    if isinstance(value, Column):
        return value
    return F.lit(value).cast(dtype)


_WIDTHS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _unfit(value, dtype: T.DataType) -> Decimal | None:
    """The number itself when a column of exact numbers cannot hold it."""
    if isinstance(value, (bool, Column)) or value is None or not isinstance(dtype, (*_WIDTHS, T.DecimalType)):
        return None
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if number.is_nan():
        return None
    if isinstance(dtype, T.DecimalType):
        fits = number.is_finite() and number == round(number, dtype.scale) and abs(number) < Decimal(10) ** (dtype.precision - dtype.scale)
    else:
        half = 1 << (_WIDTHS[type(dtype)] - 1)
        fits = number.is_finite() and number == int(number) and -half <= number < half
    return None if fits else number


def compare(op: str, col: Column, value, dtype: T.DataType) -> Column:
    """A comparison that keeps the value's own size.

    A value that the column cannot hold equals none of its values, and a range
    moves to the nearest value that it can hold: the column stays bare, so
    the condition still reaches the file reader.
    """
    number = _unfit(value, dtype)
    if number is None:
        return COMPARE[op](col, argument(value, dtype))
    if op in ("=", "!="):
        return col.isNotNull() & F.lit(op == "!=")
    if isinstance(dtype, T.DecimalType):
        step, top = Decimal(1).scaleb(-dtype.scale), Decimal(10) ** (dtype.precision - dtype.scale)
        low, high = -top + step, top - step
    else:
        half = 1 << (_WIDTHS[type(dtype)] - 1)
        step, low, high = Decimal(1), Decimal(-half), Decimal(half - 1)
    if number < low or number > high:
        return col.isNotNull() & F.lit((number > high) == (op in ("<", "<=")))
    below = number.quantize(step, rounding="ROUND_FLOOR")
    if op in ("<", "<="):
        return col <= F.lit(str(below)).cast(dtype)
    return col >= F.lit(str(below + step)).cast(dtype)


def among(col: Column, values: Sequence, dtype: T.DataType) -> Column:
    """Whether a column has one of ``values``; those it cannot hold are none of its values."""
    held = [v for v in values if _unfit(v, dtype) is None]
    return col.isin(*[argument(v, dtype) for v in held]) if held else col.isNotNull() & F.lit(False)


def like_pattern(text: str) -> str:
    """Only ``%`` and ``_`` are special, and a backslash only before one of them."""
    return re.sub(r"\\(?![%_])", r"\\\\", text)


def project(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The asked columns in the asked order; unknown names are left out."""
    known = set(df.columns)
    kept = [n for n in names or () if n in known]
    return df.select(*[quoted(n) for n in kept]) if kept else df


def predicate(df: DataFrame, f: Filter) -> Column:
    """One relational filter with SQL's three-valued logic."""
    dtype = field_of(df, f.column).dataType
    col = quoted(f.column)
    if f.op in COMPARE:
        return compare(f.op, col, f.value, dtype)
    if f.op in ("in", "notin"):
        if not f.values:
            return F.lit(f.op == "notin")
        if all(_unfit(v, dtype) is not None for v in f.values):
            return col.isNotNull() & F.lit(f.op == "notin")
        found = among(col, f.values, dtype)
        return found if f.op == "in" else ~found
    if f.op == "null":
        return col.isNull()
    if f.op == "notnull":
        return col.isNotNull()
    if f.op == "between":
        if len(f.values) != 2:
            raise ValueError("a range takes a lower and an upper value")
        return compare(">=", col, f.values[0], dtype) & compare("<=", col, f.values[1], dtype)
    text = plain_text(col, dtype)
    wanted = str(f.value)
    folded = F.lower(text)
    if f.op == "like":
        return folded.like(like_pattern(wanted.lower()))
    if f.op == "notlike":
        return ~folded.like(like_pattern(wanted.lower()))
    if f.op == "contains":
        return folded.contains(wanted.lower())
    if f.op == "startswith":
        return folded.startswith(wanted.lower())
    if f.op == "endswith":
        return folded.endswith(wanted.lower())
    if f.op == "empty":
        return (col.isNull() | (text == "")) if isinstance(dtype, T.StringType) else col.isNull()
    if f.op == "regexp":
        return text.rlike(wanted)
    raise ValueError(f"{f.op!r} is no filter")


def search_predicate(df: DataFrame, words: str) -> Column | None:
    """Quick search: any searchable column contains the words."""
    needle = words.strip().lower()
    if not needle:
        return None
    tests = [F.lower(plain_text(quoted(f.name), f.dataType)).contains(needle)
             for f in df.schema.fields if (f.metadata.get("kind") or kind_of(f.dataType)) in SEARCHABLE]
    return reduce(or_, tests) if tests else None


# Filters on raw columns, which the file reader can use, go first.
_RAW_OPS = frozenset(COMPARE) | {"in", "notin", "between", "null", "notnull"}


def narrow(df: DataFrame, filters: Iterable[Filter] = (), search: str = "", where: str = "",
           compile_filter=predicate, compile_search=search_predicate) -> DataFrame:
    """All filters, the quick search and a raw condition, AND-ed."""
    ordered = sorted(filters, key=lambda f: f.op not in _RAW_OPS)
    tests = [compile_filter(df, f) for f in ordered]
    found = compile_search(df, search) if search and search.strip() else None
    if found is not None:
        tests.append(found)
    if where and where.strip():
        tests.append(F.expr(where))
    return df.where(reduce(and_, tests)) if tests else df


def order_columns(df: DataFrame, sorts: Sequence[Sort]) -> list[Column]:
    out = []
    for s in sorts:
        field_of(df, s.column, "sort column")
        col = quoted(s.column)
        # NULLs are smallest: first ascending, last descending.
        out.append(col.desc_nulls_last() if s.desc else col.asc_nulls_first())
    return out


def sort(df: DataFrame, sorts: Sequence[Sort], meta: TableMeta | None = None) -> DataFrame:
    """The asked order, else the primary key's; views stay unordered."""
    if not sorts and meta is not None and not meta.is_view:
        sorts = [Sort(k) for k in meta.primary_key]
    return df.orderBy(*order_columns(df, sorts)) if sorts else df


def page_limit(limit: int | None) -> int:
    """Any size asked for; the default when none is."""
    return limit if limit and limit > 0 else DEFAULT_PAGE


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    info: DataFrame  # one row: offset, limit, rows, truncated


def page(df: DataFrame, offset: int = 0, limit: int | None = None, order: Sequence[Column] = ()) -> Page:
    """A slice of ordered rows.  One extra row tells whether more follow."""
    size = page_limit(limit)
    ordered = df.orderBy(*order) if order else df
    rows = ordered.offset(offset).limit(size) if offset else ordered.limit(size)
    seen = (ordered.offset(offset) if offset else ordered).limit(size + 1)
    info = seen.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(offset).cast("bigint").alias("offset"), F.lit(size).cast("bigint").alias("limit"),
        F.least("n", F.lit(size)).cast("bigint").alias("rows"), (F.col("n") > size).alias("truncated"))
    return Page(rows, info)


def page_after(df: DataFrame, key: Sequence[str], last: Sequence | None, limit: int | None = None,
               desc: bool = False) -> DataFrame:
    """The page that follows a known last key.

    Works at any depth: the key condition is pushed to the reader, so no
    earlier page is sorted again.  NULL keys are part of the order: first
    ascending, last descending.
    """
    for k in key:
        field_of(df, k, "key column")
    if last is not None:
        if len(last) != len(key):
            raise ValueError("the last key must have one value per key column")
        types = [field_of(df, k).dataType for k in key]

        def beyond(k: str, v, dtype: T.DataType, or_same: bool) -> Column:
            col = quoted(k)
            if v is None:
                return (F.lit(True) if or_same else col.isNotNull()) if not desc else (col.isNull() if or_same else F.lit(False))
            step = compare(("<" if desc else ">") + "=" * or_same, col, v, dtype)
            return step | col.isNull() if desc else step

        steps = []
        for i, (k, v) in enumerate(zip(key, last)):
            same = [quoted(a).eqNullSafe(argument(b, t)) for a, b, t in zip(key[:i], last[:i], types)]
            steps.append(reduce(and_, same + [beyond(k, v, types[i], False)]))
        # The leading column alone gives the reader a plain range.
        df = df.where(beyond(key[0], last[0], types[0], True)).where(reduce(or_, steps))
    return df.orderBy(*order_columns(df, [Sort(k, desc) for k in key])).limit(page_limit(limit))


@dataclass(frozen=True)
class Browse:
    """What to show of a table."""

    columns: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    search: str = ""
    where: str = ""
    sort: Sequence[Sort] = ()
    offset: int = 0
    limit: int | None = None


def browse(df: DataFrame, request: Browse, meta: TableMeta | None = None) -> Page:
    """A filtered, sorted, projected page."""
    kept = narrow(df, request.filters, request.search, request.where)
    sorts = list(request.sort)
    if not sorts and meta is not None and not meta.is_view:
        sorts = [Sort(k) for k in meta.primary_key]
    order = order_columns(df, sorts)
    full = page(kept, request.offset, request.limit, order)
    return Page(project(full.rows, request.columns), full.info)


def browse_all(df: DataFrame, request: Browse, meta: TableMeta | None = None) -> DataFrame:
    """Every matching row, for exports: no paging, no synthetic row key."""
    kept = sort(narrow(df, request.filters, request.search, request.where), request.sort, meta)
    return hide_row_key(project(kept, request.columns))


def count(df: DataFrame, filters: Iterable[Filter] = (), search: str = "", where: str = "") -> DataFrame:
    """Exact row count under the same conditions as a page."""
    return narrow(df, filters, search, where).agg(F.count(F.lit(1)).alias("rows")).withColumn("exact", F.lit(True))


def count_estimate(df: DataFrame, estimate: int | DataFrame | None = None, filters: Iterable[Filter] = (), search: str = "",
                   where: str = "", exact: bool = True) -> DataFrame:
    """An exact count, or with ``exact=False`` the estimate of an unfiltered table that has one.

    ``estimate`` is a number, or a row with ``rows`` such as ``describe.footer_rows`` makes of a table's footers.
    """
    filters = list(filters)
    if not exact and estimate is not None and not filters and not search.strip() and not where.strip():
        if isinstance(estimate, DataFrame):
            return estimate.select("rows", F.lit(False).alias("exact"))
        return df.sparkSession.range(1).select(F.lit(estimate).cast("bigint").alias("rows"), F.lit(False).alias("exact"))
    return count(df, filters, search, where)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add the physical row identifier of a file-backed table without a key."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                   F.col("_metadata.row_index").alias("row")).alias(ROW_KEY))


def hide_row_key(df: DataFrame) -> DataFrame:
    return df.drop(ROW_KEY) if ROW_KEY in df.columns else df


def head(df: DataFrame, n: int, order: Sequence[Column] = ()) -> DataFrame:
    """The first rows, for previews."""
    return (df.orderBy(*order) if order else df).limit(n)


def clip(df: DataFrame, limit: int, order: Sequence[Column], budget: int = PAGE_BUDGET) -> DataFrame:
    """A page that stops after the row that takes its cells past ``budget``.

    The running sum covers one page: the page is cut by ``limit`` first.
    """
    cut = df.withColumn("__size", row_size(df)).orderBy(*order).limit(page_limit(limit))
    before = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") <= budget).drop(
        "__size", "__before")


def snapshot(df: DataFrame, order: Sequence[Column], byte_limit: int, max_rows: int = 500) -> DataFrame:
    """At most ``max_rows`` rows, halved until their JSON fits ``byte_limit``."""
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = df.orderBy(*order).limit(max_rows).withColumn(
        "__bytes", F.octet_length(F.to_json(F.struct(*[quoted(c) for c in df.columns]))).cast("bigint"))
    numbered = sized.select(
        "*", F.row_number().over(Window.orderBy(*order)).alias("__n"), F.count(F.lit(1)).over(whole).alias("__have"),
        F.sum("__bytes").over(so_far).alias("__run"))
    halvings = F.array(*[F.floor(F.col("__have") / (1 << i)) for i in range(max_rows.bit_length() + 1)])
    fits = F.when(F.array_contains(halvings, F.col("__n").cast("bigint")) & (F.col("__run") <= byte_limit), F.col("__n"))
    return numbered.withColumn("__keep", F.max(fits).over(whole)).where(F.col("__n") <= F.col("__keep")).drop(
        "__n", "__have", "__run", "__keep", "__bytes")


def row_cap(df: DataFrame, max_rows: int, order: Sequence[Column] = ()) -> Page:
    """At most ``max_rows`` rows to write, with the true total beside them."""
    rows = (df.orderBy(*order) if order else df).limit(max_rows)
    info = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.least("total", F.lit(max_rows)).cast("bigint").alias("written"),
        (F.col("total") > max_rows).alias("truncated"))
    return Page(rows, info)


def sort_text(df: DataFrame, column: str, desc: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Text in number order when every value is a number, else in text order."""
    number = F.trim(quoted(column)).try_cast("double")
    # Part of the plan, so nothing runs before the rows are asked for.
    numeric = df.agg(F.coalesce(F.bool_and(number.isNotNull() | quoted(column).isNull()), F.lit(True)).alias("numeric")).scalar()
    keys = [F.when(numeric, number), F.when(~numeric, quoted(column))]
    return df.orderBy(*[k.desc_nulls_last() if desc else k.asc_nulls_first() for k in keys], *[quoted(t) for t in ties])


def sort_elements(df: DataFrame, kind: str, desc: bool = False) -> DataFrame:
    """Elements of a key in their own order: score, index or entry id."""
    if kind == "zset":
        keys = [F.col("score"), F.col("member")]
    elif kind == "list":
        keys = [F.col("index")]
    elif kind == "stream":
        # Entry ids are two numbers, milliseconds and a sequence.
        part = F.split(F.col("id"), "-")
        keys = [part[0].cast("decimal(20,0)"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("0")).cast("decimal(20,0)")]
    else:
        raise ValueError(f"{kind} keys have no order of their own")
    return df.orderBy(*[k.desc() if desc else k.asc() for k in keys])


def sort_in_partition(df: DataFrame, partition: dict, clustering: Sequence[Sort], sorts: Sequence[Sort]) -> DataFrame:
    """Order by clustering columns inside one partition of a wide-column table.

    The sort must follow the clustering columns, all in their declared
    directions or all reversed.
    """
    if not partition or not clustering:
        raise ValueError("an order needs one whole partition, chosen by =, and clustering columns")
    names = ", ".join(c.column for c in clustering)
    if len(sorts) > len(clustering) or any(s.column != c.column for s, c in zip(sorts, clustering)):
        raise ValueError(f"the order must begin as the table is clustered: {names}")
    if len({s.desc != c.desc for s, c in zip(sorts, clustering)}) > 1:
        raise ValueError("either all clustering columns keep their direction or all are turned round")
    kept = narrow(df, [Filter(k, "=", v) for k, v in partition.items()])
    return kept.orderBy(*order_columns(kept, sorts)) if sorts else kept
