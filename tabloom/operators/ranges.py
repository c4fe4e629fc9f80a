"""Ranges of sorted keys: an order-statistic index for deep pages, and where two tables differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.functions.text import quoted, text_of
from tabloom.model import Sort
from tabloom.operators.browse import field_of, page_limit
from tabloom.operators.verify import row_digest
from tabloom.session import materialize

# Ranges that are compared at once, cells for each of them, and from which size rows are compared.
OPEN_RANGES = 256
FAN = 64
LEAF_ROWS = 20_000


def _key(names: Sequence[str]) -> Column:
    return F.struct(*[quoted(n).alias(f"k{i}") for i, n in enumerate(names)])


def range_index(df: DataFrame, key: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(range, low, high, base, rows): key ranges in order, each with the number of rows before it.

    Only key columns are shuffled, once; the result is one row for each range.
    NULLs come first.  The index holds for the rows it was made of.
    """
    for k in key:
        field_of(df, k, "key column")
    order = [quoted(k).asc_nulls_first() for k in key]
    keys = df.select(*[quoted(k) for k in key])
    dealt = keys.repartitionByRange(ranges, *order) if ranges else keys.repartitionByRange(*order)
    parts = dealt.select(F.spark_partition_id().alias("range"), _key(key).alias("key")).groupBy("range").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts, "index")
    return parts.select("range", "low", "high", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), "rows")


def _within(df: DataFrame, key: Sequence[str], low: T.Row, high: T.Row) -> Column:
    """Keys from ``low`` to ``high``; the leading column alone is a plain range for the reader."""
    types = [field_of(df, k).dataType for k in key]
    at = lambda row: F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types))])
    lead, first, last = quoted(key[0]), F.lit(low[0]).cast(types[0]), F.lit(high[0]).cast(types[0])
    if high[0] is None:
        plain = lead.isNull()
    elif low[0] is None:
        plain = lead.isNull() | (lead <= last)
    else:
        plain = (lead >= first) & (lead <= last)
    return plain & (_key(key) >= at(low)) & (_key(key) <= at(high))


def page_at(df: DataFrame, key: Sequence[str], offset: int, limit: int | None, index: DataFrame) -> DataFrame:
    """The page at ``offset`` in key order, reading only the ranges it lies in.

    Work does not grow with the offset: the index tells which ranges hold the
    page, a condition on the key takes the reader to them, and only their
    rows are sorted.
    """
    size = page_limit(limit)
    rows = index.where((F.col("base") + F.col("rows") > offset) & (F.col("base") < offset + size)).orderBy("range").collect()
    if not rows:
        return df.limit(0)
    inside = _within(df, key, rows[0].low, rows[-1].high)
    return df.where(inside).orderBy(*[quoted(k).asc_nulls_first() for k in key]).offset(offset - rows[0].base).limit(size)


def sequence_fingerprint(df: DataFrame, order: Sequence[Sort], columns: Sequence[str] | None = None) -> DataFrame:
    """SHA-256 of a result as a sequence: its column names, and each row with its place.

    ``order`` may use columns that are not among ``columns``.  A place is the
    number of rows before it: rows are dealt out by ranges, numbered inside,
    and ranges start after the counts of those before them.  Place and row
    are hashed together and the hashes added up, so swapping two different
    rows changes the result.  Rows equal in ``order`` follow their digests.
    """
    names = list(columns or df.columns)
    marks = "".join(n + "\x1f" for n in names) + "\x1e"
    keyed = df.select(*[quoted(s.column).alias(f"o{i}") for i, s in enumerate(order)],
                      F.md5(row_digest(df.select(*[quoted(n) for n in names]))).alias("d"))
    by = [F.col(f"o{i}").desc_nulls_last() if s.desc else F.col(f"o{i}").asc_nulls_first() for i, s in enumerate(order)] + [F.col("d").asc()]
    placed = materialize(keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "d", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sequence")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    told = F.md5(F.concat((F.col("base") + F.col("at")).cast("string"), F.lit(":"), "d"))
    half = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(28,0)")
    one = placed.join(bases, "part").select(told.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(half(1)), F.lit(0)).alias("a"), F.coalesce(F.sum(half(17)), F.lit(0)).alias("b"))
    parts = [F.lit(marks), *[F.col(c).cast("string") for c in ("n", "a", "b")]]
    return one.select(F.col("n").alias("rows"), F.sha2(F.concat_ws("\x1e", *parts), 256).alias("hash"))


# ---- where two tables differ ---------------------------------------------------


def _cell_hash(name: str, dtype: T.DataType) -> list[Column]:
    """What is hashed of a cell: its value, and whether there is one."""
    col = quoted(name)
    plain = not isinstance(dtype, (T.MapType, T.VariantType))
    return [col if plain else text_of(col, dtype), col.isNull()]


def row_hash(df: DataFrame) -> Column:
    """A number for a row, to be added up."""
    return F.xxhash64(*[c for f in df.schema.fields for c in _cell_hash(f.name, f.dataType)]).cast("decimal(28,0)")


def differing_ranges(source: DataFrame, target: DataFrame, key: str, leaf_rows: int = LEAF_ROWS) -> list[tuple[int, int]]:
    """Ranges of a whole-number key in which the two sides have other rows; they are cut until they are small.

    A level compares counts and sums of row hashes of cells of 2^n keys, as
    small as leaves ``OPEN_RANGES * FAN`` cells, and the next one reads only
    what differed: its ranges are conditions on the key.  A level that neither
    rules out half of its rows nor leaves a ``FAN``-th of the keys is the
    last, so differences all over the key end the search at once.  The driver
    holds ranges, no rows.
    """
    ends = [df.agg(F.min(quoted(key)).alias("a"), F.max(quoted(key)).alias("b"), F.count(F.lit(1)).alias("n")).first() for df in (source, target)]
    known = [(int(r.a), int(r.b)) for r in ends if r.a is not None]
    if not known:
        return []
    open_, done = [(min(a for a, _ in known), max(b for _, b in known))], []
    rows = max(r.n for r in ends)
    while open_:
        bits = next(n for n in range(65) if sum((b >> n) - (a >> n) + 1 for a, b in open_) <= OPEN_RANGES * FAN)
        # The sign is all that 64 bits leave, as 63 do.
        cell = F.shiftright(quoted(key).cast("bigint"), min(bits, 63)).alias("cell")
        inside = reduce(or_, [quoted(key).between(F.lit(a), F.lit(b)) for a, b in open_])
        sides = [df.where(inside).select(cell, row_hash(df).alias("h")).groupBy("cell").agg(
            F.count(F.lit(1)).alias(f"{name}_n"), F.sum("h").alias(f"{name}_h")) for name, df in (("s", source), ("t", target))]
        both = sides[0].join(sides[1], "cell", "full").where(
            ~(F.col("s_n").eqNullSafe(F.col("t_n")) & F.col("s_h").eqNullSafe(F.col("t_h"))))
        found = [(r.cell << bits, ((r.cell + 1) << bits) - 1, max(r.s_n or 0, r.t_n or 0)) for r in both.collect()]
        done += [(a, b) for a, b, n in found if n <= leaf_rows or a == b]
        large = [(a, b, n) for a, b, n in found if n > leaf_rows and a < b]
        low, high, before = open_[0][0], open_[-1][1], sum(b - a + 1 for a, b in open_)
        open_ = _fewer(sorted((max(a, low), min(b, high)) for a, b, _ in large))
        left = sum(n for _, _, n in large)
        if 2 * left > rows and FAN * sum(b - a + 1 for a, b in open_) > before:
            done, open_ = done + open_, []
        rows = left
    return _fewer(sorted(done))


def _fewer(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching ranges joined, and of very many also neighbours, so that conditions stay short."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    while len(out) > OPEN_RANGES:
        out = [(x[0], y[1]) for x, y in zip(out[::2], out[1::2])] + ([out[-1]] if len(out) % 2 else [])
    return out


def verify_rows(source: DataFrame, target: DataFrame, key: Sequence[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row for each key that differs: the key, ``change`` and the ``columns`` with other values.

    ``change`` is ``missing`` (not in the target), ``extra`` (only there),
    ``changed``, or ``repeated`` when a key stands more than once and its rows
    differ.  A leading key column of whole numbers is narrowed down by a tree of
    digests, so only ranges with differences are read again; other keys are
    compared by their digests.  NULL keys are compared too.
    """
    names = [c for c in source.columns if c in target.columns]
    source = source.select(*[quoted(c) for c in names])
    target = target.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in source.schema.fields])
    lead = field_of(source, key[0], "key column").dataType
    if isinstance(lead, T.IntegralType):
        ranges = differing_ranges(source, target, key[0], leaf_rows=leaf_rows)
        near = [quoted(key[0]).between(F.lit(a), F.lit(b)) for a, b in ranges]
        inside = reduce(or_, [quoted(key[0]).isNull(), *near])
        source, target = source.where(inside), target.where(inside)
    cells = [c for c in names if c not in key]

    def side(df: DataFrame, name: str) -> DataFrame:
        digests = [F.xxhash64(*_cell_hash(c, field_of(df, c).dataType)).cast("decimal(28,0)") for c in cells]
        return df.groupBy(*[quoted(k) for k in key]).agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.sum(row_hash(df)).alias(f"{name}_row"),
            *[F.sum(d).alias(f"{name}_{i}") for i, d in enumerate(digests)])

    left, right = side(source, "s"), side(target, "t")
    right = right.toDF(*[f"__{k}" for k in key], *right.columns[len(key):])
    same = reduce(and_, [quoted(k).eqNullSafe(quoted(f"__{k}")) for k in key])
    pairs = left.join(right, same, "full").where(~(F.col("s_rows").eqNullSafe(F.col("t_rows")) & F.col("s_row").eqNullSafe(F.col("t_row"))))
    differ = F.filter(F.array(*[F.when(F.col(f"s_{i}") != F.col(f"t_{i}"), F.lit(c)) for i, c in enumerate(cells)]).cast("array<string>"),
                      lambda x: x.isNotNull())
    change = F.when(F.col("t_rows").isNull(), "missing").when(F.col("s_rows").isNull(), "extra").when(
        (F.col("s_rows") > 1) | (F.col("t_rows") > 1), "repeated").otherwise("changed")
    return pairs.select(*[F.when(F.col("s_rows").isNotNull(), quoted(k)).otherwise(quoted(f"__{k}")).alias(k) for k in key],
                        change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("columns"))
