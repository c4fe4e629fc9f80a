"""Appending and stacking rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.text import quoted


def add_rows(existing: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """Existing rows with the new ones, or the new ones alone; columns go by position."""
    if len(new.columns) != len(existing.columns):
        raise ValueError("both sides need the same number of columns")
    aligned = new.select(*[quoted(c).cast(f.dataType).alias(f.name) for c, f in zip(new.columns, existing.schema.fields)])
    if mode == "append":
        return existing.unionByName(aligned)
    if mode == "replace":
        return aligned
    raise ValueError(f"unknown row mode {mode!r}")


def rows_as_union(df: DataFrame, rows: Iterable[Sequence], types: Sequence[str]) -> DataFrame:
    """Literal rows appended as SELECT … UNION ALL SELECT …."""
    one = df.sparkSession.range(1)
    selects = [one.select(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(row, types, df.columns)]) for row in rows]
    return reduce(DataFrame.unionAll, selects, df)


def stack(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches stacked by name; fields a batch lacks are NULL, new fields join at the end."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
