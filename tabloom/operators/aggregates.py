"""Buckets, metrics, summaries and newest versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.text import quoted
from tabloom.operators.browse import field_of


def terms(df: DataFrame, key: str, metrics: Mapping[str, Column] | None = None, size: int | None = None,
          keyed: bool = False) -> DataFrame:
    """Buckets as rows: key, doc_count and the metrics by name.

    Largest buckets first, ties by key; keyed buckets are sorted by key.
    ``size`` keeps that many of them.
    """
    field_of(df, key)
    metrics = metrics or {}
    out = df.groupBy(quoted(key).alias("key")).agg(
        F.count(F.lit(1)).alias("doc_count"), *[metrics[n].alias(n) for n in sorted(metrics)]).where(F.col("key").isNotNull())
    out = out.orderBy(F.col("key").asc()) if keyed else out.orderBy(F.col("doc_count").desc(), F.col("key").asc())
    return out.limit(size) if size else out


def metrics(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Metrics without buckets: one row, columns by name."""
    return df.agg(*[aggs[n].alias(n) for n in sorted(aggs)])


def group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], by: str | None = None) -> DataFrame:
    """Group and aggregate, largest ``by`` first."""
    out = df.groupBy(*[quoted(k) for k in keys]).agg(*[c.alias(n) for n, c in aggs.items()])
    if by:
        out = out.orderBy(F.col(by).desc(), *[quoted(k) for k in keys])
    return out


def distinct_values(df: DataFrame, field: str, condition: Column | None = None) -> DataFrame:
    """Distinct values of one field; array fields give their elements."""
    dtype = field_of(df, field).dataType
    kept = df if condition is None else df.where(condition)
    col = F.explode(quoted(field)) if isinstance(dtype, T.ArrayType) else quoted(field)
    return kept.select(col.alias(field)).distinct()


def distinct_count(df: DataFrame, keys: Sequence[str], field: str, name: str = "distinct", approx: bool = False) -> DataFrame:
    """Distinct values per group, exact unless ``approx``.

    Exact counting goes through (keys, value) first, so one large group is
    spread over the tasks.
    """
    groups = [quoted(k) for k in keys]
    if approx:
        return df.groupBy(*groups).agg(F.approx_count_distinct(quoted(field)).alias(name))
    pairs = df.groupBy(*groups, quoted(field).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(*groups).agg(F.count("__value").alias(name))


def summary_by_day(df: DataFrame, ts: str, aggs: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row per day, and per further key."""
    return df.groupBy(F.to_date(quoted(ts)).alias("day"), *[quoted(k) for k in keys]).agg(
        *[c.alias(n) for n, c in aggs.items()])


def compact_sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the numeric columns of rows with the same key.

    Other columns keep the values of one of the rows, as a summing table does.
    """
    sums, others = [], []
    for f in df.schema.fields:
        if f.name not in keys:
            (sums if isinstance(f.dataType, T.NumericType) else others).append(f.name)
    aggs = [F.sum(quoted(n)).alias(n) for n in sums]
    if others:
        # One row's values together: several minima would mix rows.
        aggs.append(F.min(F.struct(*[quoted(n).alias(n) for n in others])).alias("__row"))
    out = df.groupBy(*[quoted(k) for k in keys]).agg(*aggs)
    return out.select(*[F.col("__row")[c].alias(c) if c in others else quoted(c) for c in df.columns])


def ratio(part: Column, whole: Column, per: float = 1, digits: int = 2) -> Column:
    """A rounded ratio that is NULL for a whole of zero or NULL."""
    return F.round(F.try_divide(part * F.lit(per), F.nullif(whole, F.lit(0))), digits)


def latest(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest version of every key.

    An aggregate, not a window: versions are combined before the shuffle and
    no key's history has to be sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(quoted(version), *[quoted(t) for t in ties])
    newest = df.groupBy(*[quoted(k) for k in keys]).agg(
        F.max_by(F.struct(*[quoted(c).alias(c) for c in rest]), rank).alias("__row"))
    return newest.select(*[quoted(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, dropping the repeats a scan may return."""
    return df.dropDuplicates(list(keys))


def top(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest, ties by key."""
    return df.orderBy(quoted(measure).desc(), quoted(key).asc()).limit(k)
