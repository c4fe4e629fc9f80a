"""Constraint checks for files, which enforce none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.text import quoted
from tabloom.model import TableMeta
from tabloom.operators.joins import orphan_keys
from tabloom.plans.types import conversion_loss


def _long(df: DataFrame, counts: Mapping[str, Column], label: str) -> DataFrame:
    """One aggregate over the table, laid out as one row per column."""
    names = list(counts)
    one = df.agg(*[counts[n].alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").cast("bigint").alias(label))
                     for i, n in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column that must have none."""
    return _long(df, {c: F.count_if(quoted(c).isNull()) for c in columns}, "violations")


def unique(df: DataFrame, key: Sequence[str], nulls_pass: bool = True) -> DataFrame:
    """Key values that occur more than once, with their counts.

    Unique keys let NULLs pass; a primary key does not.
    """
    kept = df.where(reduce(and_, [quoted(k).isNotNull() for k in key])) if nulls_pass else df
    return kept.groupBy(*[quoted(k) for k in key]).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def check(df: DataFrame, condition: str) -> DataFrame:
    """Rows a CHECK rejects; a NULL outcome passes."""
    return df.where(~F.coalesce(F.expr(condition).cast("boolean"), F.lit(True)))


def enum_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed ones, with their counts; NULL passes."""
    return df.where(quoted(column).isNotNull() & ~quoted(column).isin(*allowed)).groupBy(
        quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Referenced keys without a parent; keys with a NULL pass."""
    return orphan_keys(child, columns, parent, parent_columns)


def overflows(col: Column, dtype: T.DataType, target: T.DataType) -> Column:
    """Whether a value does not fit ``target`` whole."""
    if isinstance(target, (T.VarcharType, T.CharType)):
        return F.length(col.cast("string")) > target.length
    lost, altered = conversion_loss(col, dtype, target)
    return lost | altered


def fits(df: DataFrame, targets: Mapping[str, T.DataType]) -> DataFrame:
    """How many values of each column are too long or out of range."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return _long(df, {c: F.count_if(overflows(quoted(c), types[c], t)) for c, t in targets.items()}, "violations")


def check_table(df: DataFrame, meta: TableMeta, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every declared rule of a table with the number of its violations."""
    out = []
    spark = df.sparkSession

    def add(rule: str, name: str, counted: DataFrame) -> None:
        out.append(counted.select(F.lit(meta.name).alias("table"), F.lit(rule).alias("rule"), F.lit(name).alias("name"),
                                  F.col("n").cast("bigint").alias("violations")))

    required = [c.name for c in meta.columns if not c.nullable]
    simple = {("not null", c): F.count_if(quoted(c).isNull()) for c in required}
    simple |= {("check", n): F.count_if(~F.coalesce(F.expr(c).cast("boolean"), F.lit(True))) for n, c in meta.checks}
    simple |= {("enum", c.name): F.count_if(quoted(c.name).isNotNull() & ~quoted(c.name).isin(*c.enum))
               for c in meta.columns if c.enum}
    if simple:
        # All row-wise rules share one scan.
        one = df.agg(*[v.alias(f"c{i}") for i, v in enumerate(simple.values())])
        cells = F.array(*[F.struct(F.lit(meta.name).alias("table"), F.lit(r).alias("rule"), F.lit(n).alias("name"),
                                   F.col(f"c{i}").cast("bigint").alias("violations")) for i, (r, n) in enumerate(simple)])
        out.append(one.select(F.explode(cells).alias("r")).select("r.*"))
    if meta.primary_key:
        add("primary key", ",".join(meta.primary_key),
            unique(df, meta.primary_key, nulls_pass=False).agg(F.count(F.lit(1)).alias("n")))
    for cols in meta.unique:
        add("unique", ",".join(cols), unique(df, cols).agg(F.count(F.lit(1)).alias("n")))
    for fk in meta.foreign_keys:
        if parents and fk.parent in parents:
            add("foreign key", ",".join(fk.columns) + " -> " + fk.parent,
                foreign_key(df, fk.columns, parents[fk.parent], fk.parent_columns).agg(
                    F.coalesce(F.sum("rows"), F.lit(0)).alias("n")))
    if not out:
        return spark.createDataFrame([], "table string, rule string, name string, violations bigint")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
