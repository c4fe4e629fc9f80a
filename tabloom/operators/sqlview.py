"""Read queries over registered tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F


class ReadOnlyError(ValueError):
    """The text is not one statement that reads."""


@dataclass(frozen=True)
class QueryResult:
    rows: DataFrame
    info: DataFrame  # one row: rows, truncated


def check_read_only(spark: SparkSession, text: str, name: str = "__read_only_check") -> None:
    """Refuse anything but one reading statement.

    Spark itself decides: only a query can be the body of a view.
    """
    body = text.strip().rstrip(";")
    if not body:
        raise ReadOnlyError("enter a query")
    try:
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS\n{body}")
    except ParseException as e:
        raise ReadOnlyError("only statements that read are allowed: " + str(e).strip().split("\n", 1)[0]) from e
    spark.catalog.dropTempView(name)


def register(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None, max_rows: int | None = None) -> QueryResult:
    """A read query: all its rows, or the first ``max_rows`` with a flag that tells when more exist."""
    register(views or {})
    check_read_only(spark, text)
    cap = max_rows if max_rows and max_rows > 0 else None
    df = spark.sql(text.strip().rstrip(";"))
    if cap is None:
        return QueryResult(df, df.agg(F.count(F.lit(1)).alias("rows")).withColumn("truncated", F.lit(False)))
    info = df.limit(cap + 1).agg(F.count(F.lit(1)).alias("n")).select(
        F.least("n", F.lit(cap)).cast("bigint").alias("rows"), (F.col("n") > cap).alias("truncated"))
    return QueryResult(df.limit(cap), info)


