"""Relational tables over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_relational(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower: int | str | None = None,
                    upper: int | str | None = None, partitions: int = 16, predicates: Sequence[str] | None = None,
                    driver: str | None = None, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A relational table, read in ranges of ``column`` or by predicates.

    Without either the server sends the table as one stream, which suits
    small tables only.  Filters and columns are pushed to the server.
    """
    props = {"fetchsize": str(fetch_size), **options}
    if driver:
        props["driver"] = driver
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=props)
    if column is not None:
        if lower is None or upper is None:
            bounds = spark.read.jdbc(url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b", properties=props).first()
            lower, upper = bounds[0], bounds[1]
        if lower is not None:
            return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                                   numPartitions=partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def write_relational(df: DataFrame, url: str, table: str, mode: str = "append", *, driver: str | None = None,
                     batch_rows: int = 500, **options: str) -> None:
    """Insert rows in batches; a failed partition leaves the others' rows."""
    props = {"batchsize": str(batch_rows), **options}
    if driver:
        props["driver"] = driver
    df.write.jdbc(url, table, mode=mode, properties=props)
