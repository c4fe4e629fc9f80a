"""What a table is: columns, rows, bytes, files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.text import bytes_text, quoted, text_of
from tabloom.model import TableMeta


def describe(df: DataFrame, meta: TableMeta | None = None) -> DataFrame:
    """One row per column: position, name, type, kind, declared and seen
    nullability, key membership and NULL count, from one scan."""
    meta = meta or TableMeta.of(df)
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    cells = []
    for i, f in enumerate(fields):
        column = meta.column(f.name)
        cells.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(column.kind if column else "other").alias("kind"), F.lit(f.nullable).alias("nullable"),
            F.lit(f.name in meta.primary_key).alias("primary_key"), F.col("total").alias("rows"),
            (F.col("total") - F.col(f"c{i}")).alias("nulls")))
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


# What footers hold exact bounds of; bounds of text are cut short there.
BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of the data files below ``path``, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.startswith("_") & ~name.startswith(".")).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def footers(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """A table whose counts and bounds Spark takes from Parquet or ORC footers, read by the executors.

    That is what the second version of Spark's file sources does with an
    aggregate without a filter: no column is read and no row made.
    """
    listed = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in listed.split(",") if x.strip() != fmt))
    spark.conf.set(f"spark.sql.{fmt}.aggregatePushdown", "true")
    try:
        return spark.read.format(fmt).load(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", listed)


def footer_rows(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """One row: ``rows``, added up from the footers of all files."""
    return footers(spark, path, fmt).agg(F.count(F.lit(1)).alias("rows"))


def column_bounds(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row for each bounded column: its name, type, and least and greatest value as text, from footers."""
    table = footers(spark, path, fmt)
    fields = [f for f in table.schema.fields if isinstance(f.dataType, BOUNDED)]
    if not fields:
        return spark.createDataFrame([], "position int, column string, type string, low string, high string")
    one = table.agg(*[c for i, f in enumerate(fields) for c in (F.min(quoted(f.name)).alias(f"a{i}"), F.max(quoted(f.name)).alias(f"b{i}"))])
    # Footers keep a least zero as -0.
    plain = lambda c, t: (F.col(c) + F.lit(0).cast(t)).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else F.col(c)
    cells = [F.struct(F.lit(table.columns.index(f.name) + 1).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("type"), text_of(plain(f"a{i}", f.dataType), f.dataType).alias("low"),
                      text_of(plain(f"b{i}", f.dataType), f.dataType).alias("high")) for i, f in enumerate(fields)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def lake_facts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: data files, rows, bytes and the last change, from the listing and from footers."""
    listed = lake_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                                         F.max("modified").alias("last_change"))
    return listed.select("files", footer_rows(spark, path, fmt).scalar().alias("rows"), "bytes", "last_change")


def list_objects(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Tables with files, rows, bytes and the last change, largest first."""
    parts = [lake_facts(spark, path, fmt).select(F.lit(name).alias("name"), "*") for name, path in paths.items()]
    if not parts:
        return spark.createDataFrame([], "name string, files bigint, rows bigint, bytes bigint, last_change timestamp, size string")
    return reduce(DataFrame.unionByName, parts).withColumn("size", bytes_text(F.col("bytes"))).orderBy(F.col("bytes").desc(), "name")
