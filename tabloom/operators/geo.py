"""Shape columns: GeoJSON, extents and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions import geometry
from tabloom.functions.text import quoted, trim_json_numbers


def shapes(df: DataFrame, column: str, max_points: int | None = None) -> DataFrame:
    """Add GeoJSON, SRID, vertex count and bounding box for WKT, EWKT or GeoJSON text.

    With ``max_points``, a shape with more vertices is shown by its extent.
    """
    col = quoted(column)
    parsed = df.withColumn("__shape", geometry.read_shape(col)).withColumn(
        "__box", geometry.bounds(F.col("__shape.nested")))
    box, nested = F.col("__box"), F.col("__shape.nested")
    corners = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y")]
    extent_text = F.concat(
        F.lit('{"type":"Polygon","coordinates":['),
        trim_json_numbers(F.to_json(F.array(*[F.array(box[x], box[y]) for x, y in corners]))), F.lit("]}"))
    points = F.size(geometry.vertices(nested))
    readable = nested.isNotNull()
    large = readable & (points > max_points) if max_points is not None else F.lit(False)
    return parsed.select(
        *[quoted(c) for c in df.columns], geometry.srid(col).alias("srid"), F.when(readable, points).alias("points"),
        F.when(large, "extent").alias("display"),
        F.when(large, extent_text).otherwise(
            geometry.geojson_of(F.col("__shape"), col)).alias("geojson"),
        *[F.when(readable, box[n]).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])


def extent(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """The bounding box of point columns."""
    return df.agg(F.min(quoted(lon)).alias("min_x"), F.min(quoted(lat)).alias("min_y"),
                  F.max(quoted(lon)).alias("max_x"), F.max(quoted(lat)).alias("max_y"))


def features(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """One GeoJSON feature per readable shape, as text lines."""
    shape = geometry.geojson(quoted(column))
    rid = quoted(row_id)
    key = F.regexp_extract(F.to_json(F.struct(rid.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return df.where(shape.isNotNull()).select(rid.alias("id"), F.concat(
        F.lit('{"type":"Feature","id":'), key, F.lit(',"properties":{"row":'), key, F.lit('},"geometry":'),
        shape, F.lit("}")).alias("feature"))
