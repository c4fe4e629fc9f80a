"""Shapes, extents, distances."""

from pyspark.sql import functions as F

from tabloom.functions import geometry
from tabloom.operators import geo, joins as j
from tabloom.workloads.registry import query

_LON = "4.8 + ({k} % 180) / 1000.0::DOUBLE + (({k} // 9000) % 300) * 0.3::DOUBLE"
_LAT = "-60 + ({k} % 100) / 1000.0::DOUBLE + ((({k} // 9000) // 300) % 500) * 0.2::DOUBLE"


def points(df, key):
    """A point per row; every 9,000 keys fill a small town of their own, so density does not grow with the table."""
    k = F.col(key)
    town = F.floor(k / 9000)
    return df.select(k.alias("id"), (F.lit(4.8) + (k % 180) / F.lit(1000.0) + (town % 300) * F.lit(0.3)).alias("lon"),
                     (F.lit(-60) + (k % 100) / F.lit(1000.0) + (F.floor(town / 300) % 500) * F.lit(0.2)).alias("lat"))


def sql_points(table, key):
    return f"(SELECT {key} AS id, {_LON.format(k=key)} AS lon, {_LAT.format(k=key)} AS lat FROM {table})"


@query("extent_of_points", f"SELECT min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y FROM {sql_points('orders', 'o_orderkey')}")
def extent_of_points(t):
    return geo.extent(points(t.orders, "o_orderkey"), "lon", "lat")


def _wkt(t):
    """Squares around suppliers as EWKT, and points of customers as GeoJSON."""
    k = F.col("s_suppkey")
    square = F.format_string("SRID=4326;POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", k, k, k, k + 2, k + 2, k + 2, k + 2, k, k, k)
    dots = F.format_string('{"type":"Point","coordinates":[%d,%d]}', F.col("c_custkey"), F.col("c_custkey") + 1)
    return t.supplier.select(k.alias("id"), square.alias("shape")).unionByName(
        t.customer.select((F.col("c_custkey") + 1000000).alias("id"), dots.alias("shape")))


@query("shape_columns", """SELECT s_suppkey AS id, 4326 AS srid, 5 AS points, s_suppkey::DOUBLE AS min_x, s_suppkey::DOUBLE AS min_y, s_suppkey + 2.0::DOUBLE AS max_x,
  s_suppkey + 2.0::DOUBLE AS max_y, printf('{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}', s_suppkey, s_suppkey, s_suppkey, s_suppkey + 2,
  s_suppkey + 2, s_suppkey + 2, s_suppkey + 2, s_suppkey, s_suppkey, s_suppkey) AS geojson FROM supplier UNION ALL
  SELECT c_custkey + 1000000, 0, 1, c_custkey, c_custkey + 1, c_custkey, c_custkey + 1, printf('{"type":"Point","coordinates":[%d,%d]}', c_custkey, c_custkey + 1) FROM customer""")
def shape_columns(t):
    return geo.shapes(_wkt(t), "shape").select("id", "srid", "points", "min_x", "min_y", "max_x", "max_y", "geojson")


@query("shape_extents", """SELECT s_suppkey AS id, 'extent' AS display, printf('{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}', s_suppkey, s_suppkey,
  s_suppkey + 2, s_suppkey, s_suppkey + 2, s_suppkey + 2, s_suppkey, s_suppkey + 2, s_suppkey, s_suppkey) AS geojson FROM supplier""")
def shape_extents(t):
    return geo.shapes(_wkt(t), "shape", max_points=4).where(F.col("display").isNotNull()).select("id", "display", "geojson")


@query("canon_shapes", """SELECT s_suppkey AS id, printf('Y(%d %d,%d %d,%d %d,%d %d,%d %d)', s_suppkey, s_suppkey, s_suppkey + 2, s_suppkey, s_suppkey + 2, s_suppkey + 2,
  s_suppkey, s_suppkey + 2, s_suppkey, s_suppkey) AS canon FROM supplier UNION ALL SELECT c_custkey + 1000000, printf('P(%d %d)', c_custkey, c_custkey + 1) FROM customer""")
def canon_shapes(t):
    return _wkt(t).select("id", geometry.geo_canon(F.col("shape")).alias("canon"))


@query("map_features", """SELECT c_custkey AS id, printf('{"type":"Feature","id":%d,"properties":{"row":%d},"geometry":{"type":"Point","coordinates":[%d,%d]}}',
  c_custkey, c_custkey, c_custkey, c_custkey + 1) AS feature FROM customer""")
def map_features(t):
    k = F.col("c_custkey")
    return geo.features(t.customer.select(k.alias("id"), F.format_string("POINT (%d %d)", k, k + 1).alias("shape")), "shape", "id")


_SUPPLIERS, _CUSTOMERS = sql_points("supplier", "s_suppkey"), sql_points("customer", "(c_custkey * 7)")


@query("radius_join_degrees", f"""SELECT p.id, c.id AS center FROM {sql_points("customer", "c_custkey")} p JOIN {_SUPPLIERS} c
  ON sqrt(pow(p.lon - c.lon, 2) + pow(p.lat - c.lat, 2)) <= 0.0025""")
def radius_join_degrees(t):
    centers = points(t.supplier, "s_suppkey").toDF("center", "c_lon", "c_lat")
    return j.radius_join(points(t.customer, "c_custkey"), centers, 0.0025, metric="degrees").select("id", "center")


_HAVERSINE = ("2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
              " * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))")


@query("radius_join_meters", f"""SELECT p.id, c.id AS center, round({_HAVERSINE.format(a="p", b="c")}, 2) AS meters
  FROM {sql_points("customer", "c_custkey")} p JOIN {_SUPPLIERS} c ON {_HAVERSINE.format(a="p", b="c")} <= 250""")
def radius_join_meters(t):
    centers = points(t.supplier, "s_suppkey").toDF("center", "c_lon", "c_lat")
    return j.radius_join(points(t.customer, "c_custkey"), centers, 250.0).select(
        "id", "center", F.round("distance", 2).alias("meters"))


_STREET = """(SELECT o_orderkey AS id, 4.9::DOUBLE + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 180) / 1000.0::DOUBLE END AS lon,
  CASE WHEN o_orderkey % 3 = 0 THEN 52.3::DOUBLE + (o_orderkey % 1000) / 1000000.0::DOUBLE ELSE -60 + (o_orderkey % 9973) / 100.0::DOUBLE END AS lat FROM orders)"""


@query("radius_join_street", f"""SELECT c.center, count(*) AS points, CAST(sum(p.id) AS BIGINT) AS ids FROM {_STREET} p JOIN
  (SELECT s_suppkey AS center, 4.9::DOUBLE AS lon, 52.3::DOUBLE + (s_suppkey % 100) / 100000.0::DOUBLE + 0.0000005::DOUBLE AS lat FROM supplier) c
  ON abs(p.lat - c.lat) <= 0.000051 AND sqrt(pow(p.lon - c.lon, 2) + pow(p.lat - c.lat, 2)) <= 0.00005 GROUP BY 1""")
def radius_join_street(t):
    """A third of all points stands on one street, so few cells hold them; a center takes its points box by box, already added up."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    street = k % 3 == 0
    spots = t.orders.select(k.alias("id"), (F.lit(4.9) + F.when(street, 0).otherwise((k % 180) / F.lit(1000.0))).alias("lon"),
                            F.when(street, F.lit(52.3) + (k % 1000) / F.lit(1000000.0)).otherwise(F.lit(-60) + (k % 9973) / F.lit(100.0)).alias("lat"))
    centers = t.supplier.select(s.alias("center"), F.lit(4.9).alias("c_lon"), (F.lit(52.3) + (s % 100) / F.lit(100000.0) + F.lit(0.0000005)).alias("c_lat"))
    sums = {"points": F.lit(1), "ids": F.col("id")}
    return j.radius_join(spots, centers, 0.00005, metric="degrees", dense=500, sums=sums).groupBy("center").agg(
        F.sum("points").alias("points"), F.sum("ids").alias("ids"))


@query("nearest_points", f"""SELECT p.id, round({_HAVERSINE.format(a="p", b="c")}, 2) AS meters FROM {sql_points("orders", "o_orderkey")} p,
  (SELECT 4.9::DOUBLE AS lon, -59.95::DOUBLE AS lat) c ORDER BY round({_HAVERSINE.format(a="p", b="c")}, 6), p.id LIMIT 25""")
def nearest_points(t):
    found = j.nearest(points(t.orders, "o_orderkey"), 4.9, -59.95, 25, ties=["id"])
    return found.select("id", F.round("distance", 2).alias("meters"))


