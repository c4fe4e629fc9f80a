"""Shapes as text: WKT, EWKT and GeoJSON read with expressions.

A shape is held as array<array<array<array<double>>>>: polygons, rings,
points, ordinates.  Simpler shapes use the inner levels only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabloom.functions.text import let, trim_json_numbers

NESTED = "array<array<array<array<double>>>>"

# Shape names (WKT, GeoJSON), the prefix in canonical text, and
# how many of the four array levels the coordinates fill.
SHAPES = {
    "POINT": ("Point", "P", 1),
    "LINESTRING": ("LineString", "L", 2),
    "POLYGON": ("Polygon", "Y", 3),
    "MULTIPOINT": ("MultiPoint", "MP", 2),
    "MULTILINESTRING": ("MultiLineString", "ML", 3),
    "MULTIPOLYGON": ("MultiPolygon", "MY", 4),
}


_NAMES = {wkt: geo for wkt, (geo, _, _) in SHAPES.items()}
_DEPTHS = {geo: depth for geo, _, depth in SHAPES.values()}
_PREFIXES = {geo: short for geo, short, _ in SHAPES.values()}


def _pick(table: dict, key: Column) -> Column:
    """A value by key from a small fixed table, NULL for other keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def shape_name(text: Column) -> Column:
    """The GeoJSON type name, NULL for anything else."""
    word = F.when(_is_json(text), F.get_json_object(text, "$.type")).otherwise(
        F.regexp_extract(text, r"^\s*(?i:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    return _pick(_NAMES, F.upper(word))


def _is_json(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def srid(text: Column) -> Column:
    """The SRID of EWKT text, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"(?i)^\s*SRID=(\d+);", 1).try_cast("int"), F.lit(0))


def _wkt_brackets(text: Column, name: Column) -> Column:
    """WKT coordinates as JSON arrays, one level per pair of parentheses."""
    body = F.regexp_replace(F.trim(F.regexp_extract(text, r"(?s)^[^(]*(\(.*\))\s*$", 1)), r"\s*([(),])\s*", "$1")
    body = let(body, lambda b: F.when(name == "MultiPoint", F.concat(
        F.lit("("), F.regexp_replace(b, r"[()]", ""), F.lit(")"))).otherwise(b))
    json = F.translate(F.regexp_replace(F.regexp_replace(body, r"([^(),]+)", "[$1]"), r"\s+", ","), "()", "[]")
    # "(1 2)" became "[[1,2]]", which for a point is one level too many.
    return let(json, lambda j: F.when(name == "Point", F.substring(j, F.lit(2), F.length(j) - 2)).otherwise(j))


def read_shape(text: Column) -> Column:
    """struct(name, nested): the type name and the nested coordinates, which
    are NULL for text that is no plain shape."""
    def coordinates(name: Column) -> Column:
        coords = F.when(_is_json(text), F.get_json_object(text, "$.coordinates")).otherwise(_wkt_brackets(text, name))
        wraps = 4 - _pick(_DEPTHS, name)
        wrapped = F.concat(F.repeat(F.lit("["), wraps), coords, F.repeat(F.lit("]"), wraps))
        parsed = let(wrapped, lambda w: F.from_json(F.when(F.try_parse_json(w).isNotNull(), w), NESTED))
        whole = let(parsed, lambda n: F.when(
            ~F.exists(vertices(n), lambda p: F.coalesce(F.size(p) < 2, F.lit(True))), n))
        return F.struct(name.alias("name"), whole.alias("nested"))

    return let(shape_name(text), coordinates)


def parse_shape(text: Column) -> Column:
    """Nested coordinates, NULL for text that is no plain shape."""
    return read_shape(text)["nested"]


def vertices(nested: Column) -> Column:
    return F.flatten(F.flatten(nested))


def _signed_area(ring: Column) -> Column:
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
                       F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(1))),
                       lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def orient(nested: Column) -> Column:
    """Outer rings counter-clockwise, inner rings clockwise."""
    def turn(ring: Column, i: Column) -> Column:
        area = _signed_area(ring)
        wrong = ((i == 0) & (area < 0)) | ((i > 0) & (area > 0))
        return F.when(wrong, F.reverse(ring)).otherwise(ring)

    return F.transform(nested, lambda polygon: F.transform(polygon, turn))


def _ordinate(x: Column) -> Column:
    return F.regexp_replace((F.round(x, 7) + 0.0).cast("string"), r"\.0$", "")


def geo_canon(text: Column) -> Column:
    """One text per shape, however it was written: coordinates rounded to
    seven decimals, rings in one orientation.  Collections stay as text."""
    def ring_text(ring: Column) -> Column:
        return F.array_join(F.transform(ring, lambda p: F.array_join(F.transform(p, _ordinate), " ")), ",")

    def write(shape: Column) -> Column:
        name, nested = shape["name"], shape["nested"]
        areal = name.isin("Polygon", "MultiPolygon")
        turned = F.when(areal, orient(nested)).otherwise(nested)
        parts = F.transform(turned, lambda polygon: F.array_join(F.transform(polygon, ring_text), "|"))
        inner = F.when(name == "MultiPolygon", F.transform(parts, lambda p: F.concat(F.lit("Y("), p, F.lit(")")))).otherwise(parts)
        shown = F.concat(_pick(_PREFIXES, name), F.lit("("), F.array_join(inner, ";"), F.lit(")"))
        return F.when(nested.isNull(), F.trim(text)).otherwise(shown)

    return let(read_shape(text), write)


def geojson_of(shape: Column, text: Column) -> Column:
    """GeoJSON text of a shape already read by ``read_shape``."""
    name, nested = shape["name"], shape["nested"]
    coords = (
        F.when(name == "Point", F.to_json(nested[0][0][0]))
        .when(name.isin("LineString", "MultiPoint"), F.to_json(nested[0][0]))
        .when(name.isin("Polygon", "MultiLineString"), F.to_json(nested[0]))
        .otherwise(F.to_json(nested))
    )
    written = F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), trim_json_numbers(coords), F.lit("}"))
    return F.when(_is_json(text) & nested.isNotNull(), F.trim(text)).otherwise(written)


def geojson(text: Column) -> Column:
    """The shape as GeoJSON text, NULL when it cannot be read."""
    return let(read_shape(text), lambda shape: geojson_of(shape, text))


def bounds(nested: Column) -> Column:
    """The bounding box of a shape as struct(min_x, min_y, max_x, max_y)."""
    xs = F.transform(vertices(nested), lambda p: p[0])
    ys = F.transform(vertices(nested), lambda p: p[1])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                    F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


# Fixed value: the mean radius of the Earth in metres.
EARTH_RADIUS = 6371008.8
