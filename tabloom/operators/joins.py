"""Joins the workbench needs: lookups, orphans, summaries and distances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.geometry import EARTH_RADIUS, haversine
from tabloom.functions.text import quoted
from tabloom.session import materialize

# Points of a grid cell that stay together, and rows that a fuller cell is cut into at most.
DENSE_CELL = 20_000
MOST_ROWS = 64
# For sums: places of a box that are measured one by one, how often a cell is cut, and by what share of the radius a box must clear the circle.
EDGE_PLACES = 32
DEEPEST = 15
CLEAR = 1e-7


def lookup(df: DataFrame, dim: DataFrame, on: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """Add columns of a dictionary by key; unknown keys give NULL.

    A dictionary has one row per key.  Spark broadcasts it when its bytes are
    few enough, and joins by shuffle otherwise.
    """
    keys = {f"__k{i}": v for i, v in enumerate(on.values())}
    right = dim.select(*[quoted(v).alias(k) for k, v in keys.items()], *[quoted(c) for c in columns])
    tests = [quoted(a) == F.col(k) for a, k in zip(on, keys)]
    return df.join(right, tests, "left").drop(*keys)


def join_summary(parents: DataFrame, key: str, children: DataFrame, child_key: str, aggs: Mapping[str, Column],
                 condition: Column | None = None, how: str = "left") -> DataFrame:
    """Parents with aggregates of their children.

    Children are filtered and aggregated by key first: a parent with a third
    of all children costs one row in the join.
    """
    kept = children if condition is None else children.where(condition)
    sums = kept.groupBy(quoted(child_key).alias("__key")).agg(*[c.alias(n) for n, c in aggs.items()])
    return parents.join(sums, quoted(key) == F.col("__key"), how).drop("__key")


def orphan_keys(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Referenced keys that no parent has, with the number of rows; NULL keys pass.

    The child's keys are counted before the join, so a hot key is one row.
    """
    names = [f"__p{i}" for i in range(len(columns))]
    present = child.where(reduce(and_, [quoted(c).isNotNull() for c in columns]))
    keys = present.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows"))
    right = parent.select(*[quoted(p).alias(n) for p, n in zip(parent_columns, names)])
    tests = [quoted(c) == F.col(n) for c, n in zip(columns, names)]
    return keys.join(right, tests, "left_anti")


def orphan_rows(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """The child rows themselves whose parent is missing."""
    names = [f"__p{i}" for i in range(len(columns))]
    right = parent.select(*[quoted(p).alias(n) for p, n in zip(parent_columns, names)]).distinct()
    present = child.where(reduce(and_, [quoted(c).isNotNull() for c in columns]))
    return present.join(right, [quoted(c) == F.col(n) for c, n in zip(columns, names)], "left_anti")


def update_from(df: DataFrame, key: Sequence[str], source: DataFrame, source_key: Sequence[str],
                assignments: Mapping[str, Column]) -> DataFrame:
    """UPDATE … FROM a join: matched rows get new values, others stay.

    ``source`` must have one row per key; ``assignments`` may use its columns
    as ``src_<name>``.
    """
    names = [f"__s{i}" for i in range(len(key))]
    right = source.select(*[quoted(s).alias(n) for s, n in zip(source_key, names)],
                          *[quoted(c).alias(f"src_{c}") for c in source.columns if c not in source_key],
                          F.lit(True).alias("__hit"))
    joined = df.join(right, [quoted(k) == F.col(n) for k, n in zip(key, names)], "left")
    return joined.select(*[
        F.when(F.col("__hit"), assignments[f.name].cast(f.dataType)).otherwise(quoted(f.name)).alias(f.name)
        if f.name in assignments else quoted(f.name) for f in df.schema.fields])


def radius_join(points: DataFrame, centers: DataFrame, radius: float, *, lon: str = "lon", lat: str = "lat",
                c_lon: str = "c_lon", c_lat: str = "c_lat", metric: str = "meters", dense: int = DENSE_CELL,
                sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Pairs of points and centers within ``radius``, with their ``distance``.

    ``meters`` measures great circles, ``degrees`` measures on the plane.
    Both sides get a grid cell no smaller than the radius; a center looks
    into its own and the neighbouring cells, so the join is by equality.

    A cell with more than ``dense`` points is cut into parts, as many on each
    side as bring them below that if its points are spread; a part takes its
    own points, and a center looks only into the parts that its circle
    reaches.  Points on one spot are dealt over parts of the same place, so no
    part holds more.

    With ``sums``, numbers of a point to add up by name, points that lie in one
    box all within a circle meet its center at once: a row is a center's
    columns and the sums of some of its points, and the caller adds up a
    center's rows.  So work grows with the boxes on a circle's edge, not with
    the pairs.  A box with more than ``dense`` places is cut then, or with
    more than ``EDGE_PLACES``.
    """
    if metric == "degrees":
        height = radius
        bands_of = F.floor(quoted(c_lat) / height)
        width = lambda band: F.lit(float(radius))
        distance = lambda x, y: F.sqrt(_squared(x - quoted(c_lon)) + _squared(y - quoted(c_lat)))
        shifts = [0.0]
    elif metric == "meters":
        # A little more than the radius, so rounding cannot lose a border.
        half = radius / (2 * EARTH_RADIUS)
        height = max(2 * half * 180 / 3.141592653589793 * 1.000001, 1e-9)
        bands_of = F.floor(quoted(c_lat) / height)

        def width(band: Column) -> Column:
            edge = F.least((F.greatest(F.abs(band), F.abs(band + 1)) + 1) * height, F.lit(89.999999))
            reach = F.least(F.sin(F.lit(half)) / F.cos(F.radians(edge)), F.lit(1.0))
            return F.degrees(2 * F.asin(reach)) * 1.000001

        distance = lambda x, y: haversine(x, y, quoted(c_lon), quoted(c_lat))
        shifts = [-360.0, 0.0, 360.0]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    gridded = points.withColumn("__band", F.floor(quoted(lat) / height)).withColumn(
        "__cell", F.floor(quoted(lon) / width(F.col("__band"))))
    looked = centers.withColumn("__cband", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bands_of + d)))
    step = width(F.col("__cband"))
    cells = F.flatten(F.array(*[
        F.sequence(F.floor((quoted(c_lon) + s - step) / step), F.floor((quoted(c_lon) + s + step) / step)) for s in shifts]))
    low, high = F.floor(F.lit(-180.0) / step), F.floor(F.lit(180.0) / step)
    if metric == "meters":
        cells = F.filter(cells, lambda c: (c >= low) & (c <= high))
    looked = looked.withColumn("__ccell", F.explode(F.array_distinct(cells)))
    if sums is not None:
        # Where a point stands in its cell, from 0 to 1 across and up.
        across, up = quoted(lon) / width(F.col("__band")) - F.col("__cell"), quoted(lat) / height - F.col("__band")
        return _sums_within(gridded, looked, radius, sums, distance, metric, min(dense, EDGE_PLACES), quoted(lon), quoted(lat), across, up).select(
            *[quoted(c) for c in centers.columns], *[quoted(n) for n in sums])
    gridded, looked = _cut_dense(gridded, looked, dense, height, width, radius if metric == "degrees" else height, quoted(lon), quoted(lat),
                                 quoted(c_lat))
    same = [(F.col(a) == F.col(b)) for a, b in (("__band", "__cband"), ("__cell", "__ccell"), ("__row", "__crow"), ("__part", "__cpart"))]
    pairs = gridded.join(looked, same)
    return pairs.withColumn("distance", distance(quoted(lon), quoted(lat))).where(F.col("distance") <= radius).drop(
        "__band", "__cell", "__row", "__part", "__cband", "__ccell", "__crow", "__cpart")


def _squared(x: Column) -> Column:
    """A product, as ``pow`` costs many times that for each pair."""
    return x * x


def _sums_within(points: DataFrame, centers: DataFrame, radius: float, sums: Mapping[str, Column], distance, metric: str, most: int,
                 lon: Column, lat: Column, across: Column, up: Column) -> DataFrame:
    """Centers with sums of the points within ``radius``, in several rows for a center; see ``radius_join``.

    Points of one place are added up first.  A cell is cut into 16 boxes, with
    the bounds and sums of their places.  A box wholly within a circle gives
    its sums, one wholly outside gives nothing; of one on the edge the places
    are measured if they are at most ``most``, and its 16 parts are looked at
    otherwise.  Only boxes on some circle's edge are cut further.
    """
    total = {f"__s{i}": v for i, v in enumerate(sums.values())}
    box = ("__band", "__cell", "__x", "__y")
    seen = tuple(f"__c{b[2:]}" for b in box)
    own = [c for c in centers.columns if c not in seen]
    done = [quoted(c) for c in own] + [F.col(s).alias(n) for s, n in zip(total, sums)]
    looked = materialize(centers.select(F.col("__cband").alias("__b"), F.col("__ccell").alias("__c")).distinct(), "looked-cells")
    # A place that is not a number is within no radius, and would hide the bounds of its box.
    finite = (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf"))
    near = points.where(finite).join(looked, (F.col("__band") == F.col("__b")) & (F.col("__cell") == F.col("__c")), "left_semi")
    parts = 4 ** DEEPEST
    step = lambda share: F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts))).cast("long")
    # Equal places have equal steps; max gives one of them.
    places = materialize(near.groupBy("__band", "__cell", lon.alias("__lon"), lat.alias("__lat")).agg(
        F.max(step(across)).alias("__x"), F.max(step(up)).alias("__y"), *[F.sum(v).alias(s) for s, v in total.items()]), "places")
    types = {s: places.schema[s].dataType for s in total}
    lon, lat = F.col("__lon"), F.col("__lat")
    middle = [(F.col(f"__low_{a}") + F.col(f"__high_{a}")) / 2 for a in ("lon", "lat")]
    half = [F.greatest(F.col(f"__high_{a}") - m, m - F.col(f"__low_{a}")) for a, m in zip(("lon", "lat"), middle)]
    if metric == "degrees":
        size, clear = F.sqrt(_squared(half[0]) + _squared(half[1])), radius * CLEAR
    else:
        # Along a meridian, and then along a parallel, the longest of which is the nearest to the equator.
        low, high = F.col("__low_lat"), F.col("__high_lat")
        beyond = F.greatest(F.abs(low), F.abs(high)) > 90
        nearest_lat = F.when(beyond | ((low <= 0) & (high >= 0)), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
        size, clear = EARTH_RADIUS * (F.radians(half[1]) + F.radians(half[0]) * F.cos(F.radians(nearest_lat))), radius * CLEAR + 1e-6
    found, looking, rest = [], centers.withColumns({"__cx": F.lit(0).cast("long"), "__cy": F.lit(0).cast("long")}), places
    for level in range(1, DEEPEST + 1):
        shift = 2 * (DEEPEST - level)
        at = [F.col("__band"), F.col("__cell"), F.shiftright("__x", shift), F.shiftright("__y", shift)]
        boxes = materialize(rest.groupBy(*[a.alias(b) for a, b in zip(at, box)]).agg(
            F.count(F.lit(1)).alias("__n"), F.min(lon).alias("__low_lon"), F.max(lon).alias("__high_lon"), F.min(lat).alias("__low_lat"),
            F.max(lat).alias("__high_lat"), *[F.try_sum(s).try_cast(t).alias(s) for s, t in types.items()]), "boxes")
        parent = [F.col("__band"), F.col("__cell"), F.shiftright("__x", 2), F.shiftright("__y", 2)]
        met = looking.join(boxes, [p == F.col(c) for p, c in zip(parent, seen)]).withColumns({"__far": distance(*middle), "__size": size})
        # A sum that is NULL may be too large for its type, and no circle need hold all of it: that box is cut.
        whole = reduce(and_, [F.col(s).isNotNull() for s in total], F.col("__far") + F.col("__size") <= radius - clear)
        met = materialize(met.where(F.col("__far") - F.col("__size") <= radius + clear).select(
            *[quoted(c) for c in own], *[F.col(b).alias(c) for b, c in zip(box, seen)], "__n", *total, whole.alias("__whole")), "met")
        found.append(met.where("__whole").select(*done))
        edge = met.where(~F.col("__whole")).drop(*total)
        last = level == DEEPEST
        here = [a == F.col(c) for a, c in zip(at, seen)]
        found.append((edge if last else edge.where(F.col("__n") <= most)).join(rest, here).where(distance(lon, lat) <= radius).select(*done))
        if last:
            break
        looking = edge.where(F.col("__n") > most).select(*[quoted(c) for c in own], *seen)
        cut = materialize(looking.select(*seen).distinct(), "boxes-cut")
        if cut.isEmpty():
            break
        rest = places.join(cut, here, "left_semi")
    return reduce(DataFrame.unionByName, found)


def _cut_dense(points: DataFrame, centers: DataFrame, dense: int, height: float, width, reach: float, lon: Column, lat: Column,
               c_lat: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with the row and part of a cell: 0 and 0, but for cells with more than ``dense`` points.

    A dense cell has rows of equal height; points that share a row are dealt
    over its parts by a hash, so a row on which all points stand is cut too.
    Only dense cells have an entry, which is few rows.
    """
    rows = F.least(F.ceil(F.sqrt(F.col("n") / dense)), F.lit(MOST_ROWS)).cast("int")
    counts = points.groupBy("__band", "__cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    by_row = F.greatest(F.lit(0), F.least(F.col("__rows") - 1, F.floor((lat - F.col("__band") * height) / height * F.col("__rows")))).cast("int")
    cells = materialize(counts.select(F.col("__band").alias("__b"), F.col("__cell").alias("__c"), rows.alias("__rows")), "dense-cells")
    if cells.isEmpty():
        return (points.withColumns({"__row": F.lit(0), "__part": F.lit(0)}), centers.withColumns({"__crow": F.lit(0), "__cpart": F.lit(0)}))
    at = (F.col("__band") == F.col("__b")) & (F.col("__cell") == F.col("__c"))
    placed = points.join(cells, at, "left").withColumn("__row", F.when(F.col("__rows").isNotNull(), by_row).otherwise(0)).drop("__b", "__c")
    full = placed.where(F.col("__rows").isNotNull()).groupBy("__band", "__cell", "__row", "__rows").agg(F.count(F.lit(1)).alias("n"))
    # Parts of each row of the dense cells.
    parts = materialize(full.select(F.col("__band").alias("__b"), F.col("__cell").alias("__c"), F.col("__row").alias("__r"), F.col("__rows").alias("__k"),
                                    F.ceil(F.col("n") / dense).cast("int").alias("__parts")), "dense-parts")
    here = (F.col("__band") == F.col("__b")) & (F.col("__cell") == F.col("__c")) & (F.col("__row") == F.col("__r"))
    salt = F.pmod(F.xxhash64(lon, lat, F.monotonically_increasing_id()), F.coalesce("__parts", F.lit(1))).cast("int")
    placed = placed.drop("__rows").join(parts.drop("__k"), here, "left").withColumn("__part", salt).drop("__b", "__c", "__r", "__parts")
    looks = (F.col("__cband") == F.col("__b")) & (F.col("__ccell") == F.col("__c"))
    step = F.lit(height) / F.col("__k")
    low = F.col("__cband") * height + F.col("__r") * step
    # A row is in reach if its nearest edge is; a little more, as places were rounded.
    slack = step * 1e-6
    near = (c_lat + reach + slack >= low) & (c_lat - reach - slack <= low + step)
    inside = centers.join(parts, looks).where(near).withColumn("__cpart", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    inside = inside.withColumn("__crow", F.col("__r")).drop("__b", "__c", "__r", "__k", "__parts")
    others = centers.join(parts.select("__b", "__c").distinct(), looks, "left_anti").withColumns({"__cpart": F.lit(0), "__crow": F.lit(0)})
    return placed, others.unionByName(inside)


def nearest(points: DataFrame, at_lon: float, at_lat: float, k: int, *, lon: str = "lon", lat: str = "lat",
            ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` points nearest to one place: top-k by distance, no full sort."""
    far = haversine(quoted(lon), quoted(lat), F.lit(float(at_lon)), F.lit(float(at_lat)))
    return points.withColumn("distance", far).orderBy(F.col("distance"), *[quoted(t) for t in ties]).limit(k)
