import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from tabloom.functions import geometry
from tabloom.model import (ColumnMeta, ForeignKey, TableMeta, apply_case, choose_row_key, clip_ident, header_names, norm_name,
                           parents_first, relationships)
from tabloom.operators import joins as j, verify as v
from tabloom.plans import migration as mg, types as ty
from tabloom.model import Canon


def fk(parent):
    return ForeignKey(("x",), parent, ("id",))


def test_parents_first():
    child, tree, parent = (TableMeta("child", foreign_keys=(fk("parent"),)), TableMeta("tree", foreign_keys=(fk("tree"),)), TableMeta("parent"))
    assert [t.name for t in parents_first([child, tree, parent])] == ["parent", "child", "tree"]
    a, b = TableMeta("a", foreign_keys=(fk("b"),)), TableMeta("b", foreign_keys=(fk("a"),))
    assert [t.name for t in parents_first([a, b])] == ["b", "a"]
    assert relationships([child]) == [("child", ("x",), "parent", ("id",))]


def test_row_key_choice():
    cols = (ColumnMeta("a", "int", nullable=False), ColumnMeta("b", "text"), ColumnMeta("c", "int"))
    assert choose_row_key(TableMeta("t", cols, ("a",))).how == "primary"
    assert choose_row_key(TableMeta("t", cols, unique=(("c",), ("a",)))).columns == ("a",)
    assert choose_row_key(TableMeta("t", cols), has_row_id=True).how == "rowid"
    assert choose_row_key(TableMeta("t", cols)).columns == ("a", "c")
    assert choose_row_key(TableMeta("t", cols, is_view=True)) is None


def test_names():
    assert header_names(["a", " a ", "", None], 5) == ["a", "a (2)", "Column 3", "Column 4", "Column 5"]
    assert norm_name("Order Key_1") == "orderkey1" and apply_case("Ab", "upper") == "AB" and len(clip_ident("postgresql", "x" * 99)) == 63


@pytest.mark.parametrize("canon,want,lossy", [
    (Canon("bool"), "BOOLEAN", False), (Canon("int", 64, True), "DECIMAL(20,0)", False), (Canon("int", 8), "TINYINT", False),
    (Canon("int", 8, True), "SMALLINT", False), (Canon("int", 16), "SMALLINT", False), (Canon("int", 24), "INT", False),
    (Canon("int", 32, True), "BIGINT", False), (Canon("int", 64), "BIGINT", False), (Canon("decimal"), "DECIMAL(38,9)", True),
    (Canon("decimal", p=65, s=30), "DECIMAL(38,30)", True), (Canon("decimal", p=12, s=2), "DECIMAL(12,2)", False),
    (Canon("float", 32), "FLOAT", False), (Canon("float", 64), "DOUBLE", False), (Canon("uuid"), "STRING", False),
    (Canon("blob"), "BINARY", False), (Canon("date"), "DATE", False), (Canon("time"), "STRING", False),
    (Canon("datetime", frac=7), "TIMESTAMP_NTZ", True), (Canon("timestamptz", frac=6), "TIMESTAMP", False),
    (Canon("json"), "VARIANT", False), (Canon("array"), "VARIANT", False), (Canon("geometry"), "STRING", False),
])
def test_lake_types(canon, want, lossy):
    got = ty.lake_type(canon)
    assert (got.type, got.lossy) == (want, lossy)


def test_canon_names():
    assert ty.canon_of_name("decimal(12,2)") == Canon("decimal", p=12, s=2) and ty.canon_of_name("array<string>").t == "object"
    assert ty.canon_of_name("varchar(9)").n == 9 and ty.canon_of_name("widget").note


def test_digest_ignores_order_and_sees_swaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "n int, s string")
    swapped = spark.createDataFrame([(1, "y"), (2, "x")], "n int, s string")
    assert v.digest(a).first() == v.digest(b).first() == v.digest(swapped).first()
    assert v.verify(a, swapped).first().contents == "match"
    assert v.verify(a, swapped, row_hash=True).first()["columns"] == ["row"]
    assert v.verify(a, b, appended=True).first().contents == "skipped"


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, None), (2, "")], "n int, s string")
    b = spark.createDataFrame([(1, ""), (2, None)], "n int, s string")
    h = lambda df, **kw: v.fingerprint(df, **kw).first().hash
    assert h(a) == h(a.repartition(2)) != h(b) and h(a) != h(a.toDF("n", "t"))
    from tabloom import Sort

    assert h(a, order=[Sort("n")]) != h(a, order=[Sort("n", True)])


def test_migration_reports_and_policies(spark, tmp_path):
    meta = TableMeta("T", (ColumnMeta("id", "int"), ColumnMeta("twice", "int", generated="id*2")), ("id",))
    df = spark.range(5).select("id", (F.col("id") * 2).alias("twice"))
    root = str(tmp_path)
    run = lambda **kw: mg.Migration({"T": (df, meta)}, root, mg.Options(case="lower", **kw)).run().first()
    first = run()
    assert (first.status, first.rows, first.verdict) == ("done", 5, "match") and "computed" in " ".join(first.notes)
    assert mg.open_target(spark, root, "t").columns == ["id"]
    assert run().status == "failed"
    assert run(existing="replace").verdict == "match" and mg.open_target(spark, root, "t").count() == 5
    assert run(existing="keep").verdict == "skipped" and mg.open_target(spark, root, "t").count() == 10


def test_key_types_follow_parent(spark):
    parent = (spark.createDataFrame([(1,)], "id bigint"), TableMeta("p", (ColumnMeta("id", "int"),), ("id",)))
    child = (spark.createDataFrame([(1,)], "pid int"), TableMeta("c", (ColumnMeta("pid", "int"),), foreign_keys=(ForeignKey(("pid",), "p", ("id",)),)))
    plans = mg.plan({"c": child, "p": parent})
    assert [p.meta.name for p in plans] == ["p", "c"] and mg.target_schema(plans[1]) == {"pid": "bigint"}


def _close(a, b, radius):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(
        math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geometry.EARTH_RADIUS * math.asin(math.sqrt(min(1, h))) <= radius


@pytest.mark.parametrize("radius", [50_000.0, 400_000.0])
def test_radius_join_everywhere(spark, radius):
    """Against brute force, across the date line and near the poles."""
    rng = random.Random(3)
    near = lambda: rng.choice([(180 - rng.random(), rng.uniform(-70, 70)), (-180 + rng.random(), rng.uniform(-70, 70)),
                               (rng.uniform(-180, 180), rng.uniform(85, 90)), (rng.uniform(-3, 3), rng.uniform(-3, 3))])
    points = [(i, *near()) for i in range(200)]
    centers = [(i, *near()) for i in range(60)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    c = spark.createDataFrame(centers, "cid int, c_lon double, c_lat double")
    got = {(r.id, r.cid) for r in j.radius_join(p, c, radius).select("id", "cid").collect()}
    assert got == {(a[0], b[0]) for a in points for b in centers if _close(a[1:], b[1:], radius)} and got


def test_radius_join_on_the_plane(spark):
    """Against brute force, borders included; a pair's distance takes products, no calls of pow."""
    rng = random.Random(5)
    points = [(i, rng.randrange(-40, 40) / 8, rng.randrange(-40, 40) / 8) for i in range(300)] + [(300, None, 1.0), (301, 1.0, None)]
    centers = [(i, rng.randrange(-40, 40) / 8, rng.randrange(-40, 40) / 8) for i in range(50)] + [(50, None, None)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    c = spark.createDataFrame(centers, "cid int, c_lon double, c_lat double")
    pairs = j.radius_join(p, c, 0.625, metric="degrees")
    got = {(r.id, r.cid): r.distance for r in pairs.collect()}
    far = {(a[0], b[0]): math.hypot(a[1] - b[1], a[2] - b[2]) for a in points[:300] for b in centers[:50]}
    assert got == pytest.approx({k: d for k, d in far.items() if d <= 0.625}) and 0.625 in got.values()
    assert "POW" not in pairs._jdf.queryExecution().toString().upper()


def test_conversion_loss(spark):
    df = spark.createDataFrame([(3.0, 300, "12"), (3.5, 100, "x"), (1e12, 5, "1.5"), (None, None, None)], "d double, n int, s string")
    rows = {r.column: r for r in ty.fit_report(df, {"d": "int", "n": "tinyint", "s": "int"}).collect()}
    assert (rows["d"].unconvertible, rows["d"].changed) == (1, 1) and rows["n"].unconvertible == 1
    assert rows["s"].unconvertible >= 1
    dec = spark.createDataFrame([("1.50",), ("100.25",)], "s string").select(F.col("s").cast("decimal(10,2)").alias("x"))
    r = ty.fit_report(dec, {"x": T.DecimalType(4, 1)}).first()
    assert (r.unconvertible, r.changed) == (0, 1)
