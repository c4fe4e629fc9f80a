import os

import pytest
from pyspark.sql import functions as F, types as T

from tabloom.operators import edits as e


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (4, None, 4.0)], "id long, name string, price double")


def up(key, **values):
    return {"op": "update", "key": {"id": key}, "values": values}


def run(table, changes, tmp_path, key=("id",), **kw):
    frame = e.cast_inputs(table, changes, list(key), kw.pop("defaults", None))
    return e.apply_edits(table, frame, list(key), str(tmp_path / "out"), **kw)


def test_applies_all_kinds(table, tmp_path):
    out = run(table, [up(1, name="A", price={"$null": True}), {"op": "delete", "key": {"id": 2}},
                      {"op": "insert", "values": {"id": 9, "name": {"$expr": "upper('new')"}}}, up(3, price={"$default": True})],
              tmp_path, defaults={"price": "7.5"})
    assert out.applied == 4
    assert sorted((tuple(r) for r in out.table.collect()), key=str) == [
        (1, "A", None), (3, "c", 7.5), (4, None, 4.0), (9, "NEW", None)]


@pytest.mark.parametrize("changes,message", [
    ([up(1, name="x"), up(77, name="y")], "change 2: no row has this key any more"),
    ([{"op": "insert", "values": {"id": 1}}], "change 1: its key is taken"),
    ([{"op": "insert", "values": {"id": 8}}, {"op": "insert", "values": {"id": 8}}], "change 2: its key is taken"),
    ([{"op": "delete", "key": {"id": 2}}, up(2, name="x")], "change 2: no row has this key any more"),
    ([{"op": "upsert", "key": {"id": 2}}], "is no change"),
])
def test_nothing_is_saved_on_error(table, tmp_path, changes, message):
    with pytest.raises(e.EditError, match=message):
        run(table, changes, tmp_path)
    assert not os.path.exists(tmp_path / "out")


def test_more_than_one_row(spark, tmp_path):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string")
    with pytest.raises(e.EditError, match="hits 2 rows instead of one"):
        run(twice, [up(1, name="x")], tmp_path)


def test_last_update_wins_and_key_is_freed(table, tmp_path):
    out = run(table, [up(1, name="x", price=5.0), up(1, name="y"), {"op": "delete", "key": {"id": 2}},
                      {"op": "insert", "values": {"id": 2, "name": "again"}}], tmp_path)
    rows = {r.id: r for r in out.table.collect()}
    assert (rows[1].name, rows[1].price) == ("y", 5.0) and rows[2].name == "again"


def test_null_keys_match_null(table, tmp_path):
    out = run(table, [{"op": "delete", "key": {"name": None}}], tmp_path, key=("name",))
    assert out.table.count() == 3


def test_empty_update_is_passed_over(table, tmp_path):
    assert run(table, [up(99), up(1, name="z")], tmp_path).applied == 1


def test_version_check(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 3)], "id long, name string, version int")
    ch = e.cast_inputs(t, [up(1, name="b")], ["id"]).selectExpr("*", "2 AS seen_version")
    with pytest.raises(e.EditError, match="newer version"):
        e.apply_edits(t, ch, ["id"], str(tmp_path / "v"), version="version")
    ok = ch.selectExpr("* EXCEPT (seen_version)", "3 AS seen_version")
    assert e.apply_edits(t, ok, ["id"], str(tmp_path / "v"), version="version").table.first().name == "b"


@pytest.mark.parametrize("default,t,want", [
    ("CURRENT_TIMESTAMP(6)", "datetime", "current_timestamp()"), ("(getdate())", "datetime", "current_timestamp()"),
    ("'abc'::character varying", "varchar", "'abc'"), ("((0))", "int", "0"), ("false", "bool", "false"), ("1", "bool", "true"),
    ("nextval('seq'::regclass)", "int", None), ("gen_random_uuid()", "uuid", "uuid()"), ("some_function(1)", "int", None),
    ("now()", "int", None), ("N'x'", "varchar", "'x'"), (None, "int", None), ("SYSDATE", "datetime", "current_timestamp()"),
])
def test_defaults(default, t, want):
    assert e.translate_default(default, t)[0] == want


def test_restructure(table):
    out = e.restructure(table, [e.ColumnDef("price2", generated="price * 2", type="double"), e.ColumnDef("key", "id", "string"),
                                e.ColumnDef("price", "price"), e.ColumnDef("added", type="int", default="5")])
    assert out.columns == ["price2", "key", "price", "added"] and out.schema["key"].dataType == T.StringType()
    assert tuple(out.where("key = '2'").first()) == (4.0, "2", 2.0, 5)


def test_edit_markers(spark):
    t = spark.createDataFrame([(1, b"x", [1])], "id long, raw binary, list array<int>")
    frame = e.cast_inputs(t, [up(1, raw={"$bin": "AP8="}, list="[3,4]")], ["id"])
    r = frame.first()
    assert r.set_raw == b"\x00\xff" and r.set_list == [3, 4] and r.has_raw


def test_only_touched_files_are_written(spark, tmp_path):
    """Ten changes in a table of 200 files write at most ten files, and name the others as they are."""
    from tabloom.sinks import edit, load

    target = str(tmp_path / "t")
    rows = spark.range(4000).select("id", (F.col("id") * 2).alias("v")).repartitionByRange(200, "id")
    load.load(rows, target)
    before = set(load.read_loaded(spark, target).inputFiles())
    changes = e.cast_inputs(rows, [{"op": "update", "key": {"id": i}, "values": {"v": -1}} for i in (5, 6, 900, 2000)]
                             + [{"op": "delete", "key": {"id": i}} for i in (7, 3999, 2500)]
                             + [{"op": "insert", "values": {"id": 9000 + i, "v": 1}} for i in range(3)], ["id"])
    out = edit.edit_loaded(spark, target, changes, ["id"])
    after = set(out.table.inputFiles())
    want = {i: -1 if i in (5, 6, 900, 2000) else 2 * i for i in range(4000) if i not in (7, 3999, 2500)} | {9000 + i: 1 for i in range(3)}
    assert {r.id: r.v for r in out.table.collect()} == want and out.applied == 10
    assert len(before) > 150 and len(after - before) <= 10 and len(before & after) >= len(before) - 6
    with pytest.raises(e.EditError):
        edit.edit_loaded(spark, target, e.cast_inputs(rows, [{"op": "delete", "key": {"id": 7}}], ["id"]), ["id"])
    assert load.versions(spark, target) == [1, 2]
    assert load.read_loaded(spark, target, version=1).count() == 4000
    load.forget_versions(spark, target)
    assert load.read_loaded(spark, target).count() == len(want)
    # Only inserts, and a table that another writer changed meanwhile.
    more = e.cast_inputs(rows, [{"op": "insert", "values": {"id": 1, "v": 2}}], ["id"])
    with pytest.raises(e.EditError):
        edit.edit_loaded(spark, target, more, ["id"])
