"""Split records, footers, sequences, deep pages and differences between tables."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tabloom.model import Filter, Sort
from tabloom.operators import browse, describe, flavours, ranges
from tabloom.sources import files as src


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _cells(rng, n):
    parts = ["a", "b", ",", '"', "\n", '""', "\r\n", " ", "é", '"\n', ',"', "\r"]
    return ["".join(rng.choice(parts) if rng.random() < 0.8 else "x" * rng.randrange(1, 300) for _ in range(rng.randrange(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_quoted_records_split(small_blocks, tmp_path, quoting):
    rng = random.Random(quoting)
    rows = [[str(i), *_cells(rng, 3)] for i in range(400)]
    rows[200][2] = "long\n" * 3000 + '"q",\n'
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", newline="", encoding="utf-8-sig" if part else "utf-8") as f:
            writer = csv.writer(f, quoting=quoting, lineterminator="\r\n" if part else "\n")
            writer.writerow(["k", "two\nlines", "c", "d"])
            writer.writerows(rows[part * 200:part * 200 + 200])
    # The long cell must lie across several blocks.
    assert small_blocks.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 10
    df = src.read_delimited(small_blocks, str(tmp_path), delimiter=",", position=True)
    assert df.columns == ["k", "two\nlines", "c", "d", src.POSITION]
    assert [tuple(r)[:4] for r in df.orderBy(src.POSITION).collect()] == [tuple(r) for r in rows]
    assert df.select("k").rdd.getNumPartitions() > 1


def test_quotes_that_are_text(spark, tmp_path):
    text = 'a,b\n1,5" disk\n2,"two\nlines"\n3,x"y\n4,"say ""hi""\nand go"\n'
    (tmp_path / "q.csv").write_text(text)
    want = [tuple(r) for r in csv.reader(io.StringIO(text))][1:]
    assert sorted(tuple(r) for r in src.read_delimited(spark, str(tmp_path / "q.csv")).collect()) == sorted(want)


def test_single_lines_take_the_plain_reader(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b\n1,"x, y"\n2,"say ""hi"""\n')
    df = src.read_delimited(spark, str(tmp_path / "s.csv"))
    assert sorted(map(tuple, df.collect())) == [("1", "x, y"), ("2", 'say "hi"')]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("indent", [None, 1])
def test_array_records_split(small_blocks, tmp_path, indent):
    rng = random.Random(9)
    objects = [{"id": i, "t": _cells(rng, 1)[0] + '}{][\\"\\', "n": {"a": [1, {"b": "}"}], "c": i} if i % 3 else None,
                **({"late": 1} if i % 7 == 5 else {})} for i in range(300)]
    objects[100]["t"] = "}" * 9000
    for part in range(2):
        (tmp_path / f"{part}.json").write_text(("﻿" if part else "") + json.dumps(objects[part * 150:part * 150 + 150], indent=indent))
    df = src.read_json_array(small_blocks, str(tmp_path))
    assert df.columns == ["id", "t", "n", "late"]
    want = {(str(o["id"]), o["t"], json.dumps(o["n"], separators=(",", ":")) if o["n"] else None, "1" if "late" in o else None) for o in objects}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(objects)


@pytest.mark.parametrize("text, rows", [("[]", 0), ("[ ]\n", 0), ("", 0), ('[{"a":1}]', 1), ('[{"a":{}},\n{"a":{}}]', 2), ('[{}]', 1)])
def test_odd_arrays(spark, tmp_path, text, rows):
    (tmp_path / "a.json").write_text(text)
    assert src.read_json_array(spark, str(tmp_path / "a.json")).count() == rows


def test_arrays_of_other_things(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, {"a": 2}]')
    with pytest.raises(ValueError, match="not a JSON object"):
        src.read_json_array(spark, str(tmp_path / "a.json"))


def test_header_rows_of_tsv(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "2.tsv").write_text("3\t4\na\tb\n5\t6\n")
    got = sorted(tuple(r) for r in src.read_tsv(spark, str(tmp_path)).collect())
    assert got == [("1", "2"), ("3", "4"), ("5", "6"), ("a", "b")]


def _write(df, path, fmt, parts):
    df.repartition(parts).write.format(fmt).save(str(path))
    return [f for f in os.listdir(path) if f.startswith("part-") and not f.endswith(".crc")]


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_footers(spark, tmp_path, fmt):
    df = spark.range(1000).select("id", (F.col("id") / 4).alias("x"), F.col("id").cast("string").alias("s"))
    names = _write(df, tmp_path / "t", fmt, 3)
    facts = describe.lake_facts(spark, str(tmp_path / "t"), fmt)
    row = facts.first()
    stats = [os.stat(tmp_path / "t" / n) for n in names]
    assert (row.files, row.rows, row.bytes) == (3, 1000, sum(s.st_size for s in stats))
    assert abs(row.last_change.timestamp() - max(s.st_mtime for s in stats)) < 1
    # Neither a column nor a row of the table is read: counts come from the footers.
    plan = describe.footer_rows(spark, str(tmp_path / "t"), fmt)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "COUNT(*)" in plan
    bounds = {r.column: (r.low, r.high) for r in describe.column_bounds(spark, str(tmp_path / "t"), fmt).collect()}
    assert bounds == {"id": ("0", "999"), "x": ("0", "249.75")}


def test_objects_by_size(spark, tmp_path):
    for name, n in (("small", 5), ("big", 5000)):
        _write(spark.range(n), tmp_path / name, "parquet", 2)
    rows = describe.list_objects(spark, {n: str(tmp_path / n) for n in ("small", "big")}).collect()
    assert [(r.name, r.rows, r.files) for r in rows] == [("big", 5000, 2), ("small", 5, 2)]
    assert rows[0].bytes > rows[1].bytes and rows[0].last_change is not None and rows[0]["size"].endswith("B")
    assert browse.count_estimate(spark.range(1), describe.footer_rows(spark, str(tmp_path / "big")), exact=False).first() == (5000, False)


def test_sequences(spark):
    rows = [(i, i // 3, "abc"[i % 3]) for i in range(60)]
    frame = lambda r: spark.createDataFrame(r, "place int, k int, v string").repartition(5)
    of = lambda r, order=("place",): ranges.sequence_fingerprint(frame(r), [Sort(c) for c in order], ["k", "v"]).first().hash
    swapped = [(p, *rows[{4: 5, 5: 4}.get(p, p)][1:]) for p, _, _ in rows]
    assert of(rows) == of(rows[::-1])
    # Two rows with one key in another order, and the same rows as a set.
    assert of(rows) != of(swapped)
    assert of(rows, ["k", "v"]) == of(swapped, ["k", "v"])
    assert of(rows) != of(rows[:-1]) and of([]) != of(rows[:1])
    assert ranges.sequence_fingerprint(frame([]), [], ["k"]).first().rows == 0


def test_deep_pages(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("b"), "id"
                                  ).withColumn("a", F.when(F.col("a") > 20, F.col("a"))).repartition(6)
    key = ["a", "b", "id"]
    index = ranges.range_index(df, key, 16)
    assert index.agg(F.sum("rows")).first()[0] == 5000 and index.count() > 4
    want = [tuple(r) for r in df.orderBy(*[F.col(k).asc_nulls_first() for k in key]).collect()]
    for offset, limit in ((0, 10), (140, 30), (2500, 700), (4990, 50), (5000, 5)):
        page = ranges.page_at(df, key, offset, limit, index)
        assert [tuple(r) for r in page.collect()] == want[offset:offset + limit]
    plan = ranges.page_at(df, key, 4000, 10, index)._jdf.queryExecution().executedPlan().toString()
    assert "4010" not in plan


def test_deep_page_reads_one_range(spark, tmp_path):
    spark.range(20_000).repartitionByRange(8, "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    page = ranges.page_at(df, ["id"], 17_000, 5, ranges.range_index(df, ["id"], 40))
    assert [r.id for r in page.collect()] == list(range(17_000, 17_005))
    assert "GreaterThanOrEqual(id," in page._jdf.queryExecution().executedPlan().toString()


def test_differences(spark, tmp_path):
    rows = [(i * 7, i % 5, f"v{i}", None if i % 4 else 1.5) for i in range(4000)] + [(None, 1, "n", None)]
    other = list(rows)
    other[100] = (700, 0, "changed", None)
    other[2000] = (*rows[2000][:3], 2.5)
    other[3000:3001] = []
    other += [(10**12, 3, "far", None), (7, 1, "v1", None)]
    other[[r[0] for r in other].index(None)] = (None, 1, "m", None)
    schema = "k long, g int, v string, x double"
    a, b = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(other, schema).repartition(4)
    for leaf in (50, 10**6):
        got = {(r.k, r.change, tuple(r.columns)) for r in ranges.verify_rows(a, b, ["k"], leaf).collect()}
        assert got == {(700, "changed", ("v", "x") if rows[100][3] else ("v",)), (14000, "changed", ("x",)), (21000, "missing", ()),
                       (10**12, "extra", ()), (7, "repeated", ()), (None, "changed", ("v",))}
    assert ranges.verify_rows(a, a, ["k"]).count() == 0
    # Ranges close in on what differs.
    found = ranges.differing_ranges(a, b, "k", leaf_rows=50)
    assert sum(high - low + 1 for low, high in found if high < 10**6) < 28_000 / 4
    text = {r.v for r in ranges.verify_rows(a.select("v", "x"), b.select("v", "x"), ["v"]).collect()}
    assert text == {"v100", "changed", "v2000", "v3000", "far", "v1", "n", "m"}


def test_differences_all_over_the_key_end_the_search(spark, monkeypatch):
    """Every cell differs and is larger than a leaf, so no level rules anything out."""
    monkeypatch.setattr(ranges, "OPEN_RANGES", 2)
    monkeypatch.setattr(ranges, "FAN", 4)
    a = spark.range(-300, 1000).select("id", (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") % 10 == 0, F.col("v") + 1).otherwise(F.col("v")))
    assert ranges.differing_ranges(a, b, "id", leaf_rows=5) == [(-300, 999)]
    assert {r.id for r in ranges.verify_rows(a, b, ["id"], 5).collect()} == set(range(-300, 1000, 10))


@pytest.mark.parametrize("flavour", ["document", "search", "item", "wide"])
def test_numbers_no_column_holds(spark, flavour):
    df = spark.createDataFrame([(9,), (10,), (11,), (None,)], "k long")
    test = flavours.FLAVOURS[flavour][0]
    kept = lambda *a, **kw: sorted(r.k for r in df.where(test(df, Filter("k", *a, **kw))).collect() if r.k)
    assert kept("<", 10.5) == [9, 10] and kept(">=", "10.5") == [11] and kept("=", "10.5") == []
    assert kept("between", values=[9.5, 10.5]) == [10] and kept("in", values=["9", 10.5]) == [9]
    assert kept(">", 10**30) == [] and kept("<=", 10**30) == [9, 10, 11]


@pytest.mark.parametrize("metric, radius", [("degrees", 0.02), ("meters", 1500.0)])
def test_dense_cells_are_cut(spark, metric, radius):
    """A third of all points on one spot, a third on a street, and the rest spread: the same pairs, in small parts."""
    from tabloom.operators import joins

    k = F.col("id")
    spots = spark.range(6000).select("id", F.when(k % 3 == 0, 4.9).when(k % 3 == 1, F.lit(4.9) + (k % 500) / 1e5).otherwise(F.lit(4) + (k % 770) / 500.0).alias("lon"),
                                     F.when(k % 3 == 0, 52.3).when(k % 3 == 1, F.lit(52.3) + (k % 700) / 4e4).otherwise(F.lit(52) + (k % 650) / 700.0).alias("lat"))
    centers = spark.range(30).select(k.alias("center"), (F.lit(4.88) + k / 700.0).alias("c_lon"), (F.lit(52.28) + k / 900.0).alias("c_lat"))
    of = lambda dense: joins.radius_join(spots, centers, radius, metric=metric, dense=dense)
    want = sorted((r.id, r.center) for r in of(10**9).collect())
    assert sorted((r.id, r.center) for r in of(100).collect()) == want and len(want) > 6000
    assert of(100).columns == of(10**9).columns
    near = joins.radius_join(spots, centers, radius, metric=metric, dense=100)
    # The parts of the join: none has far more points than asked for.
    gridded = spots.withColumns({"__band": F.floor(F.col("lat") / 0.02), "__cell": F.floor(F.col("lon") / 0.02)})
    placed, _ = joins._cut_dense(gridded, centers.withColumns({"__cband": F.floor(F.col("c_lat") / 0.02), "__ccell": F.floor(F.col("c_lon") / 0.02)}),
                                 100, 0.02, None, 0.02, F.col("lon"), F.col("lat"), F.col("c_lat"))
    parts = [r["count"] for r in placed.groupBy("__band", "__cell", "__row", "__part").count().collect()]
    assert max(parts) < 200 and near.count() == len(want)


@pytest.mark.parametrize("metric, radius", [("degrees", 0.02), ("meters", 1500.0), ("meters", 400_000.0)])
def test_sums_within_a_radius(spark, metric, radius, monkeypatch):
    """Spots, a street, a crowded square, both sides of the date line and a pole: the sums of the pairs, in far fewer rows."""
    from tabloom.operators import joins

    rng = random.Random(9)
    points = [(i, 4.9, 52.3) for i in range(300)] + [(i, 4.9, 52.3 + rng.random() / 50) for i in range(300, 1500)]
    points += [(i, 4.9 + rng.random() / 50, 52.28 + rng.random() / 50) for i in range(1500, 3500)]
    points += [(i, rng.choice((179.99, -179.99)) + rng.random() / 100, rng.uniform(-0.01, 0.01)) for i in range(3500, 3800)]
    points += [(i, rng.uniform(-180, 180), rng.uniform(89.98, 90)) for i in range(3800, 4100)] + points[:40] + points[2000:2040]
    points += [(5000, None, 52.3), (5001, 4.9, None), (5002, float("nan"), 52.3), (5003, 4.9, float("nan")), (None, 4.9, 52.3)]
    centers = [(i, 4.9 + rng.uniform(-1, 1) / 40, 52.3 + rng.uniform(-1, 1) / 40) for i in range(20)] + [(20, 4.9, 52.3), (20, 4.9, 52.3), (21, 0.0, 89.99)]
    centers += [(22, 180.0, 0.0), (23, -180.0, 0.001), (24, None, 1.0), (None, 4.9, 52.31), (26, 100.0, 10.0)]
    p = spark.createDataFrame(points, "id bigint, lon double, lat double").repartition(3)
    c = spark.createDataFrame(centers, "center int, c_lon double, c_lat double")
    total = lambda n, ids: {r.center: (r.n, r.ids) for r in joined.groupBy("center").agg(n.alias("n"), ids.alias("ids")).collect()}
    joined = joins.radius_join(p, c, radius, metric=metric)
    want = total(F.count(F.lit(1)), F.sum("id"))
    assert None in want and 26 not in want and len(want) > 20
    for places in (joins.EDGE_PLACES, 2):
        monkeypatch.setattr(joins, "EDGE_PLACES", places)
        joined = joins.radius_join(p, c, radius, metric=metric, sums={"n": F.lit(1), "ids": F.col("id")})
        assert joined.columns == ["center", "c_lon", "c_lat", "n", "ids"]
        assert total(F.sum("n"), F.sum("ids")) == want
    assert joined.count() * 5 < sum(n for n, _ in want.values())


def test_sums_too_large_for_a_whole_box(spark):
    """A circle adds up what it holds, though all points of the box are too much for the type."""
    from tabloom.operators import joins

    big = 2**62
    p = spark.createDataFrame([(big, 0.001, 0.001), (big, 0.009, 0.009), (5, 0.0011, 0.001)], "id bigint, lon double, lat double")
    c = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.02)], "center int, c_lon double, c_lat double")
    joined = joins.radius_join(p, c, 0.01, metric="degrees", sums={"ids": F.col("id")})
    assert joined.groupBy("center").agg(F.sum("ids")).collect() == [(0, big + 5)]


def test_street_makes_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    """40,000 points on a street and 500 centers have two million pairs, which the query adds up from a hundredth of the rows."""
    from tabloom.operators import joins
    from tabloom.workloads import runner

    spark.range(120_000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(500).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    made, join = [], joins.radius_join
    monkeypatch.setattr(joins, "radius_join", lambda *a, **b: made.append(join(*a, **b)) or made[-1])
    got = {r.center: (r.points, r.ids) for r in runner("radius_join_street")(spark, str(tmp_path)).collect()}
    street = [(i, 52.3 + (i % 1000) / 1000000.0) for i in range(0, 120_000, 3)]
    lat = {c: 52.3 + (c % 100) / 100000.0 + 0.0000005 for c in range(500)}
    for c in (0, 7, 50, 99, 499):
        near = [i for i, y in street if abs(y - lat[c]) <= 0.00005]
        assert got[c] == (len(near), sum(near))
    assert len(got) == 500 and made[0].count() * 100 < sum(n for n, _ in got.values()) > 1_900_000
