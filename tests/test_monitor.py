import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from tabloom.operators import runs
from tabloom.streaming import alerts as al, cron, streams as st


def next_runs(spark, expression, zone, after, n, days=800):
    table = cron.timetable_frame(spark, {"s": (expression, zone)})
    return [r.tick.strftime("%Y-%m-%d %H:%M") for r in cron.next_runs(table, after, n, days).orderBy("run").collect()]


@pytest.mark.parametrize("expression,want", [
    ("*/15 * * * *", ["2026-09-30 10:30", "2026-09-30 10:45", "2026-09-30 11:00"]),
    ("0 8 * * 1-5", ["2026-10-01 08:00", "2026-10-02 08:00", "2026-10-05 08:00"]),
    ("30 9 * * MON", ["2026-10-05 09:30", "2026-10-12 09:30"]), ("0 6 1 * *", ["2026-10-01 06:00", "2026-11-01 06:00"]),
    ("0 18 L * *", ["2026-09-30 18:00", "2026-10-31 18:00", "2026-11-30 18:00"]), ("0 0 29 2 *", ["2028-02-29 00:00"]),
    ("@hourly", ["2026-09-30 11:00", "2026-09-30 12:00"]), ("0 12 * * 7", ["2026-10-04 12:00"]),
    ("5/20 * * * *", ["2026-09-30 10:25", "2026-09-30 10:45", "2026-09-30 11:05"]),
    ("0 9 13 * FRI", ["2026-10-02 09:00", "2026-10-09 09:00", "2026-10-13 09:00"]),
    ("0 0 * JAN,JUL *", ["2027-01-01 00:00"]), ("0 12 15,L * *", ["2026-09-30 12:00", "2026-10-15 12:00"]),
])
def test_cron_runs(spark, expression, want):
    days = 800 if expression.startswith("0 0 29") else 120
    assert next_runs(spark, expression, "UTC", "2026-09-30 10:17:30", len(want), days) == want


@pytest.mark.parametrize("expression", ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "*/0 * * * *",
                                        "5-1 * * * *", "a * * * *", "1,,2 * * * *"])
def test_cron_rejects(expression):
    with pytest.raises(ValueError):
        cron.parse_cron(expression)


def test_cron_zones_and_clock_changes(spark):
    assert next_runs(spark, "0 8 * * *", "Asia/Riyadh", "2026-09-30 06:00:00", 1, 5) == ["2026-10-01 05:00"]
    # 02:30 is skipped on 2026-03-08 in New York: 03:30 EDT is 07:30 UTC.
    assert next_runs(spark, "30 2 * * *", "America/New_York", "2026-03-07 17:00:00", 2, 5) == ["2026-03-08 07:30", "2026-03-09 06:30"]


def test_cron_gap(spark):
    table = cron.timetable_frame(spark, {"five": ("*/5 * * * *", "UTC"), "two": ("0,2 * * * *", "UTC"), "day": ("58 23 * * *", "UTC"),
                                         "hour": ("0 8,9 * * 1", "UTC")})
    ticks = cron.cron_ticks(table, "2026-09-30 00:00:00", "2026-10-14 00:00:00")
    assert {r.schedule: r.gap for r in cron.min_gap(ticks).collect()} == {"five": 300, "two": 120, "day": 86400, "hour": 3600}
    with pytest.raises(ValueError, match="two: a schedule can run at most every 5 minutes"):
        cron.check_gaps(ticks)


def judge(spark, rule, rows=3, value="4", hash_="h2", prev="h1"):
    df = spark.createDataFrame([(rows, value, hash_, prev)], "rows long, value string, hash string, prev string")
    fired, seen, error = al.judged(rule, F.col("rows"), F.col("value"), F.col("hash"), F.col("prev"))
    return tuple(df.select(fired.alias("f"), seen.alias("s"), error.alias("e")).first())


R = al.Rule


@pytest.mark.parametrize("rule,state,fired,seen", [
    (R("rows", ">", "0"), {}, True, "3 rows"), (R("rows", "=", "0"), {}, False, "3 rows"),
    (R("value", "<", "5", "Stock"), {}, True, "4"), (R("value", ">=", "5", "stock"), {}, False, "4"),
    (R("value", "=", "A-1"), {"value": "A-1"}, True, "A-1"), (R("value", "!=", "A-1"), {"value": "A-1"}, False, "A-1"),
    (R("value", "=", "4.0"), {}, True, "4"), (R("changed"), {}, True, "changed"), (R("changed"), {"prev": "h2"}, False, "unchanged"),
    (R("changed"), {"prev": None}, False, "first result"), (R("value", ">", "1"), {"rows": 0, "value": None}, False, "no rows"),
    (R("value", "!=", "1"), {"value": None}, False, "NULL"),
])
def test_alert_truth_table(spark, rule, state, fired, seen):
    state = {**{"prev": "h1"}, **state}
    got = judge(spark, rule, **{k: v for k, v in state.items() if k != "hash"})
    assert got == (fired, seen, None)


def test_alert_errors(spark):
    fired, _, error = judge(spark, R("value", ">", "1"), value="A-1")
    assert not fired and error == 'a number is expected in the first column, not "A-1"'
    with pytest.raises(ValueError, match="no result column"):
        al.metric_column(spark.range(1), "missing")
    with pytest.raises(ValueError):
        R("value", "~", "1")


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k, n in (("hot", 600), ("cold", 40), ("one", 1)):
        at = start
        for i in range(n):
            at += dt.timedelta(minutes=rng.choice([5, 30, 60, 60 * 30]))
            rows.append((k, at, rng.random() < 0.6, rng.choice(["a", "b"]), None if rng.random() < 0.5 else i))
    return spark.createDataFrame(rows, "k string, tick timestamp, bad boolean, hash string, mark int")


def test_blocks_equal_plain_windows(history):
    w = Window.partitionBy("k").orderBy("tick")
    block = runs.block_of(F.col("tick"), 6 * 3600)
    a = runs.previous(history, ["k"], "tick", ["hash"], block).select("k", "tick", "prev_hash")
    b = history.select("k", "tick", F.lag("hash").over(w).alias("prev_hash"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a = runs.streak(history, ["k"], "tick", F.col("bad"), block, "n").select("k", "tick", "n")
    island = history.withColumn("i", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    b = island.withColumn("n", F.sum(F.col("bad").cast("long")).over(Window.partitionBy("k", "i").orderBy("tick"))).select(
        "k", "tick", F.when(F.col("bad"), F.col("n")).otherwise(0).alias("n"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a = runs.last_known(history, ["k"], "tick", "mark", block, "m").select("k", "tick", "m")
    b = history.select("k", "tick", F.last("mark", ignorenulls=True).over(w).alias("m"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_keep_newest(history):
    w = Window.partitionBy("k").orderBy(F.col("tick").desc())
    want = history.withColumn("r", F.row_number().over(w)).where("r <= 37").drop("r")
    got = al.keep_newest(history, ["k"], "tick", 37)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pause_after_five_failures(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=i), False, "boom" if i >= 2 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "tick timestamp, fired boolean, error string")
    out = al.run_history(df).orderBy("tick").collect()
    assert [r.failures for r in out] == [0, 0, 1, 2, 3, 4, 5, 6] and [r.paused for r in out] == [False] * 6 + [True] * 2


def test_stream_equals_batch(spark, history, tmp_path):
    obs = history.select("k", "tick", F.lit(1).cast("long").alias("rows"), F.col("mark").cast("string").alias("value"), "hash")
    bounds = ["2024-01-01", "2024-01-04", "2024-01-09", "2024-02-01", "2030-01-01"]
    for rule in (R("value", ">", "9", edge=True), R("changed", edge=True)):
        stored, target = str(tmp_path / f"{rule.kind}-in"), str(tmp_path / rule.kind)
        for lo, hi in zip(bounds, bounds[1:]):
            # Ticks arrive in order from run to run.
            obs.where((F.col("tick") >= lo) & (F.col("tick") < hi)).repartition(2).write.mode("append").parquet(stored)
            st.alert_stream(st.file_stream(spark, stored, obs.schema), rule, ["k"], target)
        got = st.read_alerts(spark, target).select("k", "tick", "fired", "seen", "notify")
        want = al.alert(obs, rule, ["k"]).select("k", "tick", "fired", "seen", "notify")
        assert got.count() == 641 and got.exceptAll(want).count() == 0
        # Nothing new: another run changes nothing.
        st.alert_stream(st.file_stream(spark, stored, obs.schema), rule, ["k"], target)
        assert st.read_alerts(spark, target).count() == 641


def test_summary_survives_new_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 5)
    data, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, k string, v long"
    for part in ([(day, "a", 1), (day, "b", 2)], [(day, "a", 10), (day + dt.timedelta(days=1), "a", 5)]):
        df = spark.createDataFrame(part, schema)
        df.write.mode("append").parquet(data)
        st.maintain_summary(st.file_stream(spark, data, df.schema), "ts", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, target, ["k"])
    rows = sorted((str(r.day), r.k, r.n, r.s) for r in st.read_summary(spark, target, ["k"]).collect())
    assert rows == [("2024-01-01", "a", 2, 11), ("2024-01-01", "b", 1, 2), ("2024-01-02", "a", 1, 5)]


def test_windowed_summary_drops_late_rows(spark, tmp_path):
    data = str(tmp_path / "in")
    base = dt.datetime(2024, 1, 1, 12)
    schema = "ts timestamp, v long"
    for i, at in enumerate([base, base + dt.timedelta(hours=6), base - dt.timedelta(hours=5), base + dt.timedelta(hours=12)]):
        spark.createDataFrame([(at, i)], schema).coalesce(1).write.mode("append").parquet(data)
    stream = st.file_stream(spark, data, spark.read.parquet(data).schema, max_files=1)
    out = st.windowed_summary(stream, "ts", "1 hour", {"n": F.count(F.lit(1))}, watermark="1 hour")
    got = []
    st.run_available(out, lambda b, _: got.extend(r.window.start for r in b.collect()), str(tmp_path / "cp"))
    assert base in got and base - dt.timedelta(hours=5) not in got
