"""Timetables, observations and alerts, in batch and over streams."""

from pyspark.sql import functions as F

from tabloom.session import materialize, work_path
from tabloom.streaming import alerts as al, cron, streams as st
from tabloom.workloads.registry import query


def _observations(t, every="1 hour"):
    return al.observe(t.events.select("ts", "event_id", "event_type", "value"), "ts", every, "value", ["ts", "event_id"], ["event_type"])


_OBS = """(SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS tick, count(*) AS rows, arg_min(value, {{'t': ts, 'e': event_id}}) AS first_value,
  {digest} AS d FROM events GROUP BY 1, 2)"""
_DIGEST = "sum(hash(event_id, value))"
_OBS_SQL = _OBS.format(digest=_DIGEST)
_SHOW = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"


@query("observe_ticks", f"SELECT event_type, tick, rows, {_SHOW.format('first_value')} AS value FROM {_OBS_SQL}")
def observe_ticks(t):
    return _observations(t).select("event_type", F.col("tick"), "rows", "value")


@query("observe_result", f"SELECT count(*) AS rows, (SELECT event_type FROM events ORDER BY event_id LIMIT 1) AS value FROM events")
def observe_result(t):
    return al.observe_result(t.events.select("event_id", "event_type"), "EVENT_TYPE", ["event_id"]).select("rows", "value")


@query("alert_rows", f"SELECT event_type, tick, rows > 1 AS fired, rows || ' rows' AS seen, rows > 1 AS notify FROM {_OBS_SQL}")
def alert_rows(t):
    return al.alert(_observations(t), al.Rule("rows", ">", "1"), ["event_type"]).select("event_type", "tick", "fired", "seen", "notify")


@query("alert_value_edge", f"""SELECT event_type, tick, fired, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY event_type ORDER BY tick), false) AS notify
  FROM (SELECT *, first_value >= 60 AS fired FROM {_OBS_SQL})""")
def alert_value_edge(t):
    rule = al.Rule("value", ">=", "60", "Value", edge=True)
    return al.alert(_observations(t), rule, ["event_type"]).select("event_type", "tick", "fired", "notify")


@query("alert_changed", f"""SELECT event_type, tick, coalesce(d <> lag(d) OVER w, false) AS fired,
  CASE WHEN lag(d) OVER w IS NULL THEN 'first result' ELSE 'changed' END AS seen FROM {_OBS_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY tick)""")
def alert_changed(t):
    return al.alert(_observations(t), al.Rule("changed"), ["event_type"]).select("event_type", "tick", "fired", "seen")


_PART = """SELECT o_orderstatus, o_orderdate AS tick, count(*) AS rows, sum(o_custkey % 2)::BIGINT AS odd FROM orders GROUP BY 1, 2"""


@query("alert_changed_quiet", f"""SELECT o_orderstatus, tick, coalesce(odd <> lag(odd) OVER w, false) AS fired,
  CASE WHEN lag(odd) OVER w IS NULL THEN 'first result' WHEN odd <> lag(odd) OVER w THEN 'changed' ELSE 'unchanged' END AS seen
  FROM ({_PART}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY tick)""")
def alert_changed_quiet(t):
    obs = t.orders.groupBy("o_orderstatus", F.col("o_orderdate").alias("tick")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_custkey") % 2).cast("string").alias("hash")).withColumn("value", F.col("hash"))
    return al.alert(obs, al.Rule("changed"), ["o_orderstatus"]).select("o_orderstatus", "tick", "fired", "seen")


@query("alert_text_error", f"""SELECT event_type, tick, false AS fired,
  'a number is expected in the first column, not "' || event_type || '"' AS error FROM {_OBS_SQL}""")
def alert_text_error(t):
    obs = _observations(t).withColumn("value", F.col("event_type"))
    return al.alert(obs, al.Rule("value", ">", "1"), ["event_type"]).select("event_type", "tick", "fired", "error")


_RUNS = f"""(SELECT event_type, tick, CASE WHEN first_value > 30 THEN 'failed' WHEN rows > 1 THEN 'alert' ELSE 'quiet' END AS status FROM {_OBS_SQL})"""


def _judged(t):
    obs = _observations(t)
    out = al.alert(obs, al.Rule("rows", ">", "1"), ["event_type"])
    return out.withColumn("error", F.when(F.col("value").cast("double") > 30, "too much"))


@query("run_history", f"""SELECT event_type, tick, status, CASE WHEN status = 'failed' THEN row_number() OVER (PARTITION BY event_type, island ORDER BY tick)
  - CASE WHEN island > 0 THEN 1 ELSE 0 END ELSE 0 END AS failures FROM (
  SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY tick) AS island FROM {_RUNS})""")
def run_history(t):
    return al.run_history(_judged(t), ["event_type"], keep=None).select("event_type", "tick", "status", "failures")


@query("run_history_kept", f"""SELECT event_type, tick, status FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tick DESC) AS n FROM {_RUNS}) WHERE n <= 200""")
def run_history_kept(t):
    return al.run_history(_judged(t), ["event_type"], keep=al.KEEP_RUNS).select("event_type", "tick", "status")


@query("paused_schedules", f"""SELECT event_type, count(*) AS pauses FROM (SELECT event_type, status, island, row_number() OVER (PARTITION BY event_type, island ORDER BY tick)
  - CASE WHEN island > 0 THEN 1 ELSE 0 END AS failures FROM (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY tick) AS island
  FROM {_RUNS})) WHERE status = 'failed' AND failures >= 5 GROUP BY 1""")
def paused_schedules(t):
    return al.run_history(_judged(t), ["event_type"], keep=None).where("paused").groupBy("event_type").agg(F.count(F.lit(1)).alias("pauses"))


def _timetables(t):
    """A schedule per supplier: hourly or daily, by its key, in its zone."""
    names = {"0": ("15 */6 * * *", "UTC"), "1": ("30 8 * * 1-5", "Europe/Amsterdam"), "2": ("0 18 L * *", "America/New_York")}
    base = cron.timetable_frame(t.spark, names)
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 3).cast("string").alias("kind"))
    return s.join(base, s.kind == base.schedule).drop("schedule", "kind").withColumnRenamed("name", "schedule")


@query("cron_ticks", """SELECT 's' || s_suppkey AS schedule, tick FROM supplier, LATERAL (
  SELECT d + to_hours(h) + INTERVAL '15 minutes' AS tick FROM range(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL '1 day') r(d), (VALUES (0), (6), (12), (18)) v(h)
    WHERE s_suppkey % 3 = 0
  UNION ALL SELECT d + INTERVAL '450 minutes' FROM range(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL '1 day') r(d) WHERE s_suppkey % 3 = 1 AND dayofweek(d) BETWEEN 1 AND 5
  UNION ALL SELECT TIMESTAMP '2024-02-29 23:00:00' WHERE s_suppkey % 3 = 2) x""")
def cron_ticks(t):
    return cron.cron_ticks(_timetables(t), "2024-02-27 00:00:00", "2024-03-02 00:00:00").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("cron_gaps", """SELECT 's' || s_suppkey AS schedule, CASE s_suppkey % 3 WHEN 0 THEN 21600 WHEN 1 THEN 86400 ELSE 2674800 END::BIGINT AS gap FROM supplier""")
def cron_gaps(t):
    return cron.min_gap(cron.cron_ticks(_timetables(t), "2024-02-01 00:00:00", "2024-04-02 00:00:00"))


@query("missed_ticks", """WITH ticks AS (SELECT 's' || s_suppkey AS schedule, d AS tick FROM supplier, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '6 hours') r(d)),
  looks AS (SELECT DISTINCT 's' || user_id AS schedule, date_trunc('hour', ts) AS looked FROM events),
  first_look AS (SELECT t.schedule, tick, min(looked) AS looked FROM ticks t JOIN looks l ON l.schedule = t.schedule AND looked >= tick GROUP BY 1, 2)
  SELECT schedule, looked AS "at", max(tick) AS tick, count(*) AS collapsed FROM first_look GROUP BY 1, 2""")
def missed_ticks(t):
    tables = cron.with_timetable(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("schedule")), "0 */6 * * *")
    ticks = cron.cron_ticks(tables, "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    looks = t.events.select(F.concat(F.lit("s"), "user_id").alias("schedule"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).distinct()
    return cron.due(ticks, looks).select("schedule", F.col("at").cast("timestamp_ntz"), F.col("tick").cast("timestamp_ntz"), "collapsed")


def _event_stream(t):
    return st.file_stream(t.spark, t.folder, t.events.schema, glob="events.parquet")


@query("summary_stream", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  max(value) AS highest, min(value) AS lowest, CAST(round(sum(CAST(value AS DECIMAL(18,2))) / count(*), 6) AS DOUBLE) AS mean
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def summary_stream(t):
    target = work_path(t.spark, "summary")
    # Rows arrive in two loads, so that every function has parts to merge.
    money, stored = F.col("value").cast("decimal(18,2)"), work_path(t.spark, "arrivals")
    for odd in (0, 1):
        t.events.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(stored)
        st.maintain_summary(st.file_stream(t.spark, stored, t.events.schema), "ts", {
            "n": ("count", F.lit(1)), "revenue": ("sum", money), "highest": ("max", F.col("value")), "lowest": ("min", F.col("value")),
            "mean": ("avg", money)}, target, ["event_type"], F.col("event_type") != "error")
    rows = st.read_summary(t.spark, target, ["event_type"])
    return rows.withColumn("revenue", F.col("revenue").cast("double")).withColumn("mean", F.round("mean", 6).cast("double"))


@query("summary_compacted", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS highest, true AS visitors_near FROM events GROUP BY 1""")
def summary_compacted(t):
    target = work_path(t.spark, "summary")
    st.maintain_summary(_event_stream(t), "ts", {"n": ("count", F.lit(1)), "highest": ("max", F.col("value")),
                                                 "visitors": ("distinct", F.col("user_id"))}, target)
    exact = t.events.select(F.to_date("ts").alias("day"), "user_id").distinct().groupBy("day").agg(F.count("user_id").alias("exact"))
    return st.compact_summary(t.spark, target).join(exact, "day").select(
        "day", "n", "highest", (F.abs(F.col("visitors") - F.col("exact")) <= 0.05 * F.col("exact")).alias("visitors_near"))


@query("windowed_summary", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2""")
def windowed_summary(t):
    """Complete windows of a stream that ends: the watermark passes them all."""
    windows = st.windowed_summary(_event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day",
                                  {"n": F.count(F.lit(1)), "highest": F.max("value")}, ["event_type"])
    target = work_path(t.spark, "windows")
    st.run_available(windows, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/batch={epoch}"), f"{target}/_checkpoint", "complete")
    last = t.spark.read.parquet(target)
    return last.where(F.col("batch") == last.agg(F.max("batch")).scalar()).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "highest")


@query("alert_stream", f"""SELECT event_type, tick, fired, fired AND NOT coalesce(lag(fired) OVER (PARTITION BY event_type ORDER BY tick), false) AS notify
  FROM (SELECT *, first_value >= 60 AS fired FROM {_OBS_SQL})""")
def alert_stream(t):
    # Observations arrive in two loads, and the second run goes on from the first.
    obs = materialize(_observations(t), "observed")
    early = F.col("tick") < F.lit("2024-01-11").cast("timestamp")
    stored, target = work_path(t.spark, "arrivals"), work_path(t.spark, "alerts")
    for part in (obs.where(early), obs.where(~early)):
        part.write.mode("append").parquet(stored)
        st.alert_stream(st.file_stream(t.spark, stored, obs.schema), al.Rule("value", ">=", "60", edge=True), ["event_type"], target)
    return st.read_alerts(t.spark, target).select("event_type", "tick", "fired", "notify")


@query("log_after_id", "SELECT event_id, ts, event_type FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 300")
def log_after_id(t):
    return st.log_after(t.events.select("event_id", "ts", "event_type"), "event_id", 400, 300)


