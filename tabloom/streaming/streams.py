"""The same monitors over streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tabloom.functions.text import quoted
from tabloom.session import work_path
from tabloom.sinks.load import path_exists
from tabloom.streaming.alerts import Rule, judged


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def run_available(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; a later run goes on from the checkpoint."""
    query = (stream.writeStream.foreachBatch(commit).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


# Bits of a sketch's registers: estimates are about 1 % off.
SKETCH_BITS = 14
# How parts of a summary become one, by function; an average is kept as a sum and a count.
MERGES = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "total": F.sum, "number": F.sum, "sketch": F.hll_union_agg}


def _parts(aggs: Mapping[str, tuple[str, Column]]) -> list[Column]:
    """Partial aggregates, each named by the function that merges it."""
    out = []
    for name, (kind, col) in aggs.items():
        if kind == "avg":
            out += [F.sum(col).alias(f"total:{name}"), F.count(col).alias(f"number:{name}")]
        elif kind == "distinct":
            out.append(F.hll_sketch_agg(col, F.lit(SKETCH_BITS)).alias(f"sketch:{name}"))
        elif kind in ("sum", "count", "min", "max"):
            out.append(getattr(F, kind)(col).alias(f"{kind}:{name}"))
        else:
            raise ValueError(f"parts of {kind!r} cannot be merged")
    return out


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*[quoted(k) for k in keys]).agg(*[MERGES[c.split(":", 1)[0]](quoted(c)).alias(c) for c in values])


def maintain_summary(stream: DataFrame, ts: str, aggs: Mapping[str, tuple[str, Column]], target: str, keys: Sequence[str] = (),
                     condition: Column | None = None) -> None:
    """A summary by day kept up to date as rows arrive, late ones included.

    ``aggs`` gives a function (sum, count, min, max, avg or distinct) and a
    column for each name; distinct values are estimated from sketches of a
    fixed size, which merge as sums do.  Every batch appends its own partial aggregates under its batch
    number, so a repeated batch replaces itself; ``read_summary`` merges them.
    """
    rows = stream if condition is None else stream.where(condition)
    made = _parts(aggs)
    root = target.rstrip("/")

    def commit(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy(F.to_date(quoted(ts)).alias("day"), *[quoted(k) for k in keys]).agg(*made)
        part.write.mode("overwrite").parquet(f"{root}/batch={epoch}")

    run_available(rows, commit, f"{root}/_checkpoint")


def read_summary(spark: SparkSession, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """The parts of all batches merged by day and key, each by its own function."""
    return _finished(_merged(spark.read.parquet(target).drop("batch"), ["day", *keys]), ["day", *keys])


def _finished(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = [quoted(k) for k in keys]
    for c in merged.columns:
        kind, _, name = c.partition(":")
        if c not in keys and kind != "number":
            shown = {"total": lambda c=c, name=name: F.try_divide(quoted(c), quoted(f"number:{name}")),
                     "sketch": lambda c=c: F.hll_sketch_estimate(quoted(c))}.get(kind, lambda c=c: quoted(c))
            out.append(shown().alias(name))
    return merged.select(*out)


def compact_summary(spark: SparkSession, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """The summary rewritten with one row per key, as a new folder."""
    path = work_path(spark, "summary")
    _merged(spark.read.parquet(target).drop("batch"), ["day", *keys]).write.parquet(path)
    return read_summary(spark, path, keys)


def windowed_summary(stream: DataFrame, ts: str, every: str, aggs: Mapping[str, Column], keys: Sequence[str] = (),
                     watermark: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark, for append or update sinks."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(quoted(ts), every), *[quoted(k) for k in keys]).agg(
        *[c.alias(n) for n, c in aggs.items()])


# State of keys in a store that writes what has changed.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_last(stream: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], again: str) -> DataFrame:
    """Each row of a stream with the ``values`` of its key's row before, and the ``again`` of the one before that.

    Rows of a key stand in ``order`` within a batch.  A key's last row is kept
    as keyed state, so a batch writes the state of its own keys only.
    """
    kept = T.StructType([stream.schema[v] for v in values] + [T.StructField(f"prev_{again}", stream.schema[again].dataType)])
    added = [T.StructField("known", T.BooleanType())] + [T.StructField(f"prev_{f.name}", f.dataType) for f in kept]
    names, place = stream.columns, [stream.columns.index(v) for v in values]
    at, old, shown = stream.columns.index(order), values.index(again), [*names, *[f.name for f in added]]

    # Defined here, so that it travels by value to the workers.
    class Last(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", kept)

        def handleInputRows(self, key, rows, timerValues):
            held = tuple(self.last.get()) if self.last.exists() else None
            for row in sorted(rows, key=lambda r: r[at]):
                yield Row(*shown)(*row, held is not None, *(held or [None] * (len(place) + 1)))
                held = (*[row[i] for i in place], held[old] if held else None)
            self.last.update(held)

        def close(self) -> None:
            pass

    return stream.groupBy(*[quoted(k) for k in keys]).transformWithState(
        Last(), T.StructType([*[stream.schema[n] for n in names], *added]), "append", "none")


def alert_stream(stream: DataFrame, rule: Rule, keys: Sequence[str], target: str, tick: str = "tick") -> None:
    """Judge a stream of observations, remembering each key's last one.

    Batch by batch this equals ``alerts.alert`` over the whole history when
    ticks arrive in order.  A key's last observation is keyed state of the
    query; results are stored under their batch's number.
    """
    spark, root = stream.sparkSession, target.rstrip("/")
    chained = with_last(stream, keys, tick, ["rows", "value", "hash"], "hash")

    def commit(batch: DataFrame, epoch: int) -> None:
        fired, seen, error = judged(rule, F.col("rows"), F.col("value"), F.col("hash"), F.col("prev_hash"))
        before, _, _ = judged(rule, F.col("prev_rows"), F.col("prev_value"), F.col("prev_hash"), F.col("prev_prev_hash"))
        held = F.col("known") & before
        out = batch.select(*[quoted(c) for c in stream.columns], fired.alias("fired"), seen.alias("seen"), error.alias("error"), held.alias("held"))
        notify = F.col("fired") & ~F.coalesce("held", F.lit(False)) if rule.edge else F.col("fired")
        out.withColumn("notify", notify).drop("held").write.mode("overwrite").parquet(f"{root}/alerts/batch={epoch}")

    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        run_available(chained, commit, f"{root}/_checkpoint")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_alerts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target.rstrip('/')}/alerts").drop("batch")


def log_after(df: DataFrame, id_column: str, last: Any, limit: int | None = None) -> DataFrame:
    """Entries of a log after a known id, oldest first."""
    rows = df if last is None else df.where(quoted(id_column) > F.lit(last))
    rows = rows.orderBy(quoted(id_column).asc())
    return rows.limit(limit) if limit else rows


def append_history(rows: DataFrame, path: str, epoch: int) -> None:
    """The run table grows by one folder per batch; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path).drop("batch") if path_exists(spark, path) else None
