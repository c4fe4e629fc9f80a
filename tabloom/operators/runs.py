"""Previous-row logic over long histories without one task per key.

``lag`` and running counts are usually windows partitioned by a key, which
puts the whole history of a key into one task.  Here a history is cut into
blocks of its order column.  Windows run inside (key, block); what crosses a
border is carried by a summary of one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions.text import quoted


def block_of(order: Column, seconds: int = 86_400) -> Column:
    """The block of a timestamp: days unless told otherwise."""
    return F.floor(F.unix_micros(order.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def previous(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], block: Column,
             prefix: str = "prev_") -> DataFrame:
    """Add each row's previous values within its key, as ``lag`` would."""
    parts = [quoted(k) for k in keys]
    inner = Window.partitionBy(*parts, F.col("__block")).orderBy(quoted(order))
    pack = F.struct(*[quoted(v).alias(v) for v in values])
    blocked = df.withColumn("__block", block)
    # The last row of every block, carried to the next block that has rows.
    ends = blocked.groupBy(*parts, F.col("__block")).agg(F.max_by(pack, quoted(order)).alias("__end"))
    carried = ends.select(*parts, "__block", F.lag("__end").over(
        Window.partitionBy(*parts).orderBy("__block")).alias("__carry"))
    local = blocked.withColumn("__lag", F.lag(pack).over(inner))
    joined = join_blocks(local, carried, keys)
    took = F.when(F.col("__lag").isNotNull(), F.col("__lag")).otherwise(F.col("__carry"))
    return joined.select(*[quoted(c) for c in df.columns], *[took[v].alias(prefix + v) for v in values])


def last_known(df: DataFrame, keys: Sequence[str], order: str, value: str, block: Column, name: str) -> DataFrame:
    """Add the last non-NULL ``value`` at or before each row of its key."""
    parts = [quoted(k) for k in keys]
    inner = Window.partitionBy(*parts, F.col("__block")).orderBy(quoted(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    blocked = df.withColumn("__block", block)
    ends = blocked.where(quoted(value).isNotNull()).groupBy(*parts, F.col("__block")).agg(
        F.max_by(quoted(value), quoted(order)).alias("__end"))
    # Blocks without a value take part too: they pass on what came before.
    all_blocks = blocked.select(*parts, "__block").distinct()
    known = join_blocks(all_blocks, ends, keys)
    over = Window.partitionBy(*parts).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select(*parts, "__block", F.last("__end", ignorenulls=True).over(over).alias("__carry"))
    local = blocked.withColumn("__here", F.last(quoted(value), ignorenulls=True).over(inner))
    return join_blocks(local, carried, keys).select(
        *[quoted(c) for c in df.columns], F.coalesce("__here", "__carry").alias(name))


def streak(df: DataFrame, keys: Sequence[str], order: str, hit: Column, block: Column, name: str) -> DataFrame:
    """Add the number of consecutive ``hit`` rows that end at each row."""
    parts = [quoted(k) for k in keys]
    inner = Window.partitionBy(*parts, F.col("__block")).orderBy(quoted(order))
    blocked = df.withColumn("__block", block).withColumn("__hit", F.coalesce(hit, F.lit(False)))
    local = blocked.withColumn("__n", F.row_number().over(inner)).withColumn(
        "__miss", F.max(F.when(~F.col("__hit"), F.col("__n"))).over(inner))
    ends = local.groupBy(*parts, F.col("__block")).agg(
        F.max("__n").alias("__rows"), F.max("__miss").alias("__last_miss"))
    over = Window.partitionBy(*parts).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of whole blocks passed since the last block that holds a miss.
    passed = F.sum("__rows").over(over)
    mark = Window.partitionBy(*parts).orderBy("__block")
    at_miss = ends.withColumn("__upto", F.sum("__rows").over(mark)).withColumn(
        "__miss_at", F.when(F.col("__last_miss").isNotNull(), F.col("__upto") - F.col("__rows") + F.col("__last_miss")))
    carried = at_miss.select(
        *parts, "__block",
        (F.coalesce(passed, F.lit(0)) - F.coalesce(F.max("__miss_at").over(over), F.lit(0))).alias("__carry"))
    joined = join_blocks(local, carried, keys)
    run = F.when(F.col("__miss").isNotNull(), F.col("__n") - F.col("__miss")).otherwise(
        F.col("__n") + F.col("__carry"))
    return joined.select(*[quoted(c) for c in df.columns],
                         F.when(F.col("__hit"), run).otherwise(0).cast("bigint").alias(name))


def join_blocks(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a block's summary to its rows; both are keyed by (key, block)."""
    names = list(keys) + ["__block"]
    right = summary.select(*[quoted(n).alias(f"__r{i}") for i, n in enumerate(names)],
                           *[quoted(c) for c in summary.columns if c not in names])
    on = [quoted(n).eqNullSafe(F.col(f"__r{i}")) for i, n in enumerate(names)]
    return rows.join(right, on, "left").drop(*[f"__r{i}" for i in range(len(names))])
