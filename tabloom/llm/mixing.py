"""Mixing sources to target weights: whole copies that are certain, then a Pareto order sample of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import TOKEN_SQL, prepare, stored

WEIGHTS = (1, 2, 3)
MOST = 3                 # a source gives at most so many times its size
SEED = 20_240_601
# Blocks of the order of a source's documents; only the one where the sample ends is sorted.
BLOCKS = 4096
# Chances below certainty stay below this.
NEARLY = 1 - 1e-6


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): weights in turn over the sources by code point, the null source last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source").distinct().select(
        "source", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), 1 + (place - 1) % len(weights)).alias("weight"))


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, where null is a source too; the left one stays."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def targets(sizes: DataFrame, weights: DataFrame, percent: int = 100, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the total's share by weight, and no target beyond ``most`` times the source's size.

    Sharing what is above a limit again until nothing is above ends at one
    level for each unit of weight: sources below ``most * size`` get level *
    weight.  Sorted by the level at which they are full, the sources before
    the right place are full and the others are not.  One row for each source.
    """
    rows = by_source(sizes, weights).withColumn("cap", most * F.col("source_size"))
    every, fill = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * percent / 100.0
    level = (total - full) / open_
    leveled = rows.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return leveled.select("source", "source_size", F.coalesce(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def inclusion(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``whole`` copies, the words of the ``rest``, and what gives a document its chance in it.

    A chance grows with a document's words, up to certainty: documents of a
    size class above ``edge`` are certain, others have ``rate`` * size, and
    the expected words are the rest.  Classes are sizes with the same five
    leading bits, so a source has some hundreds of them at any size.
    """
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    big = F.col("size").cast("decimal(18,0)")
    classes = sized.where("size > 0").groupBy("source", size_class().alias("class")).agg(
        F.sum("size").alias("x"), F.sum(big * big).cast("double").alias("xx"), F.max("size").alias("top"))
    classes = by_source(classes, plan.select("source", "rest"))
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("x").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("xx").over(down.rowsBetween(0, Window.unboundedFollowing))
    rates = classes.withColumn("rate", F.greatest((F.col("rest") - above) / below, F.lit(0.0)))
    fits = F.col("rate") * F.col("top") <= 1
    edges = rates.groupBy("source").agg(
        F.coalesce(F.max(F.when(fits, F.col("class"))), F.min("class")).alias("edge"),
        F.coalesce(F.max_by(F.when(fits, F.col("rate")), F.when(fits, F.col("class"))), F.min_by("rate", "class")).alias("rate"))
    return by_source(plan, edges, "left")


def size_class() -> Column:
    return F.expr("length(bin(size)) * 32 + shiftright(size, greatest(length(bin(size)) - 5, 0))")


def draws(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, draw): the words of a text and a number in (0, 1) that depends on seed, id and text alone."""
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    digits = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 13), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(TOKEN_SQL)).cast("long").alias("size"),
                       ((digits + 0.5) / float(1 << 52)).alias("draw"))


def mix(docs: DataFrame, weights: DataFrame | None = None, percent: int = 100, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it.

    ``weights`` (source, weight) defaults to 1, 2, 3 in turn.  A source whose
    target is k times its size and a rest gives k whole copies of every
    document; the rest is a sample in Pareto order: documents are ranked by
    the odds of their draw divided by the odds of their chance, and taken from
    the first on until their words come nearest to the rest.  So a source
    misses its target by less than half of the last document.

    Documents in certain classes come first.  The order is cut into blocks;
    sums of blocks tell where the sample ends, and only that block is sorted,
    so a source with a third of all rows is no single task.  All steps are JVM
    operations.

    A null or empty text has no words and nothing is taken; a null source is a
    source of its own; null ids are ids like others; equal rows are
    interchangeable; rows with one id and different texts are different
    documents; sources without words have target 0; an empty table gives an
    empty table; other columns are ignored.  The same seed gives the same mix.
    """
    prepare(docs.sparkSession)
    sized = stored(draws(docs.select("doc_id", "source", "text"), seed), "sizes")
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weights = cycled_weights(sizes) if weights is None else weights.select("source", F.col("weight").cast("double").alias("weight"))
    plan = stored(inclusion(sized, targets(sizes, weights, percent, most)), "plan")

    chance = F.least(F.col("rate") * F.col("size"), F.lit(NEARLY))
    ours, theirs = F.col("draw") * (1 - chance), (1 - F.col("draw")) * chance
    # q / (1 + q) of the Pareto rank q: in order of q, and between 0 and 1.
    place = F.when(F.col("size") == 0, 1.0).when(size_class() > F.col("edge"), -1.0).otherwise(ours / (ours + theirs))
    placed = by_source(sized, plan.select("source", "rate", "edge")).select("doc_id", "source", "size", place.alias("place"))
    placed = stored(placed.withColumn("block", F.floor(F.col("place") * BLOCKS)), "placed")

    up = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("x")).withColumn("before", F.coalesce(F.sum("x").over(up), F.lit(0)))
    ends = by_source(blocks, plan.select("source", "rest")).where("before <= rest").groupBy("source").agg(
        F.max("block").alias("last"), F.max_by("before", "block").alias("before"))
    final = stored(by_source(plan.select("source", "source_size", "target", "whole", "rest"), ends, "left"), "ends")

    rows = by_source(placed, final)
    inside = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_end = rows.where("block = last").withColumn("picked", (2 * earlier + F.col("size") <= 2 * F.col("rest")).cast("int"))
    others = rows.where("block <> last or last is null").withColumn("picked", F.coalesce((F.col("block") < F.col("last")).cast("int"), F.lit(0)))
    return at_end.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("picked")).alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("picked"))).alias("taken"))
