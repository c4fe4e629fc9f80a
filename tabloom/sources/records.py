"""Records that go over several lines or stand in one array, read from file blocks in parallel.

A file's blocks are read as pieces of text, each task its own.  What state a
block begins in (inside a quoted field, how deep inside brackets) follows from
the blocks before it: every block is reduced to one row that says what it
does to each state, these rows are scanned in file order, and then every block
is cut into records in its known state.  Pieces of a record that lies across
a border of blocks meet by the record's first piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.functions.text import let
from tabloom.session import materialize

FILE, BLOCK, ROW, FIRST = "__file", "__block", "__row", "__first"


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """The text between two ``end`` marks with its file, block and a rising number; the byte order mark is left out."""
    rows = spark.read.text(path, lineSep=end).select(
        "value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW))
    return rows.withColumn("value", F.when(F.col(BLOCK) == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))


def _in_block():
    return Window.partitionBy(FILE, BLOCK).orderBy(ROW)


def _blocks():
    return Window.partitionBy(FILE).orderBy(BLOCK)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


# ---- quoted fields over several lines ------------------------------------------


def ends_quoted(line: Column, sep: str) -> Column:
    """Whether a line ends inside a quoted field, as ``from_out`` and ``from_in``: given that it begins outside of one or inside.

    A quote opens a field at its first character and closes it before a
    separator or the line's end; a doubled one, and any other, is text.  The
    line is split once and walked once for both.
    """
    no, yes = F.lit(False), F.lit(True)
    state = lambda q, skip: F.struct(q.alias("q"), skip.alias("skip"))
    pair = lambda out, inside: F.struct(out.alias("from_out"), inside.alias("from_in"))

    def walk(parts: Column) -> Column:
        last = F.size(parts) - 2
        marks = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.struct(
            ((F.get(parts, i + 1) == "") & (i != last)).alias("pair"),
            (F.get(parts, i + 1).startswith(sep) | ((i == last) & (F.get(parts, i + 1) == ""))).alias("ends"),
            (((i == 0) & (p == "")) | p.endswith(sep)).alias("opens")))

        def step(now: Column, m: Column) -> Column:
            return F.when(now["skip"], state(yes, no)).when(now["q"], state(m["pair"] | ~m["ends"], m["pair"])).otherwise(state(m["opens"], no))

        both = F.aggregate(marks, pair(state(no, no), state(yes, no)), lambda now, m: pair(step(now["from_out"], m), step(now["from_in"], m)))
        return let(both, lambda b: pair(b["from_out"]["q"], b["from_in"]["q"]))

    split = F.split(F.regexp_replace(line, "\r$", ""), '"', -1)
    return F.when(F.contains(line, F.lit('"')), let(split, walk)).otherwise(pair(no, yes))


def _effects(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with ``from_out`` and ``from_in``: whether they end quoted, from both states."""
    return lines.withColumn("ends", ends_quoted(F.col("value"), sep)).withColumns(
        {"from_out": F.col("ends.from_out"), "from_in": F.col("ends.from_in")}).drop("ends")


def quote_blocks(lines: DataFrame, sep: str) -> DataFrame:
    """One row for each block: does it begin quoted, where did the open record begin, has any line an open end."""
    known = _effects(lines, sep)
    mark = F.when(F.col("from_out") | ~F.col("from_in"), F.struct(F.col(ROW).alias("row"), "from_out", "from_in"))
    blocks = known.groupBy(FILE, BLOCK).agg(F.array_sort(F.collect_list(mark)).alias("marks"), F.max("from_out").alias("open_end"))
    none = F.lit(None).cast("bigint")

    def through(start: bool) -> Column:
        def step(now: Column, m: Column) -> Column:
            then = F.when(now["q"], m["from_in"]).otherwise(m["from_out"])
            return F.struct(then.alias("q"), F.when(~now["q"] & then, m["row"]).otherwise(now["row"]).alias("row"))

        return F.aggregate("marks", F.struct(F.lit(start).alias("q"), none.alias("row")), step)

    table = materialize(blocks.select(FILE, BLOCK, "open_end", through(False).alias("a"), through(True).alias("b")), "quotes")
    # A block keeps, turns or sets the state; turns count since the last one that set it.
    turned = F.sum(F.when(F.col("a.q") & ~F.col("b.q"), 1).otherwise(0)).over(_upto(_blocks())) % 2
    scanned = table.withColumn("turned", turned).withColumn(
        "set", F.last(F.when(F.col("a.q") == F.col("b.q"), (F.col("a.q").cast("int") + F.col("turned")) % 2), True).over(_upto(_blocks())))
    after = (F.coalesce("set", F.lit(0)) + F.col("turned")) % 2 == 1
    scanned = scanned.withColumn("after", after).withColumn("quoted", F.lag("after", 1, False).over(_blocks()))
    begun = F.when(F.col("after"), F.when(F.col("quoted"), F.col("b.row")).otherwise(F.col("a.row")))
    return scanned.withColumn("begun", begun).select(
        FILE, BLOCK, "quoted", "open_end", F.col("after").alias("left_open"), F.last("begun", True).over(_before(_blocks())).alias("begun"))


def quoted_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """``value``, place and ``first`` of every record, or None if each record is one line.

    Records stand in order within a block; only those that lie across a
    border of blocks are shuffled once more.
    """
    lines = pieces(spark, path, "\n")
    blocks = materialize(quote_blocks(lines, sep), "blocks")
    if not blocks.where("open_end").limit(1).collect():
        return None
    rows = _effects(lines, sep).join(blocks.drop("open_end"), [FILE, BLOCK])
    same = F.col("from_out") == F.col("from_in")
    turned = F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(_upto(_in_block())) % 2
    rows = rows.withColumn("turned", turned).withColumn(
        "set", F.last(F.when(same, (F.col("from_out").cast("int") + F.col("turned")) % 2), True).over(_upto(_in_block())))
    after = (F.coalesce("set", F.col("quoted").cast("int")) + F.col("turned")) % 2 == 1
    rows = rows.withColumn("after", after).withColumn("inside", F.coalesce(F.lag("after").over(_in_block()), "quoted"))
    first = (F.col(BLOCK) == 0) & (F.row_number().over(_in_block()) == 1)
    rows = rows.withColumn("start", F.last(F.when(~F.col("inside"), F.col(ROW)), True).over(_upto(_in_block())))
    rows = rows.withColumn("last_start", F.max("start").over(Window.partitionBy(FILE, BLOCK)))
    cross = F.col("start").isNull() | F.col("left_open") & (F.col("start") == F.col("last_start"))
    rows = rows.select("value", FILE, BLOCK, ROW, F.coalesce("start", "begun").alias("key"), first.alias(FIRST), cross.alias("cross"))
    inner = rows.where("not cross").groupBy(FILE, BLOCK, "key").agg(F.max(FIRST).alias(FIRST), _in_order("\n").alias("value")).select(
        "value", FILE, BLOCK, F.col("key").alias(ROW), FIRST).sortWithinPartitions(FILE, BLOCK, ROW)
    across = rows.where("cross").groupBy(FILE, F.col("key").alias(ROW)).agg(
        F.min(BLOCK).alias(BLOCK), F.max(FIRST).alias(FIRST), _in_order("\n").alias("value"))
    return inner.unionByName(across).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")


def _in_order(between: str) -> Column:
    texts = F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("row"), "value")))
    return F.array_join(F.transform(texts, lambda x: x["value"]), between)


# ---- objects of one array ------------------------------------------------------


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and place of every object of the arrays, one array in each file.

    Pieces end at closing braces, so an object without inner ones is one
    piece; no escape of JSON reaches over a brace.  What follows the last
    object of a file (its closing bracket) is no record.
    """
    parts = pieces(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '(?s)".*$', "")
    turns = _count(plain, '"') % 2
    depth = lambda text: _count(bare(text), "{[") - _count(bare(text), "]")
    # The brace that ends a piece closes something only outside of a text.
    marked = parts.withColumns({"turns": turns, "out": depth(plain) + turns - 1, "in": depth(F.concat(F.lit('"'), plain)) - turns})
    small = materialize(marked.select(FILE, BLOCK, ROW, "turns", "out", "in"), "pieces")
    odd = F.coalesce(F.sum("turns").over(_before(_in_block())), F.lit(0)) % 2 == 1
    blocks = small.withColumn("odd", odd).groupBy(FILE, BLOCK).agg(
        F.sum("turns").alias("turns"), F.sum(F.when(F.col("odd"), F.col("in")).otherwise(F.col("out"))).alias("a"),
        F.sum(F.when(F.col("odd"), F.col("out")).otherwise(F.col("in"))).alias("b"))
    blocks = blocks.withColumn("quoted", F.coalesce(F.sum("turns").over(_before(_blocks())), F.lit(0)) % 2)
    blocks = materialize(blocks.withColumn("deep", F.when(F.col("quoted") == 1, F.col("b")).otherwise(F.col("a"))).select(
        FILE, BLOCK, "quoted", F.coalesce(F.sum("deep").over(_before(_blocks())), F.lit(0)).alias("deep")), "depths")
    closed = materialize(_closed(small, blocks).where("ends").groupBy(FILE, BLOCK).agg(F.max(ROW).alias("closed")), "closed")
    carried = blocks.join(closed, [FILE, BLOCK], "left").select(
        FILE, BLOCK, "quoted", "deep", F.last("closed", True).over(_before(_blocks())).alias("carried"))
    rows = _closed(marked, carried)
    rows = rows.withColumn("earlier", F.last(F.when(F.col("ends"), F.col(ROW)), True).over(_before(_in_block())))
    rows = rows.withColumn("last_end", F.max(F.when(F.col("ends"), F.col(ROW))).over(Window.partitionBy(FILE, BLOCK)))
    cross = F.col("earlier").isNull() & (F.col(BLOCK) > 0) | F.col("last_end").isNull() | (F.col(ROW) > F.col("last_end"))
    rows = rows.select("value", FILE, BLOCK, ROW, "ends", F.coalesce("earlier", "carried", F.lit(-1)).alias("key"), cross.alias("cross"))
    inner = rows.where("not cross").groupBy(FILE, BLOCK, "key").agg(F.min(ROW).alias(ROW), _in_order("}").alias("value")).select(
        "value", FILE, BLOCK, ROW, "key").sortWithinPartitions(FILE, BLOCK, ROW)
    across = rows.where("cross").groupBy(FILE, "key").agg(
        F.min(BLOCK).alias(BLOCK), F.min(ROW).alias(ROW), F.max("ends").alias("ends"), _in_order("}").alias("value")).where("ends")
    every = inner.unionByName(across.select("value", FILE, BLOCK, ROW, "key"))
    opening = F.when(F.col("key") == -1, r"^\s*\[\s*").otherwise(r"^\s*,\s*")
    return every.select(F.concat(F.regexp_replace(F.col("value"), opening, F.lit("")), F.lit("}")).alias("value"), FILE, BLOCK, ROW)


def _closed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with ``ends``: an object of the array ends with this piece."""
    rows = rows.join(blocks, [FILE, BLOCK])
    start = (F.col("quoted") + F.coalesce(F.sum("turns").over(_before(_in_block())), F.lit(0))) % 2
    rows = rows.withColumn("start", start)
    own = F.when(F.col("start") == 1, F.col("in")).otherwise(F.col("out"))
    after = F.col("deep") + F.sum(own).over(_upto(_in_block()))
    return rows.withColumn("ends", ((F.col("start") + F.col("turns")) % 2 == 0) & (after == 1))
