"""Shared pieces of the text operators: words, row maps, numbering, work tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabloom.session import tune, work_path

# Rows that travel to Python at once: whole texts may be long.
BATCH_ROWS = 1000

# A word is a run of digits, letters and everything beyond ASCII.  On UTF-8
# bytes that is the same rule, as all bytes of such characters are >= 0x80.
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PLAIN = bytes(_LOWER[b] if _LOWER[b] in _WORD_BYTES else 0x20 for b in range(256))
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_SQL = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for the operators of this package."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation, as UTF-8 bytes."""
    return text.encode().translate(PLAIN).split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else touched."""
    return text.encode().translate(_LOWER) if text else b""


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches given and taken as lists by column."""
    kind = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Like ``map_rows``, but ``fn`` sees a partition's batches one after another."""
    kind = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches if b.num_rows)
        for out in fn(rows):
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def same_columns(df: DataFrame) -> list[Column]:
    """The columns by quoted name."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_state(owner: str) -> types.ModuleType:
    """A place that lives as long as the worker process does, and is emptied when another ``owner`` asks for it.

    Workers go on from stage to stage, so what one operator keeps must not
    stand beside what the next one does.
    """
    state = sys.modules.setdefault("_tabloom_worker", types.ModuleType("_tabloom_worker"))
    if getattr(state, "owner", None) != owner:
        vars(state).clear()
        pa.default_memory_pool().release_unused()
        state.owner = owner
    return state


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared work folder and go on from the files."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A filter of keys has 16 bits for each, and no more than this in all.
FILTER_BITS = 27


def key_filter(keys: DataFrame, name: str = "key") -> np.ndarray:
    """A bounded set of bits that tells which keys can be wanted; those that pass by chance are sorted out by exact joins."""
    n = keys.count()
    bits = 1 << min(FILTER_BITS, max(16, (16 * n).bit_length()))
    cell = F.shiftright(F.col(name).bitwiseAND(F.lit(bits - 1)), 6).cast("int").alias("cell")
    rows = keys.select(cell, F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("bit")).groupBy("cell").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out


def passes(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.int64(64 * len(cells) - 1)
    return (cells[at >> 6] >> (at & 63)) & 1 == 1


# Rows of a group that are numbered together.
BLOCK_ROWS = 1000


def numbered(df: DataFrame, group: Column, size: Column, order: list[Column], name: str) -> DataFrame:
    """Add gapless numbers from 0 within ``group``, without one task for a group.

    ``size`` is the number of rows of a row's group.  Rows go to blocks of
    about ``BLOCK_ROWS`` by a hash of their order columns; a block is numbered
    alone, by ``order``, and starts after the counts of the blocks before it.
    The sequence is that of (block, order), so callers that need one order
    overall must not use it.  ``df`` is read twice: it should be a stored
    table.
    """
    df = df.withColumns({"_group": group, "_block": F.pmod(F.xxhash64(F.lit(97), *order), F.lit(1) + F.floor(size / BLOCK_ROWS))})
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy("_group", "_block").agg(F.count("*").alias("_n")).select(
        "_group", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_group", "_block").orderBy(*order))
    return df.withColumn("_at", inside).join(bases, ["_group", "_block"]).withColumn(
        name, F.col("_base") + F.col("_at") - 1).drop("_group", "_block", "_base", "_at")
