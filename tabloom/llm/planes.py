"""Token ids as files of bit or byte planes, each compressed, with an index of chunks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, map_stream, prepare
from tabloom.llm.tokens import END, default_path, encoder

BLOCK_IDS = 1 << 16      # ids whose planes are compressed together
CHUNK_IDS = 1 << 20      # ids after which a chunk ends, at the end of a document
LEVEL = 3

# A chunk holds whole documents; ``planes`` has the byte length of each plane of each block, in payload order.
CHUNK = ("file long, chunk int, mode string, n_ids long, doc_ids array<long>, doc_lengths array<int>, "
         "block_ids array<int>, planes array<array<int>>, payload binary")


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of one block, least significant first; all-zero planes at the end are left out."""
    if mode == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
        top = (int(ids.max(initial=0)).bit_length() + 7) // 8
        return [np.ascontiguousarray(rows[i]).tobytes() for i in range(top)]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T
    top = int(ids.max(initial=0)).bit_length()
    return [np.packbits(bits[i], bitorder="little").tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            rows[:, i] = np.frombuffer(p, np.uint8)
        return rows.reshape(-1).view("<u4")
    bits = np.zeros((32, n), np.uint8)
    for i, p in enumerate(planes):
        bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_chunk(ids: np.ndarray, mode: str, level: int = LEVEL) -> tuple[list[int], list[list[int]], bytes]:
    """Block sizes, plane lengths and the payload."""
    press = zstandard.ZstdCompressor(level=level)
    sizes, lengths, parts = [], [], []
    for k in range(0, len(ids), BLOCK_IDS):
        block = ids[k:k + BLOCK_IDS]
        pressed = [press.compress(p) for p in to_planes(block, mode)]
        sizes.append(len(block))
        lengths.append([len(p) for p in pressed])
        parts += pressed
    return sizes, lengths, b"".join(parts)


def unpack_chunk(sizes: list[int], lengths: list[list[int]], payload: bytes, mode: str) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    at, out = 0, []
    for n, own in zip(sizes, lengths):
        planes = []
        for size in own:
            planes.append(open_.decompress(payload[at:at + size]))
            at += size
        out.append(from_planes(planes, n, mode))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, mode: str = "byte") -> None:
    """Encode every text and write its ids, and an end id, in ascending doc_id order.

    A range partition of ids is one file; within it chunks follow each other.
    The container is Parquet, whose commit leaves no half-written file behind
    a lost executor and which any store takes; a row is a chunk with its own
    index entry (documents, block sizes, plane lengths).

    A null or empty text is one end id; null ids come first; rows with equal
    ids are ordered by text; an empty table writes no chunks; other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        file, chunk = TaskContext.get().partitionId(), 0
        own, held, lengths, total = [], [], [], 0

        def flush() -> dict[str, list]:
            ids = np.concatenate(held)
            sizes, planes, payload = pack_chunk(ids, mode)
            return {"file": [file], "chunk": [chunk], "mode": [mode], "n_ids": [len(ids)], "doc_ids": [list(own)],
                    "doc_lengths": [list(lengths)], "block_ids": [sizes], "planes": [planes], "payload": [payload]}

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encoder(tokenizer).encode_many(batch["text"])):
                own.append(doc_id)
                held.append(np.append(ids, np.uint32(end)))
                lengths.append(len(ids) + 1)
                total += len(ids) + 1
                if total >= CHUNK_IDS:
                    yield flush()
                    chunk += 1
                    own, held, lengths, total = [], [], [], 0
        if own:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    map_stream(rows, run, CHUNK).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, chunk, n_ids, start): where each chunk stands in the sequence of all ids."""
    chunks = spark.read.parquet(path).select("file", "chunk", "n_ids", F.element_at("doc_ids", 1).alias("first"))
    # One row for each file, so this order is over files and not over documents.
    files = chunks.groupBy("file").agg(F.sum("n_ids").alias("n"), F.min("first").alias("low"), F.min("chunk"),
                                       F.max(F.col("first").isNull()).alias("nulls"))
    earlier = Window.orderBy(F.col("nulls").desc(), "low", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.join(files, "file").select(
        "file", "chunk", "n_ids", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, checksum, and its ids if asked."""
    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {n: [] for n in ("file", "chunk", "doc_id", "at", "n_tokens", "ids_crc32")}
        every = []
        for i, file in enumerate(rows["file"]):
            ids = unpack_chunk(rows["block_ids"][i], rows["planes"][i], rows["payload"][i], rows["mode"][i])
            at = 0
            for doc_id, n in zip(rows["doc_ids"][i], rows["doc_lengths"][i]):
                own = ids[at:at + n]
                for name, value in zip(out, (file, rows["chunk"][i], doc_id, at, n, zlib.crc32(own.astype("<u4").tobytes()))):
                    out[name].append(value)
                if with_ids:
                    every.append(own.astype(np.int32))
                at += n
        return out | ({"ids": every} if with_ids else {})

    spark = prepare(spark)
    # A row is a chunk of many documents.
    chunks = spark.read.parquet(path)
    schema = "file long, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = map_rows(chunks, run, schema)
    return docs.join(chunk_index(spark, path).select("file", "chunk", "start"), ["file", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
