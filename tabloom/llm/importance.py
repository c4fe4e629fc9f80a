"""Importance resampling towards a target text: hashed n-grams by prefix CRCs, log-ratio gains, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, plain_words, prepare, stored, to_arrow, worker_state

BUCKETS = 10_000
NGRAM = 1
PERCENT = 10
MIN_WORDS = 20
SEED = 2024

_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)


def byte_table() -> np.ndarray:
    """What one zero byte does to a register with only its low byte set."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & np.uint32(1), (rows >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), rows >> np.uint32(1))
    return rows


class Shift:
    """Appending zero bytes to a CRC register is linear over GF(2): tables for 1, 2, 4, ... bytes."""

    def __init__(self):
        self.byte = byte_table()
        places = np.arange(256, dtype=np.uint32)
        one = lambda v: (v >> np.uint32(8)) ^ self.byte[v & np.uint32(255)]
        self.powers = [np.stack([one(places << np.uint32(8 * j)) for j in range(4)])]

    def _times(self, k: int, crc: np.ndarray) -> np.ndarray:
        while len(self.powers) <= k:
            last = len(self.powers) - 1
            self.powers.append(np.stack([self._times(last, row) for row in self.powers[-1]]))
        t = self.powers[k]
        low = np.uint32(255)
        return (t[0][crc & low] ^ t[1][(crc >> np.uint32(8)) & low] ^ t[2][(crc >> np.uint32(16)) & low] ^ t[3][crc >> np.uint32(24)])

    def __call__(self, crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        out = crc.copy()
        for k in range(int(n_bytes.max(initial=0)).bit_length()):
            at = np.flatnonzero((n_bytes >> k) & 1)
            out[at] = self._times(k, out[at])
        return out

    def space(self, crc: np.ndarray) -> np.ndarray:
        """The running CRC behind one more space."""
        register = crc ^ _ALL
        return (register >> np.uint32(8)) ^ self.byte[(register ^ np.uint32(0x20)) & np.uint32(255)] ^ _ALL


def shifter() -> Shift:
    state = worker_state("importance")
    if not hasattr(state, "shifter"):
        state.shifter = Shift()
    return state.shifter


def ngram_crcs(texts: list[list[bytes]], longest: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(text number, CRC-32) of all runs of 1 to ``longest`` words of every text, joined by one space.

    One scan runs a CRC over all words with single spaces between them and
    keeps it at every word's end; at a word's start it is one space further.
    The CRC of a run is its end's prefix CRC with the start's prefix CRC,
    shifted by the run's length, cancelled out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    crc32, c, ends = zlib.crc32, 0, []
    keep = ends.append
    for w in words:
        c = crc32(w, c)
        keep(c)
        c = crc32(b" ", c)
    shift = shifter()
    ends = np.array(ends, np.uint32)
    starts = np.concatenate((np.zeros(1, np.uint32), shift.space(ends[:-1])))
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], stops[:-1] + 1))
    text = np.repeat(np.arange(len(texts)), sizes)
    numbers, found = [], []
    for n in range(1, longest + 1):
        if len(words) < n:
            break
        first = np.flatnonzero(text[:len(words) - n + 1] == text[n - 1:])
        last = first + n - 1
        numbers.append(text[first])
        found.append(ends[last] ^ shift(starts[first], stops[last] - begins[first]))
    return np.concatenate(numbers), np.concatenate(found)


def features(texts: DataFrame, keys: list[str], buckets: int, longest: int) -> DataFrame:
    """``keys`` (long columns), n_words, and every feature's bucket as 32-bit numbers in one binary cell."""
    def run(rows: dict[str, list]) -> dict[str, list]:
        words = [plain_words(t) for t in rows["text"]]
        number, crc = ngram_crcs(words, longest)
        order = np.argsort(number, kind="stable")
        own = (crc[order] % np.uint32(buckets)).astype("<u4")
        raw, edges = own.tobytes(), np.searchsorted(number[order], np.arange(len(words) + 1)) * 4
        return {k: rows[k] for k in keys} | {
            "n_words": [len(w) for w in words], "features": [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]}

    return map_rows(texts, run, ", ".join(f"{k} long" for k in keys) + (", " if keys else "") + "n_words long, features binary")


def _numbers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch's cells, and where each cell's begin and end."""
    ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, cells.offset * 4) // 4
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    return data[:len(data) // 4 * 4].view("<u4"), ends


def bucket_counts(found: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): how many features are in each bucket, added up in each task first."""
    schema = f"bucket long, {name} long"
    kind = to_arrow(found.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, ends = _numbers(batch.column(0))
            total += np.bincount(values[ends[0]:ends[-1]], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=kind)

    return found.select("features").mapInArrow(run, schema).groupBy("bucket").agg(F.sum(name).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain: floored 1000 * log of the smoothed target share over the smoothed source share.

    One number for each bucket is on the driver, however large the tables are.
    """
    spark = source.sparkSession
    rows = spark.range(buckets).withColumnRenamed("id", "bucket").join(source, "bucket", "left").join(target, "bucket", "left").fillna(0)
    every = Window.partitionBy()
    of = lambda c: F.col(c).cast("double")
    ratio = ((of("t") + 1) * (F.sum("s").over(every) + buckets)) / ((of("s") + 1) * (F.sum("t").over(every) + buckets))
    out = rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toArrow().sort_by("bucket")
    return out.column("gain").to_numpy()


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of a document's features, added up."""
    schema = "doc_id long, n_words long, n_features long, weight long"
    kind = to_arrow(found.sparkSession, schema)
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _numbers(batch.column(2))
            sums = np.concatenate(([0], np.cumsum(sent.value[values[:ends[-1]]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)),
                                              pa.array(np.diff(sums[ends]).astype(np.int64))], schema=kind)

    return found.select("doc_id", "n_words", "features").mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in ``order``: sorted range partitions, and the rows of those before."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sorted_ = stored(sorted_, "ranked")
    # One row for each partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sorted_.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return sorted_.join(bases, "_part").withColumn("rank", F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = NGRAM, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, seed: int = SEED, target_text: str = "text") -> DataFrame:
    """Every document's features, weight, score, and its rank among the drawn ones.

    Texts are scanned once; features are kept as bucket numbers, from which
    counts and then weights are taken.  A score is the weight plus Gumbel
    noise that depends on the seed and the id, so the documents with the
    highest scores are a sample without replacement by importance.

    Null and empty texts have no features and weight 0, and are never drawn;
    an empty target or table leaves smoothed shares; a null id takes noise of
    the empty id and comes last among ties; rows with one id share their noise and
    are drawn each for itself, the one with fewer features first; other columns of either table are ignored.
    """
    prepare(docs.sparkSession)
    found = stored(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], buckets, longest), "features")
    aim = features(target.select(F.col(target_text).alias("text")), [], buckets, longest)
    gain = gains(bucket_counts(found, buckets, "s"), bucket_counts(aim, buckets, "t"), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(found, gain).withColumn("score", F.col("weight") + noise).withColumn("_long", F.col("n_words") >= min_words)
    order = [F.col("_long").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = ranked(scored, order)
    drawn = found.where(F.col("n_words") >= min_words).agg(F.floor(percent * F.count("*") / F.lit(100)).alias("drawn"))
    keep = int(drawn.first().drawn)
    return placed.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("_long") & (F.col("rank") <= keep), F.col("rank")).alias("rank"))
