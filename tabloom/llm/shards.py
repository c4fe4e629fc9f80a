"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import free_name, numbered, prepare, stored

SHARDS = 24
SEED = 20_240_601


def draw(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good: the hypergeometric law, inverted from its mode.

    The probabilities are added up outwards from the most likely count, so a
    draw takes some standard deviations of steps at any population size.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left = rng.random() - up
    above = below = mode
    while left > 0 and (above < hi or below > lo):
        if above < hi:
            up *= (good - above) * (n - above) / ((above + 1) * (bad - n + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > lo:
            down *= below * (bad - n + below) / ((good - below + 1) * (n - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: sums are the partitions' and the shards' exact sizes.

    Shard sizes are at most one apart.  It has a row for each partition, not
    for each document, and is drawn row by row from what the shards still take.
    """
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in counts:
        row, rest, left = [], sum(room), n
        for j in range(shards):
            rest -= room[j]
            got = draw(rng, room[j], rest, left)
            row.append(got)
            left -= got
            room[j] -= got
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there: a uniform shuffle.

    Rows are permuted inside their partition, the matrix tells how many of
    them go to which shard, and rows are permuted again inside the shard.
    Both permutations sort by hashes of seed and row, so a task that runs
    again gives the same rows.  Only JVM operations touch rows; the driver
    sees one count for each partition.

    A null text has no bytes and checksum 0; null ids are rows like others;
    equal rows are interchangeable, so their ties do not matter; an empty
    table gives an empty table; ``carry`` names further columns to take
    along; one with a name that the result has itself gets an underscore.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.limit(0).selectExpr("1 as doc_id", "1 as size", "1 as text_crc32", "1 as shard", "1 as slot", "1 as _key", "1 as _part", "1 as _at",
                                   "1 as _sent", "1 as _ends", "1 as _group", "1 as _block", "1 as _base")
    taken = [F.col(f"`{c}`").alias(free_name(own, c)) for c in carry or []]
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *taken)
    mix = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "text_crc32", "size")
    # First permutation: positions in the order of the hash, within the partition as it was read.
    placed = rows.withColumn("_key", mix(1)).sortWithinPartitions("_key", "doc_id", "text_crc32").drop("_key").withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = stored(placed, "placed")
    sizes = {r["_part"]: r.n for r in placed.groupBy("_part").agg(F.count("*").alias("n")).toLocalIterator()}
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    text_of = json.dumps([{"_part": p, "_sent": row} for p, row in zip(parts, matrix)])
    bounds = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text_of), "array<struct<_part:int,_sent:array<long>>>")))
    ends = F.transform("_sent", lambda x, i: F.aggregate(F.slice("_sent", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    sent = placed.join(bounds.select("_part", ends.alias("_ends")), "_part")
    shard = F.size(F.filter("_ends", lambda x: x <= F.col("_at")))
    # Exchange, and the second permutation.
    there = sent.withColumn("shard", shard).withColumn("_key", mix(2)).drop("_ends", "_part", "_at")
    return numbered(stored(there, "sent"), F.col("shard"), F.lit(sum(sizes.values()) // shards), [F.col("_key"), F.col("doc_id"), F.col("text_crc32")], "slot"
                    ).drop("_key")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within each file."""
    shuffled.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
