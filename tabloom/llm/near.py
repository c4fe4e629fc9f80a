"""MinHash near-dedup: one-permutation signatures, banded buckets, star-shaped candidates, exact checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import key_filter, lower_ascii, map_rows, passes, prepare, same_columns, stored, to_arrow
from tabloom.llm.graphs import components

SHINGLE = 5
PERCENT = 75         # links need 100 * intersection >= PERCENT * union
# 48 bands of 4 values: a pair at the threshold shares no bucket with a probability of 1e-8.
BANDS, VALUES = 48, 4
# Shingles of a group that are compared in one place.
CELL = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh3_64_intdigest
    found = [hash_of(line[a:b]) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())]
    return np.unique(np.array(found, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    return x * np.uint64(0xC4CEB9FE1A85EC53) ^ (x >> np.uint64(29))


def _probes(bins: int, tries: int) -> np.ndarray:
    """For each bin, the bins it looks at in turn while it is empty: the same for all texts."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (_mixed(at * _ODD[0]) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One permutation, ``bins`` bins, each with its smallest hash; empty bins borrow by optimal densification."""
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    borders = np.searchsorted(place, np.arange(bins, dtype=np.uint64))
    safe = np.minimum(borders, len(hashes) - 1)
    full = place[safe] == np.arange(bins, dtype=np.uint64)
    values = np.where(full, hashes[safe], np.uint64(0))
    if not full.all():
        out, left = values.copy(), np.flatnonzero(~full)
        for t in range(probes.shape[1]):
            from_bin = probes[left, t]
            got = full[from_bin]
            out[left[got]] = values[from_bin[got]]
            left = left[~got]
            if not len(left):
                break
        if len(left):
            # After so many tries the next full bin to the right is taken.
            filled = np.flatnonzero(full)
            out[left] = values[filled[np.searchsorted(filled, left) % len(filled)]]
        values = out
    return values


def bands_of(hashes: np.ndarray, bands: int, values: int, probes: np.ndarray) -> np.ndarray:
    """One bucket number for each band."""
    rows = signature(hashes, bands * values, probes).reshape(bands, values)
    mixed = np.zeros(bands, np.uint64)
    for i in range(values):
        mixed = _mixed(mixed + rows[:, i] * _ODD[i % 4])
    return _mixed(mixed + np.arange(bands, dtype=np.uint64) * _ODD[0]).view(np.int64)


def many_bands(sets: list[np.ndarray], bands: int, values: int, probes: np.ndarray) -> np.ndarray:
    """``bands_of`` for many sets (sorted, distinct and not empty) at once: a row for each."""
    bins = bands * values
    sizes = np.array([len(s) for s in sets])
    row, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    place = row * bins + (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    values_at, full = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    values_at[place[first]], full[place[first]] = hashes[first], True
    out, left = values_at.copy(), np.flatnonzero(~full)
    for t in range(probes.shape[1]):
        if not len(left):
            break
        at = left % bins
        origin = left - at + probes[at, t]
        got = full[origin]
        out[left[got]] = values_at[origin[got]]
        left = left[~got]
    if len(left):
        # After so many tries the next full bin to the right is taken, or the set's first.
        filled = place[first]
        nxt = np.searchsorted(filled, left)
        starts = np.searchsorted(filled, left // bins * bins)
        same = (nxt < len(filled)) & (filled[np.minimum(nxt, len(filled) - 1)] // bins == left // bins)
        out[left] = values_at[filled[np.where(same, nxt, starts)]]
    rows = out.reshape(len(sets), bands, values)
    mixed = np.zeros((len(sets), bands), np.uint64)
    for i in range(values):
        mixed = _mixed(mixed + rows[:, :, i] * _ODD[i % 4])
    return _mixed(mixed + np.arange(bands, dtype=np.uint64) * _ODD[0]).view(np.int64)


def text_words(text: str | None) -> list[bytes]:
    return lower_ascii(text).split()


def sketches(docs: DataFrame, bands: int = BANDS, values: int = VALUES) -> DataFrame:
    """doc_id, a 128-bit digest of the words (two longs), the set's size, and the buckets."""
    def run(rows: dict[str, list]) -> dict[str, list]:
        probes, sets = _probes(bands * values, 64), []
        out = {"doc_id": rows["doc_id"], "d1": [], "d2": []}
        for text in rows["text"]:
            words = text_words(text)
            d = xxhash.xxh3_128_digest(b" ".join(words))
            sets.append(shingles(words))
            out["d1"].append(int.from_bytes(d[:8], "little", signed=True))
            out["d2"].append(int.from_bytes(d[8:], "little", signed=True))
        buckets: list = [np.zeros(0, np.int64)] * len(sets)
        some = [i for i, s in enumerate(sets) if len(s)]
        for i, row in zip(some, many_bands([sets[i] for i in some], bands, values, probes) if some else ()):
            buckets[i] = row
        return out | {"n": [len(s) for s in sets], "buckets": buckets}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, d1 long, d2 long, n long, buckets array<long>")


def shingle_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(node, hashes): the whole shingle sets of the texts whose id ``wanted`` lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(rows: dict[str, list]) -> dict[str, list]:
        there = [i for i, d in enumerate(rows["doc_id"]) if d is not None]
        ids = np.array([rows["doc_id"][i] for i in there], np.int64)
        at = [there[k] for k in np.flatnonzero(passes(sent.value, ids))]
        return {"node": [rows["doc_id"][i] for i in at], "hashes": [shingles(text_words(rows["text"][i])).view(np.int64) for i in at]}

    return map_rows(docs.select("doc_id", "text"), run, "node long, hashes array<long>")


def link(members: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame], known: DataFrame | None = None,
         percent: int = PERCENT) -> DataFrame:
    """(node, component) of all nodes that share a bucket with a similar one.

    ``members``: (bucket, node); ``sizes``: (node, n), n being the set's size; ``sets`` gives
    (node, hashes) for at least a frame of nodes; ``known`` (a, b) are links there are in any case.

    A bucket is a star around its smallest node: a bucket of m gives m - 1
    edges.  Buckets with one centre are one group, so a node goes once to each
    of its centres and not to each of its buckets.  All members of a group are
    compared where it is read, on whole sets; of what is similar a group
    returns a forest, so rows stay in proportion to edges.  A group with more
    than ``CELL`` shingles is cut into blocks, and every two blocks are a cell
    of their own, so no task holds more than that and no pair is left out.
    """
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    # Both sides grow with the documents, so neither is ever broadcast.
    stars = stored(members.join(shared.select("bucket", "centre").hint("merge"), "bucket").select("centre", "node").distinct(), "stars")
    load = stars.join(sizes, "node").groupBy("centre").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    cells = stars.join(load, "centre", "left").fillna(1, ["blocks"]).select("centre", "node", own.alias("own"), other.alias("other")).select(
        "centre", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    whole = sets(stars.select("node").distinct()).select("node", "hashes")
    dealt = cells.join(whole.hint("merge"), "node").repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "node")
    found = forests(dealt, percent)
    return components(stored(found if known is None else found.unionByName(known), "edges"))


def forests(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join what is similar within each cell of ``dealt``, whose rows stand cell by cell."""
    schema = "a long, b long"
    kind = to_arrow(dealt.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held = None, [], []
        a, b = [], []

        def close() -> None:
            for x, y in similar(held, percent):
                a.append(min(nodes[x], nodes[y]))
                b.append(max(nodes[x], nodes[y]))

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            ids, cells = batch.column(3).to_pylist(), batch.column(4)
            values, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
            for i, now in enumerate(keys):
                if now != key:
                    close()
                    key, nodes, held = now, [], []
                own = values[ends[i]:ends[i + 1]]
                if nodes and nodes[-1] == ids[i] and np.array_equal(held[-1], own):
                    continue
                nodes.append(ids[i])
                # A copy: views would keep whole batches.
                held.append(own.copy())
            if a:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=kind)
                a, b = [], []
        close()
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=kind)

    return dealt.select("centre", "i", "j", "node", "hashes").mapInArrow(run, schema)


def similar(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest that joins the similar ones of some sets (each with distinct values): pairs of their places.

    A set is compared with all others at once, over lists of who has each of
    its values.  Those that are already joined need not be compared with each
    other, so sets of the largest component are left out while there is one.
    """
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if 100 * sizes.min() >= percent * sizes.max() else 0
        return [(0, 1)] if (100 + percent) * both >= percent * sizes.sum() and both else []
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    # Values of several sets: ``holders`` by value, and the values of each set.
    often = counts > 1
    holders = owner[np.repeat(often, counts)]
    counts = counts[often]
    begins = np.cumsum(counts) - counts
    by_set = np.argsort(holders, kind="stable")
    value_of = np.repeat(np.arange(len(counts)), counts)[by_set]
    met = np.bincount(holders, minlength=m)
    edge = np.append(0, np.cumsum(met))
    # What a set shares with all others bounds what it shares with one.
    able = 100 * met >= percent * sizes
    comp, done, out = np.arange(m), ~able, []

    def scan(x: int) -> None:
        own = value_of[edge[x]:edge[x + 1]]
        n = counts[own]
        at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=m)
        for y in np.flatnonzero(able & ((100 + percent) * both >= percent * (sizes + sizes[x]))).tolist():
            if comp[y] != comp[x]:
                low, high = sorted((comp[x], comp[y]))
                comp[comp == high] = low
                out.append((x, y))
        done[x] = True

    if able.any():
        scan(int(np.where(able, met, -1).argmax()))
    while True:
        left = np.flatnonzero(~done)
        todo = left[comp[left] != np.bincount(comp[left], minlength=1).argmax()] if len(left) else left
        if not len(todo):
            return out
        scan(int(todo[0]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: n_shingles, the smallest doc_id it is linked with, and whether it stays.

    Equal texts are one class before any bucket is made, so a group of copies
    is one node however large it is.  doc_id names a document: rows with one
    id are linked with each other and answered alike, also with other texts.

    Null and empty texts have an empty set, are linked with nothing and stay;
    rows without an id do so too, with a null component; an empty table gives
    an empty table; other columns of ``docs`` are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = stored(sketches(docs), "sketches")
    real = every.where("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    # One text of each class, found by id and digest.
    first = real.join(classes.select("d1", "d2", F.col("node").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    members = first.select(F.explode("buckets").alias("bucket"), F.col("doc_id").alias("node"))
    sizes = first.select(F.col("doc_id").alias("node"), "n")

    if every.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        docs = docs.dropDuplicates()

    def sets(nodes: DataFrame) -> DataFrame:
        return shingle_sets(docs, key_filter(nodes, "node"))

    linked = link(members, sizes, sets, one_id(real, classes))
    copies = classes.where("copies > 1").select("d1", "d2", F.col("node").alias("class"))
    named = every.join(copies, ["d1", "d2"], "left").withColumn(
        "node", F.when(F.col("n") > 0, F.coalesce("class", "doc_id")))
    return named.join(linked, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def one_id(real: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id and the nodes of its texts, for ids with several texts."""
    several = real.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("doc_id")
    return real.join(several, "doc_id").join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of linked documents the smallest id stays, columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*same_columns(docs))
