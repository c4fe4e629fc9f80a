"""Benchmark decontamination: one automaton over all test windows, one scan of each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import PLAIN, ddl, map_rows, plain_words, prepare, stored, worker_state

WINDOW = 10
# Benchmark text that makes up one automaton; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 16_000_000

SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
RESULT = f"n_words long, n_hit long, items array<string>, spans {SPANS}"


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The windows of one item, each with a space at both ends, a byte as a character."""
    words = plain_words(text)
    if not words:
        return set()
    return {f" {b' '.join(words[i:i + size]).decode('latin-1')} " for i in range(max(1, len(words) - size + 1))}


def held(name: str, part: list[tuple[str, str]], size: int) -> ahocorasick.Automaton | None:
    """The automaton of a block, built once in a worker process."""
    state = worker_state("decontaminate")
    if getattr(state, "automaton", (None,))[0] != (name, size):
        state.automaton = ((name, size), automaton(part, size))
    return state.automaton[1]


def automaton(items: list[tuple[str, str]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    """One automaton over the windows of (item id, text); a hit tells words and item ids."""
    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w, (w.count(" ") - 1, tuple(ids)))
    found.make_automaton()
    return found


def offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in characters of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(text.encode().translate(PLAIN), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return chars[np.flatnonzero(edges == 1)], chars[np.flatnonzero(edges == -1)]


def scan(text: str | None, search: ahocorasick.Automaton | None) -> tuple[int, int, list[str], list[tuple]]:
    """Words, words hit, items found, and the runs of hit words with their place in the text."""
    words = plain_words(text)
    if not words or search is None:
        return len(words), 0, [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    ends, items = [], set()
    for at, (n, ids) in search.iter(line):
        ends.append((at, n))
        items.update(ids)
    if not ends:
        return len(words), 0, [], []
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    change = np.zeros(len(words) + 1, np.int64)
    for at, n in ends:
        last = int(np.searchsorted(gaps, at))  # the gap behind the window's last word
        change[last - n] += 1
        change[last] -= 1
    hit = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    starts, stops = offsets(text)
    runs = [{"first": int(a), "last": int(b) - 1, "start": int(starts[a]), "end": int(stops[b - 1])}
            for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]
    return len(words), int(hit.sum()), sorted(items), runs


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark as lists of (id, text) of a bounded size each.

    The number of blocks follows from the benchmark's size, which is summed
    up first; only one block at a time is on the driver.
    """
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
                            ).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.toLocalIterator()]


def find_benchmarks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                    item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark windows occur in ``docs``: doc_id, words, hit words, item ids, spans.

    A text is scanned once for each block of the benchmark; with one block
    there is no shuffle.  Further blocks are joined by a row number, as ids
    may repeat.

    Null and empty texts have no words and no hits; items without words match
    nothing; an item id of null counts as an empty id; repeated rows give
    repeated results; an empty benchmark finds nothing; other columns of
    either table are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text).alias("text"))

    def search(part: list[tuple[str, str]], rows: DataFrame, keys: list[str]) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batch: dict[str, list]) -> dict[str, list]:
            own = held(name, sent.value, size)
            found = [scan(t, own) for t in batch["text"]]
            return {k: batch[k] for k in keys} | {n: [f[i] for f in found] for i, n in enumerate(
                ("n_words", "n_hit", "items", "spans"))}

        return map_rows(rows, run, ", ".join(f"{k} long" for k in keys) + f", {RESULT}")

    parts = blocks(benchmark, item, item_text, block_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return search(first, rows, ["doc_id"])

    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    every = search(first, rows, ["row", "doc_id"]).unionByName(search(second, rows, ["row", "doc_id"]))
    for part in parts:
        every = every.unionByName(search(part, rows, ["row", "doc_id"]))
    merged = every.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    return merged.select("doc_id", "n_words", *_joined(F.col("all")), "items").select(
        "doc_id", "n_words", "n_hit", "items", "spans")


def _joined(spans):
    """Overlapping and touching runs of several blocks as one; the words they hold."""
    empty = F.array().cast(SPANS)

    def add(done, x):
        last = F.element_at(done, -1)
        grow = (F.size(done) > 0) & F.coalesce(x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1, F.lit(False))
        wide = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
                        last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(grow, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wide))).otherwise(
            F.concat(done, F.array(x))).cast(SPANS)

    merged = F.aggregate(spans, empty, add)
    words = F.aggregate(merged, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return words.alias("n_hit"), merged.alias("spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, columns unchanged.

    One pass: each row carries its own verdict, so nothing is joined back.
    """
    spark = prepare(docs.sparkSession)
    kept = docs
    for part in blocks(benchmark, "item_id", "text", BLOCK_BYTES):
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batch: dict[str, list], sent=sent, name=name) -> dict[str, list]:
            own = held(name, sent.value, WINDOW)
            clean = [i for i, t in enumerate(batch["text"]) if not scan(t, own)[1]]
            return {c: [v[i] for i in clean] for c, v in batch.items()}

        kept = map_rows(kept, run, ddl(docs.schema))
    return kept
