"""Substring dedup: paragraphs by MinHash bands and exact Jaccard, passages inside paragraphs by shared windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, free_name, key_filter, lower_ascii, map_rows, passes, prepare, same_columns, stored, to_arrow
from tabloom.llm.graphs import components
from tabloom.llm.near import SHINGLE, _probes, link, many_bands

MIN_WORDS = 50           # a passage that counts as repeated
# With independent values a pair at the threshold shares no bucket with a probability of 3e-8.
BANDS, VALUES = 32, 3
# Windows start at the smallest of SPREAD neighbouring shingle hashes.  Two texts that share
# WINDOW + SPREAD - 1 words, one less than MIN_WORDS, share one such window.  Windows are seeds:
# they tell where runs of MIN_WORDS words need to be compared.
WINDOW, SPREAD = 30, 20

UNITS = ("doc_id long, key long, start int, end int, win_key array<long>, "
         "line_key array<long>, line_start array<int>, line_end array<int>, "
         "new_key array<long>, new_n array<int>, new_buckets array<array<long>>")
# Bytes of a word that are read together, and what is left of them in a shorter one.
BLOCK = 8
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(BLOCK + 1)], np.uint64)
# Longer words get their key one by one.
BLOCK_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT1, _SHIFT2 = np.uint64(31), np.uint64(29)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD1
    x += b
    x ^= x >> _SHIFT1
    x *= _ODD2
    x ^= x >> _SHIFT2
    return x


def word_keys(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of ``raw``, all words' first blocks together, then the second ones of those that have them."""
    blocks = np.ndarray(len(raw) + 1, "<u8", raw + bytes(BLOCK), strides=(1,))
    sizes = ends - starts
    keys = _pair(blocks[starts] & _LEFT[np.minimum(sizes, BLOCK)], sizes.astype(np.uint64))
    some = np.flatnonzero((sizes > BLOCK) & (sizes <= BLOCK_WORD))
    at, left = starts[some] + BLOCK, sizes[some] - BLOCK
    while len(some):
        keys[some] = _pair(keys[some], blocks[at] & _LEFT[np.minimum(left, BLOCK)])
        more = left > BLOCK
        some, at, left = some[more], at[more] + BLOCK, left[more] - BLOCK
    for i in np.flatnonzero(sizes > BLOCK_WORD).tolist():
        keys[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]])
    return keys


def run_keys(keys: np.ndarray, n: int, powers: list[np.ndarray] | None = None) -> np.ndarray:
    """A hash of every ``n`` neighbouring keys, put together from runs of 1, 2, 4, ...

    ``powers`` keeps these runs for other calls with the same keys.
    """
    powers = [] if powers is None else powers
    if not powers:
        powers.append(keys)
    while len(powers) < n.bit_length():
        power, size = powers[-1], 1 << len(powers) - 1
        powers.append(_pair(power[:-size], power[size:]))
    out, have = None, 0
    for i, power in enumerate(powers[:n.bit_length()]):
        if n >> i & 1:
            out = power if out is None else _pair(out[:max(len(power) - have, 0)], power[have:])
            have += 1 << i
    return out[:max(len(keys) - n + 1, 0)]


class Words:
    """The words of a text, their places in characters, and a hash for each place where a shingle starts."""

    def __init__(self, text: str | None):
        raw = lower_ascii(text)
        self.raw, self.words = raw, raw.split()
        self.n = len(self.words)

    def places(self) -> None:
        data = np.frombuffer(self.raw, np.uint8)
        inside = ~_SPACE[data]
        edge = np.concatenate(([False], inside, [False]))
        borders = np.flatnonzero(edge[1:] != edge[:-1])
        first, last = borders[::2], borders[1::2]
        if self.raw.isascii():
            self.starts, self.ends = first, last
        else:
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            self.starts, self.ends = chars[first], chars[last]
        breaks = np.flatnonzero(data == 10)
        # Words before each line's end.
        self.line_ends = np.append(np.searchsorted(first, breaks), self.n)
        self.keys, self.powers = word_keys(self.raw, first, last), []
        self.hashes = self.runs(SHINGLE)

    def runs(self, n: int) -> np.ndarray:
        return run_keys(self.keys, n, self.powers)

    def digest(self, a: int, b: int) -> int:
        """A hash of words a to b - 1."""
        return xxhash.xxh3_64_intdigest(b" ".join(self.words[a:b])) - (1 << 63)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``size`` neighbours, from those of 2, 4, 8, ..."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the windows of a text with ``MIN_WORDS`` words or more."""
    places = words.n - WINDOW + 1
    h = words.hashes[:places]
    # A place is picked if it is the least of some SPREAD neighbours: the greatest of those neighbourhoods' least values is its own.
    least = _sliding(h, SPREAD, np.minimum)
    edge = np.zeros(SPREAD - 1, np.uint64)
    picked = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), SPREAD, np.maximum) == h)
    return words.runs(WINDOW)[picked].view(np.int64), picked


def paragraphs(words: Words) -> Iterator[tuple[int, int, int]]:
    """(key, first word, end) of the lines of ``MIN_WORDS`` words or more."""
    at = 0
    for end in words.line_ends.tolist():
        if end - at >= MIN_WORDS:
            yield words.digest(at, end), at, end
        at = end


def paragraph_set(words: Words, at: int, end: int) -> np.ndarray:
    return np.unique(words.hashes[at:end - SHINGLE + 1])


def units(docs: DataFrame) -> DataFrame:
    """Each text's extent, window keys and paragraphs; buckets of the distinct ones."""
    names = [x.split()[0] for x in UNITS.split(", ")]

    def run(rows: dict[str, list]) -> dict[str, list]:
        probes, out, sets = _probes(BANDS * VALUES, 64), {n: [] for n in names}, []
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            words = Words(text)
            if doc_id is None or words.n < MIN_WORDS:
                continue
            words.places()
            lines, seen = list(paragraphs(words)), {}
            for key, at, end in lines:
                if key not in seen:
                    seen[key] = paragraph_set(words, at, end)
            sets += seen.values()
            for name, value in zip(names, (
                    doc_id, words.digest(0, words.n), int(words.starts[0]), int(words.ends[-1]), windows(words)[0],
                    [x[0] for x in lines], [int(words.starts[x[1]]) for x in lines], [int(words.ends[x[2] - 1]) for x in lines],
                    list(seen), [len(x) for x in seen.values()], None)):
                out[name].append(value)
        # The buckets of all paragraphs at once.
        buckets = many_bands(sets, BANDS, VALUES, probes) if sets else np.zeros((0, BANDS), np.int64)
        ends = np.cumsum([len(x) for x in out["new_key"]])
        out["new_buckets"] = [list(buckets[a:b]) for a, b in zip([0, *ends[:-1]], ends)] if len(ends) else []
        return out

    return map_rows(docs.select("doc_id", "text"), run, UNITS)


def known(ids: list[int | None], cells: np.ndarray | None, taken: bool) -> list[int]:
    """Places of the ids that a filter lets through, or (``taken`` false) of the others; never of nulls."""
    there = np.array([i is not None for i in ids], bool)
    if cells is not None:
        there &= passes(cells, np.array([i or 0 for i in ids], np.int64)) == taken
    return np.flatnonzero(there).tolist()


RUNS = "doc_id long, key long, start int, end int"


def runs(docs: DataFrame, seeds: np.ndarray, aside: np.ndarray | None = None) -> DataFrame:
    """(doc_id, key, start, end) of all runs of ``MIN_WORDS`` words around windows that ``seeds`` lets through.

    Documents that ``aside`` lets through are left out.  Where ``docs`` has ``lost`` and ``until`` (begins and ends of disjoint spans), runs with a part in a span are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast((seeds, aside))
    holes = "lost" in docs.columns

    def run(rows: dict[str, list]) -> dict[str, list]:
        parts: list[list] = [[], [], [], []]
        seeds, aside = sent.value
        for i in known(rows["doc_id"], aside, False):
            doc_id, text = rows["doc_id"][i], rows["text"][i]
            words = Words(text)
            if words.n < MIN_WORDS:
                continue
            words.places()
            key, at = windows(words)
            at = at[passes(seeds, key)]
            if not len(at):
                continue
            # Places that lie in reach of a window.
            reach = np.zeros(words.n + 1, np.int32)
            np.add.at(reach, np.maximum(at - (MIN_WORDS - WINDOW), 0), 1)
            reach[at + 1] -= 1
            first = np.flatnonzero(np.cumsum(reach[:words.n - MIN_WORDS + 1]) > 0)
            if holes and rows["lost"][i]:
                # The first span that ends behind the run's start must begin behind its end.
                lost, until = np.append(np.sort(rows["lost"][i]), len(text)), np.sort(rows["until"][i])
                after = lost[np.searchsorted(until, words.starts[first], "right")]
                first = first[after >= words.ends[first + MIN_WORDS - 1]]
            for part, values in zip(parts, (np.full(len(first), doc_id), words.runs(MIN_WORDS)[first].view(np.int64),
                                            words.starts[first], words.ends[first + MIN_WORDS - 1])):
                part.append(values)
        return {n.split()[0]: np.concatenate(p) if p else [] for n, p in zip(RUNS.split(", "), parts)}

    return map_rows(docs.select("doc_id", "text", *(["lost", "until"] if holes else [])), run, RUNS)


SPANS = "doc_id long, start int, end int, source long"


def later(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, source) of the runs that a smaller document has too, ``source`` being the smallest."""
    kind = to_arrow(found.sparkSession, SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_source = None, None
        for batch in batches:
            key, doc, start, end = (batch.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            source = np.repeat(doc[first], np.diff(np.append(first, len(key))))
            if key[0] == last_key:
                source[:first[1] if len(first) > 1 else len(key)] = last_source
            last_key, last_source = key[-1], source[-1]
            at = doc != source
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (doc, start, end, source)], schema=kind)

    return found.repartition("key").sortWithinPartitions("key", "doc_id").select("key", "doc_id", "start", "end").mapInArrow(run, SPANS)


def paragraph_sets(docs: DataFrame, owners: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(node, hashes) of the paragraphs whose key, crossed with the document's id, ``wanted`` lets through.

    ``owners`` tells which documents are read for that.
    """
    sent = docs.sparkSession.sparkContext.broadcast((owners, wanted))

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"node": [], "hashes": []}
        owners, wanted = sent.value
        for i in known(rows["doc_id"], owners, True):
            words = Words(rows["text"][i])
            if words.n < MIN_WORDS:
                continue
            words.places()
            lines = {key: (at, end) for key, at, end in paragraphs(words)}
            keys = np.array(list(lines), np.int64)
            for key in keys[passes(wanted, keys ^ np.int64(rows["doc_id"][i]))].tolist():
                out["node"].append(key)
                out["hashes"].append(paragraph_set(words, *lines[key]).view(np.int64))
        return out

    return map_rows(docs.select("doc_id", "text"), run, "node long, hashes array<long>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, source_doc_id, component_id): what to cut from which text, in characters.

    The document with the smallest id keeps a passage; all others lose it.
    Spans of a document don't overlap; each names the smallest document that
    has (part of) the passage.  ``component_id`` joins documents that share
    passages, directly or over others.

    Paragraphs are lines of ``MIN_WORDS`` words or more.  Equal ones are one
    node; others collide in MinHash bands and are linked by the exact Jaccard
    index of their shingle sets.  As a repeated passage may stand inside
    different paragraphs, every run of ``MIN_WORDS`` words that a smaller
    document has too is cut, so a passage goes from its first word to its
    last.  Such a run holds a shared window of ``WINDOW`` words, whose starts
    depend on nearby words alone; only runs around these are made.  Equal
    documents are compared with others once.

    Texts are read where they are: which of them matter is told by filters of
    bounded size, and what passes by chance meets nothing later on.  Only
    texts that lose paragraphs are joined with what they lose.

    Paragraphs go first.  A document keeps runs for others only outside of
    the paragraphs that it loses, so each equal passage stays in a document.

    doc_id names a document: nothing is cut between rows with one id, and
    rows without an id are left alone.  Null, empty and short texts have
    nothing to cut; whole texts are read; an empty table gives an empty
    table; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = stored(units(docs), "units")
    classes = every.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last")
    copies = stored(every.join(classes.select("key", "source"), "key").where("doc_id <> source").select("doc_id", "start", "end", "source"), "copies")
    # doc_id names a document: rows with one id go together.
    gone = copies.select("doc_id").distinct()
    firsts = every.join(gone, "doc_id", "left_anti")

    lines = firsts.select("doc_id", F.inline(F.arrays_zip("line_key", "line_start", "line_end"))).toDF("doc_id", "key", "start", "end")
    nodes = stored(lines.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")), "paragraphs")
    # Each paragraph goes into its buckets once, from its first document.
    new = firsts.select("doc_id", F.inline(F.arrays_zip("new_key", "new_n", "new_buckets"))).toDF("source", "key", "n", "buckets")
    members = new.join(nodes.select("key", "source"), ["key", "source"]).select(
        F.explode("buckets").alias("bucket"), F.col("key").alias("node"))
    sizes = new.groupBy(F.col("key").alias("node")).agg(F.max("n").alias("n"))

    def sets(wanted: DataFrame) -> DataFrame:
        own = stored(nodes.join(wanted.select(F.col("node").alias("key")), "key", "left_semi").select(
            "source", F.col("key").bitwiseXOR(F.col("source")).alias("crossed")), "wanted")
        return paragraph_sets(docs, key_filter(own.select("source").distinct(), "source"), key_filter(own, "crossed"))

    linked = stored(link(members, sizes, sets), "linked")
    comp = nodes.join(linked.select(F.col("node").alias("key"), "component"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    first = comp.groupBy("component").agg(F.min("source").alias("source"), F.max("last").alias("last")).where("source < last")
    owner = comp.join(first.select("component", "source"), "component").select("key", first["source"])
    more = stored(merged(lines.join(owner, "key").where("doc_id <> source").select("doc_id", "start", "end", "source")), "cut-paragraphs")

    # What a paragraph's cut takes away can't be kept for others.
    shared = firsts.select("doc_id", F.explode("win_key").alias("key")).groupBy("key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    seeds = key_filter(stored(shared, "windows"))
    holes = more.groupBy("doc_id").agg(F.collect_list("start").alias("lost"), F.collect_list("end").alias("until"))
    aside = key_filter(gone.union(holes.select("doc_id")).distinct(), "doc_id")
    cut = later(runs(docs, seeds, aside).unionByName(runs(with_holes(docs, aside, gone, holes), seeds)))

    flat = stored(merged(cut.unionByName(more)), "spans")
    # What a copy's first document has lost to smaller ones, the copy has lost to them too.
    lost = flat.groupBy(F.col("doc_id").alias("source")).agg(F.min("source").alias("least"))
    flat = flat.unionByName(copies.distinct().join(lost, "source", "left").select("doc_id", "start", "end", F.least("source", "least").alias("source")))
    groups = components(flat.select(F.col("doc_id").alias("a"), F.col("source").alias("b")).distinct())
    return flat.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id").select(
        "doc_id", "start", "end", F.col("source").alias("source_doc_id"), F.col("component").alias("component_id"))


def only(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """The documents that a filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(cells)

    def run(rows: dict[str, list]) -> dict[str, list]:
        at = known(rows["doc_id"], sent.value, True)
        return {c: [v[i] for i in at] for c, v in rows.items()}

    return map_rows(docs, run, "doc_id long, text string")


def with_holes(docs: DataFrame, cells: np.ndarray, gone: DataFrame, holes: DataFrame) -> DataFrame:
    """The documents that a filter lets through and ``gone`` does not have, with what they lose.

    Neither side is broadcast: a task that reads texts here and looks for runs
    in them would hold two Python workers, and executors keep all they ever had.
    """
    return only(docs, cells).join(gone.hint("merge"), "doc_id", "left_anti").join(holes.hint("merge"), "doc_id", "left")


def merged(spans: DataFrame) -> DataFrame:
    """Each document's spans with overlapping and touching ones joined; the smallest source stays."""
    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "start": [], "end": [], "source": []}
        for doc_id, starts, ends, sources in zip(rows["doc_id"], rows["start"], rows["end"], rows["source"]):
            starts, ends, sources = np.array(starts), np.array(ends), np.array(sources)
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order])
            first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1] + 1))
            out["doc_id"] += [doc_id] * len(first)
            out["start"] += starts[first].tolist()
            out["end"] += np.maximum.reduceat(ends, first).tolist()
            out["source"] += np.minimum.reduceat(sources[order], first).tolist()
        return out

    lists = spans.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("start", "end", "source")])
    return map_rows(lists, run, "doc_id long, start int, end int, source long")


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages, with the same columns.

    A document left without words goes; ``n_chars`` is counted anew.
    """
    name = free_name(docs, "_cut")
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    schema = docs.schema

    def run(rows: dict[str, list]) -> dict[str, list]:
        cuts, keep = rows.pop(name), []
        for i, (text, cut) in enumerate(zip(rows["text"], cuts)):
            if cut:
                ends = [0] + [c["end"] for c in cut]
                text = "".join(text[a:b] for a, b in zip(ends, [c["start"] for c in cut] + [len(text)]))
                rows["text"][i] = text
                if "n_chars" in rows:
                    rows["n_chars"][i] = len(text)
                if not text.split():
                    continue
            keep.append(i)
        return {c: [v[i] for i in keep] for c, v in rows.items()}

    return map_rows(docs.join(spans, "doc_id", "left").select(*same_columns(docs), name), run, ddl(schema))
