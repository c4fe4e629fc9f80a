"""Best-fit packing by linear grouping: few sizes, configurations, substitution, small pieces last."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, numbered, prepare, stored
from tabloom.llm.tokens import END, default_path, encoder

CAPACITY = 1024
GROUPS = 64          # sizes that large pieces are rounded up to
LARGE = 4            # a large piece takes more than a LARGE-th of a sequence, so under LARGE of them fit

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full, but for a shorter first one."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """The pieces of every document's ids, an end id included."""
    tokenizer = tokenizer or default_path()
    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {n: [] for n in names}
        for doc_id, ids in zip(rows["doc_id"], encoder(tokenizer).encode_many(rows["text"])):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for k, (a, n) in enumerate(cut(len(ids), capacity)):
                part = ids[a:a + n]
                for name, value in zip(names, (doc_id, k, a, n, zlib.crc32(part.tobytes()), part.astype(np.int32))):
                    out[name].append(value)
        return out

    return map_rows(docs.select("doc_id", "text"), run, PIECE + ", ids array<int>" * with_ids)


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: lengths from the largest down in groups of equal cardinality, as (length, count).

    A length with twice a group's share or more is a group alone, so nothing
    is rounded up to or from it.
    """
    total = sum(counts.values())
    alone = {k for k, n in counts.items() if n * groups >= 2 * total}
    rest = {k: n for k, n in counts.items() if k not in alone}
    total, groups = sum(rest.values()), max(1, groups - len(alone))
    out: list[list[tuple[int, int]]] = [[]]
    taken = 0
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = (total * len(out)) // groups - taken
            if room <= 0:
                out.append([])
                continue
            n = min(left, room)
            out[-1].append((length, n))
            taken, left = taken + n, left - n
    merged: list[list[tuple[int, int]]] = []
    for group in filter(None, out):
        # Neighbours that round up to one size are one group.
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    return merged + [[(k, counts[k])] for k in sorted(alone, reverse=True)]


def configurations(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """All multisets of size numbers that fit."""
    most = capacity // min(sizes)
    return [c for k in range(1, most + 1) for c in combinations_with_replacement(range(len(sizes)), k)
            if sum(sizes[i] for i in c) <= capacity]


def best_mix(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which configuration so that all demand is met.

    The linear program over all configurations is solved by the simplex
    method, starting from one size for each sequence; whole parts are taken
    and first fit decreasing covers the rest.
    """
    configs = configurations(sizes, capacity)
    columns = np.zeros((len(sizes), len(configs)))
    for j, c in enumerate(configs):
        for i in c:
            columns[i, j] += 1
    # Configurations come by length, so the first ones hold one size each.
    basis, amounts = list(range(len(sizes))), np.array(demand, float)
    for _ in range(50 * len(sizes)):
        own = columns[:, basis]
        price = np.linalg.solve(own.T, np.ones(len(sizes)))
        value = price @ columns
        enter = int(np.argmax(value))
        if value[enter] <= 1 + 1e-9:
            break
        step = np.linalg.solve(own, columns[:, enter])
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        amounts = np.maximum(amounts - step * ratio[leave], 0)
        amounts[leave] = ratio[leave]
        basis[leave] = enter
    left = list(demand)
    mix = []
    for j, x in zip(basis, amounts):
        c = configs[j]
        n = int(x + 1e-6)
        need = {i: c.count(i) for i in c}
        n = min([n, *(left[i] // k for i, k in need.items())])
        if n > 0:
            mix.append((c, n))
            for i, k in need.items():
                left[i] -= k * n
    # First fit decreasing over what is left: as many equal sequences at once as there are pieces for.
    while any(left):
        c, room, now = [], capacity, list(left)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = min(now[i], room // sizes[i])
            c += [i] * k
            room -= k * sizes[i]
        n = min(left[i] // c.count(i) for i in set(c))
        mix.append((tuple(c), n))
        for i in c:
            left[i] -= n
    return mix


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal sequences: (number of sequences, lengths in it).

    Works on the counts of lengths alone, of which there are ``capacity`` at
    most, so neither time nor size depend on the number of documents.
    """
    runs: list[tuple[int, tuple[int, ...]]] = []
    if counts.get(capacity):
        runs.append((counts[capacity], (capacity,)))
    large = {k: n for k, n in counts.items() if capacity // LARGE < k < capacity and n}
    small = {k: n for k, n in counts.items() if k <= capacity // LARGE and n}
    open_runs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    if large:
        stock = grouped(large, min(groups, sum(large.values())))
        sizes = [g[0][0] for g in stock]
        for config, n in best_mix(sizes, [sum(c for _, c in g) for g in stock], capacity):
            # Actual pieces take the places of the rounded sizes; where a length ends, a run ends.
            taken = [_take(stock[i], n) for i in config]
            done = 0
            while done < n:
                step = min(t[0][1] for t in taken)
                lengths = tuple(t[0][0] for t in taken)
                open_runs[capacity - sum(lengths)].append((step, lengths))
                for t in taken:
                    t[0] = (t[0][0], t[0][1] - step)
                    if not t[0][1]:
                        t.pop(0)
                done += step
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            fits = [r for r in open_runs if r >= length and open_runs[r]]
            if fits:
                room = min(fits)
                n, lengths = open_runs[room].pop()
            else:
                room, n, lengths = capacity, -(-left // (capacity // length)), ()
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                open_runs[room - each * length].append((full, lengths + (length,) * each))
            if rest:
                open_runs[room - rest * length].append((1, lengths + (length,) * rest))
            if n - full - bool(rest):
                # Only sequences that were open before can be left over.
                open_runs[room].append((n - full - bool(rest), lengths))
            left -= full * each + rest
    return runs + [run for room in sorted(open_runs) for run in open_runs[room]]


def _take(stock: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out = []
    while n:
        length, have = stock[0]
        got = min(n, have)
        out.append((length, got))
        n -= got
        if got == have:
            stock.pop(0)
        else:
            stock[0] = (length, have - got)
    return out


def places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, sequence and offset of each stretch of pieces."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, lengths in runs:
        at = 0
        for length in lengths:
            found[length].append((used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END,
         with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Pieces are numbered within their length, in blocks; a piece's number
    tells its sequence by the plan, so the packing itself needs no shuffle of
    ids and no task sees more than a block.

    A null or empty text is one end id; repeated rows are packed each; null
    ids are packed like others; an empty table gives an empty table; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    cut_up = stored(pieces(docs, capacity, tokenizer, end, with_ids), "pieces")
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(counts, capacity))
    # By length, how many pieces have it.
    sizes = F.array(*[F.lit(counts.get(k, 0)).cast("long") for k in range(capacity + 1)])
    ranked = numbered(cut_up, F.col("length"), F.get(sizes, F.col("length").cast("int")), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")

    def run(rows: dict[str, list]) -> dict[str, list]:
        length, rank = np.array(rows["length"]), np.array(rows.pop("rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            first, seq, at = where[int(k)]
            own = np.flatnonzero(length == k)
            i = np.searchsorted(first, rank[own], "right") - 1
            sequence[own] = seq[i] + rank[own] - first[i]
            offset[own] = at[i]
        return rows | {"sequence_id": sequence, "offset": offset}

    return map_rows(ranked, run, PIECE + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed ``with_ids``; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
