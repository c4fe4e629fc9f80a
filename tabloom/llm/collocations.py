"""Phrase mining: best-first growth of prefixes, bounded by prefix counts, until every language's last place is settled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import key_filter, lower_ascii, map_rows, passes, prepare, stored, to_arrow

LONGEST = 5              # words of a phrase
MIN_COUNT = 100
TOP = 2000
# The share of a language's words whose best-bounded first words are grown first; then follows what the bounds leave.
FIRST_SHARE = 0.25
# Words of one row of keys, and windows that a task counts together.  Readers and Arrow batches hold
# a number of rows whatever their length, so rows are short.
CHUNK_WORDS = 512
COUNT_WINDOWS = 1 << 18
SALTS = 32

_BREAKS = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in range(256))
_BREAK, _NONE = 0, 1     # keys that stand for the end of a piece and for no word


def key_of(word: bytes, seed: int) -> int:
    """A signed 64-bit key of a word in a language; two values are set aside."""
    key = xxhash.xxh3_64_intdigest(word, seed) - (1 << 63)
    return key if key not in (_BREAK, _NONE) else 2


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase from the key of all its words but the last, and the last word's."""
    x = prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def tokens(docs: DataFrame) -> DataFrame:
    """(lang, keys, vocab): runs of word keys with breaks between pieces, and the words behind the keys with their counts."""
    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "keys": [], "vocab": []}
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(rows["lang"], rows["text"]):
            if text:
                by_lang.setdefault(lang if lang is not None else "und", []).append(lower_ascii(text))
        for lang, texts in by_lang.items():
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            found = b"\n".join(texts).translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")
            counts = Counter(found)
            counts.pop(b"", None)
            counts.pop(b"\n", None)
            key = {w: key_of(w, seed) for w in counts}
            vocab = [{"key": k, "word": w.decode(), "n": counts[w]} for w, k in key.items()]
            key[b""], key[b"\n"] = _NONE, _BREAK
            keys = np.fromiter(map(key.__getitem__, found), np.int64, len(found))
            keys = keys[keys != _NONE]
            for part in chunks(keys):
                out["lang"].append(lang)
                out["keys"].append(part)
                out["vocab"].append(vocab)
                vocab = []
        return out

    return map_rows(docs.select("lang", "text"), run, "lang string, keys array<long>, vocab array<struct<key:long,word:string,n:long>>")


def chunks(keys: np.ndarray) -> list[np.ndarray]:
    """``keys`` cut at breaks into parts of about ``CHUNK_WORDS``."""
    breaks = np.flatnonzero(keys == _BREAK)
    ends = np.append(breaks[np.flatnonzero(np.diff(breaks // CHUNK_WORDS, prepend=0))], len(keys))
    starts = np.concatenate(([0], ends[:-1]))
    return [keys[a:b] for a, b in zip(starts, ends) if b > a]


def scan(rows: DataFrame, work: Callable[[np.ndarray], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """Apply ``work`` to the keys of each batch of ``rows``, put in a row with breaks between."""
    kind = to_arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            for columns in work(keys):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

        for batch in batches:
            for cell in batch.column(0):
                keys = cell.values.to_numpy()
                held += [keys, np.zeros(1, np.int64)]
                size += len(keys) + 1
                if size >= COUNT_WINDOWS:
                    yield from done()
                    size = 0
        if held:
            yield from done()

    return rows.select("keys").mapInArrow(run, schema)


def words_left(keys: np.ndarray) -> np.ndarray:
    """How many words there are from each place to the end of its piece."""
    ends = np.append(np.flatnonzero(keys == _BREAK), len(keys))
    return np.repeat(ends, np.diff(ends, prepend=-1))[:len(keys)] - np.arange(len(keys))


def counted(rows: DataFrame, first: np.ndarray, prefixes: list[np.ndarray], word: np.ndarray, size: int) -> DataFrame:
    """(key, f) of the windows of ``size`` words that grow from ``prefixes`` (by their words: 2, 3, ...)."""
    sent = rows.sparkSession.sparkContext.broadcast((first, prefixes, word))

    def work(keys: np.ndarray) -> Iterator[list[np.ndarray]]:
        first, prefixes, word = sent.value
        good = passes(word, keys)
        at = np.flatnonzero((words_left(keys) >= size) & passes(first, keys))
        own = keys[at]
        for n in range(2, size + 1):
            keep = good[at + n - 1]
            at, own = at[keep], own[keep]
            own = joined(own, keys[at + n - 1])
            if n < size:
                keep = passes(prefixes[n - 2], own)
                at, own = at[keep], own[keep]
        found, times = np.unique(own, return_counts=True)
        yield [found, times]

    return scan(rows, work, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def described(rows: DataFrame, first: np.ndarray, wanted: list[np.ndarray], longest: int) -> DataFrame:
    """What surrounds each wanted phrase: its words' keys, and the least and greatest key next to it on both sides."""
    sent = rows.sparkSession.sparkContext.broadcast((first, wanted))
    names = [f"w{i + 1}" for i in range(longest)]

    def work(keys: np.ndarray) -> Iterator[list[np.ndarray]]:
        first, wanted = sent.value
        left, last = words_left(keys), len(keys) - 1
        at = np.flatnonzero((left >= 2) & passes(first, keys))
        own = keys[at]
        for n in range(2, longest + 1):
            own = joined(own, keys[at + n - 1])
            keep = passes(wanted[n - 2], own)
            at, own = at[keep], own[keep]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            place, key = at[order], own[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            before = np.where(place > 0, keys[np.maximum(place - 1, 0)], _BREAK)
            after = np.where(place + n <= last, keys[np.minimum(place + n, last)], _BREAK)
            some = place[starts]
            yield [key[starts], np.full(len(starts), n), *[keys[some + i] if i < n else np.zeros(len(starts), np.int64) for i in range(longest)],
                   np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts),
                   np.minimum.reduceat(after, starts), np.maximum.reduceat(after, starts)]
            keep = left[at] > n
            at, own = at[keep], own[keep]

    schema = "key long, size int, " + ", ".join(f"{n} long" for n in names) + ", before_lo long, before_hi long, after_lo long, after_hi long"
    return scan(rows, work, schema).groupBy("key").agg(
        F.max("size").alias("size"), *[F.max(n).alias(n) for n in names], F.min("before_lo").alias("before_lo"),
        F.max("before_hi").alias("before_hi"), F.min("after_lo").alias("after_lo"), F.max("after_hi").alias("after_hi"))


def cuts(phrases: DataFrame, longest: int) -> DataFrame:
    """(key, k, head, tail, tail_size): a phrase's cuts with the keys of both parts."""
    names = [f"w{i + 1}" for i in range(longest)]

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {n: [] for n in ("key", "k", "head", "tail", "tail_size")}
        size = np.array(rows["size"])
        words = np.array([rows[n] for n in names], np.int64)
        key = np.array(rows["key"], np.int64)
        for n in range(2, longest + 1):
            own = np.flatnonzero(size == n)
            head = words[0, own]
            for k in range(1, n):
                tail = words[k, own]
                for i in range(k + 1, n):
                    tail = joined(tail, words[i, own])
                for name, values in zip(out, (key[own], [k] * len(own), head, tail, [n - k] * len(own))):
                    out[name] += list(values)
                head = joined(head, words[k, own])
        return out

    return map_rows(phrases.select("key", "size", *names), run, "key long, k int, head long, tail long, tail_size int")


def tails(rows: DataFrame, word: np.ndarray, wanted: list[np.ndarray | None]) -> DataFrame:
    """(key, f) of the phrases that ``wanted`` (by their words: 2, 3, ...) lets through."""
    sent = rows.sparkSession.sparkContext.broadcast((word, wanted))

    def work(keys: np.ndarray) -> Iterator[list[np.ndarray]]:
        word, wanted = sent.value
        good, left = passes(word, keys), words_left(keys)
        at = np.flatnonzero(good)
        own, found = keys[at], []
        for n, only in enumerate(wanted, 2):
            keep = (left[at] >= n) & good[np.minimum(at + n - 1, len(keys) - 1)]
            at, own = at[keep], own[keep]
            own = joined(own, keys[at + n - 1])
            if only is not None:
                found.append(own[passes(only, own)])
        key, times = np.unique(np.concatenate(found), return_counts=True)
        yield [key, times]

    return scan(rows, work, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def frontier(words: DataFrame, min_count: int) -> DataFrame:
    """``words`` with ``lot``: 0 for the rarest, best-bounded ones with ``FIRST_SHARE`` of a language's words, else 1.

    Words whose counts have the same power of two stay together, so a
    language is some dozen rows.
    """
    band = F.floor(F.log2(F.col("f") / float(min_count)))
    rows = words.withColumn("band", band)
    up = Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    shares = rows.groupBy("lang", "band").agg(F.sum("f").alias("x")).withColumn("upto", F.sum("x").over(up)).withColumn(
        "all", F.sum("x").over(Window.partitionBy("lang"))).withColumn("least", F.min("band").over(Window.partitionBy("lang")))
    lots = shares.select("lang", "band", F.when((F.col("upto") <= FIRST_SHARE * F.col("all")) | (F.col("band") == F.col("least")), 0).otherwise(1).alias("lot"))
    return rows.join(lots, ["lang", "band"]).drop("band")


def grow(rows: DataFrame, words: DataFrame, word: np.ndarray, starts: DataFrame, known: DataFrame, min_count: int, longest: int
         ) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases whose first word is in ``starts`` that stay, with their scores; and all counts known then."""
    first, prefixes, new = key_filter(starts), [], None
    for size in range(2, longest + 1):
        found = stored(counted(rows, first, prefixes, word, size).where(F.col("f") >= min_count), "phrases")
        prefixes.append(key_filter(found))
        new = found if new is None else new.unionByName(found)
    # Some may have been counted as tails before.
    counts = known.unionByName(new.join(known, "key", "left_anti"))
    # First words that pass the filter by chance are grown in their own lot, if at all.
    around = stored(described(rows, first, prefixes, longest).join(new, "key").join(starts.select(F.col("key").alias("w1")), "w1", "left_semi"), "around")
    cut = stored(cuts(around, longest), "cuts")
    # Tails begin with other words; those not grown yet are counted on their own.
    missing = stored(cut.where("tail_size > 1").select(F.col("tail").alias("key"), F.col("tail_size").alias("size")).distinct().join(
        counts, "key", "left_anti"), "missing")
    sizes = {r["size"] for r in missing.select("size").distinct().toLocalIterator()}
    if sizes:
        wanted = [key_filter(missing.where(F.col("size") == n)) if n in sizes else None for n in range(2, longest)]
        extra = stored(tails(rows, word, wanted).join(missing.select("key"), "key", "left_semi"), "tails")
    else:
        extra = known.limit(0)
    counts = stored(counts.unionByName(extra), "counts")
    f = lambda name: counts.select(F.col("key").alias(name), F.col("f").alias(f"f_{name}"))
    total = words.select(F.col("key").alias("w1"), "lang", "n")
    wide = lambda c: F.col(c).cast("decimal(14,0)")
    scored = cut.join(around.select("key", "w1", F.col("f").alias("a")), "key").join(total, "w1").join(f("head"), "head").join(f("tail"), "tail").select(
        "key", "lang", "n", "a", "k", F.col("f_head").alias("l"), F.col("f_tail").alias("r")).withColumn(
        "score", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("score div cast(cast(l as decimal(14,0)) * cast(r as decimal(14,0)) as decimal(38,0))"))
    best = scored.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("b")).select("key", "b.*")
    same = lambda side: (F.col(f"{side}_lo") == F.col(f"{side}_hi")) & (F.col(f"{side}_lo") != _BREAK)
    inside = (F.col("size") < longest) & (same("before") | same("after"))
    return stored(best.join(around.where(~inside).drop("f"), "key"), "scored"), counts


def top(rows: DataFrame, order: list, n: int) -> DataFrame:
    """Each language's first ``n`` rows, with ``rank``; parts of a language are cut down first."""
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    part = rows.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(
        F.col("rank") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n).drop("_salt")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, n: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Each language's first ``n`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase that grows from a first word with count f scores at most
    1000 * n / f, as its first cut divides by f and by a tail at least as
    frequent as itself.  First words with the best bounds are grown first, word by
    word over frequent prefixes only; then those whose bound still
    reaches a language's last place, ties included.  What is left can't
    change the result, and is never counted.

    A phrase drops out if a longer one is as frequent.  Then so is one with a
    single word more, that is, all its occurrences have the same word before
    or behind them.

    Phrases are counted by 64-bit keys; scores are exact integers.  Tasks test
    windows against filters of bounded size, and exact joins follow.

    A null text has no words, a null language is ``und``, repeated rows count
    each time, ties are in order of the phrase's bytes; an empty table gives
    an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = stored(tokens(docs), "tokens")
    vocab = rows.select("lang", F.inline("vocab"))
    counts = stored(vocab.groupBy("lang", "key").agg(F.sum("n").alias("f")), "vocab")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= min_count)
    # Texts of words are only looked up for those that count.
    spelt = vocab.join(often.select("lang", "key"), ["lang", "key"], "left_semi").select("lang", "key", "word").distinct().groupBy("lang", "key").agg(
        F.min("word").alias("word"))
    words = stored(often.join(spelt, ["lang", "key"]).join(totals, "lang").withColumn("bound", F.expr("1000 * n div f")), "words")
    words = stored(frontier(words, min_count), "frontier")
    word, counts, found = key_filter(words), words.select("key", "f"), None
    order = [F.col("score").desc(), F.col("a").desc()]
    for lot in (0, 1):
        starts = words.where(F.col("lot") == lot)
        if found is not None:
            last = top(found, [*order, F.col("key")], n).where(F.col("rank") == n).select("lang", F.col("score").alias("least"))
            starts = starts.join(last, "lang", "left").where("least is null or bound >= least").select(*words.columns)
        starts = stored(starts, "starts")
        if starts.isEmpty():
            continue
        more, counts = grow(rows, words, word, starts, counts, min_count, longest)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return words.select("lang", F.lit(0).alias("rank"), F.col("word").alias("phrase"), F.col("f").alias("a"), F.col("f").alias("l"),
                            F.col("f").alias("r"), "n", F.col("bound").alias("score")).where("false").withColumn("rank", F.col("rank").cast("long"))
    # All that reach a language's last place, ties included, get their words.
    last = top(found, [*order, F.col("key")], n).groupBy("lang").agg(F.min("score").alias("least"))
    final = stored(found.join(last, "lang").where("score >= least"), "final")
    spelled = final.select("key", F.posexplode(F.slice(F.array(*[f"w{i + 1}" for i in range(longest)]), 1, F.col("size"))).alias("at", "w")).join(
        words.select(F.col("key").alias("w"), "word"), "w").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return top(final.join(spelled, "key"), [*order, F.col("phrase")], n).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
