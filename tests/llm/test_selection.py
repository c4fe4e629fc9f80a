"""Importance resampling, source mixing and phrase mining against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tabloom.llm import collocations, importance, mixing
from tabloom.llm.common import BATCH_ROWS

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.mark.parametrize("longest", [1, 3])
def test_crcs_from_prefixes(longest):
    rng = random.Random(1)
    texts = [[bytes(rng.choices(range(97, 123), k=rng.randrange(1, 40))) for _ in range(rng.randrange(0, 60))] for _ in range(20)]
    texts += [[], [b"x"], [b"a" * 70_000, "ünï".encode()]]
    number, crc = importance.ngram_crcs(texts, longest)
    got = Counter(zip(number.tolist(), crc.tolist()))
    assert got == Counter((t, zlib.crc32(b" ".join(w[i:i + n]))) for t, w in enumerate(texts) for n in range(1, longest + 1)
                          for i in range(len(w) - n + 1))
    assert len(importance.ngram_crcs([[]], longest)[0]) == 0


def plain_resample(rows, target, percent=10, longest=1, buckets=10_000, least=20, seed=2024):
    def own(text):
        w = word_list(text)
        return [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    every = [(i, own(t), len(word_list(t))) for i, t in rows]
    s = Counter(b for _, f, _ in every for b in f)
    t = Counter(b for x in target for b in own(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, f, n in every:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(drawn[:percent * len(drawn) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 60)])
def test_resample(spark, docs, texts, longest, percent):
    target = spark.createDataFrame([(1, texts[1], 5), (2, None, 5), (3, "", 5), (3, texts[15], 5)], "item_id int, text string, s int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs, target, percent=percent, longest=longest).collect()
    assert Counter(tuple(r) for r in got) == plain_resample(rows, [texts[1], texts[15]], percent, longest)


def test_resample_empty(spark, docs, nothing):
    assert importance.resample(nothing, docs).count() == 0
    got = importance.resample(docs, nothing)
    assert got.count() == docs.count()


def test_targets_stop_at_their_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, mixing.cycled_weights(sizes)).collect()}
    # Shares are given again until none is above its limit.
    left, want, weight = 1115.0, {}, {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    limit = {"a": 30, "b": 3000, "c": 300, None: 15, "z": 0}
    while True:
        open_ = {s: left * w / sum(weight[x] for x in weight if x not in want) for s, w in weight.items() if s not in want}
        full = {s: float(limit[s]) for s, x in open_.items() if x > limit[s]}
        if not full:
            break
        want |= full
        left -= sum(full.values())
    assert got == pytest.approx(want | open_)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", "w " * (rng.randrange(1, 60) if i % 50 else 5000)) for i in range(3000)]
    rows += [(5000, None, "a b c"), (None, "hot", "x y"), (5001, "s1", None), (5002, "none", ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, source string, text string, size int, place int, target double")
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, s, t in rows)
    taken, target, longest = Counter(), {}, {}
    for r in got:
        assert r.taken == r["size"] * r.copies <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())
    assert Counter(map(tuple, mixing.mix(docs.repartition(7)).collect())) == Counter(map(tuple, got))
    assert Counter(map(tuple, mixing.mix(docs, seed=2).collect())) != Counter(map(tuple, got))


def test_mix_odd(docs, nothing, spark):
    assert mixing.mix(nothing.withColumn("source", nothing.text)).count() == 0
    odd = mixing.mix(docs.withColumn("source", docs.shard)).collect()
    assert len(odd) == docs.count() and {r.copies for r in odd} == {1}


def test_chances_are_kept(spark):
    """Over many seeds a document is drawn about as often as its chance says."""
    rows = [(i, s, "w " * n) for s, lot in (("a", range(0, 40)), ("b", range(40, 44))) for i in lot for n in [1 + i % 8]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {i: len(t.split()) for i, _, t in rows}
    drawn, runs = Counter(), 12
    for seed in range(runs):
        for r in mixing.mix(docs, seed=seed).collect():
            if r.source == "a":
                drawn[r["size"]] += r.copies
    big = sum(drawn[n] for n in (7, 8)) / sum(1 for i in range(40) if sizes[i] in (7, 8)) / runs
    small = sum(drawn[n] for n in (1, 2)) / sum(1 for i in range(40) if sizes[i] in (1, 2)) / runs
    assert big > small


def test_mix_stays_in_the_jvm(docs):
    plan = mixing.mix(docs.withColumn("source", docs.shard))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_collocations(rows, least, top, longest):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i:i + m])] += 1
    often = {k: v for k, v in count.items() if v >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = any(often.get((lang, q), 0) >= a for q in {x for (g, x) in often if g == lang and len(x) > len(p)
                                                            and any(x[i:i + len(p)] == p for i in range(len(x)))})
        if not inside:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, every in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1)}


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(11)
    fixed = [["new", "york", "city"], ["ad", "hoc"], ["a", "b", "c", "d", "e", "f"], ["the", "ünï"], ["x y", "z"]]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(5, 60)):
            w += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(["the", "of", "The", "a"]) if rng.random() < 0.5 else f"v{int(rng.paretovariate(0.7))}"]
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".\r"]) for x in w)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    rows += [("en", None), ("en", ""), ("fr", " , . "), rows[0], rows[0], ("en", "new york city " * 300)]
    return rows


@pytest.mark.parametrize("least, top, longest", [(4, 2000, 5), (4, 12, 5), (3, 3, 4), (6, 1, 3), (4, 40, 2)])
def test_collocations(spark, phrases, least, top, longest):
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in phrases], "lang string, text string, n int, rank int, key string").repartition(4)
    got = collocations.collocations(df, least, top, longest).collect()
    assert {tuple(r) for r in got} == plain_collocations(phrases, least, top, longest)
    assert len(got) == len({(r.lang, r.rank) for r in got})


def test_collocations_of_many_words(spark):
    """First words of the second lot that pass the first one's filter by chance are found once."""
    rows = [("en", ". ".join(f"w{i}" for i in range(4000))) for _ in range(4)] + [("en", ". ".join(f"h{i} t{i}" for i in range(200))) for _ in range(16)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 4, 2000, 3).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, 4, 2000, 3))


def test_collocations_odd(spark, docs, nothing):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(docs, 10**6).count() == 0


def test_chunks_end_at_breaks():
    rng = random.Random(2)
    keys = collocations.np.array([rng.choice([0, 5, 6, 7, 8, 9]) for _ in range(50_000)])
    parts = collocations.chunks(keys)
    assert len(parts) > 3 and (collocations.np.concatenate(parts) == keys).all() and all(p[0] == 0 for p in parts[1:])


def test_collocations_rows_are_short(spark):
    """Whatever number of rows an Arrow batch holds, their keys stay within a few MB."""
    text = ". ".join(f"a{i} b{i} c{i}" for i in range(30_000))
    rows = collocations.tokens(spark.createDataFrame([("en", text), (None, text)], "lang string, text string")).select("lang", "keys").collect()
    assert max(len(r["keys"]) for r in rows) * BATCH_ROWS * 8 < 8 << 20
    for lang in ("en", "und"):
        keys = [k for r in rows if r["lang"] == lang for k in r["keys"]]
        assert sum(k != 0 for k in keys) == 90_000


def test_collocations_scan(spark):
    """All keys reach the work, with a break behind each row, and no more at once than are counted together."""
    rows = spark.createDataFrame([(list(range(2, 300)),)] * 2000, "keys array<long>").coalesce(1)

    def work(keys):
        yield [collocations.np.array([len(keys)]), collocations.np.array([int((keys == 0).sum())])]

    seen = collocations.scan(rows, work, "n long, breaks long").collect()
    assert sum(r["n"] for r in seen) == 2000 * 299 and sum(r["breaks"] for r in seen) == 2000
    assert max(r["n"] for r in seen) <= collocations.COUNT_WINDOWS + 299
