"""Near duplicates, repeated passages, components and shards against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import graphs, near, passages, shards


def brute(texts, percent=75):
    sets = {i: set(near.shingles(near.text_words(t)).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs, texts, nothing):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got.pop(None)[1:] == (None, True)
    assert got == brute(texts)
    assert near.near_duplicates(nothing).count() == 0


def test_chains(spark):
    """A chain of texts, each like the next only, and a star of copies with different edits, in one component each."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts, now = {}, list(base)
    for i in range(40):
        now[rng.randrange(120)] = f"c{i}"
        texts[i] = " ".join(now)
    for i in range(40):
        own = [f"s{k}" for k in range(120)]
        for k in rng.sample(range(120), 2):
            own[k] = f"e{i}-{k}"
        texts[100 + i] = " ".join(own)
    got = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts)


def test_keep_one(docs, texts):
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, v in brute(texts).items() if v[2]}


def test_bands_of_many_sets():
    """Many at once are the same as one by one, also where few bins are full."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) << np.uint64(1)) for n in (1, 2, 3, 5, 40, 96, 400, 3000, 1, 7)]
    for bands, values in ((48, 4), (32, 3)):
        for tries in (64, 2):
            probes = near._probes(bands * values, tries)
            got = near.many_bands(sets, bands, values, probes)
            assert all((row == near.bands_of(s, bands, values, probes)).all() for row, s in zip(got, sets))


def test_recall_of_bands():
    """Pairs at the threshold share a bucket."""
    rng, missed = np.random.default_rng(5), 0
    probes = near._probes(near.BANDS * near.VALUES, 64)
    for _ in range(300):
        n = int(rng.integers(8, 400))
        both = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        extra = rng.integers(0, 2**63, 2 * (n // 6), dtype=np.int64).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, e))) for e in np.split(extra, 2))
        x, y = (near.bands_of(s, near.BANDS, near.VALUES, probes) for s in (a, b))
        missed += not (x == y).any()
    assert missed <= 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 50)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (300, 299)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_passages(docs, texts, nothing):
    rows = passages.repeated_passages(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # 2, 3 and 4 repeat 1; 11 repeats a passage inside 10's paragraph; all others are clean.
    assert set(by) == {2, 3, 4, 11} and {r.source_doc_id for r in rows if r.doc_id == 4} == {1}
    assert by[2][0].start == 0 and by[2][0].end == len(texts[2])
    cut = by[11][0]
    assert texts[11][cut.start:cut.end] in texts[10] and len(texts[11][cut.start:cut.end].split()) >= 30
    assert passages.repeated_passages(nothing).count() == 0
    clean = {r.doc_id: r for r in passages.cut_passages(docs).collect()}
    assert not {2, 4} & set(clean) and clean[10].text == texts[10] and clean[10].n_chars == len(texts[10])
    assert len(clean[11].text) == len(texts[11]) - (cut.end - cut.start) == clean[11].n_chars
    # A text without words has lost nothing, so null and blank texts are gone only with the words they lost.
    assert clean[5].text is None and clean[7].text == texts[7] and passages.cut_passages(docs).columns == docs.columns


def test_window_guarantee():
    """Any common run of MIN_WORDS words shares a window, wherever it stands."""
    rng = random.Random(9)
    for _ in range(60):
        run = [f"r{rng.randrange(10**6)}" for _ in range(passages.MIN_WORDS)]
        keys = []
        for _ in range(2):
            side = lambda: [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 80))]
            w = passages.Words(" ".join(side() + run + side()))
            w.places()
            keys.append(set(passages.windows(w)[0].tolist()))
        assert keys[0] & keys[1]


def test_passage_goes_to_its_ends(spark):
    """Exactly the words that a smaller document has go, also where a window's smallest owner has less of the passage."""
    rng = random.Random(12)
    new = lambda n: [f"g{rng.randrange(10**9)}" for _ in range(n)]
    short, long = new(50), new(60)
    part = new(10) + long[12:47] + new(30)
    texts = {1: part, 2: new(90) + short + new(20) + long + new(80), 3: new(33) + short + new(70), 4: new(7) + long + new(100),
             5: new(20) + short[:49] + new(40)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    clean = {r.doc_id: r.text.split() for r in passages.cut_passages(docs).collect()}
    assert clean == texts | {3: texts[3][:33] + texts[3][83:], 4: texts[4][:7] + texts[4][67:]}


def test_windows_are_least_of_neighbours():
    rng = random.Random(6)
    for n in (50, 51, 69, 300):
        w = passages.Words(" ".join(f"z{rng.randrange(40)}" for _ in range(n)))
        w.places()
        h = w.hashes[:n - passages.WINDOW + 1]
        want = {p for i in range(len(h) - passages.SPREAD + 1) for p in range(i, i + passages.SPREAD) if h[p] == h[i:i + passages.SPREAD].min()}
        assert set(passages.windows(w)[1].tolist()) == want


def test_run_keys():
    """Equal runs have equal keys and others do not, at any length."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, 4000).astype(np.uint64)
    for n in (1, 2, 3, 5, 30, 31, 50):
        got = passages.run_keys(keys, n)
        runs = [tuple(keys[i:i + n].tolist()) for i in range(len(keys) - n + 1)]
        assert len(got) == len(runs) and len(set(zip(runs, got.tolist()))) == len(set(runs)) == len(set(got.tolist()))
    assert len(passages.run_keys(keys[:4], 5)) == 0


def brute_passages(texts):
    """Words that stay: near paragraphs first, then every run of MIN_WORDS that a smaller document has outside its own cuts."""
    least = passages.MIN_WORDS
    words = {i: near.text_words(t) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        if len(words[i]) >= least:
            first.setdefault(tuple(words[i]), i)
    copies = {i for i, w in words.items() if len(w) >= least and first[tuple(w)] != i}
    gone = {i: set(range(len(words[i]))) if i in copies else set() for i in words}
    lines = []
    for i in sorted(words):
        at = 0
        for line in (texts[i] or "").split("\n"):
            n = len(near.text_words(line))
            if n >= least and i not in copies:
                lines.append((i, at, at + n, set(near.shingles(words[i][at:at + n]).tolist())))
            at += n
    comp = list(range(len(lines)))
    for x in range(len(lines)):
        for y in range(x):
            both = len(lines[x][3] & lines[y][3])
            if 100 * both >= 75 * len(lines[x][3] | lines[y][3]):
                comp = [comp[y] if c == comp[x] else c for c in comp]
    owner = {}
    for x, (i, *_rest) in enumerate(lines):
        owner[comp[x]] = min(owner.get(comp[x], i), i)
    for x, (i, a, b, _s) in enumerate(lines):
        if owner[comp[x]] != i:
            gone[i] |= set(range(a, b))
    has = {}
    for i in sorted(words):
        if i not in copies:
            for a in range(len(words[i]) - least + 1):
                if not gone[i] & set(range(a, a + least)):
                    has.setdefault(tuple(words[i][a:a + least]), []).append((i, a))
    for places in has.values():
        for i, a in places:
            if i != places[0][0]:
                gone[i] |= set(range(a, a + least))
    return {i: [w for k, w in enumerate(words[i]) if k not in gone[i]] for i in words}


def test_passages_against_all_pairs(spark):
    """Whole results on a corpus of copies, shared passages, near paragraphs and a paragraph that a third of all documents have."""
    rng = random.Random(21)
    new = lambda n: [f"b{rng.randrange(10**8)}" for _ in range(n)]
    common, pool, notes = new(55), [new(rng.randrange(40, 120)) for _ in range(12)], [new(70) for _ in range(6)]
    texts = {}
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.3:
                a, b = sorted(rng.sample(range(120), 2))
                parts.append(new(rng.randrange(0, 30)) + rng.choice(pool)[a:b] + new(rng.randrange(0, 30)))
            elif kind < 0.5:
                near_one = list(rng.choice(notes))
                for k in rng.sample(range(70), rng.randrange(0, 4)):
                    near_one[k] = new(1)[0]
                parts.append(near_one)
            else:
                parts.append(new(rng.randrange(1, 90)))
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), common)
        texts[i] = "\n".join(" ".join(p) for p in parts)
    texts |= {200: texts[7], 201: texts[7].upper(), 202: None, 203: "", 204: texts[5] + "\n" + texts[9]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    clean = {r.doc_id: near.text_words(r.text) for r in passages.cut_passages(docs).collect()}
    want = brute_passages(texts)
    assert {i: w for i, w in want.items() if w} == {i: w for i, w in clean.items() if w}


def test_one_id_with_two_texts(spark):
    """Rows of one id are answered alike, and nothing is cut between them."""
    rng = random.Random(31)
    new = lambda n: " ".join(f"i{rng.randrange(10**8)}" for _ in range(n))
    a, b, c = new(80), new(90), new(100)
    docs = spark.createDataFrame([(5, a), (5, b), (7, b), (7, c), (9, c), (9, a + "\n" + b), (8, new(60))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (8, 8, True)}
    cut = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(docs).collect()}
    assert all(x != y for x, y in cut) and {x for x, _ in cut} == {7, 9}


def test_recall_of_paragraph_bands():
    """Paragraphs at the threshold share a bucket, short and long ones."""
    rng, missed = np.random.default_rng(8), 0
    probes = near._probes(passages.BANDS * passages.VALUES, 64)
    for k in range(3000):
        n = (46, 53, 140)[k % 3]
        rest = -(-n // 7)  # 6 of 8 parts are shared: an index of 0.75 or just below
        both, a, b = (rng.integers(0, 2**63, m, dtype=np.int64).astype(np.uint64) for m in (n - rest, rest, rest))
        x, y = (near.bands_of(np.unique(np.concatenate((both, z))), passages.BANDS, passages.VALUES, probes) for z in (a, b))
        missed += not set(x.tolist()) & set(y.tolist())
    assert missed == 0


def test_no_passage_vanishes(spark):
    """What a document loses with a near paragraph, it can't keep for others."""
    rng = random.Random(14)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    long, own = new(600), new(60)
    texts = {1: long, 2: long[:300] + own + long[300:], 3: new(80) + own + new(90), 4: own + new(70), 5: new(30) + long[:100] + new(10)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    clean = {r.doc_id: r.text.split() for r in passages.cut_passages(docs).collect()}
    assert clean == {1: texts[1], 3: texts[3], 4: texts[4][60:], 5: texts[5][:30] + texts[5][130:]}


def test_near_paragraph(spark):
    """A paragraph with an edit every 25 words shares no window, but is linked by its bands and its sets."""
    rng = random.Random(2)
    own = [f"p{rng.randrange(10**6)}" for _ in range(100)]
    near_one = list(own)
    for k in range(12, 100, 25):
        near_one[k] = "edit"
    other = " ".join(f"q{i}" for i in range(70))
    rows = [(1, " ".join(own) + "\n" + other), (2, "Head.\n" + " ".join(near_one[:96]) + "\nTail.")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    a, b = (set(near.shingles([w.encode() for w in x]).tolist()) for x in (own, near_one[:96]))
    assert (got.count() == 1) == (jaccard(a, b) >= 0.75)


@pytest.mark.parametrize("counts", [[5, 0, 7, 1], [1000, 3, 250_000], [1] * 40])
def test_matrix_sums(counts):
    m = shards.communication_matrix(counts, 24, 1)
    assert [sum(r) for r in m] == counts
    sizes = [sum(c) for c in zip(*m)]
    assert max(sizes) - min(sizes) <= 1 and min(min(r) for r in m) >= 0


def test_draw_follows_the_law():
    rng = random.Random(4)
    got = Counter(shards.draw(rng, 7, 13, 6) for _ in range(20_000))
    from math import comb
    for k in range(7):
        assert abs(got[k] / 20_000 - comb(7, k) * comb(13, 6 - k) / comb(20, 6)) < 0.012


def test_shards(docs, texts, nothing):
    import zlib
    rows = shards.shuffle_into_shards(docs, shards=5).collect()
    assert len(rows) == docs.count() and shards.shuffle_into_shards(nothing).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        raw = (texts.get(r.doc_id, "no id " * 60) or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sorted(by) == list(range(5)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    carried = shards.shuffle_into_shards(docs.withColumn("size", docs.n_chars), carry=["lang", "size", "shard"])
    assert carried.columns[:3] == ["doc_id", "size", "text_crc32"] and {"lang", "size_", "shard_", "shard", "slot"} <= set(carried.columns)
    assert {r.shard_ for r in carried.collect()} == {"s"}
    again = shards.shuffle_into_shards(docs, shards=5, seed=2).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} != {(r.doc_id, r.shard, r.slot) for r in rows}
    plan = shards.shuffle_into_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_keys():
    """Equal words have equal keys wherever they stand, others do not, at any length; no word is hashed alone but long ones."""
    rng = random.Random(4)
    words = [("ab\0é中"[rng.randrange(5)] * rng.randrange(1, 4) + "x" * rng.randrange(0, 90)) for _ in range(3000)]
    words += ["a", "a\0", "a\0\0", "\0", "a" * 8, "a" * 9, "a" * 16, "a" * 63 + "b", "a" * 64, "a" * 65, "z" * 5000]
    rng.shuffle(words)
    raw = passages.lower_ascii("  " + " \n".join(words))
    data = np.frombuffer(raw, np.uint8)
    inside = ~passages._SPACE[data]
    edge = np.concatenate(([False], inside, [False]))
    borders = np.flatnonzero(edge[1:] != edge[:-1])
    keys = passages.word_keys(raw, borders[::2], borders[1::2]).tolist()
    assert len(keys) == len(words) and len(dict(zip(words, keys))) == len(set(words)) == len(set(keys)) == len(set(zip(words, keys)))


def test_places_of_words():
    """Starts and ends count characters, of plain and of other texts."""
    for text in ("One two\tthree \n four" * 9, " ünë 中文 two\x0bthree \n x" * 9, "", " \n", "a"):
        w = passages.Words(text)
        w.places()
        assert [text[a:b].encode() for a, b in zip(w.starts, w.ends)] == text.encode().split()
        assert w.n == len(w.starts) == len(w.keys)


def test_runs_are_put_together_once(monkeypatch):
    """Shingles, windows and runs of one text share the runs of 1, 2, 4, ... words that they are made of."""
    calls, pair = [], passages._pair
    monkeypatch.setattr(passages, "_pair", lambda a, b: calls.append(1) or pair(a, b))
    w = passages.Words(" ".join(f"w{i}" for i in range(200)))
    w.places()
    passages.windows(w)
    before = len(calls)
    assert (passages.run_keys(w.keys, passages.MIN_WORDS) == w.runs(passages.MIN_WORDS)).all()
    assert before <= 9 and len(calls) - before <= 10


def test_one_worker_for_a_task(spark):
    """However small the tables beside them are, texts are dealt out between two steps in Python, and come with their spans."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    gone = spark.createDataFrame([(2,), (8,)], "doc_id long")
    holes = spark.createDataFrame([(3, [1], [4])], "doc_id long, lost array<int>, until array<int>")
    cells = np.full(1 << 10, -1, np.int64)
    found = passages.with_holes(docs, cells, gone, holes)
    assert sorted(map(tuple, found.collect())) == [(i, f"text {i}", [1] if i == 3 else None, [4] if i == 3 else None)
                                                   for i in range(9) if i not in (2, 8)]
    steps = passages.runs(found, cells)
    steps.collect()
    plan = steps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 2 and "Exchange" in plan.split("MapInArrow")[1] and "BroadcastHashJoin" not in plan
