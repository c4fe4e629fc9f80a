"""Token ids, planes, packing and chats against the tokenizer itself."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm import chat, packing, planes
from tabloom.llm.tokens import END, Encoder, default_path
from tabloom.session import work_path


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return Encoder(default_path())


def test_special_strings(own, plain):
    """Their strings in a text are what the library makes of them."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "a <|endoftext| > b", "a b"]
    assert [x.tolist() for x in own.encode_many(texts)] == [plain(t) for t in texts]
    assert plain(texts[0]) == [64, 220, 50256, 275]


def test_groups_of_texts(own, plain, monkeypatch):
    monkeypatch.setattr("tabloom.llm.tokens.BATCH_CHARS", 30)
    texts = ["one two, three%%%", None, "", "four\nFive six's", " lead", "x" * 90, "seven eight\n\nnine"] * 3
    assert [x.tolist() for x in own.encode_many(texts)] == [plain(t) for t in texts]


@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85   ab1é.,!'Ġ🙂中<|>"), max_size=20), max_size=4))
@settings(max_examples=300, deadline=None)
def test_cache_equals_tokenizer(own, plain, texts):
    assert [x.tolist() for x in own.encode_many(texts)] == [plain(t) for t in texts]


def test_cache_turns_over(plain, monkeypatch):
    monkeypatch.setattr("tabloom.llm.tokens.CACHE_WORDS", 50)
    own, rng = Encoder(default_path()), random.Random(1)
    for _ in range(20):
        texts = [" ".join(f"v{rng.randrange(300)}{rng.choice(['', '.', ',', chr(10) + 'Next'])}" for _ in range(40)) for _ in range(3)]
        assert [x.tolist() for x in own.encode_many(texts)] == [plain(t) for t in texts]


def test_memory_of_a_batch():
    """A batch of many texts takes the memory of a part of it: what is made of a batch at once stays with the worker."""
    script = """
import random, resource
from tabloom.llm.tokens import default_path, encoder
rng, own = random.Random(1), encoder(default_path())
own.encode_many(["some words"])
batches = [[" ".join(str(rng.randrange(30_000)) for _ in range(600)) for _ in range(1200)] for _ in range(2)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for texts in batches:
    own.encode_many(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=120,
                           cwd=Path(__file__).parents[2]).stdout
    assert int(grown) < 85


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(9, np.uint32), rng.integers(0, 50_257, 200_001, dtype=np.uint32),
                np.array([2**32 - 1, 0, 7], np.uint32)):
        packed = planes.pack_chunk(ids, mode)
        assert planes.unpack_chunk(*packed, mode).tolist() == ids.tolist()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_files(spark, docs, texts, plain, mode, monkeypatch):
    path = work_path(spark, "planes")
    monkeypatch.setattr(planes, "CHUNK_IDS", 5000)
    monkeypatch.setattr(planes, "BLOCK_IDS", 1024)
    planes.write_ids(docs, path, mode=mode)
    rows = planes.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    assert spark.read.parquet(path).count() > 3
    assert [r.doc_id for r in rows] == [None] + sorted([1, *texts])
    at = 0
    for r in rows:
        ids = plain(texts.get(r.doc_id, "no id " * 60)) + [END]
        assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)


def test_empty_files(spark, nothing):
    path = work_path(spark, "planes")
    planes.write_ids(nothing, path)
    assert planes.read_documents(spark, path).count() == 0
    assert packing.pack(nothing).count() == 0


def fill(runs):
    return sum(n for n, _ in runs)


@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 5000), min_size=1, max_size=60))
@settings(max_examples=40, deadline=None)
def test_plan(counts):
    runs = packing.plan(counts)
    used = {}
    for n, lengths in runs:
        assert n > 0 and lengths and sum(lengths) <= 1024
        for k in lengths:
            used[k] = used.get(k, 0) + n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert fill(runs) <= max(2 * -(-total // 1024), 1)


def test_plan_is_tight():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        k = min(1024, int(rng.expovariate(1 / 400)) + 1)
        counts[k] = counts.get(k, 0) + 1
    assert fill(packing.plan(counts)) <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 1024)
    # Pairs that fill a sequence exactly, of two sizes.
    assert fill(packing.plan({600: 1000, 424: 1000})) == 1000
    assert fill(packing.plan({400: 1000, 312: 2000})) == 1000


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_pack(spark, docs, texts, plain):
    rows = packing.pack(docs, with_ids=True)
    made = {r.sequence_id: list(r.ids) for r in packing.sequences(rows).collect()}
    rows = rows.collect()
    whole = {}
    for r in rows:
        ids = (plain(texts.get(r.doc_id, "no id " * 60)) + [END])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and list(r.ids) == ids
        assert made[r.sequence_id][r.offset:r.offset + r.length] == ids
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert all(len(s) <= 1024 for s in made.values()) and sum(map(len, made.values())) == sum(r.length for r in rows)
    assert whole[5] == whole[6] == 1 and whole[13] == len(plain(texts[13])) + 1


@given(st.text(st.sampled_from("<|\\>im_end x\n"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_masks():
    ids, mask = chat.assemble(np.array([1, 2]), np.array([3, 4, 5]), True)
    assert ids.tolist() == [chat.START_ID, 1, 2, chat.SEP_ID, 3, 4, 5, chat.END_ID] and mask.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]
    assert not chat.assemble(np.array([1]), np.array([], int), True)[1].any()
    assert not chat.assemble(np.array([1]), np.array([4]), False)[1].any()


def test_chats(spark, texts):
    rng, rows = random.Random(2), []
    for conv in [None, -3, 0, 1, 2]:
        for turn in [None, *range(400 if conv == 1 else 5)]:
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "<|im_sep|>"]),
                         rng.choice([None, "", texts[12], texts[17], "hi <|im_end|><\\|", texts[8], " a  b\n"]), 1, "x"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int, mask string").repartition(3)
    path = work_path(spark, "chats")
    chat.write_chats(table, path)
    got = {r.conv_id: r for r in chat.read_chats(spark, path).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        text = "".join(f"{chat.START}{chat.escape(x[2] or '')}{chat.SEP}{chat.escape(x[3] or '')}{chat.END}" for x in own)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    starts = chat.read_turns(spark, path).where("conv_id = 2").orderBy("start").collect()
    assert [r.start for r in starts] == [sum(len(x.ids) for x in starts[:i]) for i in range(len(starts))]
    chat.write_chats(table.limit(0), work_path(spark, "chats"))
