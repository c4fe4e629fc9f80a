"""Quality rules, decontamination and license scans against plain versions."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import decontaminate, licenses, quality
from tabloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, rows_of

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return PLAIN_WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items, size=10):
    words, hit, found = plain(text), set(), set()
    for item, body in items:
        own = plain(body)
        k = min(size, len(own))
        grams = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    got = rows_of(QUERIES[name](spark, sf).toArrow())
    want = rows_of(connect(sf).sql(ORACLES[name]).to_arrow_table())
    assert got[:2] == want[:2]


@pytest.fixture(scope="module")
def items(texts):
    return [("b", texts[1][:300]), ("a", texts[1][:300]), ("c", "One, TWO three"), ("d", texts[10][50:400]), ("e", ""), ("f", None)]


@pytest.mark.parametrize("block_bytes", [10**9, 200])
def test_decontaminate(spark, docs, texts, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.find_benchmarks(docs, bench, block_bytes=block_bytes).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = texts.get(r.doc_id, "no id " * 60)
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(text, items)
        # Spans point at the original words.
        found = [plain(text[s.start:s.end]) for s in r.spans]
        assert [len(f) for f in found] == [s["last"] - s["first"] + 1 for s in r.spans]
        assert all(f == plain(text)[s["first"]:s["last"] + 1] for f, s in zip(found, r.spans))


def test_decontaminate_nothing(spark, docs, nothing, items):
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.find_benchmarks(nothing, bench).count() == 0
    assert decontaminate.find_benchmarks(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and not {1, 2, 3, 4, 8, 9, 10} & {r.doc_id for r in clean.collect()}
    assert clean.count() == docs.count() - 8


def test_quality_documents(docs, texts, nothing):
    rows = quality.judge_documents(docs, with_text=True).collect()
    assert len(rows) == docs.count() and quality.judge_documents(nothing).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[5].n_words == by[6].n_words == by[7].n_words == 0 and by[5].base_failed and not by[5].kept
    assert by[14].base_failed and by[14].n_repeat_words == 600
    assert by[10].kept and by[10].cleaned == texts[10]
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in rows if r.kept}
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_lines():
    good = "A plain sentence that ends well, as sentences of clean text do, with all of its words in place. " * 2
    rules = {"Home | News | Sport | About": "navigation", "w1$$$ w2%%% w3### w4&&&": "symbols", "SALE NOW!! BUY IT ALL TODAY!!": "shouting",
             "spam " * 30: "dull", "no end of a sentence": "punctuation", "Please accept cookies.": "notice", good: None}
    for line, rule in rules.items():
        assert quality.line_rule(line, quality.ascii_split(line)) == rule
    words = " ".join(f"x{i}" for i in range(60)) + "."
    assert quality.judge(f"{words}\nHome | News | Sport\n{words[::-1]}.")[1] == f"{words}\n{words[::-1]}."
    assert not quality.judge(words + "\n" + " | ".join(f"x{i}" for i in range(90)))[0][6]


def test_quality_wrapped_lines():
    """Wrapped prose keeps each line; notices are whole words."""
    import textwrap
    sentence = "the survey of this region was carried out by several groups over more than twenty years with varying methods that follow"
    prose = "\n".join(textwrap.wrap(" ".join(" ".join(f"{w}{k}" for w in sentence.split()) + "." for k in range(3)), 80))
    got = quality.judge(f"{prose}\n\nlast words\nwithout an end")
    assert got[0][6] and got[1] == prose + "\n" and got[0][9] == 5
    for line in ("A new design in wood.", "They assign in turn.", "See the catalog in print.", "A dialog in verse."):
        assert quality.line_rule(line, quality.ascii_split(line)) is None
    for line in ("Sign in.", "Please (log in) here.", "READ MORE!"):
        assert quality.judge(line)[1] == ""
    assert quality.judge("All rights reserved\nof a text.")[0][10] == "notice"


@given(st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=60, deadline=None)
def test_repeat_words(words):
    hit = set()
    for i in range(len(words) - 2):
        if sum(words[j:j + 3] == words[i:i + 3] for j in range(len(words) - 2)) > 1:
            hit |= {i, i + 1, i + 2}
    assert quality.repeat_words(words) == len(hit)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(st.sampled_from(sorted(licenses.NOTICES)), st.lists(st.tuples(st.integers(0, 99), st.sampled_from("dis"), st.sampled_from("xyzé")),
                                                           max_size=3))
@settings(max_examples=150, deadline=None)
def test_fuzzy_notice(notice, edits):
    own = list(notice)
    for at, kind, c in edits[:licenses.budget(notice)]:
        at %= len(own)
        own[at:at + (kind != "i")] = [] if kind == "d" else [c]
    edited = "".join(own)
    got = licenses.Catalog({notice: "x"}).scan(f"Vorwort über alles. {edited} nachher")
    if distance(notice, " ".join(plain(edited))) <= licenses.budget(notice):
        assert "x" in got[5].split(",") and got[6] > 0.8


def test_licenses(docs, texts, nothing):
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in texts.items():
        words, places = plain(text), []
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k:k + len(own)] == own]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
    assert rows[12].base_labels == "mit" and rows[5].labels == "" and rows[5].score == 0
    assert licenses.scan_licenses(nothing).count() == 0
    text = "© X. Licensed under the Apache-Licence, Version 2.0 — and mit license mit license."
    got = licenses.Catalog().scan(text)
    assert got[1:6] == (2, 12, 14, "mit", "apache,mit")
    assert [text[s["start"]:s["end"]] for s in got[7]][0] == "Licensed under the Apache-Licence, Version 2.0"


def test_digest_of_items(spark, sf):
    none = QUERIES["op1_decontaminate"](spark, sf).where("n_items = 0").select("items_sha256").distinct().collect()
    assert [r[0] for r in none] == [hashlib.sha256(b"").hexdigest()]
