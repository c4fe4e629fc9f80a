"""Quality rules, line first: drop failing lines, then documents that lost too much."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, lower_ascii, map_rows, prepare, worker_state

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
# Ends of sentences, separators of menus, short notices around a text.
TERMINAL = tuple(".!?:;…\"'”’)]»。！？")
SEPARATORS = ("|", "»", "›", ">", "•", "·", "/", "-", "*")
NOTICES = ("all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
           "enable javascript", "click here", "read more", "sign in", "log in", "lorem ipsum", "subscribe to")

_NOTICE = re.compile(b"(?<![a-z0-9\x80-\xff])(?:" + b"|".join(x.encode() for x in NOTICES) + b")(?![a-z0-9\x80-\xff])")

MIN_WORDS = 50
MAX_REPEAT = 50      # percent of words in repeated windows
MAX_LOSS = 50        # percent of words in failing lines
NOTICE_WORDS = 20    # a notice is a short line
SHOUT_WORDS = 5
DULL_WORDS = 20

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_bad_lines long, n_bad_words long, bad_rules string")


def is_notice(line: str, words: list[str]) -> bool:
    return len(words) <= NOTICE_WORDS and bool(_NOTICE.search(lower_ascii(line)))


def line_rule(line: str, words: list[str]) -> str | None:
    """The rule that a line with words, judged alone, fails, if any.  Notices are whole words."""
    n = len(words)
    if 5 * sum(w in SEPARATORS for w in words) >= n:
        return "navigation"
    if 10 * sum(line.count(s) for s in SYMBOLS) > sum(map(len, words)):
        return "symbols"
    if n >= SHOUT_WORDS:
        raw = line.encode()
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        if upper > lower:
            return "shouting"
    if n >= DULL_WORDS and 5 * len(set(words)) < n:
        return "dull"
    if not any(w.endswith(TERMINAL) for w in words):
        return "punctuation"
    return "notice" if is_notice(line, words) else None


def join_wrapped(lines: list[tuple[str, list[str]]], rules: list[str | None]) -> None:
    """Take back ``punctuation`` from lines of a sentence that has its mark in another line.

    A line that doesn't end with a mark goes on in the next one, if that is
    neither blank nor fails another rule.
    """
    unit: list[int] = []

    def close() -> None:
        if any(rules[i] is None for i in unit):
            for i in unit:
                if rules[i]:
                    rules[i] = "notice" if is_notice(*lines[i]) else None
        unit.clear()

    for i, (_, words) in enumerate(lines):
        if not words or rules[i] not in (None, "punctuation"):
            close()
            continue
        unit.append(i)
        if words[-1].endswith(TERMINAL):
            close()
    close()


def repeat_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    at = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift:shift + len(at)] |= at
    return int(hit.sum())


def ascii_split(line: str) -> list[str]:
    return [w.decode() for w in line.encode().split()]


def judge(text: str | None) -> tuple[tuple, str | None]:
    """The counts and the verdict on one text, and the text without failing lines."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    repeats = repeat_words(words)
    seen, dups, lines, bad, bad_words, good, rules = set(), 0, 0, 0, 0, [], set()
    cut = [(line, ascii_split(line)) for line in text.split("\n")]
    found = [line_rule(line, own) if own else None for line, own in cut]
    if "punctuation" in found:
        join_wrapped(cut, found)
    for (line, own), rule in zip(cut, found):
        if own:
            lines += 1
            dups += line in seen
            seen.add(line)
            if rule:
                bad += 1
                bad_words += len(own)
                rules.add(rule)
                continue
        good.append(line)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    kept = not base and 100 * bad_words <= MAX_LOSS * n
    return (n, word_chars, n_symbols, dups, repeats, base, kept, lines, bad, bad_words, ",".join(sorted(rules))), (
        text if not bad else "\n".join(good))


def judge_documents(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` without its text, with the counts, the verdict and, if asked, the cleaned text.

    Lines are the parts between line feeds; a line without words is neither
    judged nor removed.  Lines of one wrapped sentence are judged together.
    A document goes if its failing lines hold more than ``MAX_LOSS`` percent
    of its words, if it has under ``MIN_WORDS`` words or
    more than ``MAX_REPEAT`` percent of repeated windows.

    A null or empty text has no words and fails; a text of any length is read
    whole; repeated rows give repeated results; an empty table gives an empty
    table; other columns of ``docs`` are ignored, so names can't clash.
    """
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [judge(t) for t in rows["text"]]
        out = {"doc_id": rows["doc_id"]} | {n: [f[0][i] for f in found] for i, n in enumerate(names)}
        return out | ({"cleaned": [f[1] for f in found]} if with_text else {})

    schema = f"doc_id long, {RESULT}" + (", cleaned string" if with_text else "")
    return map_rows(docs.select("doc_id", F.col(text).alias("text")), run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents and failing lines, with the same columns.

    ``n_chars`` is counted anew.  Each row is judged alone, so repeated rows
    stay repeated, and a null text goes.
    """
    prepare(docs.sparkSession)
    kept = docs.schema

    def run(rows: dict[str, list]) -> dict[str, list]:
        # What a run before this one left with the worker goes.
        worker_state("quality")
        found = [judge(t) for t in rows["text"]]
        at = [i for i, f in enumerate(found) if f[0][6]]
        out = {c: [v[i] for i in at] for c, v in rows.items()} | {"text": [found[i][1] for i in at]}
        if "n_chars" in out:
            out["n_chars"] = [len(t) for t in out["text"]]
        return out

    return map_rows(docs, run, ddl(kept))
