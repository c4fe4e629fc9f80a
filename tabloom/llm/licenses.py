"""License scans: exact seeds locate short notices, bounded-error matching verifies them."""

from __future__ import annotations

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, plain_words, prepare, worker_state
from tabloom.llm.decontaminate import offsets

# Phrases whose words must stand exactly, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices in plain words, their labels; one edit is allowed for about nine characters.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
EDIT_EVERY = 9

SPANS = "array<struct<label:string,start:int,end:int,edits:int>>"
RESULT = (f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          f"spans {SPANS}")


def budget(notice: str) -> int:
    """Edits that a notice may have."""
    return len(notice) // EDIT_EVERY


def seeds(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than it may have edits: one piece at least stands unchanged."""
    k = budget(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Catalog:
    """The automaton over phrases and seeds, and the patterns that verify."""

    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        self.notices = list(notices.items())
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={budget(n)}}}") for n, _ in self.notices]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _) in enumerate(self.notices):
            for at, piece in seeds(n):
                where.setdefault(piece, []).append((i, at))
        self.search = ahocorasick.Automaton()
        for piece in {*where, *self.phrases}:
            self.search.add_word(piece, (piece, where.get(piece, ()), self.phrases.get(piece)))
        self.search.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """One row of ``RESULT``."""
        words = plain_words(text)
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        line = f" {b' '.join(words).decode('latin-1')} "
        base: list[tuple[int, str]] = []
        near: dict[int, list[int]] = {}
        for end, (piece, owners, label) in self.search.iter(line):
            start = end - len(piece) + 1
            if label:
                base.append((start, label))
            for i, at in owners:
                near.setdefault(i, []).append(start - at)
        if not base and not near:
            return len(words), 0, None, None, "", "", 0.0, []
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        word_at = lambda x: int(np.searchsorted(gaps, x, "right")) - 1
        firsts = [word_at(start) for start, _ in base]
        matches: list[tuple[float, int, int, str, int]] = []
        for i, places in near.items():
            notice, label = self.notices[i]
            for lo, hi in windows(places, len(notice), budget(notice), line):
                part = line[lo:hi].encode("latin-1").decode()
                for m in self.patterns[i].finditer(part):
                    at = lo + len(part[:m.start()].encode())
                    inner = m[0].encode()
                    a = word_at(at + len(inner) - len(inner.lstrip()))
                    b = word_at(max(at, at + len(inner.rstrip()) - 1))
                    edits = sum(m.fuzzy_counts)
                    matches.append((edits / len(notice), max(a, 0), max(a, b), label, edits))
        # Of matches that overlap, the one with the smallest share of edits stands.
        found: list[tuple[float, int, int, str, int]] = []
        taken = np.zeros(len(words), bool)
        for m in sorted(matches, key=lambda m: (m[0], m[1] - m[2], m[1], m[3])):
            if not taken[m[1]:m[2] + 1].any():
                taken[m[1]:m[2] + 1] = True
                found.append(m)
        best = max([1.0] * bool(base) + [1 - m[0] for m in found], default=0.0)
        starts, stops = offsets(text) if found else ([], [])
        spans = [{"label": label, "start": int(starts[a]), "end": int(stops[min(b, len(words) - 1)]), "edits": e}
                 for _, a, b, label, e in sorted(found, key=lambda m: m[1])]
        own = sorted({label for _, label in base})
        return (len(words), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(own),
                ",".join(sorted({*own, *(m[3] for m in found)})), best, spans)


def windows(places: list[int], length: int, edits: int, line: str) -> list[tuple[int, int]]:
    """Parts of the line in which a notice that starts near ``places`` lies, cut between characters, overlapping ones joined."""
    out: list[list[int]] = []
    for p in sorted(set(places)):
        # An edit beside a character of several bytes moves more than one byte.
        lo, hi = max(0, p - 4 * edits), min(len(line), p + length + 4 * edits)
        while lo > 0 and "\x80" <= line[lo] <= "\xbf":
            lo -= 1
        while hi < len(line) and "\x80" <= line[hi] <= "\xbf":
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def scan_licenses(docs: DataFrame, text: str = "text", notices: dict[str, str] = NOTICES,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License notices in every text: exact phrases, labels with errors allowed, spans in the original.

    ``score`` is 1 for an exact phrase, else 1 less the best match's edits by
    its length.  Null and empty texts have no words and score 0; texts are
    scanned whole, once; repeated rows give repeated results; an empty table
    gives an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(rows: dict[str, list]) -> dict[str, list]:
        state = worker_state("licenses")
        key = (tuple(notices.items()), tuple(phrases.items()))
        if getattr(state, "catalog", (None,))[0] != key:
            state.catalog = (key, Catalog(notices, phrases))
        found = [state.catalog[1].scan(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    return map_rows(docs.select("doc_id", F.col(text).alias("text")), run, f"doc_id long, {RESULT}")
