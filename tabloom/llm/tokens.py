"""Token ids of whole texts by a public tokenizer file, through a word cache that gives the same ids."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.common import worker_state

TOKENIZER = "byte_bpe_50k.json"
END = 2
# Parts that a worker keeps the ids of, parts that are learnt in one call, characters that are cut in one go, and
# parts that are put in a row together: what is made for these takes most memory.
CACHE_WORDS = 500_000
BATCH_WORDS = 20_000
BATCH_CHARS = 8_000_000
ROW_PARTS = 50_000
# White space other than single spaces and line feeds, which are looked at on their own.
_OTHER_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def put(kept: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``kept`` with ``values`` from place ``at`` on; where they don't fit, a copy with room for as many again."""
    end = at + len(values)
    if end > len(kept):
        more = np.zeros(2 * end, kept.dtype)
        more[:at] = kept[:at]
        kept = more
    kept[at:end] = values
    return kept


class Encoder:
    """``encode_many(texts)`` gives the tokenizer's own ids for whole texts, as numpy arrays.

    The byte-level vocabulary never joins across the border before a single
    space or line feed between visible characters, nor between a letter and
    a mark.  So a text is cut there, each distinct part is encoded once by
    the tokenizers library, many in one call, and the ids are put in a row.
    Texts with any other white space, and texts that hold a special token's
    own string, are encoded as they are: what the library makes of such a
    string stays its decision.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # Ids that begin with a space or a line feed: in a row of parts, the first of each.
        self.opens = np.array([n.startswith(("Ġ", "Ċ")) for n in names], bool)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        # By row, where a part's ids begin and how many they are; the first ``used`` of ``ids`` are theirs.
        self.starts, self.sizes, self.ids, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32), 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of parts, which start with a line feed or stand behind a space."""
        for k in range(0, len(new), BATCH_WORDS):
            batch = new[k:k + BATCH_WORDS]
            ids = self._plain("".join([p if p[0] == "\n" else " " + p for p in batch]))
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(batch):
                raise ValueError("this vocabulary joins words: its ids can't be cached by word")
            n, now = len(self.rows), self.used
            self.starts, self.sizes = put(self.starts, n, first + now), put(self.sizes, n, np.diff(np.append(first, len(ids))))
            self.ids, self.used = put(self.ids, now, ids), now + len(ids)
            self.rows.update(zip(batch, range(n, n + len(batch))))

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with plain spaces: cut into parts, and each distinct part looked up once."""
        if len(self.rows) > CACHE_WORDS:
            self._forget()
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        ends, told = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        words = told.dictionary.to_pylist()
        found = list(map(self.rows.get, words))
        new = [w for w, row in zip(words, found) if row is None]
        if new:
            self._learn(new)
            found = list(map(self.rows.__getitem__, words))
        told = told.indices.to_numpy()
        row = np.array(found, np.int32)[told]
        start, size = self.starts[row], self.sizes[row]
        # A text's first part stands behind nothing.
        firsts = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(
            [words[i] for i in told[ends[:-1]].tolist()], add_special_tokens=False)]
        size[ends[:-1]] = [len(x) for x in firsts]
        start[ends[:-1]] = self.used + np.cumsum(size[ends[:-1]]) - size[ends[:-1]]
        # They stand behind the kept ids until other ones take their place.
        self.ids = put(self.ids, self.used, np.concatenate(firsts))
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + ROW_PARTS, "right")) - 1)
            n = size[ends[i]:ends[j]]
            after = np.cumsum(n)
            at = np.repeat(start[ends[i]:ends[j]] - (after - n), n) + np.arange(after[-1])
            out += np.split(self.ids[at], after[ends[i + 1:j] - ends[i] - 1])
            i = j
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held, chars = [], 0
        for i, t in enumerate(texts):
            if not t or not plain_spaces(t) or any(x in t for x in self.special):
                out[i] = self._plain(t or "")
                continue
            held.append(i)
            chars += len(t)
            if chars > BATCH_CHARS:
                for k, ids in zip(held, self._cut([texts[k] for k in held])):
                    out[k] = ids
                held, chars = [], 0
        if held:
            for k, ids in zip(held, self._cut([texts[k] for k in held])):
                out[k] = ids
        return out


def plain_spaces(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between visible characters."""
    return (bool(text) and text[0] not in " \n" and text[-1] not in " \n"
            and not any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
            and not any(x in text for x in _OTHER_SPACE))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    state = worker_state("tokens")
    if getattr(state, "encoder", (None,))[0] != path:
        state.encoder = (path, Encoder(path))
    return state.encoder[1]
