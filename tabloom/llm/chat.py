"""Chat formatting by token-level assembly: segments encoded alone, reserved ids spliced, masks by prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_rows, map_stream, prepare
from tabloom.llm.tokens import default_path, encoder

# Marks of the template and their ids, which lie beyond the vocabulary.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
START_ID, SEP_ID, END_ID = 50257, 50258, 50259

TURN = "conv_id long, turn long, ids array<int>, mask binary"
RESULT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, loss_tokens long")

_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text in which ``<|`` no longer occurs: a backslash goes between, one more where some are already."""
    return _OPENS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def assemble(role: np.ndarray, text: np.ndarray, learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn, and the mask: +1 where the learned segment starts, -1 behind it, summed up."""
    lengths = np.array([1, len(role), 1, len(text), 1])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    change = np.zeros(starts[-1] + 1, np.int8)
    if learned and len(text):
        change[starts[3]] += 1
        change[starts[4]] -= 1
    ids = np.concatenate(([START_ID], role, [SEP_ID], text, [END_ID])).astype(np.int32)
    return ids, np.cumsum(change[:-1]).astype(np.uint8)


def write_chats(conversations: DataFrame, path: str, learn: tuple[str, ...] = ("assistant",), tokenizer: str | None = None) -> None:
    """Format every turn and write its ids and loss mask; a conversation is its turns in a row.

    A turn depends on no other, so this is one pass without a shuffle, and a
    conversation of any length is no group in memory.

    A null role or text is empty; a null turn comes first; turns with one
    number are ordered by their ids; null conv_ids are one conversation; an
    empty table writes no rows; other columns are ignored.
    """
    prepare(conversations.sparkSession)
    tokenizer = tokenizer or default_path()

    def run(rows: dict[str, list]) -> dict[str, list]:
        own = encoder(tokenizer)
        roles = own.encode_many([escape(r or "") for r in rows["role"]])
        texts = own.encode_many([escape(t or "") for t in rows["text"]])
        made = [assemble(r, t, role in learn) for r, t, role in zip(roles, texts, rows["role"])]
        return {"conv_id": rows["conv_id"], "turn": rows["turn"], "ids": [m[0] for m in made],
                "mask": [m[1].tobytes() for m in made]}

    map_rows(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), run, TURN
             ).write.parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """The written turns with their first token's place in the conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    turns = prepare(spark).read.parquet(path)
    return turns.withColumn("start", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0)))


def read_chats(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """One row for each conversation, decoded from the written ids and masks.

    Rows stream by in order and only running digests are kept, so memory does
    not grow with a conversation; a digest over all its turns is one task.
    """
    tokenizer = tokenizer or default_path()
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        decode = encoder(tokenizer).tokenizer.decode
        now, state = None, None

        def close() -> tuple:
            turns, n, learned, chars, formatted, tokens, masked = state
            return now[0], n, turns.hexdigest(), chars, learned.hexdigest(), formatted, tokens, masked

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch["conv_id"], batch["ids"], batch["mask"]):
                if now != (conv,):
                    if now is not None:
                        done.append(close())
                    now, state = (conv,), [hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0]
                split = ids.index(SEP_ID)
                role = decode(ids[1:split], skip_special_tokens=False)
                text = decode(ids[split + 1:-1], skip_special_tokens=False)
                learned = [i for i, m in zip(ids, mask) if m]
                own = unescape(decode(learned, skip_special_tokens=False)) if learned else ""
                state[0].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[1] += 1
                state[2].update(own.encode())
                state[3] += len(own)
                state[4] += len(START) + len(role) + len(SEP) + len(text) + len(END)
                state[5] += len(ids)
                state[6] += len(learned)
            yield dict(zip(names, map(list, zip(*done)))) if done else {n: [] for n in names}
        if now is not None:
            yield {n: [v] for n, v in zip(names, close())}

    turns = prepare(spark).read.parquet(path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return map_stream(turns, run, RESULT)
