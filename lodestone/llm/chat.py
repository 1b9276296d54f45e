"""Conversations as token ids with loss masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import TOKENIZER, encode, encoding, end_of_text, ranks

CONTROLS = ("<|im_start|>", "<|im_end|>")
TRAINED = ("assistant",)
_ESCAPE, _UNESCAPE = regex.compile(r"<(\\*)\|"), regex.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """`text` with a backslash in every `<|`, so that it holds no control string."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _UNESCAPE.sub(r"<\1|", text)


def reserved(vocabulary: bytes) -> tuple[int, int]:
    """The ids of the control strings, the first two after those of the vocabulary and the end of text."""
    top = end_of_text(vocabulary) + 1
    return top, top + 1


def assemble(turns: Sequence[Sequence[tuple[str, str]]], vocabulary: bytes, trained: Sequence[str] = TRAINED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mask, where each conversation begins and the last ends).

    A turn is start id, role, new line, content, end id, new line; role, content and new line are encoded each by itself, and the reserved ids
    spliced in between. The mask is 1 on the content and the end id of trained roles: +1 where such a stretch begins, -1 where it ends, summed up.
    """
    start, end = reserved(vocabulary)
    line = encode(vocabulary, "\n")
    roles = {r: np.concatenate(([start], encode(vocabulary, escape(r)), line)) for r in {r for t in turns for r, _ in t}}
    after = np.concatenate(([end], line))
    parts: list[np.ndarray] = []
    train = []
    for role, content in (x for t in turns for x in t):
        parts += [roles[role], encode(vocabulary, escape(content)), after]
        train.append(role in trained)
    edge = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    first = edge[3 * np.concatenate(([0], np.cumsum([len(t) for t in turns]))).astype(np.int64)]
    ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    on = np.flatnonzero(train)
    step = np.zeros(len(ids) + 2, np.int8)
    np.add.at(step, edge[3 * on + 1], 1)
    np.add.at(step, edge[3 * on + 2] + 1, -1)
    return ids, np.cumsum(step[: len(ids)], dtype=np.int8), first


def parse(ids: Sequence[int], vocabulary: bytes) -> list[tuple[str, str]]:
    """The turns that assemble() made `ids` of."""
    e, (start, end) = encoding(vocabulary), reserved(vocabulary)
    turns, at = [], 0
    ids = [int(x) for x in ids]
    while at < len(ids):
        stop = ids.index(end, at)
        role, _, text = e.decode(ids[at + 1 : stop]).partition("\n")
        turns.append((unescape(role), unescape(text)))
        at = ids.index(start, stop) if start in ids[stop:] else len(ids)
    return turns


def _formatted(told, trained: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                turns = [[(t["role"], t["text"]) for t in row] for row in batch.column(1).slice(lo, 512).to_pylist()]
                ids, mask, first = assemble(turns, told.value, trained)
                off = pa.array(first.astype(np.int32))
                sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), pa.ListArray.from_arrays(off, pa.array(ids)), pa.ListArray.from_arrays(off, pa.array(mask)), pa.array(np.diff(first).astype(np.int32)), pa.array((sums[first[1:]] - sums[first[:-1]]).astype(np.int32))], ["conv_id", "input_ids", "loss_mask", "n_tokens", "n_trained"])

    return run


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, trained: Sequence[str] = TRAINED) -> DataFrame:
    """(conv_id, input_ids, loss_mask, n_tokens, n_trained) of each conversation, its turns in order of turn, role and text.

    The tokenizer file is read by the driver; tasks get its contents. `<|` in a content or role gets a backslash, and contents never encode to a
    reserved id. A null role is a user's, a null text empty, a null turn comes first; line ends in a role become spaces. Turns that repeat
    are kept. Rows without a conv_id are left out. Other columns are not looked at.
    """
    role = F.regexp_replace(F.coalesce(F.col("role").cast("string"), F.lit("user")), "[\r\n]", " ")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    told = conversations.sparkSession.sparkContext.broadcast(ranks(tokenizer))  # a vocabulary, some 1 MB
    return turns.mapInArrow(_formatted(told, tuple(trained)), "conv_id long, input_ids array<int>, loss_mask array<tinyint>, n_tokens int, n_trained int")
