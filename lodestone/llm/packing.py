"""Packing of documents into sequences of a fixed number of token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textkit import chunks, list_array
from lodestone.llm.tokens import TOKENIZER, encode, end_of_text, ranks, texts_of

CAPACITY, GROUP = 8192, 4096
#: Bytes of text up to which documents make one group.
GROUP_BYTES = 64 << 20


class Bins:
    """Bins of equal capacity, with a tournament tree over the room in each, whose inner nodes hold the most room below them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1
        self.tree = [0, capacity]
        self.used = 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) in the first bin that has room for `size`, at most the capacity."""
        if self.tree[1] < size:
            old = self.tree
            n = self.leaves
            self.leaves *= 2
            tree = [self.capacity] * (2 * self.leaves)
            level = 1
            while level <= n:
                tree[2 * level : 3 * level] = old[level : 2 * level]
                level *= 2
            self.tree = tree
        i = 1
        tree, n = self.tree, self.leaves
        while i < n:
            i *= 2
            if tree[i] < size:
                i += 1
        at = self.capacity - tree[i]
        tree[i] -= size
        found = i - n
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a >= b else b
        self.used = max(self.used, found + 1)
        return found, at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given; the largest are placed first, of equal ones the earlier."""
    bins = Bins(capacity)
    which, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        which[i], offset[i] = bins.put(int(sizes[i]))
    return which, offset


def id_type(vocabulary: bytes) -> type:
    """Two bytes hold the ids of most vocabularies."""
    return np.uint16 if end_of_text(vocabulary) < 1 << 16 else np.uint32


def _pieces(told, capacity: int):
    """(doc_id, first_token, n_tokens, ids as bytes): the tokens of each document and an end mark, cut into pieces of `capacity` and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = told.value
        kind, end = id_type(vocabulary), end_of_text(vocabulary)
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(1)):
                row, first, size, raw = [], [], [], []
                for i, text in enumerate(texts_of(batch.column(1).slice(lo, hi - lo)), lo):
                    ids = np.append(encode(vocabulary, text), end).astype(kind)
                    for at in range(0, len(ids), capacity):
                        part = ids[at : at + capacity]
                        row.append(i)
                        first.append(at)
                        size.append(len(part))
                        raw.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "first_token", "n_tokens", "ids"])

    return run


def _packed(capacity: int, kind: type):
    """The bins of one group, each a row."""

    def run(key, table):
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("first_token", "ascending")])
        which, offset = first_fit_decreasing(table.column("n_tokens").to_numpy(), capacity)
        order = np.lexsort((offset, which))
        table, which, offset = table.take(pa.array(order)), which[order], offset[order]
        bins = int(which[-1]) + 1
        piece = np.searchsorted(which, np.arange(bins + 1))
        token = np.concatenate(([0], np.cumsum(table.column("n_tokens").to_numpy(), dtype=np.int64)))[piece]
        ids = np.frombuffer(b"".join(x.as_buffer() for x in table.column("ids")), kind).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(piece.astype(np.int32)), x) for x in (table.column("doc_id").combine_chunks(), table.column("first_token").combine_chunks(), pa.array(offset.astype(np.int32)))]
        return pa.Table.from_arrays([pa.array(np.full(bins, key[0].as_py()), pa.int64()), pa.array(np.arange(bins)), pa.array(np.diff(token).astype(np.int32)), *lists, list_array(ids, token)], ["grp", "bin", "n_tokens", "doc_ids", "first_tokens", "offsets", "input_ids"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, salt: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """(grp, bin, n_tokens, doc_ids, first_tokens, offsets, input_ids): training sequences of at most `capacity` token ids.

    A document has the tokens of its text and an end mark; one that is longer than a sequence is cut into pieces of a whole sequence each and
    what is left. Pieces fall into random groups of about `group` documents (fewer where texts are long, so that a group has some 64 MB of
    text), and the pieces of each group are packed first-fit decreasing, of equal ones the smaller doc_id first. Entry i of the three lists tells of
    the i-th piece in a sequence: its document, which of the document's tokens it begins with, and where in input_ids it begins; attention and
    loss are to be cut at these offsets.

    Null and empty texts are an end mark. Rows that repeat are packed each, and are spread over the groups; a null doc_id stays null. No
    documents, no rows. Other columns are not looked at. The groups are drawn by a seeded sequence for each partition of `docs`, which is to be a
    table of files, so that a task that runs again draws the same.
    """
    told = docs.sparkSession.sparkContext.broadcast(ranks(tokenizer))  # a vocabulary, some 1 MB
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = text.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, round(size["rows"] / group), -(-size["bytes"] // GROUP_BYTES))
    pieces = text.mapInArrow(_pieces(told, capacity), "doc_id long, first_token long, n_tokens int, ids binary")
    keyed = pieces.withColumn("grp", F.floor(F.rand(salt) * groups).cast("long"))
    return keyed.groupBy("grp").applyInArrow(_packed(capacity, id_type(told.value)), "grp long, bin long, n_tokens int, doc_ids array<long>, first_tokens array<long>, offsets array<int>, input_ids array<int>")
