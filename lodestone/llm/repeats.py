"""Passages of text that occur in more than one document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stash import Stash, small
from lodestone.llm.textkit import LOWER, U, WORD, Words, chunks, mix, powers

#: Every residue modulo PERIOD is a difference of two members, so that of any shift between two equal passages one offset below PERIOD falls on members in both.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LENGTH = 50
BATCH_BYTES = 16 << 20
#: Bytes of text for each bucket of hashes, which one task holds.
BUCKET_BYTES = 64 << 20
#: Documents of a batch that have a window in as many different surroundings, from which it is known to be worth a comparison everywhere.
HOT = 64
_ANCHOR = (np.uint64, np.uint64, np.int64, np.uint32)
_WINDOW = (np.uint64, np.int64, np.uint32)
_SPAN = (np.int64, np.uint32, np.uint32)
_BLOBS = "bucket int, kind int, n int, blob binary"
HASHES, SPANS = 0, 1


class Ranges:
    """Hashes of ranges of words."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first])


def spread(key: np.ndarray, buckets: int, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has members: its number, what they are, how many, and their columns one after the other as bytes."""
    bucket = (key % U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:], len(order)]
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[lo:hi].tobytes() for c in columns) for lo, hi in zip(first, ends)]
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), kind, np.int32)), pa.array(np.diff([*first, len(order)]).astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "n", "blob"])


def gather(batches: Iterable[pa.RecordBatch], types: tuple) -> list[np.ndarray]:
    """The columns of all rows that spread() made of them."""
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for batch in batches:
        for n, blob in zip(batch.column(2).to_pylist(), batch.column(3)):
            raw, lo = blob.as_buffer(), 0
            for p, t in zip(parts, types):
                p.append(np.frombuffer(raw, t, n, lo))
                lo += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types)]


class Hashes:
    """The batches of hashes among some; those of spans, which are on their way to their documents, are kept in `passed` as they are."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.passed = batches, []

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        for batch in self.batches:
            spans = pc.equal(batch.column(1), SPANS)
            self.passed.append(batch.filter(spans))
            yield batch.filter(pc.invert(spans))


def by_doc(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64))


def _anchors(length: int, buckets: int, batch_bytes: int, hot: int):
    """A hash for each window of length - PERIOD + 1 words at a cover position, one of the PERIOD - 1 words more on each side, the document and the position."""
    width, side = length - PERIOD + 1, PERIOD - 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, off in chunks(batch.column(1)):
                w = Words(LOWER[data], off, WORD)
                pos = np.arange(len(w.text)) - w.first[w.text]
                at = np.flatnonzero(cover[pos % PERIOD] & (pos + width <= w.count[w.text]) & (w.count[w.text] >= length))
                if not len(at):
                    continue
                of = Ranges(w.hash())
                text, pos = w.text[at], pos[at]
                right = np.minimum(side, w.count[text] - pos - width)
                full = of(at - np.minimum(side, pos), at + width + right)
                held.append([of(at, at + width), full, ids[lo + text], (pos << 5 | right).astype(np.uint32)])
                size += len(at) * 28
                if size > batch_bytes:
                    yield from _flush_anchors(held, length, buckets, hot)
                    size = 0
        if held:
            yield from _flush_anchors(held, length, buckets, hot)

    return run


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before in any of some columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _ends(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest document of each row's group."""
    n = group[-1] + 1 if len(group) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    return low[group], high[group]


def _flush_anchors(held: list[list[np.ndarray]], length: int, buckets: int, hot_documents: int) -> Iterator[pa.RecordBatch]:
    """The anchors of a batch for their buckets, without those on which the batch itself decides.

    Where two documents of the batch agree on the surroundings too, the spans are sure; one anchor of the smallest and one of the largest document
    stand for all. Of a window that `hot_documents` have in surroundings of their own, the positions are to be compared in any case, and
    two anchors tell the other batches. So a window that many documents share puts a few rows a batch into its bucket.
    """
    width, side = length - PERIOD + 1, PERIOD - 1
    h, full, doc, pos = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.lexsort((pos, doc, full, h))
    h, full, doc, pos = h[order], full[order], doc[order], pos[order]
    first, right = (pos >> 5).astype(np.int64), (pos & 31).astype(np.int64)
    left = np.minimum(side, first)
    whole = left + width + right >= length
    low, high = _ends(np.cumsum(_heads(h, full)) - 1, doc)
    sure = low != high
    keep = ~sure | (_heads(h, full, doc) & ((doc == low) | (doc == high)))
    group = np.cumsum(_heads(h)) - 1
    alone = np.flatnonzero(~sure)
    several = np.bincount(group[alone][_heads(group[alone], doc[alone])] if len(alone) else alone, minlength=group[-1] + 1) >= hot_documents
    hot = np.zeros(len(h), bool)
    hot[alone] = several[group[alone]]
    at = np.flatnonzero(hot)
    low, high = _ends(np.unique(group[at], return_inverse=True)[1], doc[at])
    ends = _heads(group[at], doc[at]) & ((doc[at] == low) | (doc[at] == high)) if len(at) else hot[at]
    keep[at] = ends
    yield from spread(h[keep] >> U(16), buckets, [h[keep], full[keep], doc[keep], pos[keep]], HASHES)
    s, o = sure & whole, hot & whole
    d, a, b = union(doc[s], (first - left)[s], (first + width + right)[s])
    out = [np.concatenate((d, doc[o])), np.concatenate((a, first[o])).astype(np.uint32), np.concatenate((b, np.zeros(o.sum(), np.int64))).astype(np.uint32)]
    yield from spread(by_doc(out[0]), buckets, out, SPANS)


def _flush_windows(held: list[list[np.ndarray]], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of a batch for their buckets; of one that documents of the batch share the smallest and the largest of these stand for all, whose spans are sure."""
    h, doc, at = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.lexsort((at, doc, h))
    h, doc, at = h[order], doc[order], at[order]
    if not len(h):
        return
    low, high = _ends(np.cumsum(_heads(h)) - 1, doc)
    sure = low != high
    keep = ~sure | (_heads(h, doc) & ((doc == low) | (doc == high)))
    yield from spread(h[keep] >> U(16), buckets, [h[keep], doc[keep], at[keep]], HASHES)
    d, a, b = union(doc[sure], at[sure], at[sure] + np.uint32(length))
    yield from spread(by_doc(d), buckets, [d, a.astype(np.uint32), b.astype(np.uint32)], SPANS)


def _matched(length: int, buckets: int):
    """Of the anchors of a bucket, those that documents share: as repeated spans, where the words around agree too, and else, or where other surroundings occur, as positions to compare in the texts."""
    width, side = length - PERIOD + 1, PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashes(batches)
        h, full, doc, pos = gather(own, _ANCHOR)
        yield from own.passed
        order = np.argsort(h, kind="stable")
        low, high = _ends(np.cumsum(_heads(h[order])) - 1, doc[order]) if len(h) else (doc, doc)
        order = order[low != high]
        h, full, doc, pos = h[order], full[order], doc[order], pos[order]
        order = np.lexsort((pos, doc, full, h))
        h, full, doc, pos = h[order], full[order], doc[order], pos[order]
        if not len(h):
            return
        group, one = np.cumsum(_heads(h)) - 1, _heads(h, full)
        first, right = (pos >> 5).astype(np.int64), (pos & 31).astype(np.int64)
        left = np.minimum(side, first)
        whole = left + width + right >= length
        low, high = _ends(np.cumsum(one) - 1, doc)
        sure = low != high
        # of each surroundings the occurrences in two documents stand for all, those of one document's all
        own = _heads(h, full, doc) & ((doc == low) | (doc == high)) | ~sure
        open_ = (np.bincount(group[one]) > 1)[group] & whole & own
        s = sure & whole
        out = [np.concatenate((doc[s], doc[open_])), np.concatenate(((first - left)[s], first[open_])).astype(np.uint32), np.concatenate(((first + width + right)[s], np.zeros(open_.sum(), np.int64))).astype(np.uint32)]
        yield from spread(by_doc(out[0]), buckets, out, SPANS)

    return run


def union(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document united where they overlap or touch."""
    if not len(doc):
        return doc, first, end
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order].astype(np.int64), end[order].astype(np.int64)
    rank = np.cumsum(_heads(doc)) - 1
    reach = np.maximum.accumulate(end + rank * (1 << 33)) - rank * (1 << 33)
    new = _heads(doc)
    new[1:] |= first[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], first[starts], reach[np.append(starts[1:], len(doc)) - 1]


def _per_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, spans, open): the sure spans of a document and the positions to compare, as bytes."""
    doc, first, end = gather(batches, _SPAN)
    s = end > 0
    d, a, b = union(doc[s], first[s], end[s])
    o = np.lexsort((first[~s], doc[~s]))
    od, op = doc[~s][o], first[~s][o]
    docs = np.unique(doc)
    cut = [np.searchsorted(x, docs, side) for x in (d, od) for side in ("left", "right")]
    spans = [np.stack((a[i:j], b[i:j])).astype(np.uint32).tobytes() for i, j in zip(cut[0], cut[1])]
    opens = [op[i:j].astype(np.uint32).tobytes() for i, j in zip(cut[2], cut[3])]
    for i in range(0, len(docs), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 4096]), pa.array(spans[i : i + 4096], pa.binary()), pa.array(opens[i : i + 4096], pa.binary())], ["doc_id", "spans", "open"])


def _windows(length: int, buckets: int, batch_bytes: int):
    """The hashes of all windows of `length` words around the positions to compare."""
    side = np.arange(PERIOD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, off in chunks(batch.column(1)):
                w = Words(LOWER[data], off, WORD)
                of = Ranges(w.hash())
                opens = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2).slice(lo, hi - lo)]
                text = np.repeat(np.arange(hi - lo), [len(x) for x in opens])
                at = (np.concatenate(opens).astype(np.int64)[:, None] - side).ravel()
                text = np.repeat(text, PERIOD)
                ok = (at >= 0) & (at + length <= w.count[text])
                both = np.unique(text[ok] << 32 | at[ok])
                text, at = both >> 32, both & 0xFFFFFFFF
                held.append([of(w.first[text] + at, w.first[text] + at + length), ids[lo + text], at.astype(np.uint32)])
                size += len(at) * 20
                if size > batch_bytes:
                    yield from _flush_windows(held, length, buckets)
                    size = 0
        if held:
            yield from _flush_windows(held, length, buckets)

    return run


def _shared(length: int, buckets: int):
    """The windows of a bucket that more than one document has, as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashes(batches)
        h, doc, at = gather(own, _WINDOW)
        yield from own.passed
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        low, high = _ends(np.cumsum(_heads(h)) - 1, doc) if len(h) else (doc, doc)
        doc, at = doc[low != high], at[low != high]
        yield from spread(by_doc(doc), buckets, [doc, at, (at + np.uint32(length)).astype(np.uint32)], SPANS)

    return run


def _known(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint32).reshape(2, -1) for x in batch.column(1)]
            n = [p.shape[1] for p in parts]
            if sum(n):
                both = np.concatenate(parts, 1)
                doc = np.repeat(batch.column(0).to_numpy(), n)
                yield from spread(by_doc(doc), buckets, [doc, both[0], both[1]], SPANS)

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, first, end = union(*gather(batches, _SPAN))
    for i in range(0, len(doc), 65536):
        k = slice(i, i + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(first[k].astype(np.int64)), pa.array((end[k].astype(np.int64) - first[k]))], ["doc_id", "first_word", "n_words"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words): where each document has words that lie in a run of `length` words found in another document too.

    Words are runs of letters, digits, underscores and characters beyond ASCII; case is ignored within ASCII. Overlapping and touching
    runs are one passage. Windows of length - 30 words are hashed only where their position modulo 31 is in a difference cover: two equal
    runs of `length` words have such a window at the same offset. Windows that documents share extend to 30 words on each side; where
    those agree the span is sure, and where they differ every run of `length` words around is compared. All comparisons are of 64-bit hashes. What a batch of texts
    decides by itself leaves it as spans, so that passages which many documents share don't fill one bucket; buckets are as many as the texts need.

    A repeat within one document doesn't count. Rows that repeat a doc_id are one document if their texts are equal too; of different
    texts under one doc_id each is compared with other documents only. Rows without doc_id or text have no passages, nor have texts of fewer
    words. Other columns are not looked at.
    """
    if not PERIOD <= length:
        raise ValueError(f"a length of at least {PERIOD} words is needed")
    spark = docs.sparkSession
    stash = Stash(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def exchanged(df: DataFrame) -> DataFrame:
        return df.repartitionById(buckets, F.col("bucket"))

    matched = exchanged(text.mapInArrow(_anchors(length, buckets, batch_bytes, hot), _BLOBS)).mapInArrow(_matched(length, buckets), _BLOBS)
    per_doc = stash.put(exchanged(matched).mapInArrow(_per_doc, "doc_id long, spans binary, open binary"))
    ids = stash.put(per_doc.filter("length(open) > 0").select("doc_id"))
    asked = text.join(small(ids), "doc_id", "left_semi").join(per_doc.filter("length(open) > 0").select("doc_id", "open"), "doc_id").select("doc_id", "text", "open")
    more = exchanged(asked.mapInArrow(_windows(length, buckets, batch_bytes), _BLOBS)).mapInArrow(_shared(length, buckets), _BLOBS)
    known = per_doc.filter("length(spans) > 0").select("doc_id", "spans").mapInArrow(_known(buckets), _BLOBS)
    return stash.finish(exchanged(more.unionByName(known)).mapInArrow(_united, "doc_id long, first_word long, n_words long"))
