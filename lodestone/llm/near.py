"""Near-duplicate documents by HyperMinHash sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stash import Stash, collect_garbage, components, small
from lodestone.llm.textkit import U, WORD, Words, binary_rows, buffers, chunks, mix

REGISTERS, MANTISSA, ROWS = 256, 10, 4
#: The registers of each band: all of them in runs of ROWS, and half as many bands again with registers from all over.
BANDS = np.concatenate((np.arange(REGISTERS).reshape(-1, ROWS), np.arange(REGISTERS).reshape(ROWS, -1).T[::2]))
HUB_ROUNDS = 2
#: Texts of a bucket that are compared in one block.
TILE = 2048
#: Pairs of texts that are listed at once, and of these the pairs whose sketches are compared at once.
LISTED, COMPARED = 1 << 18, 4096
EMPTY = 65535
#: Texts of at most so many bigrams meet by their rarest bigrams, not by bands: a band of few values is one bigram or two, which many texts share.
SHORT = 128
#: Texts that bigrams are counted in to tell which are frequent, and how many of these are told.
COUNTED, FREQUENT = 1 << 16, 1 << 19
#: Degrees of texts are counted up to this.
MOST = (1 << 22) - 1


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the word bigrams of a run of texts; a text of one word has that word."""
    h = w.hash()
    if not len(h):
        return h, w.text
    pair = w.text[:-1] == w.text[1:]
    two = mix(h[:-1] * U(0x9FB21C651E98DF25) + h[1:])[pair]
    one = w.first[:-1][w.count == 1]
    return np.concatenate((two, h[one])), np.concatenate((w.text[:-1][pair], w.text[one]))


def distinct(h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct hashes each text has."""
    first = np.unique(mix(h ^ (text.astype(np.uint64) * U(0x9FB21C651E98DF25))), return_index=True)[1]
    return np.bincount(text[first], minlength=texts)


def registers(w: Words) -> np.ndarray:
    """A sketch for each text: see sketched()."""
    return sketched(w, *shingles(w))


def sketched(w: Words, h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """In each of REGISTERS buckets the smallest hash of a text, kept as its leading-zero count and MANTISSA bits after the first one.

    Both are the top bits of the hash as a float, whose order is that of the hash.
    """
    out = np.full(len(w.count) * REGISTERS, EMPTY, np.uint16)
    if len(h):
        bits = ((h >> U(11)) | U(1)).astype(np.float64).view(np.int64) >> (52 - MANTISSA)
        np.minimum.at(out, text * REGISTERS + (h & U(REGISTERS - 1)).astype(np.int64), (bits - (1023 << MANTISSA)).astype(np.uint16))
    return out.reshape(-1, REGISTERS)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash for each band of each sketch.

    An empty register counts as the next one that isn't, with the distance to it, so that short texts don't agree on bands for want of values.
    """
    n = REGISTERS
    twice = np.concatenate((sketches, sketches), 1)
    at = np.where(twice != EMPTY, np.arange(2 * n), 2 * n - 1)
    at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :n]
    full = np.take_along_axis(twice, at, 1).astype(np.uint64) | ((at - np.arange(n)).astype(np.uint64) << U(16))
    keys = np.broadcast_to(np.arange(len(BANDS), dtype=np.uint64), (len(sketches), len(BANDS)))
    for i in range(ROWS):
        keys = mix(keys * U(0x9FB21C651E98DF25) + full[:, BANDS[:, i]])
    return keys


def reach(threshold: float) -> int:
    """Bigrams at most of a text that can have the similarity to one of SHORT."""
    return int(SHORT / threshold)


def sketch_batches(threshold: float):
    """(doc_id, digest, size, sketch, grams); grams: of texts within reach() 32 bits of each distinct bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2)):
                w = Words(data, off, WORD)
                h, text = shingles(w)
                size = distinct(h, text, hi - lo)
                own = size[text] <= reach(threshold)
                grams, of = h[own], text[own]
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
                first = (np.searchsorted(of[new], np.arange(hi - lo + 1)) * 4).astype(np.int32)
                grams = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(first), pa.py_buffer((grams[new] >> U(32)).astype(np.uint32))])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(size.astype(np.int32)), binary_rows(sketched(w, h, text)), grams], ["doc_id", "digest", "size", "sketch", "grams"])

    return run


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, how many each text has)"""
    data, off = buffers(column)
    return data[off[0] : off[-1]].copy().view(np.uint32), np.diff(off) // 4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, n = np.unique(grams_of(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def frequent(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams that come more than once in at most about COUNTED of the texts that have `grams`, in order, and how often; at most FREQUENT."""
    own = units.filter("length(grams) > 0")
    some = own.filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int((1 << 20) * min(1, COUNTED / max(1, own.count()))))
    counts = some.select("grams").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    got = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    gram, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(gram)
    return gram[order].astype(np.uint32), n[order]


def rare_keys(gram: np.ndarray, size: np.ndarray, known: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text of each, whether it is of the shorter text of a pair) of the rarest bigrams of each text.

    Of sets of a <= b members and the similarity t, o members are in both, which is at least 2 t a / (1 + t) and at least t b. In any one order of all bigrams the
    first a - o + 1 of the one and b - o + 1 of the other have one in common. The order is by frequency, as `known`, and by value, so that it
    bears on the number of pairs only. Bigrams of a text that agree in these 32 bits count each, which can only add pairs.
    """
    text = np.repeat(np.arange(len(size)), size)
    at = np.minimum(np.searchsorted(known[0], gram), max(0, len(known[0]) - 1))
    often = np.where(known[0][at] == gram, known[1][at], 0) if len(known[0]) else np.zeros(len(gram), np.int64)
    order = np.lexsort((gram, often, text))
    gram, n = gram[order], size[text]
    place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
    shared = lambda share: np.ceil(share * n - 1e-6)
    own = place <= n - shared(threshold)
    shorter = (n <= SHORT) & (place <= n - shared(2 * threshold / (1 + threshold)))
    keys = mix(gram.astype(np.uint64) * U(0x9FB21C651E98DF25) + U(len(BANDS))) | U(1)
    return keys[own].view(np.int64), text[own], shorter[own]


def long_keys(sketches: np.ndarray) -> np.ndarray:
    """Keys of bands; they are even, those of rare_keys() odd."""
    return (band_keys(sketches) & ~U(1)).view(np.int64)


def _keyed(known: tuple[np.ndarray, np.ndarray], threshold: float):
    """(key, tid): of texts longer than SHORT a key for each band, of those within reach() one for each of their rarest bigrams. tid is -1 - tid where two such rows need no comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                tid = part.column(0).to_numpy()
                long = np.flatnonzero(part.column(1).to_numpy() > SHORT)
                banded = long_keys(sketches_of(part.column(2).take(pa.array(long)))).ravel()
                keys, text, shorter = rare_keys(*grams_of(part.column(3)), known, threshold)
                ids = np.concatenate((np.repeat(tid[long], len(BANDS)), np.where(shorter, tid[text], -1 - tid[text])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((banded, keys))), pa.array(ids)], ["key", "tid"])

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tid, n) of rows in order of key whose key has n > 1 rows, not all of them with a negative tid; of a key of MOST rows or more n is MOST, so that no more are held."""

    def rows(key: np.ndarray, tid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = n > 1
        if len(tid) and tid.min() < 0:
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            own &= np.repeat(np.logical_or.reduceat(tid >= 0, cut), np.diff(np.append(cut, len(key)))) | (n >= MOST)
            tid = np.where(tid < 0, -1 - tid, tid)
        return pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (key, tid, np.minimum(n, MOST))], ["key", "tid", "n"])

    held, last, count, large = [], None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1])))
        first = int(cut[0]) if len(cut) else len(key)
        if first:
            held, count = [*held, tid[:first]], count + first
        if count >= MOST or large:
            large = True
            all_ = np.concatenate(held) if held else tid[:0]
            yield rows(np.full(len(all_), last, np.int64), all_, np.full(len(all_), MOST, np.int64))
            held = []
        if not len(cut):
            continue
        if held:
            all_ = np.concatenate(held)
            yield rows(np.full(len(all_), last, np.int64), all_, np.full(len(all_), count, np.int64))
        end = int(cut[-1])
        yield rows(key[first:end], tid[first:end], np.repeat(np.diff(cut), np.diff(cut)))
        held, last, count, large = [tid[end:]], key[end], len(key) - end, False
    if held:
        all_ = np.concatenate(held)
        yield rows(np.full(len(all_), last, np.int64), all_, np.full(len(all_), MOST if large else count, np.int64))


@lru_cache(maxsize=4096)
def chance(log_a: int, log_b: int) -> float:
    """How probably two unrelated buckets of 2**(log_a / 2) and 2**(log_b / 2) values hold the same register."""
    edges = np.concatenate([np.ldexp(1 + np.arange(1 << MANTISSA) / (1 << MANTISSA), -k) for k in range(40, 0, -1)] + [[1.0]])
    none = [np.exp(-(2.0 ** (x / 2)) * edges) for x in (log_a, log_b)]
    return float(((none[0][:-1] - none[0][1:]) * (none[1][:-1] - none[1][1:])).sum())


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches of sets of so many members, corrected for chance collisions, and the registers each estimate rests on."""
    full = (a != EMPTY) & (b != EMPTY)
    same = ((a == b) & full).sum(-1).astype(float)
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1).astype(float)
    la, lb = (np.round(2 * np.log2(np.maximum(x, 1) / REGISTERS)).astype(int) for x in (size_a, size_b))
    la, lb = np.broadcast_arrays(la, lb)
    pairs, back = np.unique(np.stack((la.ravel(), lb.ravel())), axis=1, return_inverse=True)
    p = np.array([chance(int(x), int(y)) for x, y in pairs.T])[back.ravel()].reshape(same.shape)
    p = p / np.maximum(used / REGISTERS, 1e-9)
    return np.clip((same / np.maximum(used, 1) - p) / (1 - np.minimum(p, 0.5)), 0, 1), used


def near_enough(got: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    return got >= threshold - 3.5 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


def possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have sizes that allow the threshold, and estimates within 3.5 standard errors of it."""
    return alike(size_a, size_b, threshold) & near_enough(*estimate(a, b, size_a, size_b), threshold)


def alike(size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of such sizes can have the similarity at all: it is at most the smaller size over the larger."""
    return np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers of pairs of sketches differ."""
    return REGISTERS - np.bitwise_count((a == b).view(np.uint64)).sum(-1, dtype=np.int64)


def within_reach(differ: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may be possible(), by the registers that differ, and may have the similarity; none that has it and is possible() is left out.

    In a register that differs the smaller hash, or the only one, is of one set alone. Sets of that similarity have at most (1 - threshold) / (1 + threshold) of their
    sizes' sum in one of them alone, which settles pairs of short texts. Of the registers used, of which there are no more than members, the estimate allows a
    share of 1 - threshold to differ and 3.5 standard errors.
    """
    both = size_a.astype(np.int64) + size_b
    used = np.minimum(both, REGISTERS)
    return (differ * (1 + threshold) <= both * (1 - threshold) + 1e-6) & (differ <= (1 - threshold) * used + 3.5 * np.sqrt(threshold * (1 - threshold) * used) + 1e-6)


def brief(sketches: np.ndarray) -> np.ndarray:
    """The last four bits of each register, two registers a byte."""
    low = (sketches & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def differing_brief(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers of pairs differ in their last four bits: no more than differ at all."""
    x = (a ^ b).view(np.uint64)
    x |= x >> U(2)
    return np.bitwise_count((x | x >> U(1)) & U(0x1111111111111111)).sum(-1, dtype=np.int64)


def _briefed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary_rows(brief(sketches_of(b.column(2))))], ["tid", "size", "brief"])


def _open(threshold: float):
    """Pairs that sizes and the last bits of registers don't rule out."""

    def run(batches):
        for b in batches:
            size_a, size_b = b.column(3).to_numpy(), b.column(5).to_numpy()
            x, y = (np.frombuffer(b"".join(v.as_buffer() for v in b.column(c)), np.uint8).reshape(-1, REGISTERS // 2) for c in (2, 4))
            keep = alike(size_a, size_b, threshold) & within_reach(differing_brief(x, y), size_a, size_b, threshold)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(-1, REGISTERS)


def _estimated(threshold: float):
    def run(batches):
        for b in batches:
            size_a, size_b = b.column(3).to_numpy(), b.column(5).to_numpy()
            x, y = sketches_of(b.column(2)), sketches_of(b.column(4))
            own = np.flatnonzero(alike(size_a, size_b, threshold) & within_reach(differing(x, y), size_a, size_b, threshold))
            if len(own):
                got, used = estimate(x[own], y[own], size_a[own], size_b[own])
                keep = near_enough(got, used, threshold)
                rows = pa.array(own[keep])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(got[keep])], ["a", "b", "similarity"])

    return run


def _within(threshold: float):
    """Pairs of each tile (rows in order of key, i and j) whose members aren't yet in one component; of a tile i < j those of a member of i and one of j.

    A pair of texts longer than SHORT is looked at under the smallest key of a band that its members share, which has both of them too unless the pair is settled, and nowhere else; other
    pairs under each bigram by which they meet. Pairs of many tiles are listed at once, as most tiles are small.
    """

    def tiles(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, root, size, block, i, j = (t.column(c).to_numpy() for c in ("key", "tid", "root", "size", "blk", "i", "j"))
        sk = sketches_of(t.column("sketch").combine_chunks())
        new = np.logical_or.reduce([np.diff(c) != 0 for c in (key, i, j)])
        cut = np.concatenate(([0], np.flatnonzero(new) + 1, [len(ids)]))
        left, same = block == i, i == j
        met, long = (key & 1) == 1, size > SHORT
        after = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(ids)) - 1
        upto = np.concatenate(([0], np.cumsum(after)))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + LISTED, "right")) - 1)
            n = after[lo:hi]
            p = np.repeat(np.arange(lo, hi), n)
            q = p + 1 + np.arange(len(p)) - np.repeat(upto[lo:hi] - upto[lo], n)
            lo = hi
            open_ = (root[p] != root[q]) & alike(size[p], size[q], threshold) & (same[p] | (left[p] != left[q])) & ~(met[p] & long[p] & long[q])
            p, q = p[open_], q[open_]
            for s in range(0, len(p), COMPARED):
                x, y = p[s : s + COMPARED], q[s : s + COMPARED]
                ok = within_reach(differing(sk[x], sk[y]), size[x], size[y], threshold)
                x, y = x[ok], y[ok]
                if len(x):
                    ok = possible(sk[x], sk[y], size[x], size[y], threshold)
                    x, y = x[ok], y[ok]
                    ok, own = np.ones(len(x), bool), np.flatnonzero(~met[x])
                    one, other = (long_keys(sk[z[own]]) for z in (x, y))
                    ok[own] = ~((one == other) & (one < key[x[own]][:, None])).any(1)
                    x, y = ids[x[ok]], ids[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            starts = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in key])) + 1
            same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("key", "i", "j"))
            if held and not same:
                yield from tiles(pa.Table.from_batches(held))
                held = []
            if len(starts):
                yield from tiles(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                held = []
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from tiles(pa.Table.from_batches(held))

    return run


def _sets(batches):
    """(tid, grams): the distinct bigrams of each text as sorted 64-bit hashes."""
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(1)):
            h, text = shingles(Words(data, off, WORD))
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], text[new]
            first = (np.searchsorted(text, np.arange(hi - lo + 1)) * 8).astype(np.int32)
            col = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(first), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), col], ["tid", "grams"])


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= threshold * (len(p) + len(q) - both) and both > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, lowered text as bytes) of rows that have both an id and a text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return own.select("doc_id", digest("text").alias("digest"), F.lower("text").cast("binary").alias("low"))


def digest(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def numbered(table: DataFrame) -> DataFrame:
    """A stashed table with `at` of monotonically_increasing_id() as one with `tid`, numbers from 0 without gaps, so that they are small."""
    part = F.shiftright("at", 33)
    rows = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    begin = np.concatenate(([0], np.cumsum([n for _, n in rows]))).tolist()
    starts = table.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(rows, begin)], "part long, begin long")
    return table.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("tid", F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "begin", "at")


def _verify(edges: DataFrame, units: DataFrame, docs: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """The edges (a, b) whose bigram sets have at least the Jaccard similarity `threshold`, by all their 64-bit hashes."""
    own = Stash(docs.sparkSession)
    ids = own.put(edges.select(F.col("a").alias("tid")).unionByName(edges.select(F.col("b").alias("tid"))).distinct())
    asked = own.put(units.select("tid", F.col("low").alias("doc_id"), "digest").join(ids, "tid", "left_semi"))
    sets = own.put(texts(docs).join(small(asked), ["doc_id", "digest"]).select("tid", "low").mapInArrow(_sets, "tid long, grams binary").dropDuplicates(["tid"]))
    both = edges.join(sets.select(F.col("tid").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("tid").alias("b"), F.col("grams").alias("grams_b")), "b")
    out = stash.put(both.select("a", "b", "grams_a", "grams_b").mapInArrow(_verified(threshold), "a long, b long"))
    own.close()
    del both, sets
    collect_garbage(docs.sparkSession)
    return out


def _marks(docs: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """(doc_id, digest, times, dup_of, kept) of each distinct pair of doc_id and text: in how many rows it is, the smallest doc_id of its group, and whether it is the one that stays.

    Texts are compared, each once; rows come in again at the end. What is kept of a key is aggregated before the shuffle and joined back from a table, so that keys
    which many texts share are split by the skew join.
    """
    spark = docs.sparkSession
    first = Stash(spark)
    made = first.put(texts(docs).mapInArrow(sketch_batches(threshold), "doc_id long, digest binary, size int, sketch binary, grams binary"))
    units = numbered(stash.put(made.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("grams").alias("grams")).withColumn("at", F.monotonically_increasing_id())))
    rows = stash.put(made.groupBy("doc_id", "digest").agg(F.count("*").alias("times")))
    first.close()
    keyed = units.filter("size > 0").select("tid", "size", "sketch", "grams").mapInArrow(_keyed(frequent(units), threshold), "key long, tid long")
    keyed = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_several, "key long, tid long, n long")
    # at most a key a band and one for each of reach() bigrams; a row for each text, so that roots are joined to few rows
    shared = stash.put(keyed.groupBy("tid").agg(F.collect_list("key").alias("keys"), F.least(F.sum("n"), F.lit(MOST)).alias("degree")))
    reps = units.join(shared.select("tid"), "tid", "left_semi").select("tid", "size", "sketch")
    # most pairs with hubs are of texts that share little, which is seen without their whole sketches
    briefs = stash.put(reps.mapInArrow(_briefed, "tid long, size int, brief binary"))
    short = lambda c: briefs.select(F.col("tid").alias(c), F.col("brief").alias(f"brief_{c}"), F.col("size").alias(f"size_{c}"))
    side = lambda c: reps.select(F.col("tid").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("size").alias(f"size_{c}"))
    del keyed
    collect_garbage(spark)
    sure = root = later = None
    open_ = shared.select(F.explode("keys").alias("key"), "tid", "degree", F.col("tid").alias("root"))
    for _ in range(HUB_ROUNDS):
        # the highest degree, and of these the smallest tid, in one number; of keys that have the same texts one is enough, and they have the same hub
        open_ = open_.select("key", "tid", "degree", "root")
        top = F.max(F.shiftleft("degree", 40) + (F.lit((1 << 40) - 1) - F.col("tid"))).alias("top")
        hub = open_.groupBy("key").agg(top, F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("texts")).filter("n > 1")
        hub = stash.put(hub.groupBy((F.lit((1 << 40) - 1) - F.col("top").bitwiseAND((1 << 40) - 1)).alias("a"), "n", "texts").agg(F.min("key").alias("key")).select("key", "a"))
        open_ = stash.put(open_.join(hub, "key").filter("tid <> a"))
        collect_garbage(spark)
        ends = stash.put(open_.select("a", F.col("tid").alias("b"), "root").distinct())
        if root is not None:
            ends = ends.join(root.select(F.col("tid").alias("a"), F.col("root").alias("root_a")), "a", "left").filter("root <> coalesce(root_a, a)")
        ends = ends.select("a", "b").join(short("a"), "a").join(short("b"), "b").select("a", "b", "brief_a", "size_a", "brief_b", "size_b")
        ends = stash.put(ends.mapInArrow(_open(threshold), "a long, b long"))
        near = ends.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "size_a", "sketch_b", "size_b")
        near = stash.put(near.mapInArrow(_estimated(threshold), "a long, b long, similarity double"))
        best = stash.put(near.groupBy("b").agg(F.max(F.struct("similarity", "a")).alias("best")).select("best.a", "b"))
        rest = near.select("a", "b").join(best, ["a", "b"], "left_anti")
        later = rest if later is None else later.unionByName(rest)
        collect_garbage(spark)
        more = _verify(best, units, docs, threshold, stash)
        sure = more if sure is None else sure.unionByName(more)
        root = stash.put(components(sure, stash).withColumnRenamed("id", "tid"))
        # a hub has been compared with all texts of its key, which goes on without it
        labelled = stash.put(open_.drop("root", "a").join(root, "tid", "left").select("key", "tid", "degree", F.coalesce("root", "tid").alias("root")))
        several = stash.put(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi"))
        # a key whose texts are in one component stays so, and is done
        open_ = stash.put(labelled.join(several.select("key", "n"), "key"))
        collect_garbage(spark)
    # a bucket of many texts is cut into blocks, each pair of which is a tile of its own
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    tiled = open_.select("key", "tid", "root", blocks.alias("blocks")).withColumn("blk", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("blk", k).alias("i"), F.greatest("blk", k).alias("j")))
    tiled = tiled.join(reps, "tid").select("key", F.explode(ends).alias("at"), "tid", "root", "size", "sketch", "blk").select("key", "at.i", "at.j", "blk", "tid", "root", "size", "sketch")
    # as many tasks as a shuffle has: their work is not in proportion to their bytes
    rest = tiled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = stash.put(rest.mapInArrow(_within(threshold), "a long, b long"))
    collect_garbage(spark)
    # pairs that hubs proposed beside the best ones
    for c in ("a", "b"):
        later = later.join(root.select(F.col("tid").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    rest = stash.put(rest.unionByName(later.filter("root_a <> root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    root = components(sure.unionByName(_verify(rest, units, docs, threshold, stash)), stash).withColumnRenamed("id", "tid")
    classes = stash.put(units.select("tid", "low", "digest").join(root, "tid", "left").select("low", "digest", F.coalesce("root", "tid").alias("root")))
    stays = stash.put(classes.groupBy("root").agg(F.min(F.struct("low", "digest")).alias("keep")))
    classes = stash.put(classes.join(stays, "root").select("digest", F.col("keep.low").alias("dup_of"), (F.col("keep.digest") == F.col("digest")).alias("first")))
    return stash.put(rows.join(classes, "digest").select("doc_id", "digest", "times", "dup_of", (F.col("first") & (F.col("doc_id") == F.col("dup_of"))).alias("kept")))


def near_duplicates(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, dup_of) for every document that is not the smallest id of its group of near copies.

    Two documents are near copies if the Jaccard similarity of their sets of word bigrams (lower case, punctuation
    dropped; 64-bit hashes) is at least `threshold`; groups are connected components. HyperMinHash sketches (leading-zero count and
    MANTISSA bits in each of REGISTERS buckets) are banded, ROWS registers to a band; texts of at most SHORT bigrams meet each other and longer ones by
    their rarest bigrams instead, which leaves out no pair that has the similarity. A bucket first proposes its members
    against that one of them which shares most buckets, as the original of many edited copies does; estimates that come near the
    threshold are verified on the whole sets, the best partner of a document at once and the others at the end if they are still in different components. The bucket goes
    on without that member. After HUB_ROUNDS of this all pairs of a bucket that are
    still in different components are estimated and verified, large buckets in tiles of two blocks of TILE texts. Pairs within one component can't change
    it, so none that matters is left out and no bucket is capped. Pairs are estimated only if the registers that differ don't rule the similarity out.

    The sketches are what may miss a pair: of 1,000 made pairs of texts of over 1,000 words, 0.997 share a band and pass the filter at a similarity of 0.50, 0.999 at
    0.52, and all at 0.55 and 0.60.

    Rows without doc_id or text are ignored. Identical texts, empty ones too, are copies. Texts without a word are
    compared no further. Rows that repeat both doc_id and text are one document; different texts under one doc_id are documents of their own, and the
    doc_id is named if one of them is a copy of a text under a smaller one. Other columns are not looked at. No documents, no rows.
    """
    stash = Stash(docs.sparkSession)
    return stash.finish(_marks(docs, threshold, stash).filter("not kept and doc_id <> dup_of").select("doc_id", "dup_of").distinct())


def without_near_duplicates(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` with one row of each group of near copies: of the smallest doc_id, and if it has several texts in the group the one with the smallest MD5.

    Rows are told apart by doc_id and text: a doc_id that comes again with a text unlike the others keeps that row. Rows without doc_id or text stay, all
    of them. Other columns, whatever they are called, stay as they are; of rows that repeat doc_id and text any one stays. Of an empty table nothing is left.

    The result is read from `docs` and from two tables of ids, which stay in the shared folder.
    """
    stash, told = Stash(docs.sparkSession), Stash(docs.sparkSession)
    marks = _marks(docs, threshold, stash)
    gone = told.put(marks.filter("not kept").select(F.col("doc_id").alias("dup"), "digest"))
    again = told.put(marks.filter("kept and times > 1").select(F.col("doc_id").alias("dup"), "digest"))
    stash.close()
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    doc_id, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    keyed = flat.withColumns({"dup": F.col(doc_id).cast("long"), "digest": digest(text)})
    out = keyed.join(small(gone), ["dup", "digest"], "left_anti")
    if not again.isEmpty():
        once = out.join(small(again), ["dup", "digest"], "left_semi").dropDuplicates(["dup", "digest"])
        out = out.join(small(again), ["dup", "digest"], "left_anti").unionByName(once)
    return out.select(*names).toDF(*docs.columns)
