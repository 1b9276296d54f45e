"""Vectors with a high cosine, found by int8 products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.stash import Stash, components

BLOCK, STRIP = 4096, 1024
#: Above the rounding of the float64 sums that the bounds are made of.
SLACK = 1e-9


def valid(batch: pa.RecordBatch, at: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by dimension, of the rows whose list has numbers only, all finite and not all zero."""
    lists = batch.column(at)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    off = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
    dims = np.diff(off)
    for d in np.unique(dims[dims > 0]):
        rows = np.flatnonzero(dims == d)
        x = flat[off[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(1)
        ok = np.isfinite(x).all(1) & (top > 0)
        rows, x = rows[ok], x[ok] / top[ok, None]
        if len(rows):
            yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, int8 codes of what these miss, and six rows of floats) of unit vectors.

    The floats are the scale, the length of the decoded vector and the length of what it misses, for the first codes and for both together.
    """
    q, scale = _code(x)
    back = q * scale[:, None]
    more, fine = _code(x - back)
    both = back + more * fine[:, None]
    length = lambda v: np.sqrt((v * v).sum(1))
    return q, more, np.stack((scale, length(back), length(x - back), fine, length(both), length(x - both)))


def _blocks(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, weight = (batch.column(i).to_numpy() for i in (0, 2, 3))
            for rows, x in valid(batch):
                q, more, meta = quantise(x)
                for g in np.unique(group[rows]):
                    own = group[rows] == g
                    blob = ids[rows[own]].tobytes() + weight[rows[own]].tobytes() + meta[:, own].tobytes() + q[own].tobytes() + more[own].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([int(own.sum())], pa.int32()), pa.array([blob], pa.binary())], ["grp", "dim", "n", "blob"])

    return run


@dataclass(frozen=True)
class Block:
    """Vectors of one length: their ids, how many equal ones each stands for, and what quantise() gave."""

    ids: np.ndarray
    weights: np.ndarray
    meta: np.ndarray
    q: np.ndarray
    more: np.ndarray

    def decoded(self, rows: np.ndarray) -> np.ndarray:
        return self.q[rows] * self.meta[0, rows, None] + self.more[rows] * self.meta[3, rows, None]


def _load(table: pa.Table, g: int, d: int) -> Block | None:
    parts: list[tuple] = []
    for grp, dim, n, blob in zip(*(table.column(c) for c in ("grp", "dim", "n", "blob"))):
        if grp.as_py() == g and dim.as_py() == d:
            raw, n = blob.as_buffer(), n.as_py()
            at = 64 * n
            parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.float64, 6 * n, 16 * n).reshape(6, n), np.frombuffer(raw, np.int8, n * d, at).reshape(n, d), np.frombuffer(raw, np.int8, n * d, at + n * d).reshape(n, d)))
    if not parts:
        return None
    ids, weights, meta, q, more = zip(*parts)
    return Block(np.concatenate(ids), np.concatenate(weights), np.concatenate(meta, 1), np.concatenate(q), np.concatenate(more))


def _bound(size_x, miss_x, size_y, miss_y):
    """How far the product of decoded vectors may be from that of the vectors: |e_x||y'| + |x'||e_y| + |e_x||e_y|."""
    return miss_x * size_y + size_x * miss_y + miss_x * miss_y + SLACK


def judged(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, sure) of the pairs of two blocks whose cosine may reach the threshold; `sure` where it does for certain.

    Int8 products come first; only pairs that these leave open are computed again, from both codes.
    """
    d = a.q.shape[1]
    kind = np.float32 if d * 127 * 127 < 1 << 24 else np.float64  # in which sums of products of codes are exact
    right = b.q.astype(kind).T
    for lo in range(0, len(a.ids), STRIP):
        s, size, miss = a.meta[:3, lo : lo + STRIP, None]
        near = (a.q[lo : lo + STRIP].astype(kind) @ right).astype(np.float64) * (s * b.meta[0])
        bound = _bound(size, miss, b.meta[1], b.meta[2])
        x, y = np.nonzero(near + bound >= threshold)
        sure = near[x, y] - bound[x, y] >= threshold
        keep = np.ones(len(x), bool)
        open_ = np.flatnonzero(~sure)
        for at in range(0, len(open_), step := max(1, (1 << 22) // d)):
            k = open_[at : at + step]
            p, q = x[k] + lo, y[k]
            near2 = np.einsum("ij,ij->i", a.decoded(p), b.decoded(q))
            bound2 = _bound(a.meta[4, p], a.meta[5, p], b.meta[4, q], b.meta[5, q])
            sure[k] = near2 - bound2 >= threshold
            keep[k] = near2 + bound2 >= threshold
        yield x[keep] + lo, y[keep], sure[keep]


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`root`, the smallest position of each one's component, once x and y are linked."""
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            return root
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]


LINKS, EDGE, OPEN = 0, 1, 2


def _tile(threshold: float, groups: int):
    """(kind, a, b) of two blocks: LINKS, `a` has `b` links here; EDGE, `a` and `b` are in one component; OPEN, the cosine of `a` and `b` is to be computed.

    Links are counted and components joined here, so that what leaves grows with the vectors of the blocks and not with their pairs.
    """

    def run(key, table):
        i, j = divmod(key[0].as_py(), groups)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for d in np.unique(table.column("dim").to_numpy()):
            a = _load(table, i, d)
            b = a if i == j else _load(table, j, d)
            if a is None or b is None:
                continue
            links_a = np.zeros(len(a.ids), np.int64)
            links_b = links_a if i == j else np.zeros(len(b.ids), np.int64)
            shift = 0 if i == j else len(a.ids)
            root = np.arange(len(b.ids) + shift)
            for x, y, sure in judged(a, b, threshold):
                if i == j:
                    once = x < y
                    x, y, sure = x[once], y[once], sure[once]
                out.append((OPEN, a.ids[x[~sure]], b.ids[y[~sure]]))
                x, y = x[sure], y[sure]
                np.add.at(links_a, x, b.weights[y])
                np.add.at(links_b, y, a.weights[x])
                root = joined(root, x, y + shift)
            ids = a.ids if i == j else np.concatenate((a.ids, b.ids))
            links = links_a if i == j else np.concatenate((links_a, links_b))
            some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
            out += [(LINKS, ids[some], links[some]), (EDGE, ids[moved], ids[root[moved]])]
        kinds = np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in out]) if out else np.zeros(0, np.int32)
        both = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*((x, y) for _, x, y in out)) if out else ((), ()))]
        return pa.table({"kind": pa.array(kinds), "a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return run


def _exact(threshold: float):
    """The pairs (a, b, weight of a, weight of b, vector, vector) whose cosine in float64 is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.full(batch.num_rows, -2.0)
            x = {d.shape[1]: (r, d) for r, d in valid(batch, 4)}
            y = {d.shape[1]: (r, d) for r, d in valid(batch, 5)}
            for d in x.keys() & y.keys():
                (r, u), (s, v) = x[d], y[d]
                both, at, to = np.intersect1d(r, s, assume_unique=True, return_indices=True)
                sim[both] = (u[at] * v[to]).sum(1)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "n_a", "n_b"]).filter(pa.array(sim >= threshold))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the distinct rows that have an id and a vector of finite numbers that is not all zero."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: how many others have a cosine of at least `threshold` with it, and the smallest vec_id that a chain of such links leads to.

    Equal vectors are compared once. The others are made unit, coded in int8 with a scale each, what that misses in int8 again, and fall by hash into blocks
    of about `block`. For every pair of blocks one task multiplies the codes; the lengths of what the codes miss bound the error. Pairs that are certain
    either way are decided there, the rest from both codes, and what is open even then (some 1e-4 around the threshold) in float64 from the
    embeddings. Every pair of vectors is covered; links are counted and components joined in the tasks, so that no group of copies is spelled out as pairs.

    Rows without vec_id or embedding have no row in the result, nor have empty or zero vectors, or such with nulls, NaN or infinities; vectors of different
    length are not linked. Rows that repeat a vec_id with the same vector are one; with another vector they are vectors, and rows of the result, of
    their own, and may link to each other. No vectors, no rows. Other columns are not looked at.
    """
    stash = Stash(vectors.sparkSession)
    own = stash.put(usable(vectors))
    reps = stash.put(own.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    groups = max(1, -(-reps.count() // block))
    blocks = stash.put(reps.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("grp"), "n").mapInArrow(_blocks(groups), "grp int, dim int, n int, blob binary"))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.least("grp", k).cast("long") * groups + F.greatest("grp", k))
    found = stash.put(blocks.select(F.explode(tiles).alias("tile"), "grp", "dim", "n", "blob").groupBy("tile").applyInArrow(_tile(threshold, groups), "kind int, a long, b long"))
    side = lambda c, v: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("v").alias(v))
    open_ = found.filter(F.col("kind") == OPEN).select("a", "b").join(side("a", "u"), "a").join(side("b", "v"), "b").select("a", "b", "n_a", "n_b", "u", "v")
    sure = stash.put(open_.mapInArrow(_exact(threshold), "a long, b long, n_a long, n_b long"))
    counts = found.filter(F.col("kind") == LINKS).select(F.col("a").alias("rep"), F.col("b").alias("more"))
    counts = counts.unionByName(sure.select(F.col("a").alias("rep"), F.col("n_b").alias("more"))).unionByName(sure.select(F.col("b").alias("rep"), F.col("n_a").alias("more")))
    counts = counts.groupBy("rep").agg(F.sum("more").alias("more"))
    root = components(found.filter(F.col("kind") == EDGE).select("a", "b").unionByName(sure.select("a", "b")), stash).withColumnRenamed("id", "rep")
    told = stash.put(reps.select("rep", "low", "n").join(counts, "rep", "left").join(root, "rep", "left").select("rep", "low", F.coalesce("root", "rep").alias("root"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = stash.put(told.groupBy("root").agg(F.min("low").alias("class_id")))
    made = stash.put(told.join(least, "root").select("rep", "class_id", "n_links").join(reps.select("rep", "v"), "rep").select("v", "class_id", "n_links"))
    return stash.finish(own.join(made, "v").select("vec_id", "class_id", "n_links"))
