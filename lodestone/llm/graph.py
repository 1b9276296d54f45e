"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.stash import Stash, collect_garbage
from lodestone.llm.textkit import binary_rows, buffers
from lodestone.llm.vectors import usable, valid

#: Neighbours of a vector in the graph; vectors it is a neighbour of that take part in a round; vectors of a stretch that the first lists are made of; rounds at most.
NEIGHBOURS, REVERSE, CELL, SEEDS, ROUNDS = 32, 16, 256, 3, 8
#: Entries of a beam for each doubling of the vectors beyond CELL, the part of a beam that a hop expands, and the links back from each vector's nearest ones.
BEAM_STEP, PART, BACK, LINKS_BACK = 32, 5, 8, 16
_ROW = np.dtype([("id", "<i8"), ("sim", "<f4"), ("new", "<i4")])


def beam_size(rows: int) -> int:
    """How many entries a beam holds: it grows with the logarithm of the vectors, as the share that a fixed beam finds would fall."""
    return BEAM_STEP * max(3, int(np.ceil(np.log2(max(1, rows) / CELL))))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, code): a scale and the unit vector in int8."""
    for batch in batches:
        for rows, x in valid(batch):
            scale = (np.abs(x).max(1, keepdims=True) / 127).astype(np.float32)
            code = np.concatenate((scale.view(np.uint8), np.rint(x / scale).clip(-127, 127).astype(np.int8).view(np.uint8)), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), binary_rows(code)], ["id", "dim", "code"])


class Codes:
    """Decoded rows of a column of codes; those asked for together have one length."""

    def __init__(self, column: pa.Array):
        self.data, self.off = buffers(column)

    def __call__(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros((0, 1), np.float32)
        raw = self.data[self.off[lo] : self.off[hi]].reshape(hi - lo, -1)
        return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def read(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, _ROW)


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def tops(at: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, rows, where each list begins and the last ends): for each `at` the k most similar of its rows by distinct ids; of an id that repeats the entry that isn't new counts."""
    order = np.lexsort((rows["new"], rows["id"], at))
    at, rows = at[order], rows[order]
    one = _starts(at, rows["id"])
    at, rows = at[one], rows[one]
    order = np.lexsort((rows["id"], -rows["sim"], at))
    at, rows = at[order], rows[order]
    begin = np.flatnonzero(_starts(at)) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(begin, np.diff([*begin, len(at)]))
    at, rows = at[rank < k], rows[rank < k]
    begin = np.flatnonzero(_starts(at)) if len(at) else np.zeros(0, np.int64)
    return at[begin], rows, np.append(begin, len(at))


def blobs(rows: np.ndarray, first: np.ndarray) -> pa.Array:
    raw = rows.tobytes()
    return pa.array([raw[a * _ROW.itemsize : b * _ROW.itemsize] for a, b in zip(first[:-1], first[1:])], pa.binary())


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, how many of each list) of a column of lists as bytes; null is an empty list."""
    raw = [x or b"" for x in column.to_pylist()]
    return read(b"".join(raw)), np.array([len(x) // _ROW.itemsize for x in raw], np.int64)


# -- graph ----------------------------------------------------------------------------------------


def _placed(bits: int, salt: int):
    """The cell of each vector, by the signs of `bits` random projections, and its place along another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = batch.column(1).to_numpy(), Codes(batch.column(2))
            cell, along = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi in zip(begin := np.flatnonzero(_starts(dims)) if len(dims) else [], [*begin[1:], len(dims)]):
                plane = np.random.Generator(np.random.PCG64(salt)).standard_normal((dims[lo], bits + 1)).astype(np.float32)
                y = codes(lo, hi) @ plane
                cell[lo:hi], along[lo:hi] = ((y[:, :bits] > 0) << np.arange(bits)).sum(1), y[:, bits]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cell), pa.array(along), batch.column(0), batch.column(2)], ["dim", "cell", "along", "id", "code"])

    return run


def _stretches(k: int):
    """(id, list): of vectors in order the k nearest within stretches of CELL vectors of one length; the last stretch reaches back."""

    def lists(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_numpy()
        x = Codes(t.column("code").combine_chunks())(0, len(ids))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        n = min(k, len(ids) - 1)
        top = np.argpartition(-s, n - 1, 1)[:, :n] if n > 0 else np.zeros((len(ids), 0), int)
        rows = np.zeros(top.shape, _ROW)
        rows["id"], rows["sim"], rows["new"] = ids[top], np.take_along_axis(s, top, 1), 1
        return pa.RecordBatch.from_arrays([pa.array(ids), blobs(rows.ravel(), np.arange(len(ids) + 1) * n)], ["id", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, dim = None, None, None
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for lo, hi in zip(begin := np.flatnonzero(_starts(dims)) if len(dims) else [], [*begin[1:], len(dims)]):
                if dims[lo] != dim and held is not None:
                    yield lists(held if last is None else pa.concat_tables([last, held]).slice(held.num_rows))
                    held = last = None
                dim = dims[lo]
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows > CELL:
                    last, held = held.slice(0, CELL), held.slice(CELL)
                    yield lists(last)
        if held is not None:
            yield lists(held if last is None else pa.concat_tables([last, held]).slice(held.num_rows))

    return run


def _merged(k: int, age: bool):
    """(id, code, list, bar, grown): a vector's list and those it was sent as one; with `age`, entries of its own list are old from now on. `bar` is what an entry must exceed to enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            own, n = flattened(batch.column(2))
            own = own.copy()
            if age:
                own["new"] = 0
            more, m = flattened(batch.column(3).flatten())
            sent = np.add.reduceat(np.append(m, 0), np.minimum(off := np.concatenate(([0], np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy())))[:-1], len(m))) if len(m) else np.zeros(len(at), np.int64)
            sent[np.diff(np.append(off, len(m))) == 0] = 0
            who, rows, first = tops(np.concatenate((np.repeat(at, n), np.repeat(at, sent))), np.concatenate((own, more)), k)
            size = np.zeros(len(at), np.int64)
            size[who] = np.diff(first)
            edge = np.concatenate(([0], np.cumsum(size)))
            bar = np.full(len(at), -2, np.float32)
            full = np.flatnonzero(size == k)
            bar[full] = rows["sim"][edge[full + 1] - 1]
            grown = np.concatenate(([0], np.cumsum(rows["new"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs(rows, edge), pa.array(bar), pa.array((grown[edge[1:]] - grown[edge[:-1]]).astype(np.int64))], ["id", "code", "list", "bar", "grown"])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, member, new, sim) of every entry of the lists."""
    for batch in batches:
        rows, n = flattened(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("id", "new", "sim"))], ["at", "member", "new", "sim"])


def _local(take: int, k: int):
    """Members of one neighbourhood are compared with each other; each is sent the most similar ones that it hasn't been compared with, if they can enter its list.

    What a batch has for one vector leaves it as one list, so that a vector which is in many neighbourhoods gets a list a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 4096):
                batch = big.slice(start, 4096)
                flat = batch.column(1).flatten()
                member, new, bar = (flat.field(i).to_numpy() for i in range(3))
                codes = Codes(flat.field(3))
                off = np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy())))
                to, out = [], []
                for lo, hi in zip(off[:-1], off[1:]):
                    ids, fresh = member[lo:hi], new[lo:hi] > 0
                    if len(ids) < 2 or not fresh.any():
                        continue
                    y = codes(lo, hi)
                    s = y @ y.T
                    s[~(fresh[:, None] | fresh[None, :])] = -2
                    s[ids[:, None] == ids[None, :]] = -2
                    n = min(take, len(ids) - 1)
                    top = np.argpartition(-s, n - 1, 1)[:, :n]
                    near = np.take_along_axis(s, top, 1)
                    i, j = np.nonzero(near > bar[lo:hi, None])
                    rows = np.zeros(len(i), _ROW)
                    rows["id"], rows["sim"], rows["new"] = ids[top[i, j]], near[i, j], 1
                    to.append(ids[i])
                    out.append(rows)
                if to:
                    at, rows, first = tops(np.concatenate(to), np.concatenate(out), k)
                    yield pa.RecordBatch.from_arrays([pa.array(at), blobs(rows, first)], ["id", "list"])

    return run


_GRAPH = "id long, code binary, list binary, bar float, grown long"


def neighbour_graph(codes: DataFrame, rows: int, stash: Stash, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, tolerance: float = 0.01) -> DataFrame:
    """(id, code, list, bar, grown): the k nearest neighbours that NN-descent finds for each vector of `codes` (id, dim, code).

    Lists begin with the nearest in stretches of vectors that random projections put in order. In each round the neighbours of a vector, and `reverse` of the
    vectors it is a neighbour of, drawn anew each round, are joined with each other (pairs of which one at least is new), and every list keeps its
    k best, until fewer than `tolerance` of the entries change.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, rows) / CELL))))
    order = ["dim", "cell", "along", "id"]
    seeds = None
    for salt in range(SEEDS):
        placed = codes.mapInArrow(_placed(bits, salt), "dim int, cell long, along double, id long, code binary").repartitionByRange(*order).sortWithinPartitions(*order)
        one = placed.mapInArrow(_stretches(k), "id long, list binary")
        seeds = one if seeds is None else seeds.unionByName(one)
    seeds = seeds.groupBy("id").agg(F.collect_list("list").alias("more"))  # two a salt
    graph = stash.put(codes.join(seeds, "id", "left").select("id", "code", F.lit(None).cast("binary").alias("list"), "more").mapInArrow(_merged(k, False), _GRAPH))
    for r in range(rounds):
        edges = graph.select("id", "list").mapInArrow(_edges, "at long, member long, new int, sim float")
        # of a vector that is a neighbour of many only `reverse` leave each task
        draw = F.row_number().over(W.partitionBy("member").orderBy(F.desc("new"), F.xxhash64("at", "member", F.lit(r)), "at"))
        back = edges.withColumn("n", draw).filter(F.col("n") <= reverse).select(F.col("member").alias("at"), F.col("at").alias("member"), "new")
        both = edges.select("at", "member", "new").unionByName(back)
        told = graph.select(F.col("id").alias("member"), "bar", "code")
        around = both.join(told, "member").groupBy("at").agg(F.collect_list(F.struct("member", "new", "bar", "code")).alias("members"))  # k + reverse at most
        sent = around.mapInArrow(_local(max(4, k // 3), k), "id long, list binary").groupBy("id").agg(F.collect_list("list").alias("more"))
        graph = stash.put(graph.select("id", "code", "list").join(sent, "id", "left").mapInArrow(_merged(k, True), _GRAPH))
        collect_garbage(codes.sparkSession)
        if (graph.agg(F.sum("grown")).first()[0] or 0) < tolerance * rows * k:
            break
    return graph


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, n = flattened(batch.column(1))
        edge = np.concatenate(([0], np.cumsum(n)))
        out = [np.union1d(rows["id"][a:b], np.array(back or [], np.int64)).tobytes() for a, b, back in zip(edge[:-1], edge[1:], batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "links"])


def linked(graph: DataFrame, stash: Stash) -> DataFrame:
    """(node, links): the neighbours of each vector, and those nearest of the vectors that have it among their BACK nearest, so that each can be reached from those near it."""
    edges = graph.select("id", "list").mapInArrow(_edges, "at long, member long, new int, sim float")
    near = edges.withColumn("n", F.row_number().over(W.partitionBy("at").orderBy(F.desc("sim"), "member"))).filter(F.col("n") <= BACK)
    back = near.withColumn("n", F.row_number().over(W.partitionBy("member").orderBy(F.desc("sim"), "at"))).filter(F.col("n") <= LINKS_BACK)
    back = back.groupBy(F.col("member").alias("id")).agg(F.collect_list("at").alias("back"))  # LINKS_BACK at most
    return stash.put(graph.select("id", "list").join(back, "id", "left").mapInArrow(_linked, "node long, links binary"))


# -- search ---------------------------------------------------------------------------------------


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, n = flattened(batch.column(2))
        rows = rows.copy()
        rows["new"] = 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], blobs(rows, np.concatenate(([0], np.cumsum(n))))], ["id", "code", "list"])


def _asked(expanded: int):
    """(node, id): the most similar entries of each beam that haven't been expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r["id"][r["new"] > 0][:expanded] for r in map(read, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(r) for r in found]))], ["node", "id"])

    return run


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, member): the links of the expanded entries that are not in the beam."""
    for batch in batches:
        ids, out = [], []
        for q, beam, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            got = np.setdiff1d(np.frombuffer(b"".join(lists), np.int64), np.append(read(beam)["id"], q))
            ids.append(np.full(len(got), q))
            out.append(got)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (ids, out)], ["id", "member"])


def _stepped(beam: int, expanded: int):
    """The beams with those entries that were expanded marked so, and the new ones that are good enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, flat = Codes(batch.column(1)), batch.column(3).flatten()
            member, codes = flat.field(0).to_numpy(), Codes(flat.field(1))
            off = np.concatenate(([0], np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy())))
            at, parts = [], []
            for i, blob in enumerate(batch.column(2).to_pylist()):
                b = read(blob).copy()
                b["new"][np.flatnonzero(b["new"] > 0)[:expanded]] = 0
                lo, hi = off[i], off[i + 1]
                got = np.zeros(hi - lo, _ROW)
                if hi > lo:
                    got["id"], got["sim"], got["new"] = member[lo:hi], codes(lo, hi) @ own(i, i + 1)[0], 1
                parts += [b, got]
                at.append(np.full(len(b) + hi - lo, i))
            who, rows, first = tops(np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(parts) if parts else np.zeros(0, _ROW), beam)
            size = np.zeros(batch.num_rows, np.int64)
            size[who] = np.diff(first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], blobs(rows, np.concatenate(([0], np.cumsum(size))))], ["id", "code", "list"])

    return run


def greedy_search(queries: DataFrame, graph: DataFrame, links: DataFrame, codes: DataFrame, stash: Stash, beam: int) -> DataFrame:
    """(id, code, list): for each of `queries` (id) the best vectors that a walk on the graph finds from its own list.

    In each hop the best entries of a beam that haven't been looked at are joined with the graph, and their neighbours enter the beam if they are
    similar enough; it ends when all entries of all beams have been looked at.
    """
    expanded = max(8, beam // PART)
    beams = stash.put(graph.join(queries, "id", "left_semi").select("id", "code", "list").mapInArrow(_begun, "id long, code binary, list binary"))
    while True:
        asked = stash.put(beams.select("id", "list").mapInArrow(_asked(expanded), "node long, id long"))
        if asked.isEmpty():
            return beams
        met = asked.join(links, "node").groupBy("id").agg(F.collect_list("links").alias("links"))  # `expanded` at most
        unseen = beams.select("id", F.col("list").alias("beam")).join(met, "id").select("id", "beam", "links").mapInArrow(_unseen, "id long, member long")
        news = unseen.join(codes.select(F.col("id").alias("member"), "code"), "member").groupBy("id").agg(F.collect_list(F.struct("member", "code")).alias("members"))
        beams = stash.put(beams.join(news, "id", "left").select("id", "code", "list", "members").mapInArrow(_stepped(beam, expanded), "id long, code binary, list binary"))
        collect_garbage(queries.sparkSession)


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(x)["id"][:k] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(r) for r in rows])), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], ["a", "b"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sim = np.full(batch.num_rows, -2.0)
        x, y = ({r.shape[1]: (i, r) for i, r in valid(batch, c)} for c in (2, 3))
        for d in x.keys() & y.keys():
            both, i, j = np.intersect1d(x[d][0], y[d][0], assume_unique=True, return_indices=True)
            sim[both] = (x[d][1][i] * y[d][1][j]).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "similarity"])


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 1, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, beam: int | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): about the k nearest other vectors, by cosine, of each vector whose vec_id is divisible by `every`; all vectors are searched.

    The graph comes from NN-descent over all vectors, equal ones taken once; each query then searches it greedily from its own list, with a beam of
    beam_size() entries unless `beam` is given. Walks go by int8 codes; the 2k best entries are ranked by their exact cosines, rounded to six digits.
    Ties have the smaller neighbour_id first. All of it is joins of tables, whatever their size; nothing is broadcast.

    Rows without vec_id or embedding have no neighbours and are none, nor are empty or zero vectors, or such with nulls, NaN or infinities. Vectors of
    different length aren't neighbours. Rows that repeat a vec_id with the same vector are one; with another vector they are searched for and
    found each, and the best of them counts. A vec_id is not its own neighbour. No vectors, no rows. Other columns are not looked at.
    """
    stash = Stash(vectors.sparkSession)
    own = stash.put(usable(vectors))
    nodes = stash.put(own.groupBy("v").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    rows = nodes.count()
    codes = stash.put(nodes.select("id", "v").mapInArrow(_coded, "id long, dim int, code binary"))
    at = stash.put(own.join(nodes.select("v", "id"), "v").select("vec_id", "id"))
    asked = stash.put(at.filter(F.pmod("vec_id", F.lit(every)) == 0))
    graph = neighbour_graph(codes, rows, stash, neighbours, reverse, rounds)
    beams = greedy_search(asked.select("id").distinct(), graph, linked(graph, stash), codes, stash, beam or beam_size(rows))
    pairs = stash.put(beams.select("id", "list").mapInArrow(_pairs(2 * k), "a long, b long"))
    exact = pairs.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("u")), "a").join(nodes.select(F.col("id").alias("b"), "v"), "b").select("a", "b", "u", "v").mapInArrow(_cosines, "a long, b long, similarity double")
    same = nodes.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    # of equal vectors no more than the k smallest other ids can be among the nearest
    few = at.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    found = asked.withColumnRenamed("id", "a").join(exact.unionByName(same), "a").join(few.select(F.col("id").alias("b"), F.col("vec_id").alias("neighbour_id")), "b").filter("vec_id <> neighbour_id")
    best = found.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))).filter(F.col("rank") <= k)
    return stash.finish(ranked.select("vec_id", "neighbour_id", "rank", F.round("similarity", 6).alias("similarity")))
