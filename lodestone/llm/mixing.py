"""Rates at which documents are drawn so that the expected tokens of each domain meet target weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.stash import Stash
from lodestone.llm.textkit import U, WORD, Words, binary_rows, chunks, plus
from lodestone.llm.tokens import TOKENIZER, encode, ranks, texts_of

#: Domains by the language and the quality label of a document, and the share of the tokens that each is to have.
DOMAINS: tuple[tuple[str, int], ...] = tuple((lang, quality) for lang in ("en", "fr", "de", "es") for quality in (1, 0))
TARGETS: tuple[float, ...] = (0.54, 0.05, 0.13, 0.01, 0.13, 0.01, 0.12, 0.01)
#: Tokens of the mixture, as a multiple of those there are; above 1, so that few documents are drawn less than once.
BUDGET = 1.25
#: Bytes told apart by the classifier: each letter in either case, each byte beyond ASCII, and groups of others.
_KIND = np.zeros(256, np.int64)
_KIND[48:58], _KIND[[9, 10, 13, 32]], _KIND[[33, 46, 63]], _KIND[[44, 58, 59]], _KIND[[35, 36, 37, 38, 42, 61, 64, 124]] = 1, 2, 3, 4, 5
_KIND[65:91] = _KIND[97:123] = np.arange(6, 32)
_KIND[128:192] = np.arange(32, 96)
_KIND[192:] = 96
KINDS = 97
COUNTS = KINDS + 4


def describe(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each text: shares of the kinds of byte, of capitals, mean word length, distinct words among its words, log of the words."""
    w = Words(data, off, WORD)
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    size = np.maximum(np.diff(off), 1)[:, None]
    kinds = np.sqrt(np.bincount(text * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, -1) / size)
    capitals = np.bincount(text, (data >= 65) & (data < 91), n) / size[:, 0]
    words = w.count
    h = np.unique((w.text.astype(np.uint64) << U(40)) | (w.hash() >> U(24))) if len(w.start) else np.zeros(0, np.uint64)
    distinct = np.bincount((h >> U(40)).astype(np.int64), minlength=n)
    letters = np.bincount(w.text, w.end - w.start, n)
    more = np.stack((capitals, letters / np.maximum(words, 1) / 10, distinct / np.maximum(words, 1), np.log1p(words) / 10), 1)
    return np.concatenate((kinds, more), 1).astype(np.float32)


@dataclass(frozen=True)
class Posterior:
    """A softmax over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate((z, np.ones((len(z), 1))), 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = self.expand(x) @ self.weights
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)


def fit(x: np.ndarray, domain: np.ndarray, k: int, ridge: float = 3e-3, rounds: int = 300) -> Posterior:
    """Softmax regression by accelerated gradient steps; without rows every domain is equally probable."""
    if not len(x):
        return Posterior(np.zeros(COUNTS), np.ones(COUNTS), np.zeros((COUNTS + 1, k)))
    model = Posterior(x.mean(0), x.std(0) + 1e-3, np.zeros((x.shape[1] + 1, k)))
    z = model.expand(x)
    y = np.eye(k)[domain]
    limit = 0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + ridge
    w = last = np.zeros((z.shape[1], k))
    for r in range(rounds):
        at = w + (r / (r + 3)) * (w - last)
        s = z @ at
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        last, w = w, at - (z.T @ (p - y) / len(z) + ridge * at) / limit
    return Posterior(model.mean, model.scale, w)


def rate_of(rate: np.ndarray, p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The rates after some steps, of rows with posteriors `p`."""
    for m in moves:
        rate = np.maximum(0.0, rate - p @ m)
    return rate


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(1)):
            x = describe(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), binary_rows(x)], ["doc_id", "quality", "lang", "x"])


def train(docs: DataFrame, labels: DataFrame, domains: Sequence[tuple[str, int]] = DOMAINS, sample: int = 8000) -> Posterior:
    """Fits on at most `sample` labelled documents, those whose doc_id has the smallest hashes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null")
    # at most `sample` rows of 12 bytes
    made = text.join(F.broadcast(own), "doc_id").select("doc_id", "text", "quality", "lang").mapInArrow(_described, "doc_id long, quality int, lang string, x binary").toPandas()
    of = {d: i for i, d in enumerate(domains)}
    made = made.assign(d=[of.get(d, -1) for d in zip(made["lang"], made["quality"])]).query("d >= 0").sort_values(["doc_id", "d", "x"])
    return fit(np.frombuffer(b"".join(made["x"]), np.float32).reshape(len(made), COUNTS).astype(float), made["d"].to_numpy(int), len(domains))


def _memberships(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = told.value
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                tokens = np.fromiter((len(encode(vocabulary, t)) for t in texts_of(batch.column(1).slice(lo, hi - lo))), np.int64, hi - lo)
                p = model(describe(data, off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(tokens), *(pa.array(c) for c in p.T)], ["doc_id", "n_tokens", *(f"p{i}" for i in range(p.shape[1]))])

    return run


def memberships(docs: DataFrame, model: Posterior, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...): tokens and domain posteriors of each row; a null text has no token and the posteriors of an empty one."""
    told = docs.sparkSession.sparkContext.broadcast((model, ranks(tokenizer)))
    k = model.weights.shape[1]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(_memberships(told), "doc_id long, n_tokens long, " + ", ".join(f"p{i} double" for i in range(k)))


def fit_moves(made: DataFrame, k: int, targets: Sequence[float], budget: float, stash: Stash, rounds: int = 60, tolerance: float = 1e-5) -> np.ndarray:
    """The steps of projected gradient descent on the rates, one row each.

    The rates are nonnegative, begin at 1, and are to bring the expected tokens by domain, sum(rate * n_tokens * p), closest to budget * tokens * targets
    (least squares of the whitened residuals). A step needs the domain totals of the last one, the only thing that comes to the driver. A
    rate is a function of its row's posteriors and of the steps so far; the rows carry it, written anew every eighth step.
    """
    goal = np.asarray(targets, float) / sum(targets) * budget
    ps = [f"p{i}" for i in range(k)]
    row = made.agg(F.sum("n_tokens").alias("t"), *(F.sum(F.col("n_tokens") * F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for i, a in enumerate(ps) for b in ps[i:])).first()
    total = float(row["t"] or 0)
    if total == 0:
        return np.zeros((0, k))
    gram = np.array([[row[f"g_{min(a, b)}_{max(a, b)}"] for b in ps] for a in ps]) / total
    white = np.linalg.inv(gram + (1e-3 * np.trace(gram) / k + 1e-12) * np.eye(k))
    now = made.select(*ps, F.col("n_tokens").cast("double").alias("n_tokens"), F.lit(1.0).alias("rate"))
    moves: list[np.ndarray] = []
    held = 0

    def parts(b, past):
        p = np.stack([b.column(i).to_numpy() for i in range(k)], 1)
        return p, rate_of(b.column(k + 1).to_numpy(), p, past)

    def sums(past):
        def run(batches):
            out = np.zeros(k)
            for b in batches:
                p, rate = parts(b, past)
                out += p.T @ (rate * b.column(k).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ps)  # a row of k numbers for each partition, added up before the driver

        return run

    def applied(past):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(parts(b, past)[1])], b.schema.names)

        return run

    best = np.inf
    for _ in range(rounds):
        past = np.array(moves[held:]).reshape(-1, k)
        moved = now.mapInArrow(sums(past), ", ".join(f"{p} double" for p in ps)).agg(*(F.sum(p).alias(p) for p in ps)).first()
        gap = np.array(moved, float) / total - goal
        size = float(gap @ white @ gap)
        if np.abs(gap).max() < tolerance or size > best * (1 - 1e-6):
            break
        best = size
        moves.append(white @ gap)
        if len(moves) - held == 8:
            now = stash.put(now.mapInArrow(applied(np.array(moves[held:])), now.schema))
            held = len(moves)
    return np.array(moves).reshape(-1, k)


def _solve(docs: DataFrame, labels: DataFrame, targets, budget, domains, sample, tokenizer):
    stash = Stash(docs.sparkSession)
    model = train(docs, labels, domains, sample)
    made = stash.put(memberships(docs, model, tokenizer))
    return stash, model, made, fit_moves(made, len(domains), targets, budget, stash)


def rates(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, budget: float = BUDGET, domains: Sequence[tuple[str, int]] = DOMAINS, sample: int = 8000, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, p0 ..., rate) of every row: its tokens (those that packing counts, without end marks), its domain posteriors by a classifier fitted to `labels`, and the rate to draw it at.

    A null text counts as empty; it has no token, and the rate that its posteriors give. Rows that repeat have a rate each; a null doc_id stays
    null. Without labels the posteriors are all equal. Without a token in all documents every rate is 1. Other columns are not looked at.
    """
    stash, _, made, moves = _solve(docs, labels, targets, budget, domains, sample, tokenizer)
    k = len(domains)

    def run(batches):
        for b in batches:
            p = np.stack([b.column(2 + i).to_numpy() for i in range(k)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate_of(np.ones(b.num_rows), p, moves))], [*b.schema.names, "rate"])

    return stash.finish(made.mapInArrow(run, plus(made.schema, "rate", T.DoubleType())))


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, budget: float = BUDGET, domains: Sequence[tuple[str, int]] = DOMAINS, sample: int = 8000, salt: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """`docs` with each row as often as its rate in rates() says: the whole part of the rate, and once more with the chance of the rest.

    Every row is drawn by itself, also those that repeat: the draws are a seeded sequence for each partition of `docs`, which is to be a table of files, so that
    a task that runs again draws the same. A null or empty text has the rate of a text without words; a null doc_id stays null. Without
    a token in all documents every row stays once. Other columns, whatever they are called, are copied.
    """
    stash, model, _, moves = _solve(docs, labels, targets, budget, domains, sample, tokenizer)
    stash.close()
    told = docs.sparkSession.sparkContext.broadcast((model, moves))
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text = names[docs.columns.index("text")]

    def run(batches):
        for b in batches:
            rate = np.ones(b.num_rows)
            for lo, hi, data, off in chunks(b.column(b.num_columns - 1)):
                rate[lo:hi] = rate_of(np.ones(hi - lo), told.value[0](describe(data, off)), told.value[1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rate)], [*b.schema.names[:-1], "__rate"])

    made = flat.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).mapInArrow(run, plus(flat.schema, "__rate", T.DoubleType()))
    copies = (F.floor("__rate") + (F.rand(salt) < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return made.withColumn("__n", copies).filter("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), "__n"))).select(*names).toDF(*docs.columns)
