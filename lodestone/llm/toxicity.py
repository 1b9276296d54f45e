"""Toxic documents by a linear classifier whose score must not depend on which group a sentence names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.stash import Stash
from lodestone.llm.textkit import LOWER, U, WORD, Words, binary_rows, chunks, plus, mix, windows

#: Terms that name groups; within a set each may stand for any other.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"), ("immigrant", "native"), ("immigrants", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"),
)
#: Eight orders in which the smallest hash of five words is taken; two in a row that are equal make two labelled texts near copies.
SALTS = mix(np.arange(1, 9, dtype=np.uint64))
#: Bytes of the beginnings of words that are features beside the words, so that the rare forms of one stem count together.
PREFIXES = range(3, 9)
#: A feature that a text has once, twice, three times or more is one of as many features, told apart by the low bits of the hash.
LEVELS = 3
_BASE = ~U(3)
_SENTENCE = regex.compile(r"[^.!?\n]+")
_TOKEN = regex.compile(rb"[0-9A-Za-z_\x80-\xff]+")


def features(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with the low bits clear, text of each) of all words of a run of texts and of their beginnings that end with a character.

    `terms`, which name groups, count once a text and as whole words alone, so that a swap of two changes nothing that the counterfactual penalty doesn't see.
    """
    h = w.hash() & _BASE
    maybe = np.zeros(1 << 16, bool)
    maybe[(terms >> U(2) & U(0xFFFF)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(h >> U(2) & U(0xFFFF)).astype(np.int64)])
    hit = hit[np.isin(h[hit], terms)]
    other = np.ones(len(h), bool)
    other[hit] = False
    use = other.copy()
    use[hit[np.unique(mix(h[hit] + w.text[hit].astype(np.uint64)), return_index=True)[1]]] = True
    hashes, text = [h[use]], [w.text[use]]
    length = (w.end - w.start) * other
    after = np.append(w.data, np.uint8(0))
    for n in PREFIXES:
        own = np.flatnonzero(length >= n)
        own = own[(length[own] == n) | ((after[w.start[own] + n] & 0xC0) != 0x80)]
        hashes.append(mix(w.hash(w.start[own], w.start[own] + n) + U(n)))
        text.append(w.text[own])
    return np.concatenate(hashes) & _BASE, np.concatenate(text)


def levels(base: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, which of `base` it comes from) for hashes that a text has `count` times."""
    which = np.concatenate([np.flatnonzero(count > k) for k in range(LEVELS)])
    return base[which] | np.repeat(np.arange(LEVELS, dtype=np.uint64), [(count > k).sum() for k in range(LEVELS)]), which


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, the bias, and the terms that name groups; a text's score is the logistic of bias plus the weights of its distinct features."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        w = Words(LOWER[data], off, WORD)
        total = np.full(len(off) - 1, self.bias)
        if len(self.words) and len(w.start):
            h, text = features(w, self.terms)
            base = np.unique(self.words & _BASE)
            maybe = np.zeros(1 << 16, bool)
            maybe[(base >> U(2) & U(0xFFFF)).astype(np.int64)] = True
            hit = np.flatnonzero(maybe[(h >> U(2) & U(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(base, h[hit]), len(base) - 1)
            good = base[at] == h[hit]
            each, count = np.unique(text[hit[good]] * len(base) + at[good], return_counts=True)
            has, which = levels(base[each % len(base)], count)
            at = np.minimum(np.searchsorted(self.words, has), len(self.words) - 1)
            good = self.words[at] == has
            np.add.at(total, each[which[good]] // len(base), self.weights[at[good]])
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """The features of words that a text has."""
    raw = [w.encode() for w in words]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Words(data, off, np.ones(256, bool)).hash(off[:-1], off[1:]) & _BASE


def swaps(text: str, sets: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """(term, counterpart) of every sentence that names a group, for every counterpart of the term."""
    of = {t: [x for x in s if x != t] for s in sets for t in s}
    out = []
    for sentence in _SENTENCE.findall(text):
        for t in sorted({w.lower().decode("utf-8", "replace") for w in _TOKEN.findall(sentence.encode())} & of.keys()):
            out += [(t, other) for other in of[t]]
    return out


def _features(sets: Sequence[Sequence[str]]):
    terms = word_hashes([t for s in sets for t in s]) if sets else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                w = Words(LOWER[data], off, WORD)
                h = w.hash()
                all_, of = features(w, terms)
                order = np.argsort(of, kind="stable")
                all_, cut = all_[order], np.searchsorted(of[order], np.arange(hi - lo + 1))
                group, hashes, pairs = [], [], []
                for i in range(hi - lo):
                    own = h[w.first[i] : w.first[i + 1]]
                    five = windows(own, np.arange(len(own) - 4), 5) if len(own) >= 5 else np.array([np.bitwise_xor.reduce(own) if len(own) else 0], np.uint64)
                    group.append(mix(five[:, None] ^ SALTS).min(0))
                    has = np.sort(levels(*np.unique(all_[cut[i] : cut[i + 1]], return_counts=True))[0])
                    hashes.append(has.tobytes())
                    named = np.isin(terms, has).any()
                    p = swaps(bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"), sets) if named else []
                    pairs.append(np.stack((word_hashes([a for a, _ in p]), word_hashes([b for _, b in p])), 1).tobytes() if p else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), binary_rows(np.array(group, np.uint64)), pa.array(hashes, pa.binary()), pa.array(pairs, pa.binary())], ["doc_id", "toxic", "grp", "words", "pairs"])

    return run


def one_of_each(sketches: np.ndarray) -> np.ndarray:
    """The first row of each group of rows that share two neighbouring sketch values."""
    root = np.arange(len(sketches))
    keys = [np.unique(mix(sketches[:, i] * U(3) + sketches[:, i + 1]), return_inverse=True)[1] for i in range(0, sketches.shape[1] - 1, 2)]
    while True:
        before = root.copy()
        for k in keys:
            low = np.full(k.max() + 1 if len(k) else 0, len(root))
            np.minimum.at(low, k, root)
            root = low[k]
        if (root == before).all():
            return np.flatnonzero(root == np.arange(len(root)))


def pull_limit(df: np.ndarray, share: float) -> np.ndarray:
    """The gradient that a feature of `df` texts must exceed, where `share` of all texts are toxic."""
    return 4 * np.sqrt(df * share * (1 - share)) + 3


def fit(y: np.ndarray, rows: list[np.ndarray], pairs: np.ndarray, counterfactual: float) -> Model:
    """A sparse logistic model of labels `y` on the distinct features of each text.

    Features enter if the gradient of the loss exceeds four standard errors of chance; those kept are refitted with a small ridge and
    with the penalty counterfactual / 2 * mean over `pairs` (one for each swap in a labelled sentence) of the squared change of the score.
    """
    n = len(y)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    if not n or y.sum() == 0:
        return none
    if y.sum() == n:
        return Model(none.words, none.weights, np.inf)
    text = np.repeat(np.arange(n), [len(r) for r in rows])
    vocab, at = np.unique(np.concatenate(rows), return_inverse=True)
    df = np.bincount(at, minlength=len(vocab))
    limit = pull_limit(df, y.mean())
    weights, bias, active = np.zeros(len(vocab)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(vocab), bool)
    terms = np.isin(vocab, pairs)
    for _ in range(20):
        z = bias + np.bincount(text, weights[at], n)
        p = 1 / (1 + np.exp(-z))
        pull = np.bincount(at, (y - p)[text], len(vocab))
        new = (pull > limit) & ~active
        if not new.any() and active.any():
            break
        active |= new | (terms & (df > 0) & (np.abs(pull) > 0))
        own = np.flatnonzero(active)
        if not len(own):
            break
        slot = np.full(len(vocab), -1)
        slot[own] = np.arange(len(own))
        k = slot[at] >= 0
        x = np.zeros((n, len(own) + 1))
        x[text[k], slot[at[k]]] = 1
        x[:, -1] = 1
        w = np.append(weights[own], bias)
        where = np.searchsorted(vocab[own], pairs)
        where = np.minimum(where, len(own) - 1)
        d = np.zeros((len(pairs), len(own) + 1))
        for side, sign in ((0, -1.0), (1, 1.0)):
            ok = vocab[own][where[:, side]] == pairs[:, side] if len(pairs) else np.zeros(0, bool)
            d[np.flatnonzero(ok), where[ok, side]] += sign
        penalty = d.T @ d / max(1, len(d)) * counterfactual + np.diag(np.append(np.full(len(own), 5e-5), 1e-9))
        for _ in range(60):
            p = 1 / (1 + np.exp(-(x @ w)))
            g = x.T @ (p - y) / n + penalty @ w
            bend, curve = p * (1 - p) / n, penalty.copy()
            for lo in range(0, n, 1024):
                part = x[lo : lo + 1024]
                curve += (part * bend[lo : lo + 1024, None]).T @ part
            step = np.linalg.solve(curve, g)
            w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        weights[own], bias = w[:-1], float(w[-1])
    own = np.flatnonzero(weights)
    return Model(vocab[own], weights[own], bias)


def _within(rows: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in `vocab`, row of each) of the features of the rows that it has."""
    raw = rows.to_pylist()
    h = np.frombuffer(b"".join(raw), np.uint64)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    ok = np.flatnonzero(vocab[at] == h)
    return at[ok], np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])[ok]


def _counts(told):
    """(at, n): how many rows have the features of `told`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, vocab = told.value
        n = np.zeros(len(vocab), np.int64)
        for batch in batches:
            rows = batch.column(1).filter(pa.array(np.isin(batch.column(0).to_numpy(), kept)))
            if len(rows) and len(vocab):
                n += np.bincount(_within(rows, vocab)[0], minlength=len(vocab))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    return run


def _only(told):
    """Rows that are kept, with those features alone that `told` has, as positions in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, vocab = told.value
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), kept)))
            if batch.num_rows:
                at, row = _within(batch.column(1), vocab) if len(vocab) else (np.zeros(0, np.int64),) * 2
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                words = pa.array([at[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), words, batch.column(2)], ["row", "words", "pairs"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, counterfactual: float = 1.0, sets: Sequence[Sequence[str]] = IDENTITY_SETS) -> Model:
    """Fits on at most `sample` labelled documents, those whose doc_id has the smallest hashes; of near copies one counts.

    The driver gets only the words of `sets` and features that can exceed the limit of fit(): a gradient is at most the number of toxic documents
    that have the feature, since only they add to it, each at most 1.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")
    # at most `sample` ids of 12 bytes
    made = text.join(F.broadcast(own), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_features(sets), "doc_id long, toxic int, grp binary, words binary, pairs binary")
    made = stash.put(made.withColumns({"mark": F.xxhash64("words"), "row": F.monotonically_increasing_id()}))
    rows = made.select("row", "doc_id", "mark", "toxic", "grp").toPandas().sort_values(["doc_id", "mark"])
    rows = rows.iloc[one_of_each(np.frombuffer(b"".join(rows["grp"]), np.uint64).reshape(-1, len(SALTS)))]
    kept, y = np.sort(rows["row"].to_numpy(np.int64)), rows["toxic"].to_numpy(float)
    toxic = set(rows["row"][y > 0])
    seen = made.filter("toxic = 1").select("row", "words").toPandas()
    vocab, own = np.unique(np.frombuffer(b"".join(x for i, x in zip(seen["row"], seen["words"]) if i in toxic), np.uint64), return_counts=True)
    vocab, own = vocab[own > 3], own[own > 3]
    del seen
    # at most `sample` ids, and features of four of as many documents
    counted = made.select("row", "words").mapInArrow(_counts(spark.sparkContext.broadcast((kept, vocab))), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocab), np.int64)
    df[counted["at"].to_numpy(np.int64)] = counted["n"]
    share = y.mean() if len(y) else 0.0
    terms = word_hashes([t for s in sets for t in s]) if sets else np.zeros(0, np.uint64)
    vocab = np.union1d(vocab[own > pull_limit(df, share)], terms)
    told = spark.sparkContext.broadcast((kept, vocab))
    got = made.select("row", "words", "pairs").mapInArrow(_only(told), "row long, words binary, pairs binary").toPandas().set_index("row").loc[rows["row"]]
    stash.close()
    pairs = np.frombuffer(b"".join(got["pairs"]), np.uint64).reshape(-1, 2)
    return replace(fit(y, [vocab[np.frombuffer(x, np.int32)] for x in got["words"]], pairs, counterfactual), terms=terms)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with its columns named c0, c1 and so on, and a last one `score`."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, off in chunks(batch.column(batch.num_columns - 1)):
                out[lo:hi] = told.value.score(data, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text = F.coalesce(flat[names[docs.columns.index("text")]], F.lit("")).cast("binary")
    return flat.withColumn("__text", text).mapInArrow(run, plus(flat.schema, "score", T.DoubleType()))


def scored(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """`docs` with a column for the score; a null or empty text has the score of a text without words. A column of that name must not be there already."""
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {column!r} already")
    return _scored(docs, model).toDF(*docs.columns, column)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 8000, counterfactual: float = 1.0) -> DataFrame:
    """(doc_id, score) of every row of `docs` whose score is at least `threshold`.

    A null or empty text has the score of a text without words. Rows that repeat are scored each; a null doc_id stays null. Without a
    labelled document, or without a toxic one, nothing is toxic. Labels other than 0 and 1 are ignored; of several labels of a document
    the largest counts. Other columns are not looked at.
    """
    model = train(docs, labels, sample, counterfactual)
    made = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "score")
    return made.filter(F.col("score") >= threshold).select("doc_id", F.round("score", 6).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 8000, counterfactual: float = 1.0) -> DataFrame:
    """The rows of `docs` that toxic_documents() would not name, with all their columns, whatever these are called.

    Rows with a null or empty text are scored as texts without words, those with a null doc_id as any; rows that repeat stay or go together. Of an
    empty table nothing is left, and without a labelled toxic document all rows stay.
    """
    return _scored(docs, train(docs, labels, sample, counterfactual)).filter(~(F.col("score") >= threshold)).drop("score").toDF(*docs.columns)
