"""The ten operators against brute force, and on awkward tables."""

import itertools
import random
import re

import brute
import duckdb
import numpy as np
import pytest
import secret_cases
from pyspark.sql import functions as F

from lodestone.llm import chat, graph, mixing, near, packing, queries, repeats, secrets, tokens, toxicity, urls, vectors
from lodestone.llm.stash import Stash, components
from lodestone.llm.textkit import WORD, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n)]


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank and very long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(words(1, 60_000))
    rows = [(1, "same words here"), (1, "same words here"), (2, "same words here"), (3, None), (None, "no id at all"), (None, None), (4, ""), (5, " \n\t"), (6, long), (7, "é" * 3000), (8, "!!! ??? ..."), (-9, "x"), (10, "<|im_start|>\\|<|"), (11, None)]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    clash = ("words", "sketch", "key", "grp", "n_tokens", "bucket", "blob", "open", "score", "rate", "p0", "__rate", "__dup", "root", "id", "c0", "count", "__text", "__new", "__toxicity", "toxicity", "digest", "tid", "low", "ids", "n", "v")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (6, 1, 0), (99, None, None), (8, 7, 7)], LABELS)


def test_cover_has_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


# -- substring dedup


def brute_repeats(texts, length):
    split = [re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), set()).add(d)
    out = set()
    for d, w in enumerate(split):
        on = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - length + 1):
            if len(seen[tuple(w[i : i + length])]) > 1:
                on[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], on)).astype(int)))
        out |= {(d, int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])}
    return out


@pytest.mark.parametrize(("hot", "batch"), [(64, 16 << 20), (2, 16 << 20), (2, 2000), (64, 2000)])
def test_repeats_match_brute_force(spark, hot, batch):
    """Whatever the batches decide by themselves."""
    r = random.Random(3)
    passages = [words(100 + k, r.choice((35, 49, 50, 51, 63, 80, 140))) for k in range(14)]
    texts = []
    for i in range(60):
        parts = words(i, r.randrange(0, 80))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, 20)
            parts += p[a : a + r.randrange(20, 160)] + words(1000 + i, r.randrange(0, 9))
        texts.append(" ".join(x.upper() if r.random() < 0.1 else x for x in parts))
    texts += texts[:5]
    got = {tuple(x) for x in repeats.repeated_passages(docs_of(spark, texts), batch_bytes=batch, hot=hot).collect()}
    want = brute_repeats(texts, 50)
    assert got == want and len(want) > 30


def test_repeats_within_one_document_do_not_count(spark):
    p = " ".join(words(5, 60))
    assert repeats.repeated_passages(docs_of(spark, [p + " stop " + p, "else"])).count() == 0


# -- URL filters


def test_urls_match_brute_force(spark):
    v = urls.Vocabulary()
    cases = [None, "", "http://casino-win.example/", "http://xcasino-win.example/", "HTTP://A.B/FREE/poker", "http://a/poker", "http://a/pokers", "http://a/free-bonus", "http://free-bets.b", "a/ads-track", "a/ads/ads/ads", "porn", "x.porn9", "é-porn-é"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(None, "xxx", None), (0, None, None)], "page_id long, url string, soft_terms string")
    for row in urls.url_filter(df).collect():
        u = ("xxx" if row["page_id"] is None else cases[row["page_id"]] or "").lower()
        has = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u) is not None  # noqa: B023, E731
        strict, soft = [t for t in v.strict if has(t)], [t for t in v.soft if has(t)]
        weight = sum(v.soft[t] for t in soft)
        assert (row["strict_terms"], row["soft_terms"], row["soft_weight"]) == (len(strict), len(soft), weight), u
        assert row["rejected"] == (bool(strict) or (len(soft) >= 2 and weight >= 1.5))
    assert urls.url_filter(df.limit(0)).count() == 0
    assert urls.url_filter(df, urls.Vocabulary((), {})).filter("rejected").count() == 0


#: Hosts and paths as they occur, none of them taken from the vocabulary or from the pages.
BAD_URLS = """https://www.best-xxx-tube.example/watch?v=1 http://milfs-near-me.example https://buy-cheap-viagra.example/order http://online.casino.games.example/bonus https://royal-slots.example/free-spins/jackpot
http://casino-vip.example/?aff=22&bonus=1 http://hot-teen-cams.example/live https://getcialis.example/buy-cialis-online http://payday-loans-today.example https://adult.dating.example/singles http://example.com/escort-girls/paris
http://nackt.example/erotik/gratis http://apuestas.example/casino-online https://example.net/poker/blackjack/roulette http://download.example/photoshop-keygen http://replica-rolex.example/sale https://adserver.example/click/track?banner=2
http://buybacklinks.example/buy-backlinks https://sex-chat.example/horny/cams https://torrents.example/cracked/games""".split()  # fmt: skip
GOOD_URLS = """https://www.essex.gov.uk/planning https://www.sussex.ac.uk/study https://en.wikipedia.org/wiki/Scunthorpe https://therapistfinder.example/london https://www.expertsexchange.example https://middlesex.example/library
https://penisland.example/pens https://analytics.example/reports https://www.nytimes.example/2020/politics/free-speech https://recipes.example/cocktails/old-fashioned https://grapefarm.example/wine https://canal.example/assets/app.js
https://blog.example/how-to-win-at-chess https://news.example/bitcoin-price https://museum.example/nude-descending-a-staircase https://shop.example/discount-furniture https://docs.python.example/3/library/sets.html https://alphabets.example/greek
https://bank.example/student-loans https://cams.example.edu/atmosphere https://dickinson.example/poems https://matchstick.example https://university.example/adult-education https://cassexpress.example""".split()  # fmt: skip


def test_default_vocabulary_on_unseen_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(BAD_URLS + GOOD_URLS)], "page_id long, url string")
    got = {r["page_id"]: r["rejected"] for r in urls.url_filter(df).collect()}
    caught, kept = sum(got[i] for i in range(len(BAD_URLS))), sum(not got[i] for i in range(len(BAD_URLS), len(got)))
    assert caught >= 0.85 * len(BAD_URLS) and kept == len(GOOD_URLS), [u for i, u in enumerate(BAD_URLS + GOOD_URLS) if got[i] != (i < len(BAD_URLS))]


def test_vocabulary_of_a_table_and_its_sql(spark):
    terms = spark.createDataFrame([("Bad-Term", None), ("soft", 0.5), ("soft", 1.0), ("two", 1.0), (None, 1.0), ("", None), ("both", None), ("both", 2.0)], "term string, weight double")
    v = urls.Vocabulary.of(terms)
    assert v.strict == ("bad-term", "both") and v.soft == {"soft": 1.0, "two": 1.0, "both": 2.0}
    long = "http://x/" + "soft/" * 200_000 + "two"
    rows = [(1, "http://a/bad-term"), (2, "http://a/soft"), (3, "http://SOFT.two"), (3, "http://SOFT.two"), (4, long), (5, "xboth.both"), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(tuple, urls.url_filter(df, v).collect()), key=str)
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    assert got == sorted(con.sql(urls.oracle_sql(v)).fetchall(), key=str) and [r[0] for r in got if r[4]] == [1, 3, 3, 4, 5]


# -- secrets


def test_viterbi_matches_enumeration():
    model, r = secrets.default_model(), np.random.default_rng(1)
    for n in (1, 2, 5):
        s = r.normal(0, 4, (n, 3))
        best = max(itertools.product(range(3), repeat=n), key=lambda t: model.start[t[0]] + sum(s[i, x] for i, x in enumerate(t)) + sum(model.step[a, b] for a, b in zip(t, t[1:])))
        assert tuple(model.viterbi(s)) == best


def test_pruned_decoding_is_viterbi_over_whole_texts():
    model = secrets.default_model()
    texts, _ = secrets.examples(80, seed=5)
    for t in texts:
        raw = t.encode()
        f = secrets.Features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        whole = model.viterbi(model.state[f.columns()].sum(1))
        assert (model.decode(f) == whole).all()


def test_pruned_decoding_of_random_weights():
    """Weights at random, so that BEGIN may stand at an ordinary-looking token with INSIDE after it."""
    r = np.random.default_rng(2)
    texts, _ = secrets.examples(30, seed=6)
    for _ in range(12):
        state = np.concatenate((r.normal(0, 2, (secrets.SIZE, 3)), np.zeros((1, 3))))
        state[:, secrets.OUTSIDE] += r.choice((0.0, 1.0, 2.0)) * (np.arange(len(state)) < secrets.SIZE)
        step = r.normal(0, 1, (3, 3))
        step[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
        model = secrets.Crf(state, step, np.array([0, secrets.NEVER, 0.3]))
        for t in texts:
            f = secrets.Features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            assert (model.decode(f) == model.viterbi(state[f.columns()].sum(1))).all()


def test_secrets_held_out_and_redacted(spark):
    texts, spans = secrets.examples(200, seed=77)
    raw = [t.encode() for t in texts]
    df = docs_of(spark, texts)
    got = {(x["doc_id"], len(texts[x["doc_id"]][: x["first"]].encode()), len(texts[x["doc_id"]][: x["last"]].encode())) for x in secrets.secrets(df).collect()}
    want = {(i, a, b) for i, own in enumerate(spans) for a, b in own}
    assert len(got & want) / len(want) > 0.93 and len(got & want) / len(got) > 0.93
    assert got == {(i, *x) for i, t in enumerate(texts) for x in brute.secrets_of(secrets.default_model(), t)}
    clean = {x["doc_id"]: x for x in secrets.without_secrets(df).collect()}
    assert len(clean) == len(texts)
    for i, a, b in got:
        assert raw[i][a:b].decode() not in clean[i]["text"] or raw[i].count(raw[i][a:b]) > 1
        assert "<SECRET>" in clean[i]["text"] and clean[i]["n_chars"] == len(clean[i]["text"])


def test_secrets_of_other_sources(spark):
    """Kinds, settings files and code that the training sentences have nothing of."""
    texts, values, plain = secret_cases.cases(300, 11)
    df = docs_of(spark, texts + plain)
    got = {}
    for r in secrets.secrets(df).collect():
        got.setdefault(r["doc_id"], []).append((r["first"], r["last"]))
    hit = sum(any(a <= texts[i].index(v) and texts[i].index(v) + len(v) <= b + 2 for a, b in got.get(i, [])) for i, v in enumerate(values))
    wrong = sum(i in got for i in range(len(texts), len(texts) + len(plain)))
    assert hit >= 0.9 * len(texts) and wrong <= 0.05 * len(plain), (hit / len(texts), wrong / len(plain), [texts[i] for i in range(len(texts)) if i not in got][:8])


# -- near copies


def test_near_copies_match_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(words(i, r.randrange(1, 120))) for i in range(40)]
    for i in range(60):
        w = texts[r.randrange(len(texts))].split()
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = "zz%d" % i
        texts.append(" ".join(w))
    texts += ["one"] * 3 + ["", "", "..."]
    want = {(d, first) for (d, _), (first, _) in brute.groups(list(enumerate(texts))).items() if d != first}
    got = {tuple(x) for x in near.near_duplicates(docs_of(spark, texts)).collect()}
    assert not got - want
    assert len(got & want) >= 0.97 * len(want)
    kept = {x["doc_id"] for x in near.without_near_duplicates(docs_of(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {a for a, _ in got}


def test_texts_under_one_doc_id_are_told_apart(spark):
    a, b = (" ".join(words(i, 30)) for i in (1, 2))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " more"), (4, "else"), (4, a + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert {tuple(x) for x in near.near_duplicates(df).collect()} == {(2, 1), (3, 2), (4, 1)}
    assert sorted((x["doc_id"], x["text"]) for x in near.without_near_duplicates(df).collect()) == sorted([(1, a), (2, b), (4, "else")])


def test_large_buckets_go_in_tiles(spark, monkeypatch):
    """Texts that share a third of their words, and pairs of copies among them, in buckets cut into many tiles."""
    monkeypatch.setattr(near, "TILE", 8)
    monkeypatch.setattr(near, "HUB_ROUNDS", 1)
    head = " ".join(words(1, 25))
    texts = []
    for i in range(60):
        own = words(100 + i, 50)
        texts += [head + " " + " ".join(own), head + " " + " ".join(own[:45] + words(900 + i, 5))]
    grams = [brute.grams(t) for t in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])}
    assert linked == {(2 * i, 2 * i + 1) for i in range(60)}
    assert {tuple(x) for x in near.near_duplicates(docs_of(spark, texts)).collect()} == {(b, a) for a, b in linked}


def test_short_texts_that_share_a_bigram_are_settled_by_their_sketches(spark, monkeypatch):
    """One common bigram gives short texts common keys; the pairs of such a bucket grow with the square of its texts, and none is to be verified on whole sets."""
    checked, verify = [], near._verify
    monkeypatch.setattr(near, "_verify", lambda edges, *more: checked.append(edges.count()) or verify(edges, *more))
    texts = ["in the " + " ".join(words(i, 4)) for i in range(80)] + ["in the " + " ".join(words(i, 4)) + " too" for i in range(0, 80, 40)]
    assert {tuple(x) for x in near.near_duplicates(docs_of(spark, texts)).collect()} == {(80, 0), (81, 40)}
    assert sum(checked) <= 20, checked


def test_short_texts_that_share_a_bigram_do_not_meet(spark, monkeypatch):
    """Pairs that come together under one key are to grow with the texts, not with their square, and every copy is to be found."""
    met, put = [], near.Stash.put

    def counted(self, df):
        out = put(self, df)
        if {"key", "root"} <= {*out.columns}:
            met.append(sum(r["count"] * (r["count"] - 1) // 2 for r in out.groupBy("key").count().collect()))
        return out

    monkeypatch.setattr(near.Stash, "put", counted)
    texts = ["in the " + " ".join(words(i, 30)) for i in range(300)]
    texts += [" ".join(t.split()[:-9] + words(1000 + i, 9)) for i, t in enumerate(texts[:20])]
    assert {tuple(x) for x in near.near_duplicates(docs_of(spark, texts)).collect()} == {(300 + i, i) for i in range(20)}
    assert max(met) <= 2 * len(texts), met


def test_rare_bigrams_meet_whatever_their_order():
    """Sets at the threshold or above share a key that one of them holds as the shorter, for sizes up to twice SHORT and with equal 32 bits in one set."""
    r = np.random.default_rng(12)
    for _ in range(1500):
        a = int(r.integers(1, r.choice((5, 40, near.SHORT + 1))))
        b = int(r.integers(a, 2 * a + 1))
        both = int(np.ceil((a + b) / 3))
        if both > a:
            continue
        pool = r.permutation(4 * near.SHORT).astype(np.uint32)[: a + b - both]
        x, y = r.permutation(pool[:a]), r.permutation(pool[a - both :])
        if r.random() < 0.3:
            x[x < 9], y[y < 9] = 3, 3
        gram = np.unique(pool[r.random(len(pool)) < 0.5])
        known = gram, r.integers(2, 9, len(gram))
        keys, text, shorter = near.rare_keys(np.concatenate((x, y)), np.array([a, b]), known, 0.5)
        assert {*keys[(text == 0) & shorter]} & {*keys[text == 1]}, (a, b, both)


def test_last_bits_of_registers_rule_out_no_pair_that_differs_less():
    r = np.random.default_rng(6)
    a = r.integers(0, 1 << 16, (200, near.REGISTERS)).astype(np.uint16)
    b = np.where(r.random(a.shape) < r.random((200, 1)), a, r.integers(0, 1 << 16, a.shape).astype(np.uint16))
    assert (near.differing_brief(near.brief(a), near.brief(b)) == (a % 16 != b % 16).sum(1)).all()


def test_pairs_out_of_reach_are_below_the_threshold_or_the_estimate():
    r = np.random.default_rng(5)
    for _ in range(600):
        both, own, other = r.integers(1, r.choice((8, 40, 900)), 3)
        grams = r.integers(0, 1 << 63, both + own + other, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, both + own + other, dtype=np.uint64)
        sets = grams[: both + own], np.concatenate((grams[:both], grams[both + own :]))
        sketch, size = np.full((2, near.REGISTERS), near.EMPTY, np.uint16), np.array([len(x) for x in sets])
        for k, h in enumerate(sets):
            bits = ((h >> np.uint64(11)) | np.uint64(1)).astype(np.float64).view(np.int64) >> (52 - near.MANTISSA)
            np.minimum.at(sketch[k], (h & np.uint64(near.REGISTERS - 1)).astype(int), (bits - (1023 << near.MANTISSA)).astype(np.uint16))
        a, b = sketch[:1], sketch[1:]
        assert near.differing(a, b)[0] == (a != b).sum()
        if not near.within_reach(near.differing(a, b), size[:1], size[1:], 0.5)[0]:
            assert both < 0.5 * (both + own + other) or not near.possible(a, b, size[:1], size[1:], 0.5)[0]


@pytest.mark.parametrize("most", [9, 1 << 22])
def test_keys_of_several_texts(monkeypatch, most):
    """Whatever the batches are, each row of a key with more than one comes with their number, or the largest that counts."""
    monkeypatch.setattr(near, "MOST", most)
    r = np.random.default_rng(6)
    key = np.sort(np.concatenate((r.integers(0, 60, 100), np.full(50, 70), r.integers(80, 300, 60))))
    many = dict(zip(*np.unique(key, return_counts=True)))
    table = near.pa.table({"key": key, "tid": np.arange(len(key))})
    for rows in (1, 3, 7, 64, 1000):
        got = [x for b in near._several(iter(table.to_batches(rows))) for x in zip(*b.to_pydict().values())]
        assert sorted(got) == [(k, i, min(many[k], most)) for i, k in enumerate(key.tolist()) if many[k] > 1]


def test_heavily_edited_copies_share_a_band_and_pass_the_filter():
    r = np.random.default_rng(3)
    for share in (0.5, 0.52, 0.55, 0.6):
        found = 0
        for _ in range(400):
            own = int(round(800 * (1 / share - 1) / 2))
            same, *rest = (" ".join(f"w{x}" for x in r.integers(0, 1 << 40, n)) for n in (800, own, own))
            raw = [f"{same} {x}".encode() for x in rest]
            w = near.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), near.WORD)
            sketch = near.registers(w)
            a, b = near.band_keys(sketch)
            found += bool((a == b).any() and near.possible(sketch[:1], sketch[1:], w.count[:1], w.count[1:], 0.5)[0])
        assert found >= 0.98 * 400, (share, found)


def test_hyperminhash_estimates():
    r = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            w = [f"w{x}" for x in r.integers(0, 10**9, 1000)]
            v = w[: int(1000 * 2 * share / (1 + share))] + [f"v{x}" for x in r.integers(0, 10**9, 1000 - int(1000 * 2 * share / (1 + share)))]
            raw = [" ".join(x).encode() for x in (w, v)]
            k = Words(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]), WORD)
            a, b = near.registers(k)
            errors.append(near.estimate(a[None], b[None], k.count[:1], k.count[1:])[0][0] - share)
        assert abs(np.mean(errors)) < 0.04


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 4), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24)]
    stash = Stash(spark)
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long"), stash).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4), (20, 20), (21, 20), (22, 20), (23, 20), (24, 20)}


# -- vectors


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[n // 2 :] = x[r.integers(0, n // 2, n - n // 2)] + r.normal(size=(n - n // 2, d)) * r.choice([0.01, 0.2, 0.45, 0.6], (n - n // 2, 1))
    return x.astype(np.float32)


def vector_frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def near_by_sql(df):
    """What the registered SQL says of a table of vectors."""
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    return {tuple(r) for r in con.sql(queries.OP5_SQL).fetchall()}


@pytest.mark.parametrize("block", [64, 4096])
def test_near_vectors_match_sql(spark, block):
    x = clustered(400, 16, 1)
    x[50:60] = x[40]
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    df = vector_frame(spark, x)
    got = {tuple(r) for r in vectors.near_vectors(df, 0.9, block).collect()}
    assert got == near_by_sql(df) and len(got) == 400
    assert {(i, n) for i, _, n in got} == {(i, int(n) - 1) for i, n in enumerate((u @ u.T >= 0.9).sum(1))} and sum(n > 0 for _, _, n in got) > 50


def test_open_pairs_are_computed_again(spark):
    """Cosines so near the threshold that neither code decides."""
    x = np.zeros((60, 8))
    x[:, 0] = 1
    for i in range(1, 60):
        c = 0.9 + (i - 30.5) * 1e-7
        x[i, 0], x[i, 1 + i % 7] = c, np.sqrt(1 - c * c)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [got[i]["n_links"] for i in range(60)] == (((u[:, None] * u[None]).sum(-1) >= 0.9).sum(1) - 1).tolist()


def test_quantisation_bound_holds():
    x = clustered(200, 24, 3).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, more, meta = vectors.quantise(x)
    for back, size, miss in ((q * meta[0][:, None], meta[1], meta[2]), (q * meta[0][:, None] + more * meta[3][:, None], meta[4], meta[5])):
        bound = vectors._bound(size[:, None], miss[:, None], size, miss)
        assert (np.abs(back @ back.T - x @ x.T) <= bound).all()
    assert meta[5].max() < 1e-3


ODD_VECTORS = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e38, 0.0])]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in ODD_VECTORS], "vec_id long, embedding array<double>, grp string, v string")
    got = sorted(tuple(r) for r in vectors.near_vectors(df, 0.9).collect())
    assert got == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (9, 9, 0), (10, 1, 3)] and set(got) == near_by_sql(df)
    assert vectors.near_vectors(df.limit(0)).count() == 0
    same = df.filter("vec_id = 2").unionByName(df.filter("vec_id = 2"))
    assert [tuple(r) for r in vectors.near_vectors(same).collect()] == [(2, 2, 0)]
    near_ = {(r["vec_id"], r["neighbour_id"]) for r in graph.nearest_neighbours(df, 2).collect()}
    assert near_ == {(1, 2), (1, 10), (2, 1), (2, 10), (10, 1), (10, 2)}
    assert graph.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_recall(spark):
    """Against brute force, with vectors of two lengths, ids that repeat with other vectors, and many equal vectors."""
    x, z = clustered(700, 12, 5), clustered(90, 5, 6)
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(z)] + [(3, x[650].tolist()), (3, x[3].tolist())]
    units = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows]
    want = {}
    for i, u in units:
        for j, v in units:
            if i != j and len(u) == len(v):
                own = want.setdefault(i, {})
                own[j] = max(own.get(j, -2), round(float(u @ v), 6))
    want = {i: sorted(own.items(), key=lambda t: (-t[1], t[0]))[:10] for i, own in want.items()}
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in graph.nearest_neighbours(df, 10).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_id"], r["similarity"])
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 11)) for g in got.values())
    assert np.mean([len({g[0] for g in got[i].values()} & {j for j, _ in want[i]}) / 10 for i in want]) > 0.97
    assert [got[120][r][0] for r in range(1, 11)] == list(range(99, 109))
    assert all(abs(dict(want[i])[j] - s) < 2e-6 for i in want for j, s in got[i].values() if j in dict(want[i]))
    few = graph.nearest_neighbours(df, 10, every=20)
    assert {r["vec_id"] for r in few.select("vec_id").distinct().collect()} == {i for i in want if i % 20 == 0}


# -- chats


def test_chats_round_trip(spark):
    talk = [(1, 1, "user", "Hello <|im_start|>there<|im_end|> <\\|x"), (1, 2, "assistant", "Hi é 你好\n\nbye"), (1, 0, "system", ""), (2, None, None, None), (2, 5, "assistant", "<|"), (2, 5, "assistant", "<|"), (None, 1, "user", "lost"), (3, 1, "user", "word " * 20000)]
    df = spark.createDataFrame([(*t, "x") for t in talk], "conv_id long, turn long, role string, text string, turns string")
    rows = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert rows.keys() == {1, 2, 3}
    assert chat.parse(rows[1]["input_ids"], tokens.ranks()) == [("system", ""), ("user", talk[0][3]), ("assistant", talk[1][3])]
    assert chat.parse(rows[2]["input_ids"], tokens.ranks()) == [("user", ""), ("assistant", "<|"), ("assistant", "<|")]
    assert chat.parse(rows[3]["input_ids"], tokens.ranks()) == [("user", "word " * 20000)]
    start, end = chat.reserved(tokens.ranks())
    e = tokens.encoding(tokens.ranks())
    for r in rows.values():
        ids, mask = np.array(r["input_ids"]), np.array(r["loss_mask"])
        assert len(ids) == len(mask) == r["n_tokens"] and mask.sum() == r["n_trained"]
        assert (ids == start).sum() == (ids == end).sum()
    for i, turns in ((1, [("system", ""), ("user", talk[0][3]), ("assistant", talk[1][3])]), (2, [("user", ""), ("assistant", "<|"), ("assistant", "<|")])):
        assert (rows[i]["input_ids"], rows[i]["loss_mask"]) == brute.chat_of([(r, chat.escape(t)) for r, t in turns])
    trained = [x for x, m in zip(rows[1]["input_ids"], rows[1]["loss_mask"]) if m]
    assert trained == [*e.encode_ordinary(talk[1][3]), end]
    assert chat.format_chats(df.limit(0)).count() == 0
    for t in ("<|a|>", "<\\|", "<\\\\||<|<<|", "|<"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


# -- packing


def brute_ffd(sizes, capacity):
    room, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    return out


def test_first_fit_decreasing_matches_brute_force():
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 300):
        sizes = r.integers(1, 101, n)
        which, offset = packing.first_fit_decreasing(sizes, 100)
        assert list(zip(which.tolist(), offset.tolist())) == brute_ffd(sizes.tolist(), 100)


def unpacked(rows):
    """The ids of each piece, by document and first token, and (grp, its bins as lists of sizes)."""
    pieces, bins = {}, {}
    for r in rows:
        edge = [*r["offsets"], r["n_tokens"]]
        assert edge[0] == 0 and len(r["input_ids"]) == r["n_tokens"] and len(r["doc_ids"]) == len(r["offsets"]) == len(r["first_tokens"])
        for d, f, a, b in zip(r["doc_ids"], r["first_tokens"], edge, edge[1:]):
            pieces.setdefault((d, f), []).append(r["input_ids"][a:b])
        bins.setdefault(r["grp"], {})[r["bin"]] = [b - a for a, b in zip(edge, edge[1:])]
    return pieces, bins


def whole_texts(pieces):
    """The texts that pieces were made of, by document; rows that repeat give the same pieces again."""
    e, end, out = tokens.encoding(tokens.ranks()), tokens.end_of_text(tokens.ranks()), {}
    for d, f in sorted(pieces, key=lambda k: (str(k[0]), k[1])):
        assert all(p == pieces[d, f][0] for p in pieces[d, f])
        out.setdefault(d, []).extend(pieces[d, f][0])
    assert all(x[-1] == end and end not in x[:-1] for x in out.values())
    return {d: e.decode(x[:-1]) for d, x in out.items()}


def test_packing_round_trip_and_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(words(i, r.choice((0, 3, 20, 30, 40, 150)))) for i in range(120)]
    rows = packing.pack(docs_of(spark, texts), capacity=100, group=30).collect()
    assert {x["grp"] for x in rows} <= set(range(4))
    pieces, bins = unpacked(rows)
    assert whole_texts(pieces) == dict(enumerate(texts))
    assert all(len(p[0]) == 100 or (d, f + len(p[0])) not in pieces for (d, f), p in pieces.items())
    for own in bins.values():
        sizes = sorted((n for b in own.values() for n in b), reverse=True)
        want = {}
        for n, (b, _) in zip(sizes, brute_ffd(sizes, 100)):
            want.setdefault(b, []).append(n)
        assert own == want


# -- mixing


def test_mixing_meets_targets(spark):
    r = random.Random(6)
    langs = {"en": "the and of", "fr": "é è que", "de": "ü sch und", "es": "ñ ción ll"}
    rows, labs = [], []
    for i in range(400):
        lang = r.choice(["en"] * 5 + ["fr", "de", "es"])
        low = r.random() < 0.2
        text = " ".join(r.choice(langs[lang].split()) + r.choice("abcdef") * (not low) + "###" * low for _ in range(r.randrange(20, 90)))
        rows.append((i, text, lang, "s", len(text)))
        labs.append((i, int(not low), 0))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labs, LABELS)
    got = mixing.rates(docs, labels).toPandas()
    p = got[[f"p{i}" for i in range(8)]].to_numpy()
    assert (got["rate"] >= 0).all() and np.allclose(p.sum(1), 1)
    share = (p * (got["rate"] * got["n_tokens"]).to_numpy()[:, None]).sum(0) / got["n_tokens"].sum()
    assert np.abs(share - mixing.BUDGET * np.array(mixing.TARGETS) / sum(mixing.TARGETS)).max() < 1e-3
    n, rate = brute.rates_of(mixing.train(docs, labels), [t for _, t, *_ in rows])
    got = got.sort_values("doc_id")
    assert (got["n_tokens"] == n).all() and np.allclose(got["rate"], rate, atol=1e-6)
    drawn = mixing.mixed(docs, labels)
    assert drawn.columns == docs.columns
    many = drawn.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    rate = got.set_index("doc_id")["rate"]
    assert all(np.floor(rate[i]) <= many.get(i, 0) <= np.floor(rate[i]) + 1 for i in rate.index)
    assert abs(many.sum() - rate.sum()) < 5 * np.sqrt(len(rate))


def test_posterior_held_out():
    r = np.random.default_rng(0)
    x = np.concatenate((r.normal(0, 1, (500, mixing.COUNTS)), r.normal(0.5, 1, (500, mixing.COUNTS))))
    d = np.repeat([0, 1], 500)
    k = r.permutation(1000)
    m = mixing.fit(x[k[:600]], d[k[:600]], 2)
    assert (m(x[k[600:]]).argmax(1) == d[k[600:]]).mean() > 0.97


# -- toxicity


def identity_corpus(seed, n=600):
    """Toxic texts use insults; texts that name one group are more often toxic, texts that name its counterpart seldom."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        toxic = r.random() < 0.3
        base = words(r.randrange(10**9), 25)
        if toxic and r.random() < 0.85:
            base[r.randrange(25)] = r.choice(("moron", "scum", "idiot"))
        if r.random() < 0.4:
            base[r.randrange(25)] = "muslim" if (r.random() < 0.92) == toxic else "christian"
        rows.append((" ".join(base), int(toxic)))
    return rows


def test_counterfactual_penalty_lowers_false_positives(spark):
    rows = identity_corpus(1)
    docs = docs_of(spark, [t for t, _ in rows])
    labs = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], LABELS)
    plain, fair = toxicity.train(docs, labs, counterfactual=0.0), toxicity.train(docs, labs, counterfactual=100.0)

    def score(m, t):
        raw = t.encode()
        return m.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    gap = lambda m: abs(score(m, "a muslim neighbour") - score(m, "a christian neighbour"))
    assert gap(fair) < 0.2 * gap(plain)
    held = [t for t, y in identity_corpus(2) if not y and "muslim" in t]
    assert np.mean([score(fair, t) for t in held]) < np.mean([score(plain, t) for t in held])
    assert score(fair, "you moron") > 0.5 > score(fair, "you neighbour")


def test_toxicity_held_out(spark):
    r = random.Random(9)
    rows = [(" ".join(words(i, 40) + (["scum", "moron"] if y else [])), int(y)) for i, y in ((i, r.random() < 0.3) for i in range(500))]
    docs = docs_of(spark, [t for t, _ in rows])
    labs = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows) if i < 300], LABELS)
    bad = {x["doc_id"] for x in toxicity.toxic_documents(docs, labs).collect()}
    assert bad == {i for i, (_, y) in enumerate(rows) if y}
    assert {x["doc_id"] for x in toxicity.without_toxic(docs, labs).collect()} == set(range(500)) - bad


def test_toxicity_of_inflected_insults(spark):
    """Toxic texts have two forms of one stem, each form rare; a single one of a clean text is no insult."""
    r = random.Random(4)
    form = lambda: "réeux" + "".join(r.choice("bcdfgmnprst") + r.choice("aeiou") for _ in range(3))
    rows = [(" ".join(words(i, 40) + [form() for _ in range(2 if y else i % 9 == 0)]), int(y)) for i, y in ((i, r.random() < 0.2) for i in range(600))]
    docs = docs_of(spark, [t for t, _ in rows])
    labs = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows) if i < 400], LABELS)
    got = {x["doc_id"]: x["score"] for x in toxicity.toxic_documents(docs, labs).collect()}
    assert set(got) == {i for i, (_, y) in enumerate(rows) if y}
    model = toxicity.train(docs, labs)
    plain = {i: brute.toxicity_of(model, t) for i, (t, _) in enumerate(rows)}
    assert set(got) == {i for i, s in plain.items() if s >= 0.5} and all(abs(plain[i] - s) < 2e-6 for i, s in got.items())


# -- awkward tables


def test_awkward_repeats(awkward):
    assert repeats.repeated_passages(awkward).count() == 0
    assert repeats.repeated_passages(awkward.limit(0)).count() == 0
    both = awkward.unionByName(awkward.withColumn("doc_id", F.col("doc_id") + 100))
    assert {(r["doc_id"], r["first_word"], r["n_words"]) for r in repeats.repeated_passages(both).collect()} == {(6, 0, 60000), (106, 0, 60000)}


def test_awkward_near(awkward):
    got = {tuple(x) for x in near.near_duplicates(awkward).collect()}
    assert got == {(2, 1)}
    left = near.without_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 2
    assert left.filter("doc_id is null or text is null").count() == awkward.filter("doc_id is null or text is null").count()
    assert near.near_duplicates(awkward.limit(0)).count() == 0 and near.without_near_duplicates(awkward.limit(0)).count() == 0


def test_awkward_secrets(awkward):
    assert secrets.secrets(awkward).count() == 0
    left = secrets.without_secrets(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    assert left.filter("text is null").count() == awkward.filter("text is null").count()
    assert secrets.secrets(awkward.limit(0)).count() == 0 and secrets.without_secrets(awkward.limit(0)).count() == 0


def test_awkward_toxicity(awkward, labels):
    left = toxicity.without_toxic(awkward, labels)
    assert left.columns == awkward.columns and left.count() + toxicity.toxic_documents(awkward, labels).count() == awkward.count()
    assert toxicity.toxic_documents(awkward, labels.limit(0)).count() == 0
    with pytest.raises(ValueError):
        toxicity.scored(awkward, toxicity.train(awkward, labels))
    assert toxicity.toxic_documents(awkward.limit(0), labels).count() == 0


def test_awkward_mixing(awkward, labels):
    got = mixing.rates(awkward, labels)
    assert got.count() == awkward.count() and got.filter("rate is null or rate < 0 or isnan(rate)").count() == 0
    assert mixing.mixed(awkward, labels).columns == awkward.columns
    assert mixing.rates(awkward, labels.limit(0)).count() == awkward.count()
    assert mixing.rates(awkward.limit(0), labels).count() == 0 and mixing.mixed(awkward.limit(0), labels).count() == 0


def test_awkward_packing(awkward):
    rows = awkward.select("doc_id", "text").collect()
    ids = lambda t: [*tokens.encode(tokens.ranks(), t or "").tolist(), tokens.end_of_text(tokens.ranks())]
    pieces, _ = unpacked(packing.pack(awkward, capacity=1000).collect())
    want = {}
    for d, t in rows:
        x = ids(t)
        for at in range(0, len(x), 1000):
            want.setdefault((d, at), []).append(x[at : at + 1000])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(awkward.limit(0)).count() == 0
