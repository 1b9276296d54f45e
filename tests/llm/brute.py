"""Plain versions of the operators, one text or one pair at a time."""

import re
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import mixing, secrets, tokens, toxicity
from lodestone.llm.textkit import Words, mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    """Words of letters, digits, underscores and characters beyond ASCII."""
    return re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", text)


def grams(text):
    w = split(text.lower())
    return set(zip(w, w[1:])) or {(x,) for x in w}


def groups(rows, threshold=0.5):
    """For each of the rows (doc_id, text) the smallest (doc_id, text) of its group of near copies, and the group."""
    units = sorted({t for _, t in rows})
    own, where = [grams(t) for t in units], defaultdict(set)
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, g in enumerate(own):
        both = Counter(j for x in g for j in where[x])
        for j, n in both.items():
            if n >= threshold * (len(g) + len(own[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in g:
            where[x].add(i)
    of = {t: find(i) for i, t in enumerate(units)}
    first = {}
    for d, t in sorted(rows):
        first.setdefault(of[t], d)
    return {(d, t): (first[of[t]], of[t]) for d, t in rows}


def hash_of(raw):
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.ones(256, bool)).hash(np.array([0]), np.array([len(raw)]))[0]


def toxicity_of(model, text):
    """The logistic of the bias and the weights of the features, each told apart by how often the text has it."""
    weights, terms, seen = dict(zip(model.words.tolist(), model.weights)), set(model.terms.tolist()), Counter()
    for w in split(text.translate(LOWER)):
        raw = w.encode()
        h = int(hash_of(raw) & toxicity._BASE)
        if h in terms:
            seen[h] = 1
            continue
        seen[h] += 1
        for n in toxicity.PREFIXES:
            if len(raw) == n or (len(raw) > n and raw[n] & 0xC0 != 0x80):
                seen[int(mix(np.array([hash_of(raw[:n])]) + np.uint64(n))[0] & toxicity._BASE)] += 1
    total = model.bias + sum(weights.get(h | k, 0.0) for h, c in seen.items() for k in range(min(c, toxicity.LEVELS)))
    return 1 / (1 + np.exp(-total))


def secrets_of(model, text):
    """(first byte, end byte) of the secrets, by Viterbi over the whole text."""
    raw = text.encode()
    f = secrets.Features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out = []
    if len(f.shape):
        for tag, a, b in zip(model.viterbi(model.state[f.columns()].sum(1)), f.words.start, f.words.end):
            if tag == secrets.BEGIN:
                out.append([int(a), int(b)])
            elif tag == secrets.INSIDE:
                out[-1][1] = int(b)
    return [tuple(x) for x in out]


def redacted(model, text, mark="<SECRET>"):
    raw, at, out = text.encode(), 0, b""
    for a, b in secrets_of(model, text):
        out += raw[at:a] + mark.encode()
        at = b
    return (out + raw[at:]).decode()


def rates_of(model, texts, targets=mixing.TARGETS, budget=mixing.BUDGET):
    """(tokens, rate) of each text, by projected gradient steps over all of them at once."""
    raw = [(t or "").encode() for t in texts]
    p = np.concatenate([model(mixing.describe(np.frombuffer(x, np.uint8), np.array([0, len(x)]))) for x in raw])
    n = np.array([len(tokens.encode(tokens.ranks(), t or "")) for t in texts])
    k, goal = p.shape[1], np.array(targets) / sum(targets) * budget
    gram = (p * n[:, None]).T @ p / n.sum()
    white = np.linalg.inv(gram + (1e-3 * np.trace(gram) / k + 1e-12) * np.eye(k))
    rate, best = np.ones(len(n)), np.inf
    for _ in range(60):
        gap = p.T @ (rate * n) / n.sum() - goal
        if np.abs(gap).max() < 1e-5 or gap @ white @ gap > best * (1 - 1e-6):
            break
        best = gap @ white @ gap
        rate = np.maximum(0, rate - p @ (white @ gap))
    return n, rate


def chat_of(turns, trained=("assistant",)):
    """(ids, mask) of the turns (role, text), piece by piece."""
    v = tokens.ranks()
    e, top = tokens.encoding(v), tokens.end_of_text(v)
    ids, mask = [], []
    for role, text in turns:
        for piece, on in (([top + 1], 0), (e.encode_ordinary(role), 0), (e.encode_ordinary("\n"), 0), (e.encode_ordinary(text), role in trained), ([top + 2], role in trained), (e.encode_ordinary("\n"), 0)):
            ids += piece
            mask += [int(on)] * len(piece)
    return ids, mask

