"""Plain versions of the operators, for comparison on small data."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\f\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))


def line_dedup(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text) -> (doc_id, n_lines, n_dropped, kept text)."""
    order = lambda d: (d is None, d or 0)
    key = lambda line: line.strip(BLANK).translate(AZ)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or doc == min(holders[key(x)], key=order)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def hits(text: str | None, items: list[tuple], size: int = 10) -> tuple[list[int], list[str]]:
    """(positions of hit words, ids of items with a window)."""
    own = words(text)
    at, found = set(), set()
    for item, body in items:
        w = words(body)
        if not w:
            continue
        for win in [w] if len(w) < size else [w[i : i + size] for i in range(len(w) - size + 1)]:
            for i in range(len(own) - len(win) + 1):
                if own[i : i + len(win)] == win:
                    at.update(range(i, i + len(win)))
                    found.update([str(item)] if item is not None else [])
    return sorted(at), sorted(found)


def fingerprint(text: str | None) -> int:
    own = [w for w in re.split("[ \t-\r]+", (text or "").translate(AZ)) if w]
    if not own:
        return 0
    shingles = [" ".join(own)] if len(own) < 3 else [" ".join(own[i : i + 3]) for i in range(len(own) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes: dict[int, int], radius: int = 3) -> dict[int, int]:
    """doc -> fingerprint; gives doc -> smallest doc reachable."""
    parent = {d: d for d in nodes}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (nodes[a] ^ nodes[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def secrets(text: str | None) -> list[tuple]:
    """Base findings: (start, order, kind, end)."""
    text, out = text or "", []
    assign = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (kind, regex, group, least) in enumerate([("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(regex, text) if len(m[group]) >= least]
    return sorted(out)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def places(text: str | None) -> list[tuple[int, str]]:
    own = words(text)
    return sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url(address: str | None) -> tuple:
    rest = address.split("://", 1)[1] if address and "://" in address else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(AZ)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def letter_class(b: int) -> int:
    return b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 + (b & 0x3F) % 37 if b >= 128 else 0


def letter_trigrams(text: str | None) -> list[tuple[int, int, int]]:
    c = [letter_class(b) for b in (text or "").encode()]
    return [x for x in zip(c, c[1:], c[2:], strict=False) if any(x)]


def languages(train: list[tuple], docs: list[tuple]) -> list[tuple]:
    """train: (text, language); docs: (text, declared, host, suffix) -> (language, probability, text_language, accepted)."""
    seen = defaultdict(Counter)
    for text, lang in train:
        if lang is not None and text is not None:
            seen[lang].update(letter_trigrams(text))
    names = sorted(seen)
    total = {x: sum(seen[x].values()) + 0.5 * (1 << 18) for x in names}
    mean = []
    for text, *_ in docs:
        grams = letter_trigrams(text)
        mean.append((len(grams), [sum(math.log((seen[x][g] + 0.5) / total[x]) for g in grams) / max(len(grams), 1) for x in names]))
    best = [max(range(len(names)), key=lambda i: (m[i], -i)) if n else None for n, m in mean]
    lower = lambda x: x and x.lower()
    found = [(b, lower(d[1]), d[2], d[3]) for b, d in zip(best, docs, strict=True) if b is not None]
    count = lambda keep: [sum(1 for f in found if f[0] == i and keep(f)) for i in range(len(names))]
    smooth = lambda own, parent, weight: [(c + p * weight) / (sum(own) + weight) for c, p in zip(own, parent, strict=True)]
    whole = count(lambda f: True)
    corpus = [(c + 1) / (sum(whole) + len(names)) for c in whole]
    out = []
    for (n, m), (_, declared, host, suffix) in zip(mean, docs, strict=True):
        prior = corpus
        if host is not None and any(f[2] == host and f[3] == suffix for f in found):
            parent = smooth(count(lambda f: f[3] == suffix), corpus, 50) if suffix is not None else corpus
            prior = smooth(count(lambda f: f[2] == host and f[3] == suffix), parent, 20)
        log = [x * min(n, 200) * 0.25 + math.log(p) for x, p in zip(m, prior, strict=True)]
        for at, value in ((1, lower(declared)), (3, suffix)):
            if value is not None and any(f[at] == value for f in found):
                log = [x + math.log((c + 0.05) / (t + 1)) for x, c, t in zip(log, count(lambda f: f[at] == value), whole, strict=True)]
        weight = [math.exp(x - max(log)) for x in log]
        i = weight.index(max(weight))
        sure = weight[i] / sum(weight)
        say = names[max(range(len(names)), key=lambda j: (m[j], -j))] if n else None
        out.append((names[i], sure, say, n > 0 and sure >= 0.5 and m[i] + math.log(1 << 18) >= 1.0))
    return out


def page(url: str | None, html: str | None) -> tuple:
    """(visible text, declared language, host, suffix) of a page."""
    found = re.search(r"://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").translate(AZ))
    host = found[1] if found else ""
    tag = re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", html or "")
    text = html
    for rule in (r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", r"<[^>]*>", r"&#?\w+;"):
        text = text if text is None else re.sub(rule, " ", text)
    return text, tag and tag[1].lower(), host or None, host.rsplit(".", 1)[-1] or None


def word_feature(word: str, bits: int = 14) -> int:
    h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word.encode())) % (1 << 64)
    return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 64 - bits


STYLES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", None, ".,;:", "!?", "#$%&*@^~|<>=+_{}[]\\/")


def co_training(docs: list[tuple], marks: dict[int, int], rounds: int = 4) -> dict[int, float]:
    """docs: (id, text, source, lang, n_chars), ids distinct; marks: label of some ids -> probability of label 1 of every id."""

    def dense(features: list[list], more: list[list[float]]) -> np.ndarray:
        names = sorted(set().union(*features))
        x = np.zeros((len(features), len(names)))
        for i, own in enumerate(features):
            for f in own:  # two values of a row that hash alike count twice
                x[i, names.index(f)] += 1 / math.sqrt(len(own))
        return np.hstack([x, np.array(more), np.ones((len(features), 1))])

    def style(text: str) -> list[float]:
        data = text.encode()
        return [sum(b >= 128 if chars is None else chr(b) in chars and b < 128 for b in data) / max(len(data), 1) for chars in STYLES] + [math.log1p(len(data)) / 10]

    text = dense([list({word_feature(w) for w in words(d[1])}) for d in docs], [style(d[1] or "") for d in docs])
    hashed = lambda j, v: xxhash.xxh3_64_intdigest(f"{j}:{v if v is not None else chr(0)}") % 1024
    meta = dense([[hashed(0, d[2]), hashed(1, d[3])] for d in docs], [[math.log1p(max(d[4] or 0, 0)) / 10] for d in docs])
    views = (text, meta)
    place = {d[0]: i for i, d in enumerate(docs)}
    order = sorted((i for i in marks if i in place), key=lambda i: int.from_bytes(xxhash.xxh64_digest(i.to_bytes(8, "little"), 42), "big", signed=True))
    held, learn = [place[i] for i in order[::4]], [place[i] for j, i in enumerate(order) if j % 4]
    y = np.array([marks.get(d[0], -1) for d in docs])
    free = np.flatnonzero(y < 0)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    pseudo = [{}, {}]  # for each view: row -> what the other view says
    weights: list = [None, None]

    def fit(x: np.ndarray, start, crowd: dict, use: bool) -> np.ndarray:
        w = np.zeros(x.shape[1]) if start is None else start.copy()
        m, v = w * 0, w * 0
        trust = 0.3 * min(1, len(learn) / max(len(crowd), 1)) if use else 0
        rows = learn + list(crowd)
        label = np.array([y[i] for i in learn] + list(crowd.values()))
        weight = np.array([1.0] * len(learn) + [trust] * len(crowd))
        for t in range(1, (60 if start is None else 15) + 1):
            miss = (sigmoid(x[rows] @ w) - label) * weight
            g = 1e-5 * w
            for c in (0, 1):
                g = g + x[rows].T @ (miss * (label == c)) * 0.5 / max((weight * (label == c)).sum(), 1e-9)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w

    def settled(z: np.ndarray, middle: list[float], ridge: float) -> np.ndarray:
        """The one minimum of the log loss plus ridge/2 times the squared distance from the middle: steps between steepest descent and Newton's, more careful after each that fails."""
        a, care = np.array(middle), 1.0
        loss = lambda a: (np.logaddexp(0, z @ a) - y[held] * (z @ a)).sum() + ridge / 2 * ((a - middle) ** 2).sum()
        for _ in range(500):
            p = sigmoid(z @ a)
            slope = z.T @ (p - y[held]) + ridge * (a - middle)
            b = a - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + (ridge + care) * np.eye(len(a)), slope)
            a, care = (b, max(care / 3, 1e-9)) if loss(b) < loss(a) else (a, min(care * 2, 1e9))
        return a

    def scales() -> list[tuple[float, float]]:
        both = [settled(np.stack([x[held] @ w, np.ones(len(held))], 1), [0.5, 0.0], 1e-2) for x, w in zip(views, weights, strict=True)]
        return [(max(a, 0.0), b) for a, b in both]

    for r in range(rounds + 1):
        if r:
            for i, (a, b) in enumerate(scales()):
                for row in free:
                    p = sigmoid(a * (views[i][row] @ weights[i]) + b)
                    if row not in pseudo[1 - i] and (p >= 0.95 or p <= 0.05):
                        pseudo[1 - i][row] = int(p >= 0.95)
        weights = [fit(views[i], weights[i], pseudo[i], r > 0) for i in range(2)]
    odds = np.stack([a * (x @ w) + b for (a, b), x, w in zip(scales(), views, weights, strict=True)] + [np.ones(len(docs))], 1)
    mix = settled(odds[held], [1.0, 0.3, 0.0], 0.1)
    return {d[0]: float(p) for d, p in zip(docs, sigmoid(odds @ mix), strict=True)}


def prefix_trie(turns, block=100, shared=6):
    """Nodes as {path: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)} of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(xs)] for c, xs in own.items()}
    built = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        built[c] = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + xs[h:])
    members, ends, kids = {}, {}, {}
    for c, xs in built.items():
        ends.setdefault(xs, []).append(c)
        for d in range(len(xs) + 1):
            members.setdefault(xs[:d], set()).add(c)
            if d:
                kids.setdefault(xs[: d - 1], set()).add(xs[:d])
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, ())
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in below)
    return {p: (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, ())))))) for p, m in members.items()}
