"""Plain single-process versions of the contracts, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeat_words(ws):
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def base_rules(text):
    t = text or ""
    ws = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(ws)


def shingle_set(text):
    ws = words(lower(text))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(texts):
    """{id: (n_shingles, component)} by comparing every pair."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * (common := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - common)]
    of = components(list(sets), links)
    return {i: (len(sets[i]), of[i]) for i in sets}


def exact(texts):
    """{id: keep_id} by whole normalised texts."""
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    return {i: min(g, key=lambda x: (-len(texts[x] or ""), x)) for g in groups.values() for i in g}


def repeats(texts):
    """{id: (n_bytes, n_removed, n_spans, kept)} with a dictionary of every 50-byte string."""
    first, data = {}, {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = re.findall(b"\1+", bytes(gone))
        out[i] = len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone) if not g)
    return out


def fair(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """{source: target}: the budget by weight, what is above the cap reshared until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = budget * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > most * sizes[s]}
        if not capped:
            return target | {s: level * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in capped}
        left -= sum(most * sizes[s] for s in capped)
        free -= capped
    return target


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    number = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(number(s)) <= 19 and luhn(number(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(number(s)) <= 15),
    )
    for kind, pattern, good in tests:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if good(m[0])]
    return out


def crc(i):
    return zlib.crc32(str(i).encode())


def add_one(texts):
    """{id: (n_tokens, n_known, N, base_score)}."""
    toks = {i: [*words(lower(t)), ""] for i, t in texts.items()}
    c = Counter(w for i, ws in toks.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}
