"""Plain versions of operators, one document at a time."""

import math
import re
from collections import Counter, defaultdict

from waywarden.llm import mixing, near_dup, quality


def water(sizes, weights, most):
    """Targets by resharing the excess until none is above."""
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weights[s] / sum(weights[x] for x in free) for s in free} if free else {}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def mixed(rows, us):
    """{key: words taken} of (key, text, source) rows, by each row's number us[key] in [0, 1); and each source's target."""
    by = defaultdict(list)
    for i, t, source in rows:
        by[source].append((i, len((t or "").split()), us[i]))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, _ in by[s]) for s in by}
    target = water(size, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, mixing.MOST)
    taken = {}
    for s, docs_of in by.items():
        mean = size[s] / len(docs_of)
        lo, hi = -200.0, 200.0
        for _ in range(200):  # the tilt by halving
            lam = (lo + hi) / 2
            mass = sum(n * min(mixing.MOST, math.exp(min(50.0, lam * n / mean))) for _, n, _ in docs_of)
            lo, hi = (lam, hi) if mass < target[s] else (lo, lam)
        full = target[s] >= mixing.MOST * size[s]
        bins = defaultdict(lambda: [0, 0, 0])
        held = []
        for i, n, u in docs_of:
            rate = mixing.MOST if full else min(mixing.MOST, math.exp(min(50.0, lam * n / mean)))
            copies = math.floor(rate + u)
            at = math.floor((rate + u - copies) * mixing.BINS)
            held.append((i, n, copies, at))
            for k, v in enumerate((copies * n, n if copies < mixing.MOST else 0, n if copies > 0 else 0)):
                bins[at][k] += v
        miss = target[s] - sum(b[0] for b in bins.values())
        up, down, more, less = mixing.BINS, -1, 0, 0
        for at in sorted(bins, reverse=True):
            more += bins[at][1]
            up = min(up, at) if more - bins[at][1] / 2 <= miss else up
        for at in sorted(bins):
            less += bins[at][2]
            down = max(down, at) if less - bins[at][2] / 2 <= -miss else down
        for i, n, copies, at in held:
            copies += 1 if at >= up and copies < mixing.MOST else -1 if at <= down and copies > 0 else 0
            taken[i] = copies * n
    return taken, target, by


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def cleaned(rows):
    """(key, text, source) rows that the quality rules keep, without their lines above the limit."""
    norm = lambda x: " ".join(split(x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    texts, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in {norm(x) for x in t.split("\n")} - {""}:
            texts[s, line].add(t)
            first[s, line] = min(i, first.get((s, line), i))
    gone = lambda i, s, line: len(texts[s, line]) > quality.MAX_LINE_DOCS and first[s, line] != i
    out = []
    for i, t, s in rows:
        ws = split(t)
        three = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        repeated = {p for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if three[g] > 1 for p in (k, k + 1, k + 2)}
        if len(ws) < quality.MIN_WORDS or 100 * len(repeated) > quality.MAX_REPEAT_PERCENT * len(ws):
            continue
        lines = t.split("\n")
        lost = sum(len(split(x)) for x in lines if norm(x) and gone(i, s, norm(x)))
        if 100 * (len(ws) - lost) >= quality.MIN_LEFT_PERCENT * len(ws):
            out.append((i, "\n".join(x for x in lines if not (norm(x) and gone(i, s, norm(x)))), s))
    return out


def classes(rows, rule):
    """{key: (shingles, smallest key that is linked to it by steps)} of (key, text) rows."""
    sets = {i: near_dup.shingles(t, rule.words) for i, t in rows if i is not None}
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= rule.percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}
