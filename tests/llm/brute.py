"""Plain-Python statements of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(t, low=True):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW) if low else t)


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """doc_id -> (n_shingles, component)."""
    sets = {i: shingles(t) for i, t in rows}
    boss = {i: i for i in sets}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    common = Counter()
    for ids in inv.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            boss[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, t) in enumerate(rows):
        nxt, k = rows[(n + 1) % len(rows)][1], len(t) // 4
        out[i] = (len(t), sha(t[:len(t) - k] + nxt[:k]))
    return out


def repeats(rows, width=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + width] for _, b in data for p in range(len(b) - width + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(out)


def targets(rows):
    """rows of (source, size) -> source -> (source_size, target)."""
    tot = Counter()
    for s, n in rows:
        tot[s] += n
    order = sorted((s for s in tot if s is not None)) + [None] * (None in tot)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, budget, out = set(order), 1.5 * sum(tot.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * tot[s]}
        if not full:
            out |= {s: weight[s] * level for s in left}
            break
        for s in full:
            out[s] = 2.0 * tot[s]
            budget -= out[s]
        left -= full
    return {s: (tot[s], out[s]) for s in order}


def windows_hit(docs, bench):
    """doc_id -> (n_words, n_hit, items)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    win = defaultdict(set)
    for item, t in bench:
        w = cut(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            win[tuple(w[i:i + k])].add(item)
    out = {}
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for k in {len(x) for x in win}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i:i + k])) in win:
                    hit.update(range(i, i + k))
                    items |= win[x]
        out[d] = (len(w), len(hit), sorted(str(x) for x in items if x is not None))
    return out
