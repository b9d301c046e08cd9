"""Plain versions of the operators, one document after the other."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring_dedup(docs, n=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            k = tuple(w[p: p + n])
            if k in seen:
                gone[p: p + n] = [True] * n
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def suffix_dedup(docs, n=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p: p + n] in seen:
                gone[p: p + n] = b"\1" * n
            seen.add(b[p: p + n])
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


def decontaminated(docs, items, n=13):
    found = []
    for item, text in items:
        w = ALNUM.findall(lower(text))
        size = min(n, len(w))
        found += [(tuple(w[i: i + size]), item) for i in range(len(w) - size + 1) if size]
    by_window, sizes = {}, {len(w) for w, _ in found}
    for w, item in found:
        by_window.setdefault(w, set()).add(str(item))
    out = []
    for i, text in docs:
        w = ALNUM.findall(lower(text))
        hit, own = [False] * len(w), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if ids := by_window.get(tuple(w[p: p + size])):
                    hit[p: p + size] = [True] * size
                    own |= ids
        n_hit = sum(hit)
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((i, len(w), n_hit, len(own), sha, n_hit > 0 and 20 * n_hit >= len(w)))
    return sorted(out, key=str)


def fingerprint(text, size=3):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i: i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(ids, near):
    """Smallest id reachable of each row, with ``near(i, j)`` on rows."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def links(rows, threshold=0.93):
    """``vec_id: (n_links, component)`` of ``(vec_id, vector, label)`` rows."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]

    def near(i, j):
        a, b = units[i], units[j]
        return rows[i][2] is not None and rows[i][2] == rows[j][2] and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold

    n = [sum(near(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    return sorted(zip([r[0] for r in rows], n, roots([r[0] for r in rows], near)))


def mixed(docs, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess until none is above."""
    size, order = {}, sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    for _, s, t in docs:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(size.values())), list(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(cap * size[s])
            left -= target[s]
            free.remove(s)
    return size, target
