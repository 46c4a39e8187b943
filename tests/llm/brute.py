"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c, c == d) for d, c in components(ids, linked).items()}


def one_edit(a, b):
    if a == b:
        return True
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + 1:] or a[p:] == b[p + 1:] or a[p + 1:] == b[p:]


def line_dedup(rows, min_chars=10):
    """Rows in corpus order."""
    seen, out = [], {}
    for d, text in rows:
        if d is None or text is None:
            out[d] = (text, 0)
            continue
        kept, n = [], 0
        for line in text.split("\n"):
            bare = line.strip(" \t\x0b\x0c\r")
            if len(bare) >= min_chars:
                again = any(abs(len(bare) - len(o)) < 2 and one_edit(bare, o) for o in seen)
                seen.append(bare)
                if again:
                    n += 1
                    continue
            kept.append(line)
        out[d] = ("\n".join(kept), n)
    return out


def repeats(rows, length=100):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(window)
        rest = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def leaks(rows, items, similarity=0.8):
    """(doc, item) with a window as long as the item whose weighted Dice reaches the similarity."""
    def weighted(w):
        return {tuple(w[i:i + 5]): sum(len(x.encode()) for x in w[i:i + 5]) for i in range(len(w) - 4)}
    found = set()
    for d, text in rows:
        w = words((text or "").lower())
        for i, item in items:
            v = words((item or "").lower())
            a = weighted(v)
            for start in range(max(1, len(w) - len(v) + 1)):
                b = weighted(w[start:start + len(v)])
                both = sum(a[s] for s in a.keys() & b.keys())
                if a and b and both and 2 * both >= similarity * (sum(a.values()) + sum(b.values())):
                    found.add((d, i))
    return found
