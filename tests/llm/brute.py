"""Plain restatements of the operators' rules, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(ids, linked):
    """Smallest reachable id of each position; ``linked(i, j)`` on positions."""
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(ids)):
        known = [ids[i]] if ids[i] is not None else []
        out.setdefault(top(i), []).extend(known)
    return [min(out[top(i)], default=None) for i in range(len(ids))]


def jaccard(rows):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= 80 * len(sets[i] | sets[j])
    comp = classes([d for d, _ in rows], linked)
    return sorted(((d, len(s), c if s else d) for (d, _), s, c in zip(rows, sets, comp)), key=str)


def removal(rows, length):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[p:p + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - length + 1):
            if d is not None and first[tuple(w[p:p + length])] < d:
                gone |= set(range(p, p + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)
