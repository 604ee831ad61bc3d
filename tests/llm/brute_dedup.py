"""Near-duplicates by comparing all pairs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs, n, percent=80):
    """{doc_id: smallest doc_id reachable} of (doc_id, text) rows; the link rule is applied to all pairs."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = sorted((top(i), top(j)))
                up[j] = i
    return {i: top(i) for i, _ in docs}
