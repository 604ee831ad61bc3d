"""The language model of the scoring operator with plain dictionaries, for comparison."""

import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def score(docs, mu=20.0, prior=5.0, rare=8, share=1e-5, frequent=64, folds=5, held_out=1):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)} of {doc_id: text}."""
    out = {}
    split = {i: zlib.crc32(str(i).encode()) % folds == held_out for i in docs}
    tokens = {i: [*words(t), None] for i, t in docs.items()}
    one, two, three = Counter(), Counter(), Counter()
    start = "<start>"
    for i, ts in tokens.items():
        if not split[i]:
            one.update(ts)
            two.update(zip([start, *ts], ts))
            three.update(zip([start, start, *ts], [start, *ts], ts))
    total, distinct = sum(one.values()), len(one)
    before = dict(one) | {start: one[None]}
    pairs = dict(two) | {(start, start): one[None]}
    p = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def k(u):
        c = before.get(u, 0)
        return prior / (c + mu) if u == start or c >= max(frequent, share * total) else prior / (rare + mu)

    def log(v, u, w):
        above = three[v, u, w] + k(u) * (two[u, w] + mu * p(w))
        return math.log10(above / (pairs.get((v, u), 0) + k(u) * (before.get(u, 0) + mu)))

    for i, ts in tokens.items():
        base = sum(math.log10(p(w)) for w in ts)
        full = sum(map(log, [start, start, *ts], [start, *ts], ts))
        out[i] = (split[i], len(ts), sum(one[w] > 0 for w in ts), total, base, full)
    return out
