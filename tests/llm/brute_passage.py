"""Passage dedup line by line, in plain Python."""

import hashlib
import re
from collections import defaultdict

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ranges(lines):
    """(start, end), from 1: content-defined chunks of two lines or more, and shortest windows of two lines with words or more and over 50 words."""
    digests = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    out, start = set(), 1
    for i in range(1, len(lines) + 1):
        rolled = hashlib.md5((digests[max(i - 2, 0)] + digests[i - 1]).encode()).hexdigest()
        if int(rolled[:6], 16) % 3 == 0 or i == len(lines):
            if i > start:
                out.add((start, i))
            start = i + 1
    full = [(i, len(_WORD.findall(x))) for i, x in enumerate(lines, 1) if _WORD.search(x)]
    for k in range(len(full)):
        for step in (1, -1):
            words, at = full[k][1], k
            while 0 <= at + step < len(full) and (words <= 50 or at == k):
                at += step
                words += full[at][1]
            if at != k and words > 50:
                out.add((min(full[k][0], full[at][0]), max(full[k][0], full[at][0])))
    return out


def passage_dedup(docs):
    """docs: [(doc_id, text)]; the texts that are left, in order."""
    places = defaultdict(list)
    for n, (doc, text) in enumerate(docs):
        if text is not None:
            lines = text.split("\n")
            for start, end in ranges(lines):
                places["\n".join(lines[start - 1 : end])].append((doc, start, end, n))
    gone = defaultdict(set)
    for rows in places.values():
        known = [r[:2] for r in rows if r[0] is not None]
        if len(rows) > 1 and known:
            first = min(known)
            for doc, start, end, n in rows:
                if doc is not None and (doc, start) != first:
                    first_end = first[1] + end - start
                    gone[n].update(range(first_end + 1 if doc == first[0] and start <= first_end else start, end + 1))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone[n]) for n, (_, t) in enumerate(docs)]
