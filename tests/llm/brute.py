"""Brute-force results of the operators, in plain Python."""

import base64
import hashlib
import re
from collections import defaultdict

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WS = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k=5, lower=True):
    w = WS.findall((text or "").translate(LOW) if lower else text or "")
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, num=85, den=100):
    """(n, component, kept) of each id; null ids link with nothing."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in owners[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def repeats(docs, window=13):
    first, out = {}, {}
    for i, t in sorted(d for d in docs if d[0] is not None):
        w = WS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def overlaps(docs, items, window=10):
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n, known in windows.items():
            for j in range(len(w) - n + 1):
                if of := known.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= of
        found -= {None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def archive(pages):
    first, out = {}, {}
    for i, html in sorted(pages):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        f = first.setdefault(digest, i)
        out[i] = (len(data), digest, "response" if f == i else "revisit", None if f == i else f)
    return out
