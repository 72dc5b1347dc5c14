"""Plain Python versions of the contracts, for small inputs."""

import re
import string
from collections import Counter

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines(rows):
    """doc_id -> (n_lines, n_dropped, kept)"""
    key = lambda line: line.strip(SPACE).translate(LOW)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        all_of = (t or "").split("\n")
        kept = [x for x in all_of if i is None or len(key(x)) < 10 or min(held[key(x)]) == i]
        out[i] = (len(all_of), len(all_of) - len(kept), "\n".join(kept))
    return out


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """doc_id -> (n_shingles, component_id)"""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(x), root(i)) for i, x in sets.items()}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contaminated(rows, items):
    """doc_id -> (n_words, n_hit, item ids)"""
    windows = {}
    for item, t in items:
        w = terms(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = {}
    for i, t in rows:
        w, hit, found = terms(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def near_items(rows, items, slop):
    """doc_id -> number of items of which a window's two rarest terms stand as in the window but for slop words"""
    df = {}
    for _, t in rows:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    out = {i: set() for i, _ in rows}
    for item, t in items:
        w = terms(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            ranked = sorted((df.get(x, 0), x, off) for off, x in enumerate(w[k : k + m]))
            if ranked[0][0]:
                (_, a, oa), (_, b, ob) = ranked[0], ranked[min(1, m - 1)]
                for i, text in rows:
                    d = terms(text)
                    pa, pb = ([p - o for p, x in enumerate(d) if x == term] for term, o in ((a, oa), (b, ob)))
                    if any(abs(p - q) <= slop for p in pa for q in pb):
                        out[i].add(str(item))
    return {i: len(x) for i, x in out.items()}


def passages(rows):
    """doc_id -> (n_words, n_removed, kept)"""
    all_of, owner = {i: words(t) for i, t in rows}, {}
    for i in sorted(all_of):
        for k in range(len(all_of[i]) - 12):
            owner.setdefault(tuple(all_of[i][k : k + 13]), i)
    out = {}
    for i, w in all_of.items():
        gone = {p for k in range(len(w) - 12) if owner[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def repeats(text):
    """(n_words, n_dup_lines, n_repeat_words)"""
    w = words(text)
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    found = {p for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    full = [x for x in (text or "").split("\n") if words(x)]
    return len(w), len(full) - len(set(full)), len(found)
