"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

BREAK = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in BREAK.split(text or "") if w]


def shingles(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id, kept) of each row; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t in rows]
    g = Groups({i for i, _ in sets if i is not None})
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and None not in (i, j) and 100 * len(s & t) >= 75 * len(s | t):
                g.join(i, j)
    return sorted(((i, len(s), None if i is None else g.find(i), i is None or g.find(i) == i) for i, s in sets), key=repr)


def repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(x and not y for x, y in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
    return sorted(out, key=repr)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_removals(rows):
    """{doc_id: numbers of removed lines}, for distinct ids."""
    import regex

    where = defaultdict(list)
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")
            if n:
                where[n].append((d, k))
    g = Groups(where)
    grams = {n: Counter(n[k : k + 4] for k in range(len(n) - 3)) for n in where}
    keys = sorted(where, key=len)
    for k, a in enumerate(keys):
        for b in reversed(keys[:k]):
            most = len(a) // 10
            if len(a) - len(b) > most:
                break
            # an edit harms four runs of four characters at most
            if sum((grams[a] & grams[b]).values()) >= len(a) - 3 - 4 * most and edit(a, b) <= most:
                g.join(a, b)
    groups = defaultdict(list)
    for n, o in where.items():
        groups[g.find(n)] += o
    out = {d: [] for d, _ in rows}
    for o in groups.values():
        for d, k in sorted(o)[1:]:
            out[d].append(k)
    return {d: sorted(x) for d, x in out.items()}


def contaminated(docs, items, percent=75):
    """{(doc_id, item_id): best similarity in millionths} by trying every window."""
    import regex

    def runs(text):
        w = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip(" ").split(" ")
        w = [x for x in w if x]
        return w

    out = {}
    for i, it in items:
        w = runs(it)
        if not w:
            continue
        width = min(5, len(w))
        item = Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
        n = sum(item.values())
        for d, t in docs:
            v = runs(t)
            s = [tuple(v[k : k + width]) for k in range(len(v) - width + 1)]
            for k in range(len(s)):
                win = Counter(s[k : k + n])
                both = sum((win & item).values())
                whole = n + sum(win.values()) - both
                if 100 * both >= percent * whole:
                    out[d, i] = max(out.get((d, i), 0), 1_000_000 * both // whole)
    return out


def backoff(rows, order, alpha=0.4):
    """[(doc_id, words, score)] by the definition."""
    import math

    docs = [(i, tuple((t or "").encode().lower().split())) for i, t in rows]
    grams = lambda w, n: Counter(w[k : k + n] for k in range(len(w) - n + 1))
    total = [None] + [sum((grams(w, n) for _, w in docs), Counter()) for n in range(1, order + 1)]
    size = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        own = [None] + [grams(w, n) for n in range(1, order + 1)]
        left = lambda g: total[len(g)][g] - own[len(g)][g]

        def score(k, n):
            if n == 1:
                return max(left(w[k : k + 1]), 0.5) / max(size - len(w), 1)
            g = w[k - n + 1 : k + 1]
            return left(g) / left(g[:-1]) if left(g) else alpha * score(k, n - 1)

        out.append((i, len(w), sum(math.log(score(k, min(order, k + 1))) for k in range(len(w)))))
    return out
