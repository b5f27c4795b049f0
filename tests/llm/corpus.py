"""A small corpus with the hard cases, and brute-force versions of the operators."""

import collections
import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode())


def rows(seed=7, n=60):
    """(doc_id, text): prose, copies, near copies, shared passages, repeats, odd and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéüñ日") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(30)
    made = []
    for i in range(n):
        kind = i % 6
        text = prose(rng.randint(5, 120))
        if kind == 1 and made:
            text = rng.choice(made)[1] or ""
        elif kind == 2 and made:
            old = (rng.choice(made)[1] or "x").split(" ")
            old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        elif kind == 3:
            text = f"{prose(12)}\n{passage}\n{prose(9)}"
        elif kind == 4:
            text = (prose(7) + "\n") * rng.randint(2, 6)
        made.append((i, text))
    odd = [None, "", " \t\n\x0b\x0c\r ", "one", "one", "ONE", "a b c d", "ab" * 300, "x " * 200, prose(3000), passage, passage.upper(), "#*$%&|<> tail\n\n\ntail", "\x1c\x1d x\x85y\u00a0z\u2003 |"]
    return made + [(n + k, t) for k, t in enumerate(odd)] + [made[3], made[3], (None, "null id " + passage)]


def frame(spark, data=None):
    """With columns whose names clash with those that operators use inside."""
    data = rows() if data is None else data
    schema = "doc_id long, text string, g string, b int, label string, `row` int, ids string, n int, lang string"
    return spark.createDataFrame([(i, t, "g", 1, "l", 2, "i", 3, None) for i, t in data], schema)


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def substring(data, window=20):
    least = {}
    for i, t in data:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, (order(i), s)), (order(i), s))
    out = []
    for i, t in data:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < (order(i), s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix(data, window=50):
    least = {}
    for i, t in data:
        raw = (t or "").encode()
        for s in range(len(raw) - window + 1):
            least[raw[s : s + window]] = min(least.get(raw[s : s + window], order(i)), order(i))
    out = []
    for i, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if least[raw[s : s + window]] < order(i):
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    w = words(text.translate({}) if text else text)
    w = [x.translate(FOLD) for x in w]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def jaccard(data, percent=75):
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(data):
        least[find(a)].append(i)
    return [(i, len(sets[a]), min(least[find(a)], key=order)) for a, (i, _) in enumerate(data)]


def covered(w, n):
    """Which words lie in an n-word window that occurs twice or more."""
    count = collections.Counter(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    hit = [False] * len(w)
    for s in range(len(w) - n + 1):
        if count[tuple(w[s : s + n])] > 1:
            hit[s : s + n] = [True] * n
    return hit


def quality_kept(text):
    """The verdict of the quality rules."""
    w = words(text)
    size = [len(x.decode()) for x in w]
    if len(w) < 50 or 100 * sum(covered(w, 3)) > 50 * len(w):
        return False
    seen, dup = set(), 0
    for line in (text or "").encode().split(b"\n"):
        inside = WORD.findall(line)
        if inside and line in seen:
            dup += sum(len(x.decode()) for x in inside)
        seen.add(line)
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    return 100 * dup <= 20 * sum(size) and all(100 * sum(s for s, h in zip(size, covered(w, n), strict=True) if h) <= most * sum(size) for n, most in limits.items())


def same(found, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in found), key=key) == sorted((tuple(r) for r in expected), key=key)
