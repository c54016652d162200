"""Plain Python versions of the operators' contracts, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Classes:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def repeated_bytes(docs, length):
    """docs: (id, text) rows. id -> (bytes, removed, spans, sha of the rest), of the last row of an id."""
    rows = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + length] for _, b in rows for p in range(len(b) - length + 1))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(docs, length):
    """docs: (id, text), ids unique. id -> (words, removed, sha of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = [True] * length
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def near_documents(docs, words=5, percent=80):
    """id -> (set size, component)."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[p : p + words]) for p in range(max(1, len(w) - words + 1))) if w else frozenset()
    classes, holders = Classes(sets), defaultdict(list)
    for x in sorted(sets):
        for y, both in Counter(y for t in sets[x] for y in holders[t]).items():
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                classes.join(x, y)
        for t in sets[x]:
            holders[t].append(x)
    return {i: (len(s), classes.find(i)) for i, s in sets.items()}


def luhn(digits):
    return sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text):
    """Base spans: (start, order, kind, end), sorted."""
    out = []
    for order, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def ftrl(rows, bias, l1, orders, alpha=0.5, beta=1.0, l2=1.0):
    """(weights that are not zero, bias) of FTRL-proximal on (features, label) rows; each order is a generator of permutations."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for rng in orders:
        for i in rng.permutation(len(rows)):
            features, label = rows[i]
            own = {f: weight(f) for f in [*features, bias]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()))))) - label
            for f, w in own.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w
                n[f] += g * g
    found = {f: weight(f) for f in list(z)}
    return {f: w for f, w in found.items() if f != bias and w}, found.get(bias, 0.0)


def sha1_32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def all_runs(words, least=12):
    """(start, length, smallest period) of every run, sorted."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, 2 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, length, p) for (s, length), p in found.items())


def periodic(doc_id, text):
    """The row of op11, without the id."""
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), s, length, p, runs and 1000 * length // p or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def codes(rows, entries=256, rounds=4, parts=4):
    """rows: (id, vector, label), ids unique. id -> (code, error, label_error), and the sha of the codebooks."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    wide = len(kept[0][1]) // parts if kept else 0
    cut = lambda v: [v[p * wide : (p + 1) * wide] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in kept[:entries]), strict=True)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v)[p], book)[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else y for e, y in enumerate(book)]
    out, sums = {}, Counter()
    for i, v, label in kept:
        best = [near(x, book) for x, book in zip(cut(v), books, strict=True)]
        out[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label)
        sums[label] += out[i][1]
    text = ",".join(str(c) for book in books for y in book for c in y)
    return {i: (c, e, sums[label]) for i, (c, e, label) in out.items()}, hashlib.sha256(text.encode()).hexdigest()


SECRETS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]+)", 32),
)


def secrets(text):
    """Base spans: (start, order, kind, end), sorted."""
    return sorted((m.start(), order, kind, m.end()) for order, (kind, pattern, least) in enumerate(SECRETS) for m in re.finditer(pattern, text or "") if len(m[1]) >= least)
