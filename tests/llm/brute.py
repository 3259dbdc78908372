"""Plain Python twins of the corpus operators."""

import collections
import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(t))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def simhash(rows):
    """(doc_id, text) rows -> component id per row."""
    fps = [fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return fps, root, [least.get(r) for r in root]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t))


def windows(items, size=10):
    out = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out[tuple(w[k:k + n])].add(str(i) if i is not None else None)
    return out


def contamination(t, wins):
    w, items = words(t), set()
    hit = [0] * len(w)
    for n in {len(x) for x in wins}:
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in wins:
                items |= wins[tuple(w[k:k + n])]
                hit[k:k + n] = [1] * n
    items = sorted(items - {None})
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), sum(hit) > 0


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii(t):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, t or ""):
            x, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(v) > 255 for v in x.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def repeats(rows, length=50):
    """(doc_id, text) rows -> (n_bytes, n_removed, n_spans, sha) per row; a null id ranks last."""
    rank = [(d is None, d or 0) for d, _ in rows]
    first = {}
    for r, (_, t) in zip(rank, rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(r, first.get(s, r))
    out = []
    for r, (_, t) in zip(rank, rows):
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < r:
                m[i:i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m) if not y)
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(b), sum(m), runs, hashlib.sha256(kept).hexdigest()))
    return out


def grams(t, order=3):
    w = words(t)
    return len(w), [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def resample(rows, target, buckets=10_000, percent=5, min_words=20, seed=42):
    """(doc_id, text) rows -> (n_features, weight, score, rank) per row; ties go to the smaller id, null first."""
    got = [(n, [zlib.crc32(g.encode()) % buckets for g in f]) for n, f in (grams(t) for _, t in rows)]
    s, t = Counter(b for _, f in got for b in f), Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (d, _), (n, f) in zip(rows, got):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((i for i in range(len(rows)) if out[i][0] >= min_words),
                  key=lambda i: (-out[i][3], rows[i][0] is not None, rows[i][0] or 0, out[i][1:3]))
    rank = {i: k + 1 for k, i in enumerate(able[:percent * len(able) // 100])}
    return [(*r[1:], rank.get(i)) for i, r in enumerate(out)]


def vector_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, label, vector) rows without bad ones -> ({row: (codes, error, label_error)}, codebooks), in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = [[math.floor(scale * c) for c in v] for _, _, v in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w:p * w + w] for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(books[p])]
    got = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in g) for g in got]
    by_label = collections.Counter()
    for r, e in zip(rows, error):
        by_label[r[1]] += e
    return [(r[0], r[1], tuple(k for _, k in g), e, by_label[r[1]]) for r, g, e in zip(rows, got, error)], books


def windows_removed(texts, window=35):
    """(n_words, n_removed, kept words) per text."""
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    n = Counter(tuple(w[i:i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
