"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 1 << 63


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def runs(flags):
    return [m.span() for m in re.finditer("1+", "".join("1" if f else "0" for f in flags))]


def op1(docs, n=50):
    least = {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            least[w] = min(least.get(w, LAST), LAST if i is None else i)
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < (LAST if i is None else i):
                gone[p : p + n] = [True] * n
        out.append((i, len(b), sum(gone), len(runs(gone)), sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def fingerprint(text, words=3):
    w = SPACED.findall(lower(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def op4(docs):
    fps = [fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    least = {}
    for c, (i, _) in zip(comp, docs):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(docs, fps, comp)]


def op8(docs):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum((x * 2 - 9 * (x > 4)) if k % 2 else x for k, x in enumerate(map(int, reversed(d))))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for i, text in docs:
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if good(k, m[0])] if k != "email" or len(text or "") < 40000 else [] for k, p in kinds.items()}
        out.append((i, *map(len, found.values()), sha(",".join(x for v in found.values() for x in v))))
    return out


def op9(docs, items, n=10):
    windows = defaultdict(set)
    for name, text in items:
        w = PLAIN.findall(lower(text))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w = PLAIN.findall(lower(text))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def held(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def katz(docs, top=5):
    """Score of every text by the recursive definition, and P(w | h) itself."""
    sequences = [[*SPACED.findall(lower(t)), "</s>"] for _, t in docs]
    one, two = Counter(), Counter()
    for (i, _), seq in zip(docs, sequences):
        if not held(i, 5, 1):
            one.update(seq)
            two.update(zip(["<s>", *seq], seq))

    def factors(counts):
        n = Counter(counts.values())
        taken = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, top + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - taken) / (1 - taken) if n[r] and taken != 1 else 0.0
            out[r] = d if 0 < d <= 1 else (r - 0.5) / r
        return out

    f1, f2 = factors(one), factors(two)
    keep = lambda f, c: f.get(c, 1.0) * c
    total = sum(one.values())
    mass = sum(keep(f1, c) for c in one.values())
    base = total if mass < total else total + 1
    p1 = lambda w: (keep(f1, one[w]) / base if w in one else 1 - mass / base) if total else 1.0
    after = defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))

    def p(h, w):
        if h not in after:
            return p1(w)
        c_h, kept = sum(c for _, c in after[h]), sum(keep(f2, c) for _, c in after[h])
        b = c_h if kept < c_h else c_h + 1
        if (h, w) in two:
            return keep(f2, two[h, w]) / b
        return (1 - kept / b) / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    out = []
    for (i, _), seq in zip(docs, sequences):
        plain = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in seq)
        out.append((i, held(i, 5, 1), len(seq), sum(one[w] > 0 for w in seq), total, plain, sum(math.log10(p(h, w)) for h, w in zip(["<s>", *seq], seq))))
    return out, p, one, after
