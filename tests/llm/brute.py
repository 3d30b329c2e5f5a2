"""Plain versions of the operators' contracts, for comparison on small tables."""

import hashlib
import re
from collections import Counter
from math import log10
from zlib import crc32

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, k=3):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, most=3):
    """rows: (doc_id, text) -> sorted (doc_id, hex, component)."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted(((d, f"{prints[i]:016x}", min(groups[find(i)]) if find(i) in groups else None) for i, (d, _) in enumerate(rows)), key=str)


def substrings(rows, window=35):
    every = Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        every.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if every[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def quality(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep))
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def language_model(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base score)."""
    toks = [[*words(lowered(t)), None] for _, t in rows]
    held = [crc32(str(d).encode() if d is not None else b"") % 10 == 0 for d, _ in rows]
    c = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[x] > 0 for x in t), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for (d, _), t, h in zip(rows, toks, held, strict=True)]


def secrets(text):
    """n_assign, n_access, n_hex, digest of the base spans."""
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*(sum(k == x for _, k, _ in found) for x in range(3)), hashlib.sha256(line.encode()).hexdigest())


def edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
