"""Plain Python versions of the contracts, written from their texts."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash_groups(rows):
    """A name of its component for each row."""
    return simhash(rows, True)


def simhash(rows, groups=False):
    """rows: (doc_id, text) -> [(doc_id, fingerprint, component)]."""
    fps = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    if groups:
        return [find(i) for i in range(len(rows))]
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spans.sort()
    counts = Counter(k for *_, k in spans)
    return counts["assign"], counts["access"], counts["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))


def lines(rows):
    """-> [(doc_id, n_lines, n_dropped, sha)]."""
    def key(x):
        k = x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
        return k if len(k) >= 40 else None

    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                held[key(x)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) and len(held[key(x)]) >= 5 and max(held[key(x)]) != (-1 if d is None else d))]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def repeats(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def pages(rows):
    """rows: (page_id, html) -> [(page_id, bytes, sha1, type, refers_to)]."""
    data = [(p, (h or "").encode()) for p, h in rows]
    most = {}
    for p, b in data:
        if len(b) >= 1000:
            most[b] = max(most.get(b, -1), -1 if p is None else p)
    out = []
    for p, b in data:
        first = most.get(b, -1)
        revisit = len(b) >= 1000 and (-1 if p is None else p) < first
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out
