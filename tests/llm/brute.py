"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

FOLD = {c: c + 32 for c in range(65, 91)}


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def marked_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def last(i):
    return (i is None, i or 0)


def word_dedup(docs, window=13):
    first, out = {}, []
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, last(i)), last(i))
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < last(i):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def byte_dedup(docs, span=200):
    texts = [(t or "").encode() for _, t in docs]
    many = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if many[t[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), sha(kept)))
    return out


def contamination(docs, items, window=13):
    phrases = defaultdict(set)
    for name, text in items:
        w = marked_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[k : k + window])].add(str(name))
    sizes = {len(p) for p in phrases}
    out = []
    for i, text in docs:
        w, hit, names = marked_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in phrases:
                    hit.update(range(k, k + size))
                    names |= phrases[p]
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near_duplicates(docs, threshold=0.8):
    """(id, copy_of, n_links, class_id) of rows with different ids."""
    first = {}
    for i, t in sorted(docs, key=lambda d: last(d[0])):
        first.setdefault(t or "", i)
    sets = {}
    for t, i in first.items():
        w = marked_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a].add(b)
                links[b].add(a)

    def group(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        return min(seen, key=last)

    return [(i, first[t or ""], len(links[first[t or ""]]), group(first[t or ""])) for i, t in docs]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KINDS = ("assign", "access", "hex")


def secrets(docs):
    out = []
    for i, text in docs:
        t = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in spans)
        listed = ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
        out.append((i, n[0], n[1], n[2], sha(listed)))
    return out


NOTICES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def notices(docs):
    out = []
    for i, text in docs:
        w = marked_words(text)
        hits = [
            (k, label) for p, label in NOTICES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()
        ]
        at = [k for k, _ in hits]
        labels = ",".join(sorted({label for _, label in hits}))
        out.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), labels))
    return out


def edits(docs):
    ordered = sorted(docs, key=lambda d: (-(1 << 63) if d[0] is None else d[0]), reverse=True)
    out = []
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        out.append((i, len(t), sha(t[: len(t) - third] + n[:third])))
    return out
