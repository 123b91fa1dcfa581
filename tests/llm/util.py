"""Plain Python versions of what the operators compute."""

import hashlib
import re
import zlib

ASCII = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(ASCII)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def shingles(text, width):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_duplicates(rows, width):
    """(doc_id, n, component, kept) of (doc_id, text) rows."""
    sets = [shingles(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = components(len(rows), links)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None] if sets[i] else [d]
        c = min((x for x in ids if x is not None), default=None)
        out.append((d, len(sets[i]), c, d == c if d is not None else c is None))
    return out


def repeats(texts, window):
    """(words, removed, kept text) of each text."""
    all_words = [words(t) for t in texts]
    count = {}
    for w in all_words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def leaks(texts, items, window):
    """(words, hits, sorted ids) of each text. items: (id, text)."""

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    wanted = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(k)
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


def part(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
