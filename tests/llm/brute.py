"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def removed_bytes(docs, length=50):
    """id -> (bytes, removed, spans, sha256); ``docs`` are (id, text), equal ids one document."""
    first = {}
    for key, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            part = data[i:i + length]
            first[part] = min(first.get(part, key), key)
    out = []
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < key:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(data, gone) if not m)
        out.append((key, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed_words(docs, window=20):
    first = {}
    for key, text in docs:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            part = tuple(words[i:i + window])
            first[part] = min(first.get(part, (key, i)), (key, i))
    out = []
    for key, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < (key, i):
                gone[i:i + window] = [True] * window
        kept = b" ".join(w for w, m in zip(words, gone) if not m)
        out.append((key, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingle_set(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if 0 < len(words) < k:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(k)]))


def groups(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(docs, k, percent):
    """id -> (set size, component)."""
    sets = {key: shingle_set(text, k) for key, text in docs}
    holders = defaultdict(list)
    links = []
    for key in sorted(sets):
        common = defaultdict(int)
        for shingle in sets[key]:
            for other in holders[shingle]:
                common[other] += 1
            holders[shingle].append(key)
        links += [(key, o) for o, n in common.items() if 100 * n >= percent * (len(sets[key]) + len(sets[o]) - n)]
    component = groups(links, sets)
    return {key: (len(sets[key]), component[key]) for key in sets}


def contained(docs, items, threshold=0.8, k=5):
    """(doc, item) pairs."""
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        return set(zip(*[words[i:] for i in range(k)]))

    parts = {item: shingles(text) for item, text in items}
    found = set()
    for key, text in docs:
        own = shingles(text)
        found |= {(key, item) for item, x in parts.items() if x and len(x & own) >= threshold * len(x) - 1e-9}
    return found
