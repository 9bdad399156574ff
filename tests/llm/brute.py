"""Plain single-process versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOT_SPACE = re.compile("[^\x20\x09-\x0d]+")
ALPHANUMERIC = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def windows_hit(docs, items, width=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}."""
    index: dict[tuple, set] = {}
    for item, text in items:
        words = ALPHANUMERIC.findall((text or "").translate(LOWER))
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            index.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in index}
    out = {}
    for doc, text in docs:
        words, hit, found = ALPHANUMERIC.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if got := index.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def windows_removed(docs, width=20):
    """{doc_id: (n_words, n_removed, sha)}; ``docs`` of distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = NOT_SPACE.findall(text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out[doc] = (len(words), len(gone), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))
    return out


def lines_removed(docs, width=3):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out[doc] = (len(lines), len(gone), sha("\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def shingles(text, width):
    words = NOT_SPACE.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard_classes(docs, width, num, den):
    """{doc_id: (n, component)} by all pairs."""
    sets = [(doc, shingles(text, width)) for doc, text in docs]
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(sets, key=lambda x: len(x[1]))
    for i, (a, sa) in enumerate(ordered):
        for b, sb in ordered[i + 1 :]:
            if len(sa) * den < num * len(sb):
                break
            if sa:
                common = len(sa & sb)
                if den * common >= num * (len(sa) + len(sb) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {doc: (len(s), root(doc)) for doc, s in sets}


def best_split(name, cost):
    """The words of the cheapest split of ``name``, found by trying all of them from the front; ties to the longer last word."""
    best = {0: (0.0, [])}
    for end in range(1, len(name) + 1):
        best[end] = max(((best[a][0] + cost(name[a:end]), best[a][1] + [name[a:end]]) for a in range(end)), key=lambda x: (round(x[0], 9), len(x[1][-1])))
    return best[len(name)][1]


def urls_judged(pages, rules, texts, weight, trusted):
    """{page_id: (host, path, rule, verdict)}."""
    counts = {}
    for text in texts:
        for w in re.findall("[a-z]+", text.lower()):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values()) + sum(trusted.values())

    def cost(word):
        n = counts.get(word, 0) * np.exp(4.0 * (min(len(word), 3) - 3)) + trusted.get(word, 0)
        return np.log(n / total) if n else -np.log(total) - 2.5 * len(word)

    out = {}
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(LOWER)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        names = [x for x in re.split("[^a-z]+", host.rpartition(".")[0]) if x]
        tokens = [w for x in names for w in best_split(x, cost)] + re.findall("[a-z]+", path.lower())
        odds = sum(weight.get(t, 0.0) for t in tokens)
        out[page] = (host, path, rule and rule.text, rule.verdict if rule else "block" if odds > 0 else "allow")
    return out


def top_k(vectors, k=5, scale=256):
    """{(query, rank): (id, score)}; ``vectors``: (id, list)."""
    sound = [(i, np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, x in sound:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in sound if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores)}
    return out


def crc(x) -> int:
    return zlib.crc32(str(x).encode())
