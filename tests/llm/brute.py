"""Plain, slow versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def exact(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[BLANK.sub("", d["text"] or "")].append(d)
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda d: (-len(d["text"] or ""), d["doc_id"] is None, d["doc_id"] or 0))
        keep = members[0]["doc_id"]
        out += [(d["doc_id"], keep, len(members), i == 0, sha(norm)) for i, d in enumerate(members)]
    return out


def repeats(docs, window=35):
    seen = Counter()
    split = [words(d["text"]) for d in docs]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in zip(docs, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d["doc_id"], len(w), sum(gone), sha(" ".join(kept))))
    return out


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for item in items:
        w = BENCH_WORD.findall((item["text"] or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            patterns[tuple(w[i : i + n])].add("" if item["item_id"] is None else str(item["item_id"]))
    sizes = {len(p) for p in patterns}
    out = []
    for d in docs:
        w = BENCH_WORD.findall((d["text"] or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := patterns.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((d["doc_id"], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near(docs, percent=75):
    sets = [shingles(d["text"]) for d in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for members in where.values():
        for k, i in enumerate(members):
            for j in members[k + 1 :]:
                common[i, j] += 1
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (i, j), c in common.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(sets[i]), low[root(i)], d["doc_id"] == low[root(i)]) for i, d in enumerate(docs)]


def base_scores(docs, trained):
    counts = Counter()
    for d in docs:
        if trained(d):
            counts.update([*words(d["text"], lower=True), None])
    total, types = sum(counts.values()), len(counts)
    out = {}
    for d in docs:
        tokens = [*words(d["text"], lower=True), None]
        out[d["doc_id"]] = (
            len(tokens),
            sum(counts[t] > 0 for t in tokens),
            total,
            sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens),
        )
    return out


def kneser_ney(texts):
    """log10 probability of a text under the bigram model trained on the texts; all words and pairs are kept."""
    split = [[*words(t, lower=True), None] for t in texts]
    types = {x for t in split for x in t}
    pairs = Counter(p for t in split for p in zip(["<begin>", *t], t))
    context, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        context[v] += c
        kinds[v][min(c, 3)] += 1
        before[w] += 1

    def cut(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5)
        return tuple(min(max(d, 0.0), k - 0.1) for k, d in enumerate(raw, 1))

    d, e = cut(pairs.values()), cut(before.values())
    total = sum(before.values())
    floor = sum(e[min(c, 3) - 1] for c in before.values()) / total / (len(types) + 1)
    lower = lambda w: (before[w] - e[min(before[w], 3) - 1] if before[w] else 0) / total + floor

    def p(v, w):
        left = sum(d[k - 1] * n for k, n in kinds[v].items()) / context[v] if context[v] else 1.0
        c = pairs[v, w]
        return ((c - d[min(c, 3) - 1]) / context[v] if c else 0.0) + left * lower(w)

    def score(text):
        seq = [*words(text, lower=True), None]
        return sum(math.log10(p(v, w)) for v, w in zip(["<begin>", *seq], seq))

    score.p, score.words = p, [*types, "<unseen>"]
    return score
