"""Plain versions of the operators, without Spark, numpy or hashing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def groups(nodes, links):
    head = {n: n for n in nodes}

    def top(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        head[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_duplicates(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    component = groups(sets, links)
    return {d: (len(sets[d]), component[d], component[d] == d) for d in sets}


def near_vectors(rows, threshold=0.93):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    use = [(i, v, k) for i, v, k in rows if ok(v) and k is not None]
    links = [(a, b) for a, v, k in use for b, w, m in use if a < b and k == m and cosine(v, w) >= threshold]
    count = Counter(x for link in links for x in link)
    component = groups([i for i, _, _ in rows], links)
    return {i: (count[i], component[i], component[i] == i) for i, _, _ in rows}


def top_k(rows, queries, k=5):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    out = set()
    for q, v in queries:
        if whole(v) is None:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(whole(v), whole(w), strict=True)), i) for i, w in rows if i != q and whole(w) is not None
        )
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def _discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def held(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def kneser_ney(rows):
    def tokens(t):
        return [*words(t), 0]

    learned = [tokens(t) for d, t in rows if held(d, 10)]
    one = Counter(w for t in learned for w in t)
    two = Counter(p for t in learned for p in zip([1, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    context, follow, before = Counter(), defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), c in two.items():
        context[u] += c
        follow[u][min(c, 3)] += 1
        before[w] += 1
    d, e, different = _discounts(list(two.values())), _discounts(list(before.values())), len(two)
    spare = sum(e[min(b, 3)] for b in before.values())

    def lower_order(w):
        if not different:
            return 1 / (v + 1)
        return max(before[w] - e[min(before[w], 3)], 0) / different + spare / different / (v + 1)

    def p(u, w):
        if not context[u]:
            return lower_order(w)
        c = two[u, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[k] * follow[u][k] for k in (1, 2, 3)) * lower_order(w)) / context[u]

    out = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = sum(math.log10(p(u, w)) for u, w in zip([1, *t[:-1]], t, strict=True))
        out.append((i, held(i, 10) == 0, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out, p, one


def recurring_lines(rows, fewest, leading=3, least=6, similar=0.6, share=0.2):
    """Dropped lines of each document: row number to a set of line numbers."""
    found = []
    for r, (d, t) in enumerate(rows):
        w = words(t)
        shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, line in enumerate((t or "").split("\n")):
            masked = ["<*>" if re.search("[0-9]", x) else x for x in words(line)]
            if d is not None and len(masked) >= least:
                found.append((r, k, d, frozenset(shingles), masked))
    leaves = defaultdict(list)
    for x in found:
        leaves[len(x[4]), tuple(x[4][:leading])].append(x)
    out = defaultdict(set)
    for members in leaves.values():
        documents = {x[2] for x in members}
        texts = Counter(s for _, s in {(x[2], x[3]) for x in members})
        if len(documents) < fewest or 2 * max(texts.values()) >= len(documents):
            continue
        places = Counter((i, w) for d, line in {(x[2], tuple(x[4])) for x in members} for i, w in enumerate(line))
        for r, k, _, _, line in members:
            constant = sum(w != "<*>" and places[i, w] >= max(fewest, share * len(documents)) for i, w in enumerate(line) if i >= leading)
            if constant >= similar * (len(line) - leading):
                out[r].add(k)
    return out
