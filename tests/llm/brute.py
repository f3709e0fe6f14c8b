"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_counts(text):
    w = words(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def substrings(rows, width=35):
    """[(id, text)] to the sorted (id, n_words, n_removed, sha256) of every row."""
    all_words = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in all_words for k in range(len(w) - width + 1))
    out = []
    for i, w in all_words:
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def components(rows, percent=75):
    """[(id, text)] with distinct ids to {id: (set size, smallest linked id)}."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in where[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            where[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def targets(sizes):
    """[(source, size)] to {source: target}: shares by weight, stopped at twice the size, reshared."""
    per = defaultdict(int)
    for s, n in sizes:
        per[s] += n
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(per.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * per[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: 2.0 * per[s] for s in full}
        left -= sum(2 * per[s] for s in full)
        open_ -= full
    return out


def warc(rows):
    """[(page_id, html)] to sorted (page_id, bytes, digest, type, refers_to)."""
    first, out = {}, []
    for i, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i)
    for i, h in rows:
        b = (h or "").encode()
        own = first[b] == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else first[b]))
    return sorted(out)


def top5(rows):
    """{vec_id: vector} to the (query, rank, id, score) rows."""
    import math

    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in (q for q in v if q % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], v[d], strict=True)), d) for d in v if d != q)[:5]
        out += [(q, k + 1, d, -s) for k, (s, d) in enumerate(scored)]
    return sorted(out)


def divergence(rows, min_words=40, max_class=0.30, max_words=0.35, chance=3.0, expected=8.0, top=20):
    """[(id, text, lang)] to {id: (class distance, word distance, kept)}."""
    import math

    def classes(text):
        groups = ("abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>")
        out = [sum(c in g for c in text) for g in groups]
        return [*out, len(text) - sum(out)]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))

    sums, counts = defaultdict(lambda: [0] * 7), defaultdict(Counter)
    for _, text, lang in rows:
        sums[lang] = [a + b for a, b in zip(sums[lang], classes(text or ""), strict=True)]
        counts[lang].update(words((text or "").lower()))
    refs = {}
    for lang in sums:
        best = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:top]
        refs[lang] = (sums[lang], [w for w, _ in best], [n for _, n in best] + [counts[lang].total() - sum(n for _, n in best)])
    pooled = [sum(r[0][k] for r in refs.values()) for k in range(7)], {w for r in refs.values() for w in r[1]}, [sum(sum(r[2][:-1]) for r in refs.values()), sum(r[2][-1] for r in refs.values())]
    out = {}
    for i, text, lang in rows:
        ref, common, shares = pooled if lang is None else refs[lang]
        own = words((text or "").lower())
        hits = [sum(w in common for w in own)] if lang is None else [own.count(w) for w in common]
        dc, dw = distance(classes(text or ""), ref), distance([*hits, len(own) - sum(hits)], shares)
        n, free = len(own), len(shares) - 1
        bad = base_counts(text)[5]
        odd = False
        if n >= min_words:
            worst = distance([0] * free + [1], shares)
            far = dw is not None and dw**2 > max_words * worst**2 + (free + chance * math.sqrt(2 * free)) / (8 * math.log(2) * n)
            odd = dc > max_class or far or (sum(hits) == 0 and n * (1 - shares[-1] / sum(shares)) >= expected)
        out[i] = (dc, dw, not bad and not odd)
    return out


def trigram_model(rows, langs):
    """[(text, lang)] to {gram: log probabilities}, floor and script use, all grams kept."""
    import math

    grams, letters = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            b = f"^{w}$"
            grams[lang].update(b[k : k + 3] for k in range(len(b) - 2))
            letters[lang].update(w)
    kinds = set().union(*grams.values())
    value = lambda k, g: math.log((grams[k][g] + 0.5) / (grams[k].total() + 0.5 * (1 + len(kinds))))
    return {g: tuple(value(k, g) for k in langs) for g in kinds}, tuple(value(k, "none") for k in langs), letters


def best_language_path(scores, penalty):
    """The best path over rows of scores by plain dynamic programming, and what it is worth."""
    best = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((b - (penalty if p[-1] != k else 0) + x, [*p, k]) for b, p in best), key=lambda t: t[0]) for k, x in enumerate(row)]
    return max(best, key=lambda t: t[0])


def tilt(sizes, target, cap=2.0):
    """The rate of each size whose tokens meet the target: min(cap, exp(lam * size)), lam by bisection."""
    import math

    used = lambda lam: sum(s * min(cap, math.exp(min(50.0, lam * s))) for s in sizes)
    lo, hi = -50.0, math.log(cap) / min(s for s in sizes if s)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if used(mid) < target else (lo, mid)
    return lambda s: min(cap, math.exp(min(50.0, hi * s)))


def codes(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, vector, label)] with sound vectors to {vec_id: (code, error, label_error, codebooks_sha256)}."""
    import math

    width = max(len(v) for _, v, _ in rows)
    step = -(-width // parts)
    whole = sorted((i, [math.floor(256 * float(c)) for c in v] + [0] * (parts * step - len(v)), label) for i, v, label in rows)
    cut = [[v[k * step : (k + 1) * step] for k in range(parts)] for _, v, _ in whole]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    nearest = lambda k, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(k, c[k])[1]].append(c[k])
            new.append([[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[k])])
        books = new
    found = [[nearest(k, c[k]) for k in range(parts)] for c in cut]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(whole, errors, strict=True):
        by_label[label] += e
    told = sha(",".join(str(x) for book in books for e in book for x in e))
    return {i: ("".join(f"{j:02x}" for _, j in f), e, by_label[label], told) for (i, _, label), f, e in zip(whole, found, errors, strict=True)}


def token_file(rows, tokenizer, end_id=2):
    """[(doc_id, text)] with distinct ids to {doc_id: (start, n_tokens, ids_crc32, ids)}, a null id first."""
    import struct
    import zlib

    out, at = {}, 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        at += len(ids)
    return out


def manifest(rows, tampered):
    """[(doc_id, text, lang, source, n_chars)] to the sorted rows of proofs."""
    hashed = lambda *a: sha("".join(a))
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: hashed(*map(told, (r[0], r[3], r[2], r[4], text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([hashed(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            at = k // 8 * 8
            out.append((level[at:k], level[k + 1 : at + 8]))
            k //= 8
        return out

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs]
    top, out = tree([t[-1][0] for t in trees]), []
    for n, lang in enumerate(langs):
        for k, (*_, own, r) in enumerate(sorted(by_lang[lang], key=lambda x: x[:3])):
            steps = path(trees[n], k) + path(top, n)
            h = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if tampered(r[0]) and r[1] is not None else r[1])
            for left, right in steps:
                h = hashed(*left, h, *right)
            out.append((r[0], own, trees[n][-1][0], top[-1][0], hashed(*(x for s in steps for part in s for x in part)), h, h == top[-1][0]))
    return sorted(out, key=repr)
