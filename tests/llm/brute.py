"""Plain versions of the corpus operators, straight from their definitions."""

import hashlib
import math
import re
from itertools import combinations


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def suffix_dedup(docs, length=100):
    """docs: {doc_id: text}. -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        cut = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                cut[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = len([x for x in bytes(cut).split(b"\0") if x])
        out[i] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(docs, n=4, percent=85):
    """docs: {doc_id: text}. -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    links = [(a, b) for a, b in pairs if 100 * (k := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - k)]
    root = roots(docs, links)
    return {i: (len(sets[i]), root[i]) for i in docs}


def near_vectors(rows, threshold=0.93):
    """rows: [(vec_id, vector, label)]. -> {vec_id: (n_links, component_id)}"""

    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for (a, u, p), (b, v, q) in combinations(rows, 2):
        if p is not None and p == q and ok(u) and ok(v) and len(u) == len(v):
            c = sum(x * y for x, y in zip(u, v)) / math.sqrt(sum(x * x for x in u)) / math.sqrt(sum(x * x for x in v))
            if c >= threshold:
                links.append((a, b))
    root = roots([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in x for x in links), root[r[0]]) for r in rows}


def unit_dedup(rows, key, least):
    """rows: [(doc_id, text)] without nulls. -> {(doc_id, text): [(start, stop)]} of runs of repeated sentences with ``least`` words."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0], key[r[1]])):
        at, run, found = 0, None, []
        for unit in re.split(r"(?<=[.!?…][ \t])|(?<=[\n。！？])", text):
            words = re.sub("[A-Z]", lambda m: m[0].lower(), unit).split()
            if words:
                if tuple(words) in seen:
                    run = (run[0], at + len(unit), run[2] + len(words)) if run else (at, at + len(unit), len(words))
                else:
                    seen.add(tuple(words))
                    found.append(run)
                    run = None
            at += len(unit)
        out[i, text] = [r[:2] for r in [*found, run] if r and r[2] >= least]
    return out


def without(text, spans):
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, key, least):
    """rows: [(doc_id, text)]. -> {(doc_id, key): [(start, stop)]} of runs of ``least`` lines, or single passages, that start earlier."""
    seen, alone, out = set(), set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0], key[r[1]])):
        lines, cut = text.split("\n"), set()
        for k, line in enumerate(lines):
            if k + least <= len(lines):
                if (run := tuple(lines[k : k + least])) in seen:
                    cut |= set(range(k, k + least))
                seen.add(run)
            if line in alone and (len(line.split()) > 50 or len(line.encode()) >= 300):
                cut.add(k)
            alone.add(line)
        starts = [k for k in sorted(cut) if k - 1 not in cut]
        if cut:
            out[i, key[text]] = [(a, next(b for b in range(a, len(lines) + 1) if b not in cut)) for a in starts]
    return out


def contaminated(text, items, n=5, threshold=0.8):
    def cut(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    have = cut(text)
    return any(s and len(s & have) >= threshold * len(s) for s in map(cut, items))
