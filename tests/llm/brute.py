"""Plain Python twins of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remove_repeats(rows, window=20):
    """rows: (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w, gone = words(text), set()
        for s in range(len(w) - window + 1):
            if (k := tuple(w[s : s + window])) in seen:
                gone.update(range(s, s + window))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, n):
    w = words(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(rows, n, num, den):
    """rows: (doc_id, text), ids distinct. doc_id -> (n_shingles, component)."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids, posting = sorted(sets), {}
    for d in ids:
        common = {}
        for s in sets[d]:
            for e in posting.setdefault(s, []):
                common[e] = common.get(e, 0) + 1
            posting[s].append(d)
        for e, c in common.items():
            if den * c >= num * (len(sets[d]) + len(sets[e]) - c):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def masked(line):
    tokens = [t for t in re.split(r"[ \t\n\x0b\x0c\r]+", line) if t]
    return ["<*>" if re.search("[0-9]", t) else t for t in tokens]


def templates(kinds, depth=4, agree=0.8):
    """kinds: token tuples of one leaf. Each line's template: its leader's tokens, or its own."""
    digest = {k: hashlib.md5(" ".join(k).encode()).digest() for k in kinds}
    out, live = {k: k for k in kinds}, set(kinds)
    if not kinds or len(next(iter(kinds))) <= depth:
        return out

    def segments(k):
        apart = int(len(k) * (1 - agree) + 1e-9)
        cut = [depth + j * (len(k) - depth) // (apart + 1) for j in range(apart + 2)]
        return [(j, k[cut[j] : cut[j + 1]]) for j in range(apart + 1)]

    while True:
        shared = defaultdict(set)
        for k in live:
            for s in segments(k):
                shared[s].add(k)
        weight = {k: sum(len(shared[s]) for s in segments(k) if len(shared[s]) > 1) for k in live}
        rank = {k: (weight[k], digest[k]) for k in live}
        leads = defaultdict(set)
        for own in shared.values():
            leader = max(own, key=rank.get)
            for k in own - {leader}:
                if sum(a == b for a, b in zip(k, leader, strict=True)) >= agree * len(k) - 1e-9:
                    leads[k].add(leader)
        if not leads:
            return out
        settled = set()
        for k, those in leads.items():
            if free := [y for y in those if y not in leads]:
                out[k] = max(free, key=rank.get)
                settled |= {k, out[k]}
        live -= settled


def drop_recurring_lines(rows, depth=4, agree=0.8, min_docs=5, min_tokens=3):
    """rows: (doc_id, text), ids distinct. doc_id -> (text, lines, dropped)."""
    leaves, at = defaultdict(set), defaultdict(list)
    for d, text in rows:
        if text is None:
            continue
        for i, line in enumerate(text.split("\n")):
            t = tuple(masked(line))
            if t and len(t) >= min_tokens:
                leaves[len(t), t[:depth]].add(t)
                at[t].append((d, i))
    held, texts = defaultdict(list), dict(rows)
    for kinds in leaves.values():
        # a leaf whose lines stand in fewer places, or in one text alone, holds no recurring template
        places = [p for k in kinds for p in at[k]]
        if len(places) >= min_docs and len({texts[d] for d, _ in places}) > 1:
            for k, template in templates(kinds, depth, agree).items():
                held[template] += at[k]
    drop = defaultdict(set)
    for places in held.values():
        if len({texts[d] for d, _ in places}) >= min_docs:
            first = min(d for d, _ in places)
            for d, i in places:
                if texts[d] != texts[first]:
                    drop[d].add(i)
    out = {}
    for d, text in rows:
        lines = text.split("\n") if text is not None else []
        out[d] = (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in drop[d]), len(lines), len(drop[d]))
    return out


def exact_groups(rows):
    """rows: (doc_id, text). doc_id -> (keep_id, group_size, kept, digest)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[lowered(t)].append(d)
    return {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
