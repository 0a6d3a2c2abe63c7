"""Plain versions of the operators' contracts for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def repeats(rows, k):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[s : s + k]) for _, w in words for s in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if count[tuple(w[s : s + k])] > 1:
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(ids, links)
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in ids)


def line_counts(text):
    w = WORD.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    count, inside = Counter(windows), set()
    for k, g in enumerate(windows):
        if count[g] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def water_fill(sizes, weights, share, most):
    """Targets by dealing the budget by weight and resharing what is above the caps, again and again."""
    budget = share * sum(sizes.values())
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while budget > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        over = 0.0
        for s in sorted(open_, key=str):
            target[s] += budget * weights[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        budget = over
    return target


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def pivotal(rows, targets, leaf, fanout, seed):
    """Copies of each (unit, nth, size, source) by sequential pivotal rounding over a tree, on the draws of the operator."""
    import math
    import struct

    import xxhash

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64(struct.pack("<q" if isinstance(v, int) else "<i", v if isinstance(v, int) else v[0]), seed=h).intdigest()
        return h

    sizes, counts = defaultdict(int), Counter()
    for _, _, size, source in rows:
        sizes[source] += size
        counts[source] += 1
    out, now = {}, defaultdict(list)
    for unit, nth, size, source in rows:
        share = targets[source] / sizes[source] if sizes[source] else 0.0
        whole = math.floor(share)
        out[unit, nth, source] = whole
        if size > 0 and share > whole:
            h = hashed(unit, nth, size, (seed,))
            now[source, (h - (h >> 63 << 64)) % math.ceil(counts[source] / leaf)].append([(unit, nth), size, share - whole])
    nodes = math.ceil(max(counts.values()) / leaf)
    while True:
        left = defaultdict(list)
        for (source, node), units in now.items():
            units.sort(key=lambda u: (u[1], u[0], u[2]), reverse=True)
            i = units[0]
            for j in units[1:]:
                a, b = min((1 - i[2]) * i[1], j[2] * j[1]), min((1 - j[2]) * j[1], i[2] * i[1])
                u = (hashed(*i[0], *j[0], (seed,)) >> 11) / 2.0**53
                if u * (a + b) < b:
                    done, carry = ((i, 1), [j[0], j[1], max(j[2] - a / j[1], 0.0)]) if (1 - i[2]) * i[1] <= j[2] * j[1] else ((j, 0), [i[0], i[1], min(i[2] + a / i[1], 1.0)])
                else:
                    done, carry = ((j, 1), [i[0], i[1], max(i[2] - b / i[1], 0.0)]) if (1 - j[2]) * j[1] <= i[2] * i[1] else ((i, 0), [j[0], j[1], min(j[2] + b / j[1], 1.0)])
                out[(*done[0][0], source)] += done[1]
                i = carry
            left[source, node // fanout].append(i)
            last = (source, i)
            if nodes <= 1:
                out[(*last[1][0], source)] += math.floor(i[2] + 0.5)
        if nodes <= 1:
            return out
        nodes, now = -(-nodes // fanout), left


def line_first(text):
    """(cleaned, share of characters lost) of a text, line by line; the rules spelled out anew."""
    space = " \t\n\x0b\x0c\r"

    def solid(x):
        return sum(c not in space for c in x)

    def bad(line):
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", line) if w]
        bars = [w for w in words if w in ("|", "»", "›", "•", "·")]
        if len(bars) >= 3 and len(bars) * 4 >= len(words):
            return True
        phrases = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "accept cookies", "accept all cookies", "enable javascript", "click here", "follow us", "share this", "read more", "skip to content", "subscribe to", "login to", "log in to", "copyright (c)", "copyright ©"]
        phrases += [f"sign {a} {b}" for a in ("in", "up") for b in ("to", "for", "now")]
        low = line.lower()
        if len(line) <= 200 and (any(p in low for p in phrases) or re.search("copyright [0-9]{4}", low)):
            return True
        if 10 * sum(line.count(c) for c in "#*$%&|<>") > solid(line):
            return True
        if 3 * sum(w.endswith("!!") for w in words) > len(words):
            return True
        marked = any(w.rstrip("\"'”’»)]")[-1:] in set(".!?…:;,。！？।؟،።") for w in words)
        return len(words) >= 12 and not marked and not any("\u0e00" <= c <= "\u0e7f" for c in line)

    text = text or ""
    cleaned = "\n".join(x for x in text.split("\n") if not bad(x))
    return cleaned, solid(text) - solid(cleaned)
