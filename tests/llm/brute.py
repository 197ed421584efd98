"""Brute-force versions of what the operators compute, from plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rule_base(text):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of words."""
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if counts[x] >= 2:
            covered |= {k, k + 1, k + 2}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def fingerprint(text, width=3):
    """Bit by bit."""
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) > width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def shingles(text, width=5):
    """Distinct shingles of a text, lower-cased in A-Z."""
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) > width else {tuple(w)} - {()}


def wide_fingerprint(text, width=5, parts=4):
    """Bit by bit, with the number of shingles: (list of 64-bit words, n)."""
    most = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & most
        return x ^ (x >> 31)

    hashes = set()
    for s in shingles(text, width):
        h = 0
        for w in s:
            h = mixed((h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) + 1) & most)
        hashes.add(h)
    out = []
    for k in range(parts):
        every = [mixed((h + k * 0x9E3779B97F4A7C15) & most) for h in hashes]
        out.append(sum((2 * sum(x >> b & 1 for x in every) > len(every)) << b for b in range(64)))
    return out, len(hashes)


def similar(a, b, radius=47, similarity=0.8):
    """Whether two wide fingerprints with their numbers of shingles link."""
    (x, m), (y, n) = a, b
    apart = [(i ^ j).bit_count() for i, j in zip(x, y, strict=True)]
    return sum(apart) <= radius and apart[0] <= radius // 2 and min(m, n) >= similarity * max(m, n)


def classes(n, linked):
    """Least index reachable, for each of n things."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def distance(a, b):
    """Levenshtein distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def same_line(a, b, edits=2, per=16):
    """Whether two lines are within the edits that the shorter one's length allows."""
    most = min(edits, len(a) // per, len(b) // per)
    return a == b or abs(len(a) - len(b)) <= most and most > 0 and distance(a, b) <= most


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Target by source, by repeated sharing of what is over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        whole = sum(weight[s] for s in free)
        out = fixed | {s: rest * weight[s] / whole for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        fixed |= {s: most * sizes[s] for s in over}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """Base spans and their digest."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    kinds = Counter(x[3] for x in out)
    return kinds, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in out).encode()).hexdigest()


def groups(pairs):
    """Values by key."""
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


class Gam:
    """Cyclic boosting of shallow trees over bins, then over pairs, by loops over rows."""

    def __init__(self, x, y, bins, coarse_bins, rounds, n_pairs, rate=0.1, lam=2.0):
        n, d = len(y), len(x[0])
        self.edges = [self.cuts([r[j] for r in x], bins) for j in range(d)]
        self.coarse = [self.cuts([r[j] for r in x], coarse_bins) for j in range(d)]
        share = (sum(y) + 1) / (n + 2)
        self.intercept = math.log(share / (1 - share))
        self.tables, self.pairs = [[0.0] * (len(e) + 1) for e in self.edges], []
        value = lambda s, lo, hi: sum(s[k][0] for k in range(lo, hi)) / (sum(s[k][1] for k in range(lo, hi)) + lam)
        gain = lambda cells: sum(g for g, _ in cells) ** 2 / (sum(h for _, h in cells) + lam)
        for _ in range(rounds):
            for j in range(d):
                sums = [[0.0, 0.0] for _ in self.tables[j]]
                for r, t in zip(x, y, strict=True):
                    p = self.score(r)
                    cell = sums[self.bin(self.edges[j], r[j])]
                    cell[0] += t - p
                    cell[1] += p * (1 - p)
                ends = [0, len(sums)]
                for _ in range(3):
                    best, where = 1e-9, None
                    for a, b in zip(ends, ends[1:], strict=False):
                        for m in range(a + 1, b):
                            g = gain(sums[a:m]) + gain(sums[m:b]) - gain(sums[a:b])
                            if g > best + 1e-12:
                                best, where = g, m
                    if where is not None:
                        ends = sorted([*ends, where])
                for a, b in zip(ends, ends[1:], strict=False):
                    for k in range(a, b):
                        self.tables[j][k] += rate * value(sums, a, b)

        def split(i, j):
            cells = [[[0.0, 0.0] for _ in range(len(self.coarse[j]) + 1)] for _ in range(len(self.coarse[i]) + 1)]
            for r, t in zip(x, y, strict=True):
                p = self.score(r)
                cell = cells[self.bin(self.coarse[i], r[i])][self.bin(self.coarse[j], r[j])]
                cell[0] += t - p
                cell[1] += p * (1 - p)
            whole = gain([c for row in cells for c in row])
            best, out = 0.0, None
            for a in range(len(cells) - 1):
                for b in range(len(cells[0]) - 1):
                    parts = defaultdict(list)
                    for u, row in enumerate(cells):
                        for v, c in enumerate(row):
                            parts[u > a, v > b].append(c)
                    g = sum(map(gain, parts.values())) - whole
                    if g > best + 1e-12:
                        best = g
                        leaf = {k: sum(c[0] for c in p) / (sum(c[1] for c in p) + lam) for k, p in parts.items()}
                        out = [[leaf[u > a, v > b] for v in range(len(cells[0]))] for u in range(len(cells))]
            return best, out

        found = sorted((-split(i, j)[0], i, j) for i in range(d) for j in range(i))
        self.pairs = [(i, j, [[0.0] * (len(self.coarse[j]) + 1) for _ in range(len(self.coarse[i]) + 1)]) for g, i, j in found[:n_pairs] if g < 0]
        for _ in range(rounds // 4):
            for i, j, table in self.pairs:
                step = split(i, j)[1]
                if step:
                    for u, row in enumerate(step):
                        for v, leaf in enumerate(row):
                            table[u][v] += rate * leaf

    @staticmethod
    def cuts(values, k):
        values, out = sorted(values), []
        for q in range(1, k):
            at = q / k * (len(values) - 1)
            low = int(at)
            out.append(values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low]))
        return sorted(set(out))

    @staticmethod
    def bin(edges, v):
        return sum(e <= v for e in edges)

    def score(self, r):
        f = self.intercept + sum(t[self.bin(e, v)] for t, e, v in zip(self.tables, self.edges, r, strict=True))
        f += sum(t[self.bin(self.coarse[i], r[i])][self.bin(self.coarse[j], r[j])] for i, j, t in self.pairs)
        return 1 / (1 + math.exp(-f))
