"""Plain versions of the operators for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def bag(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def near_classes(rows, similarity=0.8):
    """Index of each row's class, by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    bags = {t: bag(t) for t in texts}
    sizes = {t: sum(b.values()) for t, b in bags.items()}
    where = defaultdict(set)
    for t, b in bags.items():
        for s in b:
            where[s].add(t)
    for a in texts:
        for b in {t for s in bags[a] for t in where[s] if t > a}:
            shared = sum(min(n, bags[b][s]) for s, n in bags[a].items() if s in bags[b])
            if shared >= similarity * (sizes[a] + sizes[b] - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for i, t in rows:
        c = find(t or "")
        if i is not None and (c not in least or i < least[c]):
            least[c] = i
    return [(i, least.get(find(t or ""))) for i, t in rows]


def kept_words(texts, n=35):
    seen = Counter()
    all_words = [words(t) for t in texts]
    for w in all_words:
        for s in range(len(w) - n + 1):
            seen[tuple(w[s : s + n])] += 1
    out = []
    for w in all_words:
        keep = [True] * len(w)
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s : s + n])] > 1:
                keep[s : s + n] = [False] * n
        out.append((len(w), keep.count(False), [x for x, k in zip(w, keep, strict=True) if k]))
    return out


def quality_numbers(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def line_verdicts(rows, p):
    """kept for (doc_id, text, host) rows."""
    held, hosts = defaultdict(set), defaultdict(set)

    def lines(text):
        return [x for x in (tuple(words(line.translate(LOWER))) for line in (text or "").split("\n")) if x]

    for _, text, host in rows:
        hosts[host].add(text or "")
        for x in lines(text):
            held[host, x].add(text or "")
    out = []
    for i, text, host in rows:
        n, *_, repeats = quality_numbers(text)
        common = lambda x, h=host: len(held[h, x]) > p.line_docs and 1000 * len(held[h, x]) > p.line_permille * len(hosts[h])
        gone = sum(len(x) for x in lines(text) if common(x))
        failed = n < p.min_words or 100 * repeats > p.repeat_percent * n
        out.append((i, n - gone, failed, not failed and not (n - gone < p.left_words and 100 * (n - gone) < p.left_percent * n)))
    return out


def best_two_fit(counts, size):
    """Bins one at a time: the longest that fit, then the smallest for the two that fit its gap most tightly."""
    left = Counter({n: c for n, c in counts.items() if c})
    bins = []
    while left:
        bin_, gap = [], size
        while any(n <= gap for n in left):
            n = max(n for n in left if n <= gap)
            bin_.append(n)
            gap -= n
            left -= Counter([n])
        if gap:
            small = bin_[-1]
            free = left + Counter([small])
            pairs = [(a + b, -b) for a in free for b in free if b <= a < small + gap and (a != b or free[a] > 1) and small < a + b <= small + gap]
            if pairs:
                total, b = max(pairs)
                bin_[-1:] = [total + b, -b]
                left = free - Counter(bin_[-2:])
        bins.append(bin_)
    return bins


def nearest_pages(rows):
    """{rid: other} of (rid, host, path): the neighbour in order whose path begins alike the longest, the one before if both do."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    alike = lambda a, b: len(a) and next((k for k in range(len(a)) if a[: k + 1] != b[: k + 1]), len(a))
    out = {}
    for k, (rid, host, path) in enumerate(rows):
        near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][1] == host]
        if near:
            out[rid] = max(near, key=lambda r: alike(path, r[2]))[0]
    return out


def kneser_ney(taught, order=3):
    """A function of a text: log10 p of each of its words and its end, by the plain formulas of the interpolated modified model."""
    padded = lambda text: ["<s>"] * (order - 1) + words(text) + ["</s>"]
    counts = [Counter() for _ in range(order + 1)]
    for text in taught:
        w = padded(text)
        for i in range(order - 1, len(w)):
            counts[order][tuple(w[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i - 0.01) for i in (1, 2, 3)]

    off = [None, *[discounts(c) for c in counts[1:]]]
    totals = [None] + [defaultdict(lambda: [0, 0.0]) for _ in range(order)]
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            t = totals[k][gram[:-1]]
            t[0] += c
            t[1] += off[k][min(c, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        lower = p(gram[1:])
        total, taken = totals[len(gram)].get(gram[:-1], (0, 0.0))
        if not total:
            return lower
        c = counts[len(gram)][gram]
        return (c - (off[len(gram)][min(c, 3) - 1] if c else 0) + taken * lower) / total

    def score(text):
        w = padded(text)
        return [math.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w))]

    return score


LOWER = {c: c + 32 for c in range(65, 91)}


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base)."""
    docs = [(i, [*words((t or "").translate(LOWER)), "\0"]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter()
    for i, w in docs:
        if not held[i]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in docs]


def tree_scores(rows, p):
    """{doc_id: log10 probability} by a plain suffix tree over bytes, counts of words, and single rare words as contexts."""
    docs = [(i, words((t or "").translate(LOWER))) for i, t in rows]
    train = [w for i, w in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    pad = b"\n" * p.depth

    def spelled(w):
        return [*((x + " ").encode() for x in w), b"\n"]

    after = defaultdict(Counter)
    places = 0
    for w in train:
        data = pad + b"".join(spelled(w))
        for at in range(p.depth, len(data)):
            places += 1
            for d in range(p.depth + 1):
                after[data[at - d : at]][data[at]] += 1
    known = {c: n for c, n in after.items() if sum(n.values()) >= p.least * places}
    kept = {b""} & known.keys()
    for c in sorted(known, key=len, reverse=True):
        n, up = known[c], known[c[1:]]
        total, above = sum(n.values()), sum(up.values())
        if c and (c in kept or sum(k * math.log(k / total * above / up[x]) for x, k in n.items()) >= p.gain):
            kept |= {c, c[1:]}

    def byte(data, at):
        chance = 1 / 256
        for d in range(p.depth + 1):
            c = data[at - d : at]
            if c in kept:
                n = known[c]
                chance = (n[data[at]] + len(n) * chance) / (sum(n.values()) + len(n))
        return math.log10(chance)

    count = Counter(x for w in train for x in [*w, "\0"])
    total = sum(count.values())
    least = max(1.0, p.heavy * total)
    follow = defaultdict(Counter)
    for w in train:
        for a, b in zip(["\0", *w], [*w, "\0"]):
            if p.common or a != "\0" and not (count[a] >= least and count[a] >= max(p.few, p.heavy * total)):
                follow[a][b] += 1
    state = {}
    for a, n in follow.items():
        whole, once = sum(n.values()), sum(k == 1 for k in n.values())
        if whole < 2:
            continue
        gain = sum(k * (math.log(k - 1 - p.discount) - math.log(whole - 1) - math.log((count[b] if count[b] >= least else least) / total)) for b, k in n.items() if k > 1)
        if gain + once * math.log(p.discount * len(n) / whole) >= p.gain:
            state[a] = n
    out = {}
    for i, w in docs:
        score, at, data = 0.0, p.depth, pad + b"".join(spelled(w))
        for a, b, s in zip(["\0", *w], [*w, "\0"], spelled(w)):
            chance = sum(byte(data, at + k) for k in range(len(s)))
            at += len(s)
            if total:
                chance = math.log10(p.spelt * 10**chance + (1 - p.spelt) * count[b] / total)
            if a in state:
                n = state[a]
                chance = math.log10((max(n[b] - p.discount, 0) + p.discount * len(n) * 10**chance) / sum(n.values()))
            score += chance
        out[i] = score, sum(a in state for a in w)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
