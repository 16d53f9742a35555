"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRAPH = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def op1(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\x01" * 100
            else:
                seen.add(s)
        kept = bytes(c for c, m in zip(b, gone, strict=True) if not m)
        out[i] = (len(b), sum(gone), sum(1 for j, m in enumerate(gone) if m and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def op2(text, phrases):
    w = ALNUM.findall(lower(text))
    places = sorted((k, label) for p, label in phrases.items() for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def op6(docs, items):
    windows = {}
    for i, x in items:
        w = ALNUM.findall(lower(x))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes, out = sorted({len(w) for w in windows}), []
    for i, x in docs:
        w, hit, found = ALNUM.findall(lower(x)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = GRAPH.findall(lower(text))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def op8(rows):
    """[(doc_id, fingerprint, component_id)]"""
    prints = [fingerprint(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return [(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


def op10(text):
    x = text or ""
    w = GRAPH.findall(x)
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        dup += bool(GRAPH.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def patience(pairs):
    """A longest ascending run, by trying all predecessors; of equals the one whose ends come first."""
    tops, back = [], {}
    for i, (_, b) in enumerate(pairs):
        k = next((k for k, t in enumerate(tops) if pairs[t][1] >= b), len(tops))
        back[i] = tops[k - 1] if k else None
        tops[k : k + 1] = [i]
    out, i = [], tops[-1] if tops else None
    while i is not None:
        out.append(i)
        i = back[i]
    return out[::-1]


def windows(lines, least=5):
    """[(start, end)]: each line with as many after it, or before it, as give ``least`` words; all lines where there are fewer words."""
    n = [len(GRAPH.findall(x)) for x in lines]
    if sum(n) < least:
        return [(0, len(n))] if n else []
    out = set()
    for i in range(len(n)):
        out |= {next((i, j) for j in range(i + 1, len(n) + 1) if sum(n[i:j]) >= least)} if sum(n[i:]) >= least else set()
        out |= {next((k, i + 1) for k in range(i, -1, -1) if sum(n[k : i + 1]) >= least)} if sum(n[: i + 1]) >= least else set()
    return sorted(out)


def op3(rows):
    """{doc_id: (lines with words, removed)}, by aligning every pair of documents."""
    docs = [(i, [s for s in (x or "").split("\n") if GRAPH.search(s)]) for i, x in sorted(rows)]
    places = []
    for _, ls in docs:
        own = {}
        for a, b in windows(ls):
            own.setdefault(tuple(ls[a:b]), []).append(a)
        places.append(own)
    out = {}
    for b, (i, ls) in enumerate(docs):
        gone = set()
        for a in range(b):
            matched = sorted((x, y, len(key)) for key, xs in places[b].items() for x, y in zip(xs, places[a].get(key, []), strict=False))
            for k in patience([(x, y) for x, y, _ in matched]):  # the aligned run
                x, _, n = matched[k]
                gone |= set(range(x, x + n))
            for x, _, n in matched:  # and what is shared in another order
                gone |= set(range(x, x + n))
        out[i] = (len(ls), len(gone))
    return out


def op10_model(votes, kinds, start, prior, rounds=1000):
    """[posterior probability of the good class] of each document's votes (-1 bad, 0 abstains, 1 good), by EM document by document."""
    import math

    classes = [None, *dict.fromkeys(kinds)]
    first = [[start[0] if c is None else start[1] if k == c else start[2] for k in kinds] for c in classes]
    chance, shares = [list(x) for x in first], [0.5] + [0.5 / (len(classes) - 1)] * (len(classes) - 1)

    def weights(own):
        p = [math.exp(math.log(s) + sum(math.log(q) if v < 0 else math.log(1 - q) for v, q in zip(own, c, strict=True) if v)) for s, c in zip(shares, chance, strict=True)]
        return [x / sum(p) for x in p]

    for _ in range(rounds):
        w = [weights(own) for own in votes]
        new = []
        for c in range(len(classes)):
            row = []
            for r in range(len(kinds)):
                b = sum(x[c] for x, own in zip(w, votes, strict=True) if own[r] < 0)
                g = sum(x[c] for x, own in zip(w, votes, strict=True) if own[r] > 0)
                row.append((b + prior * first[c][r]) / (b + g + prior))
            new.append(row)
        shares = [(sum(x[c] for x in w) + 1) / (len(votes) + len(classes)) for c in range(len(classes))]
        move = max(abs(a - b) for x, y in zip(new, chance, strict=True) for a, b in zip(x, y, strict=True))
        chance = new
        if move < 1e-9:
            break
    return [weights(own)[0] for own in votes]


def kneser_ney(trained, texts, order):
    """[bits a byte] of each text by an interpolated modified Kneser-Ney model; None for texts without a byte."""
    import math

    pad = b"\n" * (order - 1)
    raw = Counter()
    for x in trained:
        b = pad + (x or "").encode()
        raw.update(b[i : i + order] for i in range(len(b) - order + 1))
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, kinds = {}, {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        own = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3) if n1 and n2 and n3 and n4 else None
        cuts[k] = tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(own)) if own else (0.5, 0.75, 0.9)
        totals[k], kinds[k] = Counter(), {}
        for g, v in c.items():
            totals[k][g[:-1]] += v
            kinds[k].setdefault(g[:-1], [0, 0, 0])[min(v, 3) - 1] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        total = totals[k].get(g[:-1])
        if not total:
            return p(g[1:])
        v = counts[k].get(g, 0)
        share = (v - cuts[k][min(v, 3) - 1]) / total if v else 0.0
        return share + sum(d * n for d, n in zip(cuts[k], kinds[k][g[:-1]], strict=True)) / total * p(g[1:])

    out = []
    for x in texts:
        b = pad + (x or "").encode()
        n = len(b) - order + 1
        out.append(-sum(math.log2(p(b[i : i + order])) for i in range(n)) / n if n else None)
    return out


def licence_labels(text, templates):
    """Labels whose mandatory phrases stand in order, each within its gap, by trying all places; phrases that are left out widen the gap."""
    w = ALNUM.findall(lower(text))
    places = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for parts in templates.values() for p, _, _ in parts}

    def rest(parts, end, room):
        """Whether the phrases follow, the first at most so many words after the end."""
        if not parts:
            return True
        (p, gap, mandatory), n = parts[0], len(parts[0][0].split())
        if any(end <= k <= end + room + gap and rest(parts[1:], k + n, 0) for k in places[p]):
            return True
        return not mandatory and rest(parts[1:], end, room + gap + n)

    return {label for label, parts in templates.items() if any(rest(parts[1:], k + len(parts[0][0].split()), 0) for k in places[parts[0][0]])}
