"""Plain single-process versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rlz(rows, window=20):
    """doc_id -> (n_words, n_removed, kept_sha256) of rows with distinct ids, in id order."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            gram = tuple(words[j : j + window])
            if gram in seen:
                gone[j : j + window] = [True] * window
            seen.add(gram)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def _short(piece):
    return hashlib.blake2b(piece, digest_size=16).digest()


def suffixes(rows, length=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    counts, out = Counter(), {}
    for _, text in rows:
        b = (text or "").encode()
        counts.update(_short(b[j : j + length]) for j in range(len(b) - length + 1))
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if counts[_short(b[j : j + length])] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return set()
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near(rows):
    """doc_id -> (n_shingles, component_id), from all pairs that share a shingle."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc in sorted(sets):
        shared = Counter(other for s in sets[doc] for other in holders[s])
        for s in sets[doc]:
            holders[s].append(doc)
        for other, n in shared.items():
            if 100 * n >= 75 * (len(sets[doc]) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}


def smallest_capacity(sizes, shards):
    """Of ordered group sizes, by bisection."""

    def feasible(capacity):
        used, filled = 1, 0
        for size in sizes:
            if size > capacity:
                return False
            if filled + size > capacity:
                used, filled = used + 1, 0
            filled += size
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def exact_rows(rows):
    """Of rows (doc_id, text) one for each text without blanks: most code points, then the smallest id, null last."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    return Counter((min(members, key=lambda m: m[:3])[3], text) for text, members in groups.items())


def near_rows(rows):
    """Of rows (doc_id, text) one for each group of near texts, as (doc_id, words); rows in no group all stay."""
    kept, nodes = Counter(), []
    for doc, text in rows:
        s = frozenset(shingles(text))
        if doc is None or not s:
            kept[(doc, s)] += 1
        else:
            nodes.append((doc, s))
    group = list(range(len(nodes)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            both = len(a & nodes[j][1])
            if 100 * both >= 75 * (len(a) + len(nodes[j][1]) - both):
                group[root(i)] = root(j)
    members = defaultdict(list)
    for i, (doc, s) in enumerate(nodes):
        members[root(i)].append((doc, s))
    return kept, list(members.values())


def mix_targets(rows):
    """source -> (target, size, largest document) in words of rows (doc_id, text, source)."""
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if s in over else level * weight[s] for s in (over or free)}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    return {s: (target[s], sizes[s], largest[s]) for s in order}


def copies(rows):
    """(source, doc_id) -> times that the mix takes rows (doc_id, text, source); all rows of an id and source alike."""
    sizes = defaultdict(list)
    for doc, text, source in rows:
        number = int(hashlib.md5(("null" if doc is None else str(doc)).encode()).hexdigest()[:15], 16)
        sizes[source].append((number, len(WORD.findall(text or "")), doc))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole = {s: sum(n for _, n, _ in sizes[s]) for s in order}
    left, free, target = float(sum(whole.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 3 * whole[s]}
        target |= {s: 3.0 * whole[s] if s in capped else level * weight[s] for s in (capped or free)}
        left -= sum(target[s] for s in capped)
        free = free - capped if capped else set()
    out = {}
    for s in order:
        every = int(target[s] // whole[s]) if whole[s] else 0
        budget, under, done = target[s] - every * whole[s], 0, False
        by_hash = defaultdict(list)
        for number, n, doc in sizes[s]:
            by_hash[number].append((n, doc))
        for number in sorted(by_hash):
            bar, sized = sum(n for n, _ in by_hash[number]), sum(n > 0 for n, _ in by_hash[number])
            if not done and bar and under + bar > budget:
                done, edge = True, sized == 1 and under + bar - budget < budget - under
            else:
                edge = not done
            under += bar if edge else 0
            for _, doc in by_hash[number]:
                out[(s, doc)] = every + bool(edge)
    return out


def statistics(text):
    """The quality statistics of one text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 12
    kinds = Counter()
    for b in raw:
        c = chr(b)
        kinds["beyond" if b > 127 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "blank" if c in " \t\n\x0b\x0c\r" else "mark" if c in ".,;:?-" else "!" if c == "!"
              else "|" if c == "|" else "symbol" if c in "#$%&*+=@^~<>/\\_" else "quote" if c in "\"'`()[]{}" else "other"] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    inside, per = max(len(raw) - kinds["blank"], 1), max(len(words), 1)
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", raw)
    letters = max(kinds["lower"] + kinds["upper"] + kinds["beyond"], 1)
    return [
        math.log1p(len(words)) / 4, math.sqrt(kinds["upper"] / letters), *(math.sqrt(kinds[k] / inside) for k in ("digit", "mark", "!", "|", "symbol", "quote")), math.log1p(inside / per),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / per), (len(words) - len(set(words))) / per, math.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)),
    ]


def quality(rows, labels, shrinkage=0.15, floor=1e-3):
    """Scores of rows (doc_id, text), fitted on labels (doc_id, quality) whose crc32 mod 5 is not 0."""
    x = [statistics(t) for _, t in rows]
    ids = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[doc].append(k)
    own = {c: np.array([x[k] for d, q in labels if d is not None and q == c and zlib.crc32(str(d).encode()) % 5 for k in ids[d]]) for c in (0, 1)}
    if min(len(v) for v in own.values()) < 2:
        return [0.0 if len(own[0]) > len(own[1]) else 1.0] * len(rows)
    logs = []
    for c in (0, 1):
        cov = np.cov(own[c].T, bias=True)
        spread = np.diag(np.maximum(np.diag(cov), 0))
        cov = (1 - shrinkage) * cov + shrinkage * spread + (floor + 0.01 * spread.mean()) * np.eye(len(cov))
        z = np.array(x) - own[c].mean(0)
        distance = (z * np.linalg.solve(cov, z.T).T).sum(1)
        logs.append(math.log(len(own[c]) / (len(own[0]) + len(own[1]))) - np.linalg.slogdet(cov)[1] / 2 - distance / 2)
    return list(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))))


def language(model, text, dimensions=2048):
    """(label, score) of one text by a fitted model: its own n-gram counts, margins and loss."""
    if not model.languages or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    counts = [0.0] * dimensions
    for length in (1, 2, 3):
        for j in range(len(raw) - length + 1):
            code = int.from_bytes(raw[j : j + length], "big")
            counts[(code * 0x9E3779B97F4A7C15 + length) % 2**64 >> 53] += 1
    x = [math.sqrt(c) for c in counts]
    size = math.sqrt(sum(v * v for v in x)) or 1e-12
    if model.weights is None:
        return model.languages[0], 1.0
    margins = [min(3.0, max(-3.0, sum(v / size * w for v, w in zip(x, column)) + b)) for column, b in zip(model.weights.T.tolist(), model.bias)]
    gain = [-model.sharpness * sum(t * math.exp(-m * c) for t, m, c in zip(model.trust, margins, word)) for word in model.code.tolist()]
    share = [math.exp(g - max(gain)) for g in gain]
    best = share.index(max(share))
    return model.languages[best], share[best] / sum(share)
