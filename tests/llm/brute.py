"""Plain restatements of the operators' results, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LAST = 2**63 - 1


def split(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, n=50):
    """(n_words, n_removed, kept text) per row of (doc_id, text)."""
    own = [LAST if i is None else i for i, _ in docs]
    least = {}
    for i, (_, text) in zip(own, docs):
        w = split(text)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, (_, text) in zip(own, docs):
        w = split(text)
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(docs, items, n=10):
    """(n_words, hit words, item ids) per row."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, text in items:
        w = word(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1):
            if size:
                grams[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for _, text in docs:
        w, hit, own = word(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    own |= grams[g]
                    hit.update(range(k, k + size))
        out.append((len(w), len(hit), sorted(own)))
    return out


def components(docs, size=5, percent=80):
    """(n_shingles, component_id) per row."""
    sets = []
    for _, text in docs:
        w = split(text, lower=True)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(len(s), least[find(k)] if s else docs[k][0]) for k, s in enumerate(sets)]


def token_rows(docs, tokenizer, end):
    """(doc_id, start, n_tokens, crc) in file order; rows of (doc_id, text) already in that order."""
    start, out = 0, []
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def lm(docs, train, order, discounts):
    """(n_tokens, n_known, score, base) per text, learned from the texts of ``train``."""
    tokens = lambda t: [*split(t, lower=True), None]
    raw = Counter(w for t in train for w in tokens(t))
    total, kinds = sum(raw.values()), len(raw)
    grams = {order: Counter()}
    padded = lambda t: ["<begin>"] * (order - 1) + tokens(t)
    for t in train:
        s = padded(t)
        grams[order].update(tuple(s[k : k + order]) for k in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts, held, classes = {}, {}, {}
    for k, c in grams.items():
        n = Counter(c.values())
        cuts[k] = discounts(n[1], n[2], n[3], n[4])
        held[k], classes[k] = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, x in c.items():
            held[k][g[:-1]] += x
            classes[k][g[:-1]][min(x, 3) - 1] += 1

    def p(k, g):
        if not k:
            return 1 / (kinds + 1)
        low, h = p(k - 1, g[1:]), g[:-1]
        if not held[k][h]:
            return low
        x = grams[k][g]
        cut = cuts[k][min(x, 3) - 1] if x else 0
        return (max(x - cut, 0) + sum(a * b for a, b in zip(cuts[k], classes[k][h])) * low) / held[k][h]

    out = []
    for _, t in docs:
        s, own = padded(t), tokens(t)
        score = sum(math.log10(p(order, tuple(s[k : k + order]))) for k in range(len(own)))
        base = sum(math.log10((raw[w] + 1) / (total + kinds + 1)) for w in own)
        out.append((len(own), sum(raw[w] > 0 for w in own), score, base))
    return out


def base_secrets(text):
    """(start, kind, end) of the base kinds."""
    text = text or ""
    either = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    kinds = ((rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32))
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least)


def battery(token):
    """(p that the token is random, p that text is as free of repeats)."""
    import string

    up, lo, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    own, letters = token.replace("-", "+").replace("_", "/"), up + lo + dig + "+/"
    for fits, alphabet, fold in (
        (r"[A-Za-z0-9]+", up + lo + dig, False), (r"[0-9a-z]+|[0-9A-Z]+", dig + lo, True), (r"[A-Z2-7]+", up + "234567", False), (r"[0-9a-f]+|[0-9A-F]+", dig + "abcdef", True),
    ):
        if re.fullmatch(fits, token):
            own, letters = token.lower() if fold else token, alphabet
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    v, m, n = [letters.index(c) for c in own], len(letters), len(own)
    same = sum(c * c for c in Counter(v).values())
    z1 = (m / n * same - n - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    high = sum(x >= m / 2 for x in v)
    runs = 1 + sum((a >= m / 2) != (b >= m / 2) for a, b in zip(v, v[1:]))
    mean, mid = 1 + 2 * high * (n - high) / n, sum(v) / n
    spread = sum((x - mid) ** 2 for x in v)
    random = 0.0
    if mean > 2 and spread > 0:
        z2 = (runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
        z3 = (sum((a - mid) * (b - mid) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)
        random = min(1.0, 3 * min(tail(z1), 2 * tail(abs(z2)), 2 * tail(abs(z3))))
    dev = math.sqrt((2 * (0.065 - 0.065**2) + 4 * (n - 2) * (0.0055 - 0.065**2)) / (n * (n - 1)))
    return random, tail((0.065 - (same - n) / (n * (n - 1))) / dev)
