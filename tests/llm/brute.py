"""Plain Python versions of the operators."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(docs, k, num, den):
    """docs: (doc_id, text) with distinct ids. Returns id -> (set size, component, links)."""
    sets = {i: shingles(t, k) for i, t in docs}
    near = defaultdict(set)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in ids:
        if i not in out:
            seen, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            for j in seen:
                out[j] = (len(sets[j]), min(seen), len(near[j]))
    return out


def lm(docs, order=3, backoff=0.4):
    words = {i: SPACE.findall(lower(t)) for i, t in docs}
    grams = {i: [Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in range(1, order + 1)] for i, w in words.items()}
    every = [sum((g[n] for g in grams.values()), Counter()) for n in range(order)]
    total, out = sum(every[0].values()), {}
    for i, w in words.items():

        def count(g):
            return every[len(g) - 1][g] - grams[i][len(g) - 1][g]

        def one(g):
            if len(g) == 1:
                return math.log(max(count(g), 1)) - math.log(max(total - len(w), 1))
            return math.log(count(g)) - math.log(max(count(g[:-1]), 1)) if count(g) > 0 else math.log(backoff) + one(g[1:])

        out[i] = (len(w), sum(one(tuple(w[max(0, j - order + 1) : j + 1])) for j in range(len(w))) / len(w) if w else None)
    return out


def tokens(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, at = {}, 0
    for i, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    return out


def decontaminate(docs, items, k=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for j in range(max(len(w) - k + 1, 1) if w else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[g]
        out[d] = (len(w), len(hit), sorted(found))
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licenses(text):
    w = ALNUM.findall(lower(text))
    places, labels = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def license_labels(text):
    """Labels and score: every signature run on the text, detections by priority, length and place, none inside one taken."""
    import re

    from quarrystat.llm import license_scan as L

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "surrogatepass").decode("latin-1")
    hits = []
    for priority, label, sure, keys, pattern in L.signatures():
        if all(k in low for k in keys):
            hits += [(-priority, m.start() - m.end(), m.start(), m.end(), label, sure) for m in re.finditer(f"{L.NOT_BEFORE}(?:{pattern}){L.NOT_AFTER}", low)]
    kept = []
    for h in sorted(hits):
        if not any(k[2] <= h[2] and h[3] <= k[3] for k in kept):
            kept.append(h)
    base = set(filter(None, licenses(text)[4].split(",")))
    return ",".join(sorted(base | {k[4] for k in kept})), max([0.8 if base else 0.0, *(k[5] for k in kept)])


def language(train, texts, dimensions, seed):
    """Predictions by plain trigram vectors: bound from shifted letter vectors, summed by language, compared by cosine."""
    import numpy as np

    def vector(c):
        return np.random.default_rng([seed, c]).integers(0, 2, dimensions) * 2 - 1

    def profile(text):
        out, last, letters = np.zeros(dimensions), " ", []
        for c in " " + (text or "").lower() + " ":
            c = c if c.isalpha() else " "
            if c != " " or last != " " or not letters:
                letters.append(ord(c))
            last = c
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return out

    sums = {}
    for text, lang in train:
        sums[lang] = sums.get(lang, 0) + profile(text)
    out = []
    for t in texts:
        v = profile(t)
        n = np.sqrt(v @ v)
        cos = {k: float(s @ v / (np.sqrt(s @ s) * n)) if n and s.any() else 0.0 for k, s in sorted(sums.items())}
        best = max(sorted(cos), key=lambda k: cos[k]) if n and cos else "und"
        out.append((best, min(1.0, max(0.0, cos[best])) if n and cos else 0.0))
    return out


def fill(children, budget):
    """Shares of a budget by name, children being (name, capacity, weight): everyone gets weight times one level, those full stop there."""
    if sum(c for _, c, _ in children) <= budget:
        return {n: c for n, c, _ in children}
    order, left, level = sorted(children, key=lambda x: (x[1] / x[2], x[0])), budget, 0.0
    for i, (_, c, _) in enumerate(order):
        level = max(level, left / sum(w for *_, w in order[i:]))
        left -= c
    return {n: min(c, math.floor(level * w)) for n, c, w in children}


def mixing(docs, mix):
    """Copies of each document (doc_id, text, lang, source) by plain recursion over domains, languages and sources."""
    import hashlib

    leaf = defaultdict(list)
    for i, text, lang, source in docs:
        end = (source or "")[-1:]
        domain = "web" if end in set("01234") - {""} and end else "books" if end and end in "567" else "forum"
        leaf[domain, lang or "<null>", source or "<null>"].append((i, text or "", len(SPACE.findall(text or ""))))
    leaf = {k: v for k, v in leaf.items() if sum(t for *_, t in v)}
    tokens = {k: sum(t for *_, t in v) for k, v in leaf.items()}
    cap = lambda keys: sum(tokens[k] * mix.max_epochs for k in keys)
    split = lambda keys, at: {n: [k for k in keys if k[at] == n] for n in sorted({k[at] for k in keys})}
    out, budget = {}, sum(tokens.values()) * mix.budget_percent // 100
    domains = split(list(leaf), 0)
    for d, db in fill([(d, cap(ks), mix.domains.get(d, mix.other)) for d, ks in domains.items()], budget).items():
        langs = split(domains[d], 1)
        for lang, lb in fill([(n, cap(ks), mix.languages.get(n, mix.other)) for n, ks in langs.items()], db).items():
            sources = split(langs[lang], 2)
            for s, b in fill([(n, cap(ks), mix.sources.get(n, mix.other)) for n, ks in sources.items()], lb).items():
                rows = leaf[d, lang, s]
                whole, rest = divmod(b, tokens[d, lang, s])
                keyed = sorted((hashlib.md5(f"{mix.seed}|{whole}|{'null' if i is None else i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, n) for i, t, n in rows)
                used = 0
                for _, i, n in keyed:
                    used += n
                    copies = whole + (rest > 0 and used <= rest)
                    if copies:
                        out[i] = copies
    return out
