"""Plain Python versions of the contracts, for whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        t += x
    return t % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


TERM = regex.compile(r"\p{L}{4,}+")


def entities(text):
    out = set()
    for k, s, e in pii(text):
        v = text[s:e].lower()
        d = re.sub("[^0-9]", "", v)
        part = {"email": v[v.find("@") + 1 :], "ip": v.rpartition(".")[0], "card": d[:6], "phone": d[:4]}[k]
        out |= {f"{k}:{v}", f"{k}/{part}"}
    return out


def disclosing(texts, support=2, evidence=1.0, generalise_at=0.7, remove_at=0.9):
    """{text: [(kind, start, end)]} of disclosing terms, by counts over distinct texts."""
    terms = {t: {m[0].lower() for m in TERM.finditer(t)} for t in texts}
    ents = {t: entities(t) for t in texts}
    df_t, df_e = Counter(w for x in terms.values() for w in x), Counter(e for x in ents.values() for e in x)
    co = Counter((e, w) for t in texts for e in ents[t] for w in terms[t])
    told = {}
    for (e, w), c in co.items():
        info, pmi = math.log2(len(texts) / df_e[e]), math.log2(c * len(texts) / (df_e[e] * df_t[w]))
        if (c >= support or df_e[e] == 1) and info > 0 and c * pmi >= evidence * math.log2(len(texts)) - 1e-9 and pmi / info >= generalise_at:
            told[e, w] = pmi / info
    out = {}
    for t in texts:
        base, got = pii(t), []
        for m in TERM.finditer(t):
            d = max((told.get((e, m[0].lower()), 0) for e in ents[t]), default=0)
            if d and not any(s < m.end() and e > m.start() for _, s, e in base):
                got.append(("remove" if d >= remove_at else "generalise", m.start(), m.end()))
        out[t] = sorted(got)
    return out


def secrets(text):
    text = text or ""
    ci = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = "(" + "|".join(map(ci, ("password", "passwd", "secret", "token"))) + "|" + ci("api") + "_?" + ci("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def digest(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(spans):
    return hashlib.sha256(digest(spans).encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def targets(sizes):
    """sizes: {source: words}; shares 150 % by weight, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    excess, free = 1.5 * sum(sizes.values()), set(order)
    while excess > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in list(free):
            got[s] += excess * weight[s] / w
        excess = 0.0
        for s in list(free):
            if got[s] >= 2 * sizes[s]:
                excess += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                free.discard(s)
    return got


def fingerprint(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, budget=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u = np.array(sorted(set(fps)), dtype=np.uint64)
    for i, f in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ f) <= budget):
            parent[find(int(f))] = find(int(u[i + 1 + j]))
    least = {}
    for d, f in zip(ids, fps, strict=True):
        if d is not None:
            r = find(f)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(f)) for f in fps]


def unigram(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base)} of (doc_id, text) rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: [w.translate(low) for w in WORD.findall(t or "")] + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in toks.items()}


def languages(rows, grams=4, bits=20, hashes=(2654435761, 2246822519, 3266489917), least=3, least_share=0.05):
    """[(lang_pred, score)] of (doc_id, text, lang) rows: one set of slots for each language, looked up n-gram by n-gram."""

    def of(text):
        data = f" {text.lower()} ".encode()
        for i in range(len(data) - grams + 1):
            g = data[i : i + grams]
            if any(97 <= b <= 122 or b >= 128 for b in g):
                yield int.from_bytes(g, "little")

    def slots(g):
        return [((g * (h // 2 | 1)) % 2**32) >> (32 - bits) for h in hashes]

    seen = {}
    for d, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str("" if d is None else d).encode()) % 5:
            seen.setdefault(lang, Counter()).update(of(t))
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    rate = {lang: {g: n / total[lang] for g, n in c.items() if n >= least} for lang, c in seen.items()}
    best = {}
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best.get(g, 0), x)
    filters = {lang: {s for g, x in rate[lang].items() if x >= least_share * best[g] for s in slots(g)} for lang in sorted(rate)}
    wrong = {lang: (len(f) / 2**bits) ** len(hashes) for lang, f in filters.items()}
    out = []
    for _, t, _ in rows:
        if t is None or not regex.search(r"\p{L}", t) or not filters:
            out.append(("und", 0.0))
            continue
        asked = [slots(g) for g in of(t)]
        share = {lang: max(0.0, sum(all(s in f for s in a) for a in asked) - len(asked) * wrong[lang]) / (1 - wrong[lang]) / max(len(asked), 1) for lang, f in filters.items()}
        top = max(share, key=share.get)
        if not share[top]:
            top = max(filters, key=lambda lang: len(filters[lang]))
        out.append((top, min(1.0, share[top])))
    return out


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def patience(a, b, every=False):
    """Numbers of words that patience alignment can match, by recursion and plain search for the longest
    chain: over `every` longest chain where several are equally long, else over the first."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    chains = []
    for i, j in anchors:
        before = [c for c in chains if c[-1][1] < j]
        most = max(map(len, before), default=0)
        longest = [c for c in before if len(c) == most] or [[]]
        chains += [[*c, (i, j)] for c in (longest if every else longest[:1])]
    most = max(map(len, chains), default=0)
    kept = [c for c in chains if len(c) == most]
    out = set()
    for chain in kept if every else kept[:1]:
        edges = [(-1, -1), *chain, (len(a), len(b))]
        sums = {n + most}
        for (i, j), (p, q) in zip(edges, edges[1:], strict=False):
            sums = {x + y for x in sums for y in patience(a[i + 1 : p], b[j + 1 : q], every)}
        out |= sums
    return out or {n}


def licenses(text, templates, threshold=0.8):
    """Names of the templates that some window as long as the template covers."""
    words = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", text or "")]
    out = set()
    for name, t in templates.items():
        want = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t)]
        n, known = len(want), Counter(want)
        for i in range(max(1, len(words) - n + 1)):
            window = words[i : i + n]
            if sum((Counter(window) & known).values()) >= threshold * n and max(patience(window, want)) >= threshold * n:
                out.add(name)
                break
    return out
