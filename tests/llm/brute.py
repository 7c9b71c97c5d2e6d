"""Plain versions of the document operators' results, written from their contracts, for small tables."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs, items, n=13):
    """docs, items: lists of (id, text)."""
    grams = defaultdict(set)
    for item, text in items:
        words = TOKEN.findall((text or "").translate(LOWER))
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - n + 1)):
            grams[tuple(words[i : i + n])].add(str(item))
    lengths = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        words, hit, found = TOKEN.findall((text or "").translate(LOWER)), set(), set()
        for k in lengths:
            for i in range(len(words) - k + 1):
                if (g := tuple(words[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[g]
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def op4(docs, least_chars=20, least_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)

    where = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                where[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < least_docs or doc == max(where[key(x)], key=lambda d: (d is not None, d or 0))]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op6(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = BLANK_WORD.findall(text)
        places = defaultdict(list)
        for i in range(len(words) - 4):
            places[tuple(words[i : i + 5])].append(i)
        covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(5)}
        lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
        n = len(words)
        out.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n))
    return out


def op7(docs, n=13):
    first = {}
    split = [(doc, BLANK_WORD.findall(text or "")) for doc, text in docs]
    order = lambda d: (d is not None, d or 0)
    for doc, words in split:
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g not in first or order(doc) < order(first[g]):
                first[g] = doc
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - n + 1):
            if order(first[tuple(words[i : i + n])]) < order(doc):
                gone.update(range(i, i + n))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), sha(" ".join(kept))))
    return out


ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KINDS = {"assign": (ASSIGN, 6), "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 20), "hex": (re.compile(r"([0-9a-f]+)"), 24)}


def op8(docs):
    out = []
    for doc, text in docs:
        spans = []
        for rank, (kind, (pattern, least)) in enumerate(KINDS.items()):
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[1]) >= least]
        counts = [sum(s[1] == r for s in spans) for r in range(3)]
        out.append((doc, *counts, sha(",".join(s[2] for s in sorted(spans)))))
    return out


def op9(docs, n=200):
    count = defaultdict(int)
    data = [(doc, (text or "").encode()) for doc, text in docs]
    for _, b in data:
        for i in range(len(b) - n + 1):
            count[hash(b[i : i + n])] += 1
    out = []
    for doc, b in data:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - n + 1):
            if count[hash(b[i : i + n])] > 1:
                for j in range(max(i, end), i + n):
                    gone[j] = 1
                end = i + n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def fingerprint(text) -> int:
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op10(docs, most=3):
    prints = [(doc, fingerprint(text)) for doc, text in docs]
    by = defaultdict(list)
    for doc, f in prints:
        by[f].append(doc)
    values, parent = sorted(by), {f: f for f in by}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[root(b)] = root(a)
    least = {}
    for f, ids in by.items():
        known = [d for d in ids if d is not None]
        least[root(f)] = min([*known, least.get(root(f), math.inf)])
    return [(doc, f"{f:016x}", None if least[root(f)] == math.inf else least[root(f)]) for doc, f in prints]


def op11(docs, seed=7, share=100, suffix_first=50):
    out = []
    for doc, text in docs:
        text = text or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        digits = sha(f"{seed}:{'null' if doc is None else doc}")
        h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted([h1 % (len(lines) + 1), h2 % (len(lines) + 1)])
        p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= share:
            out.append((doc, len(lines), "plain", None, None, sha(text), sha(text)))
        elif h4 % 100 < suffix_first:
            out.append((doc, len(lines), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)))
        else:
            out.append((doc, len(lines), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)))
    return out


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def op13(docs, least=30, top=50):
    """docs: list of (text, lang, source)."""
    counts, where, langs = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        for term in LETTERS.findall((text or "").translate(LOWER)):
            counts[lang, source][term] += 1
            where[lang][term].add(i)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, found in where[lang].items() if len(found) >= least]

        def shares(n):
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: {t: counts[lang, s].get(t, 0) for t in kept} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in sources if x != s]
            words = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return out
