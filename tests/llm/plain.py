"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import math
import re

from faultline.llm import line_dedup, quality

SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=SPACE):
    return re.findall(pattern, lower(text))


def base_counts(text):
    t = text or ""
    w, seen, dup = re.findall(SPACE, t), set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    mark = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)


KINDS = (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".,;:'\"?-", 5), ("!()/_[]", 6), ("#*$%&|<>@+=^~`{}\\", 7))


def kind_of(c):
    return 9 if ord(c) > 127 else next((k for chars, k in KINDS if c in chars), 8)


def shares(counts, keys):
    total = sum(counts.values())
    return [counts.get(k, 0) / total if total else 0.0 for k in keys]


def js_distance(p, q):
    middle = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, middle) if a)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2)) if sum(p) else math.sqrt(max(0.0, sum(-m * math.log2(m) for m in middle if m) - sum(-a * math.log2(a) for a in q if a) / 2))


def quality_verdicts(docs):
    """(base counts, base_failed, closest language, character distance, word distance, kept) of each (text, lang)."""
    usual = collections.defaultdict(list)
    for text, lang in docs:
        w = words(text, ALNUM)
        if lang is not None and len(w) >= quality.MIN_WORDS and len(re.findall(r"[#*$%&|<>]", text)) * quality.MAX_SYMBOLS <= len(w):
            usual[lang].append((text, w))
    langs = sorted(k for k, v in usual.items() if len(v) >= quality.LEAST_DOCS)
    weights, classes, vocabulary = {}, {}, set()
    for k in langs:
        total, by_class = collections.Counter(), collections.Counter()
        for text, w in usual[k]:
            for x, n in collections.Counter(w).items():
                total[x] += n / len(w)
            for x, n in collections.Counter(map(kind_of, text)).items():
                by_class[x] += n / len(text)
        weights[k], classes[k] = total, shares(by_class, range(10))
        often = [x for x, n in total.items() if n >= quality.WORD_SHARE * len(usual[k]) and n >= quality.LEAST_USES / quality.MIN_WORDS]
        vocabulary |= set(sorted(often, key=lambda x: -total[x])[: quality.COMMON])
    vocabulary = sorted(vocabulary)
    reference = {k: [*(r := [weights[k][x] / len(usual[k]) for x in vocabulary]), 1 - sum(r)] for k in langs}
    out = []
    for text, lang in docs:
        counts = base_counts(text)
        failed = counts[0] < quality.MIN_WORDS or 100 * counts[4] > quality.MAX_REPEAT * counts[0]
        w = words(text, ALNUM)
        mine = collections.Counter(x if x in vocabulary else None for x in w)
        by_class = shares(collections.Counter(map(kind_of, text or "")), range(10))
        by_word = shares(mine, [*vocabulary, None])
        near = {k: (js_distance(by_class, classes[k]), js_distance(by_word, reference[k])) for k in langs}
        best = min(langs, key=lambda k: sum(near[k]), default=None)
        if best is None:
            out.append((counts, failed, None, 0.0, 0.0, not failed))
            continue
        c, d = near[best]
        alone = js_distance([0.0] * len(vocabulary) + [1.0], reference[best])
        far = len(text or "") >= quality.GUARD_CHARS and c > quality.MAX_CHAR_DISTANCE
        odd = len(w) >= quality.GUARD_WORDS and len(w) * (1 - reference[best][-1]) >= quality.GUARD_COMMON and d > quality.MAX_WORD_SHARE * alone
        out.append((counts, failed, best, c, d, not failed and not ((far or odd) and (lang is None or lang in langs))))
    return out


def roots(items, alike):
    """Least item that each item reaches by links."""
    items = sorted(items)
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(items):
        for j in items[:k]:
            if alike(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dedup_lines(docs, short=1):
    """docs (id, text) with unique ids, without the lines that are like an earlier one."""
    takes = lambda x: len(x) >= line_dedup.LEAST or (len(x) >= short and x.strip())
    lines = {x for _, t in docs for x in (t or "").split("\n") if takes(x)}
    close = lambda x, y: min(len(x), len(y)) >= line_dedup.LEAST and abs(len(x) - len(y)) <= line_dedup.EDITS and distance(x, y) <= line_dedup.EDITS
    root, seen, out = roots(lines, close), set(), {}
    for i, t in sorted(docs):
        kept = []
        for x in (t or "").split("\n"):
            c = root.get(x)
            if c is None or c not in seen:
                kept.append(x)
            seen |= {c} - {None}
        out[i] = None if t is None else "\n".join(kept)
    return out


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_copies(docs, width, percent):
    """Least id that each (id, text) reaches by links."""
    sets = {i: shingles(t, width) for i, t in docs}
    return roots(sets, lambda i, j: bool(sets[i] & sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))


def benchmark_hits(text, items, window):
    doc, hit, found = words(text, ALNUM), set(), set()
    for key, item in items:
        test = words(item, ALNUM)
        n = min(window, len(test))
        for i in range(len(test) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == test[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(key))
    return len(doc), len(hit), sorted(found)


def near_items(texts, items, window, slop):
    """For each text the items with a window all of whose words are within slop words of the word that is rarest in all texts."""
    docs = [words(t, ALNUM) for t in texts]
    count = collections.Counter(w for d in docs for w in d)
    grams = {(str(k), tuple(t[i : i + min(window, len(t))])) for k, x in items if (t := words(x, ALNUM)) for i in range(max(1, len(t) - window + 1))}
    out = []
    for d in docs:
        found = set()
        for key, g in grams:
            rare = min(range(len(g)), key=lambda i: (count[g[i]], i))
            found |= {key for p, w in enumerate(d) if w == g[rare] and set(g) <= set(d[max(0, p - slop) : p + slop + 1])}
        out.append(sorted(found))
    return out
