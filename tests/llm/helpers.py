"""Fixtures and brute-force versions for the operators."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

BLANK = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# the last columns have names that the operators use themselves
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_id", T.StringType()),
    T.StructField("_th", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("_size", T.StringType())])


def corpus(spark, rows):
    """Rows of (id, text[, source]); the other columns are filled in."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", None, "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    """n words that differ from seed to seed."""
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9))) for _ in range(n))


ODD_TEXTS = [None, "", " \t\n ", "one", "a b", "É É É É É É É", "\x00 \x1c x", "word word   tail", "A" * 5000,
             "same words " * 40]


def quality_base(text):
    w = words(text)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, k in enumerate(zip(w, w[1:], w[2:])) if c[k] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(hit))


def classes(rows, percent=75, k=5):
    """doc -> (set size, least id of its class)."""
    sets = {}
    for i, text in rows:
        w = low_words(text)
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, n=13):
    """(words, hit words, item ids) of a text."""
    w = CONTENT.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        b = CONTENT.findall((item_text or "").translate(LOWER))
        size = min(n, len(b))
        windows = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if b else set()
        for p in range(len(w) - size + 1):
            if tuple(w[p:p + size]) in windows:
                hit |= set(range(p, p + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def dedup(rows, min_chars=40, min_docs=5):
    """doc -> (lines, dropped, kept text)."""
    held = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def ppm_model(texts, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text in texts:
        x = [257] * order + list((text or "").encode()) + [256]
        for j in range(order, len(x)):
            for k in range(order + 1):
                counts[k][tuple(x[j - k:j])][x[j]] += 1
    return counts


def ppm_score(text, counts, order):
    import math
    x, total = [257] * order + list((text or "").encode()) + [256], 0.0
    for j in range(order, len(x)):
        excluded, done = set(), False
        for k in range(order, -1, -1):
            seen = counts[k].get(tuple(x[j - k:j]))
            if seen is None:
                continue
            n = sum(c for s, c in seen.items() if s not in excluded)
            kinds = sum(s not in excluded for s in seen)
            if n + kinds:
                if x[j] in seen:
                    total += math.log10(seen[x[j]] / (n + kinds))
                    done = True
                    break
                total += math.log10(kinds / (n + kinds))
            excluded |= set(seen)
        if not done:
            total -= math.log10(257 - len(excluded))
    return total
