"""Small documents with every odd case, and plain versions of the operators."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    w = WORD.findall((text or "").encode())
    return [bytes(x).lower() for x in w] if lower else w


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["ta", "né", "Ro", "lu", "ist", "çá"]) * rng.randint(1, 2) + str(rng.randint(0, vocabulary // 6)) for _ in range(n))


def rows(seed=5):
    """Prose, exact and near copies, shared passages, repeated lines, nulls, empty and very long texts."""
    rng = random.Random(seed)
    out = []
    passage = prose(rng, 40)
    for i in range(60):
        text = prose(rng, rng.randint(1, 160))
        if i % 7 == 3:
            text = text + " " + passage + " " + prose(rng, 20)
        if i % 9 == 4:
            text = "\n".join([text, "same line here", "same line here", "other"])
        out.append((i, text))
    for i in range(60, 90):
        base = out[i % 12][1].split(" ")
        for _ in range(i % 4):
            base[rng.randrange(len(base))] = prose(rng, 1)
        out.append((i, " ".join(base)))
    out += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "One"), (95, "four short words only"), (96, prose(rng, 6000)), (97, "x" * 400), (98, "ab " * 150), (None, out[20][1]), (None, None), (99, out[3][1]), (99, out[3][1]), (100, "word<|endoftext|>it's $$$ 12 é́x")]
    return [(i, t, ("en", "de", None)[k % 3], (None, "s1", "s1", "s2", "s1")[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(out)]


def frame(spark, data=None, extra=False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in ("shard", "slot", "size", "score", "position", "chunk", "block", "list", "_rank", "h", "n"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def shingles(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(data):
    """(id, set size, component) of every row; quadratic."""
    known = [(i, shingles(t)) for i, t in data]
    classes = defaultdict(list)
    for i, s in known:
        if i is not None and s:
            classes[s].append(i)
    sets = list(classes)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, s in enumerate(sets):
        r = find(a)
        least[r] = min([least.get(r, 1 << 60), *classes[s]])
    at = {s: least[find(a)] for a, s in enumerate(sets)}
    return sorted(((i, len(s), None if i is None else at.get(s, i)) for i, s in known), key=repr)


def without_repeats(data, least=50):
    """(id, bytes, removed, spans, remaining bytes) of every row."""
    order = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, 1 << 62), order(i))
    out = []
    for i, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < order(i):
                gone[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def language_scores(data, discount=0.75, order=3):
    """id, held_out, tokens, known, N, base, score of every row."""
    tokens = [[*words(t, lower=True), None] for _, t in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in data]
    c, follow = Counter(), defaultdict(Counter)
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
            for k in range(1, order):
                for j in range(max(0, k - 1), len(t)):
                    follow[tuple(["^", *t][j + 1 - k : j + 1])][t[j]] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for (i, _), t, h in zip(data, tokens, held):
        p1 = [(c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        score = 0
        for j, (w, p) in enumerate(zip(t, p1)):
            for k in range(1, min(order, j + 2)):
                u = tuple(["^", *t][j + 1 - k : j + 1])
                if u in follow:
                    total = sum(follow[u].values())
                    p = max(follow[u][w] - discount, 0) / total + discount * len(follow[u]) / total * p
            score += log10(p)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(map(log10, p1)), score))
    return out


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


approx = pytest.approx
