"""Document scores of toxicity, quality and language, word by word and line by line."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from llm_cases import prose
from rollcall.llm import arrays, langid, quality, toxicity

MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x ^ (x >> 31)


def poly(symbols, base):
    return sum(mixed((s + 1) * arrays.BASE & MASK) * pow(base, i, 1 << 64) for i, s in enumerate(symbols)) & MASK


def buckets(word, sizes, bits, affixes=()):
    points = [ord(c) for c in word]
    marked = [0x10FFFF, *points, 0x10FFFF]
    out = [(poly(marked[i:i + k], arrays.STEP), k) for k in sizes for i in range(len(marked) - k + 1)]
    for a in affixes:
        if len(points) >= a:
            out += [(poly(marked[:a + 1], arrays.STEP), 101 + a), (poly(marked[-a - 1:], arrays.STEP), 201 + a)]
    out.append((mixed(poly(points, arrays.BASE) ^ len(points)), 1))
    return [mixed((h + kind * 0x1000003) & MASK) >> (64 - bits) for h, kind in out]


def texts():
    rng = random.Random(7)
    some = [" ".join(rng.choice(["Idiot", "idiot!", "nice", "\u00c9t\u00e9", "a", "\u65e5\u672c", "x1", "banana"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    return [*some, None, "", " \n\t", "word", prose(1, 300), *some[:3]]


def sigmoid(z):
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_toxicity_is_the_mean_of_its_words_bags():
    value, bias = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), -0.3

    def plain(text):
        often = {w: math.sqrt(n) for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())).items()}
        total = sum(often.values()) + toxicity.PRIOR
        return sigmoid(bias + sum(n / total * np.mean(value[buckets(w, toxicity.SIZES, toxicity.BITS)], dtype=float) for w, n in often.items()))

    got = toxicity.score(pa.array(texts()), value, bias)
    assert np.allclose(got, [plain(t) for t in texts()], atol=1e-6)
    assert np.allclose(got, np.concatenate([toxicity.score(pa.array([t], pa.string()), value, bias) for t in texts()]), atol=1e-9)


def marginals(scores, trans):
    """Label probabilities at every place, by enumeration of all paths."""
    n, k = scores.shape
    paths = list(itertools.product(range(k), repeat=n))
    p = np.exp([sum(scores[t, y[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])) for y in paths])
    return np.array([[sum(q for q, y in zip(p, paths) if y[t] == c) for c in range(k)] for t in range(n)]) / p.sum()


def test_language_is_the_mean_of_its_words_posteriors():
    rng = np.random.default_rng(2)
    weights, trans = rng.normal(scale=0.3, size=(3, 1 << langid.BITS)).astype(np.float32), rng.normal(size=(3, 3))
    names = ["aa", "bb", "cc"]
    docs = ["one two three", "zorn", "Ab9cd \u00c9t\u00e9, x", None, "", "12 !?", "so it is so it", "\u65e5\u672c \u65e5\u672c"]

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            return "und", 0.0
        scores = np.array([weights[:, buckets(w, langid.SIZES, langid.BITS, langid.AFFIXES)].sum(axis=1, dtype=float) for w in words])
        mean = marginals(scores, trans).mean(axis=0)
        return names[int(mean.argmax())], mean.max()

    got, best = langid.predict(pa.array(docs), weights, trans, names)
    expect = [plain(t) for t in docs]
    assert got == [e[0] for e in expect] and np.allclose(best, [e[1] for e in expect], atol=1e-4)


def line_measures(lines, i):
    """The twelve measures of a line, read off character by character."""
    line = lines[i]
    words, solid = re.findall(r"[^\x20\x09-\x0D]+", line), re.sub(r"[\x20\x09-\x0D]", "", line)
    sign = lambda c: not c.isalnum()
    n, k = len(solid), len(words)
    return [len(line), k, n / k, sum(map(sign, solid)) / n,
            sum(a.isupper() and b.isupper() for a, b in zip(line, line[1:])) / n, sum(c.isalpha() for c in solid) / n,
            sum(c.isalnum() and not c.isalpha() for c in solid) / n, sum(a == b for a, b in zip(words, words[1:])) / k,
            1 - len(set(words)) / k, sum(len(w) == 1 and sign(w) for w in words) / k,
            sum(len(w) >= 3 and sign(w[-1]) and sign(w[-2]) for w in words) / k, float(lines.count(line) > 1)], n


def test_quality_is_the_weighted_mean_of_its_lines():
    rng = np.random.default_rng(3)
    weights, trans, curve = rng.normal(scale=0.2, size=quality.N_FEATURES), rng.normal(size=(2, 2)), (1.3, -0.2)
    pick = random.Random(4)
    stock = ["The first line reads well.", "BUY NOW NOW!! ### $$$", "a a a - - x", "1234 5678 90", "  tail...  end!!", "ENDS WITH A", "\u00c9T\u00c9 ABC", "", " \t"]
    docs = ["\n".join(pick.choice(stock) for _ in range(pick.randrange(1, 8))) for _ in range(40)] + [None, "", " \n ", "A", "ABC"]

    def plain(text):
        lines = [x for x in re.split(r"[\n\r]+", text or "") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = len(quality.EDGES)
        bins = [[sum(v >= e for e in edges) + 1 for v, edges in zip(line_measures(lines, i)[0], quality.EDGES)] for i in range(len(lines))]
        none, span = [0] * m, m * (quality.BINS + 1)

        def good(around):
            return sum(weights[b + j * (quality.BINS + 1) + k * span] for k, own in enumerate(around) for j, b in enumerate(own))

        if not lines:
            bins = [[sum(0 >= e for e in edges) + 1 for edges in quality.EDGES]]
        z = [good((b, bins[i - 1] if i else none, bins[i + 1] if i + 1 < len(bins) else none)) for i, b in enumerate(bins)]
        p = marginals(np.array([[0.0, x] for x in z]), trans)[:, 1] if lines else np.array([sigmoid(z[0])])
        n = [line_measures(lines, i)[1] for i in range(len(lines))] or [1]
        mean = min(max(float(np.dot(p, n) / sum(n)), 1e-4), 1 - 1e-4)
        return sigmoid(curve[0] * math.log(mean / (1 - mean)) + curve[1])

    got = quality.score(pa.array(docs), weights, trans, curve, 0.5)
    assert np.allclose(got, [plain(t) for t in docs], atol=1e-6)
