"""The audit of sources against whole vocabularies counted one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longtally.llm import divergence

from .helpers import DOCS, lower, rows_of


def plain_divergence(rows, least):
    counts, spread, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        counts[lang, source].update(words)
        spread[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in spread[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in set(kept)})
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: chance(counts[lang, s]) for s in sources}, chance(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                order = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank + 1) for rank, (item, value) in enumerate(order)]
    return sorted(out, key=repr)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_against_plain_counts(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeéüßшу𝄞") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 70)}" if lang == "en" else rng.choice([None, "", "a", "é", "￿", "𝄞"])
        words = [vocabulary[min(int(rng.expovariate(0.02)), 399)].upper() if rng.random() < 0.2 else vocabulary[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "-1-", "\n"]).join(words), lang, source, i))
    rows += [rows[7], rows[7], (None, None, "en", "null text", 0), (1, "", "fr", "x", 0), (2, "only here", "fr", "y", 0), (3, None, "fr", None, 0), (4, "alone", "it", "z", 0)]
    rows += [(9000 + i, "long " * 4000 + "tail", "de", "a", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7).withColumns({c: F.lit("x") for c in ("term", "number", "block", "at", "words", "item")})
    got = divergence.divergence(docs, least=4)
    want = plain_divergence(rows, 4)
    assert len({r[1] for r in want if r[0] == "en"}) > divergence.TILE  # two tiles
    assert rows_of(got, *COLUMNS) == want
    assert divergence.divergence(docs.limit(0)).count() == 0


@given(st.lists(st.lists(st.integers(0, 4), min_size=13, max_size=13), min_size=2, max_size=5), st.integers(1, 13))
@settings(max_examples=80, deadline=None)
def test_walk_gives_sums_over_leaves(rows, width):
    counts = np.array(rows, np.int64)[:, :width]
    trees = divergence.Trees(counts)
    values = np.concatenate([[0], trees.values])
    a, b = np.triu_indices(len(rows), 1)
    priced = []

    def price(pair, x, y):
        priced.append(len(pair))
        assert len({*zip(pair.tolist(), x.tolist(), y.tolist())}) == len(pair)
        return np.where(x == 0, 0, (values[x] - values[y]) ** 2 * (pair + 1))

    sums, keys, prices = trees.walk(a, b, price)
    want = [((counts[i] - counts[j]) ** 2).sum() * (n + 1) for n, (i, j) in enumerate(zip(a, b, strict=True))]
    assert sums.tolist() == want and len(priced) == 1 and len(keys) == len(prices) == priced[0]


def test_equal_parts_are_shared():
    counts = np.zeros((40, 2048), np.int64)
    counts[:, 5] = 3
    counts[0, 1500] = 1
    trees = divergence.Trees(counts)
    assert sum(trees.sizes) < 60  # of 40 * 4095 nodes
    a, b = np.triu_indices(40, 1)
    _, keys, _ = trees.walk(a, b, lambda pair, x, y: np.zeros(len(pair), np.int64))
    assert len(keys) <= 3 * len(a)


def test_chances_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        words, terms = rng.randint(0, 10 ** rng.randint(1, 15)), rng.randint(1, 10**6)
        count = rng.randint(0, words)
        got = divergence.chances(np.array([0, count]), np.array([words]), terms)[0].tolist()
        assert got == [1 + 10**9 * (c + 2) // (words + 2 * terms) for c in (0, count)]
