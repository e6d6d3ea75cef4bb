"""The seating draws against exact laws and long chains, and the whole query against a customer-by-customer sampler."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenspan.llm import lm_scoring, seating


def law(n, weight, d):
    """P(t tables), by the recursion, for any n."""
    s = seating.log_stirling(d, n)[n, 1:] + np.arange(1, n + 1) * math.log(weight)
    p = np.exp(s - s.max())
    return p / p.sum()


@pytest.mark.parametrize("n", [2, 300, 513, 1500])
@pytest.mark.parametrize("weight", [0.01, 1.0, 24.0, 400.0, 3000.0])
def test_tables_follow_their_law(n, weight):
    p, t = law(n, weight, 0.8), np.arange(1, n + 1)
    got = seating.sample_tables(np.full(3000, n), np.full(3000, weight), 0.8, np.arange(3000, dtype=np.uint64) * np.uint64(977))
    mean, spread = (p * t).sum(), math.sqrt(max(0.0, (p * t * t).sum() - (p * t).sum() ** 2))
    assert got.mean() == pytest.approx(mean, abs=0.02 + 5 * spread / math.sqrt(3000)) and got.std() == pytest.approx(spread, rel=0.1, abs=0.05)


def test_ten_thousand_customers_against_a_long_chain():
    n, weight, d, rng = 10_000, 24.0, 0.8, random.Random(1)
    at, sizes, total, sweeps = [0] * n, {0: n}, 0, 60
    for sweep in range(sweeps):
        for who in range(n):
            sizes[at[who]] -= 1
            if not sizes[at[who]]:
                del sizes[at[who]]
            if rng.random() * (n - 1 - d * len(sizes) + weight) < weight:
                at[who] = next(k for k in range(n) if k not in sizes)
                sizes[at[who]] = 1
                continue
            while True:  # another customer's table, taken with (size - d) / size
                other = rng.randrange(n)
                if other != who and rng.random() * sizes[at[other]] < sizes[at[other]] - d:
                    break
            at[who] = at[other]
            sizes[at[who]] += 1
        total += len(sizes) if sweep >= 20 else 0
    got = seating.sample_tables(np.full(2000, n), np.full(2000, weight), d, np.arange(2000, dtype=np.uint64))
    assert got.mean() == pytest.approx(total / (sweeps - 20), rel=0.1)


def test_draws_depend_on_seeds_alone():
    rng = np.random.default_rng(3)
    n, w, seeds = rng.integers(0, 900, 400), rng.random(400) * 50 + 0.01, rng.integers(0, 2**62, 400).astype(np.uint64)
    whole, order = seating.sample_tables(n, w, 0.7, seeds), rng.permutation(400)
    assert np.array_equal(whole[order], seating.sample_tables(n[order], w[order], 0.7, seeds[order]))
    assert np.array_equal(whole[n == 0], 0 * whole[n == 0]) and np.array_equal(whole[n == 1], 0 * whole[n == 1] + 1)


def test_gamma_moments():
    for shape in (1.3, 9.0, 1e6):
        g = seating.gamma(np.full(40_000, shape), np.arange(40_000, dtype=np.uint64))
        assert g.mean() == pytest.approx(shape, rel=0.03 / math.sqrt(shape) + 1e-4) and g.var() == pytest.approx(shape, rel=0.05)


class Restaurant:
    """Seats customers one by one; a new table is a customer of the parent."""

    def __init__(self, discount, parent, rng):
        self.d, self.parent, self.rng, self.at, self.n, self.t = discount, parent, rng, defaultdict(list), 0, 0

    def p(self, w):
        mine, up = self.at.get(w, []), self.parent.p(w) if isinstance(self.parent, Restaurant) else self.parent
        return (sum(mine) - self.d * len(mine) + (lm_scoring.STRENGTH + self.d * self.t) * up) / (lm_scoring.STRENGTH + self.n)

    def add(self, w):
        up = self.parent.p(w) if isinstance(self.parent, Restaurant) else self.parent
        mine = self.at[w]
        weights = [x - self.d for x in mine] + [(lm_scoring.STRENGTH + self.d * self.t) * up]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(mine):
            mine.append(0)
            self.t += 1
            if isinstance(self.parent, Restaurant):
                self.parent.add(w)
        mine[k] += 1
        self.n += 1

    def remove(self, w):
        mine = self.at[w]
        k = self.rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        self.n -= 1
        if not mine[k]:
            del mine[k]
            self.t -= 1
            if isinstance(self.parent, Restaurant):
                self.parent.remove(w)


def test_scores_against_a_plain_sampler(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    after = {w: rng.sample(words, 6) for w in words}
    rows = []
    for i in range(120):
        w = [rng.choice(words)]
        while len(w) < 25:
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.8 else min(rng.choice(words), rng.choice(words)))
        rows.append((i, " ".join(w)))
    rows.append((500, "w1 unseen w2 unseen unseen"))
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = [p for w in train for p in zip(["<s>", *w], [*w, "</s>"], strict=True)]
    known = len({w for _, w in pairs})
    top = Restaurant(lm_scoring.PARENT_DISCOUNT, 1 / (known + 1), rng)
    contexts = defaultdict(lambda: Restaurant(lm_scoring.CONTEXT_DISCOUNT, top, rng))
    for c, w in pairs:
        contexts[c].add(w)
    sums, sweeps = defaultdict(float), 40
    asked = {p for _, t in rows for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)}
    for sweep in range(sweeps + 10):
        for c, w in pairs:
            contexts[c].remove(w)
            contexts[c].add(w)
        if sweep >= 10:
            for c, w in asked:
                sums[c, w] += contexts[c].p(w) if c in contexts else top.p(w)
    want = {i: sum(math.log10(sums[p] / sweeps) for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chars, hot in ((lm_scoring.GROUP_CHARS, lm_scoring.HOT), (500, 20)):  # also with hot words and hot pairs
        got = {r.doc_id: r.score for r in lm_scoring.score(docs, group_chars=chars, hot_share=hot).collect()}
        gaps = np.array([got[i] / want[i] - 1 for i in want])
        assert set(got) == set(want) and abs(gaps.mean()) < 0.01 and np.abs(gaps).max() < 0.06


def test_scores_are_the_same_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r.doc_id: r.score for r in lm_scoring.score(docs.repartition(int(n))).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert got[0].keys() == got[1].keys() and all(got[1][k] == pytest.approx(v, rel=1e-6) for k, v in got[0].items())
