"""The additive model against plain loops, held-out labels, and edge cases of the operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import quality

SF = "/root/testdata/sf0.1"


def test_features_of_plain_texts():
    f = dict(zip(quality.NAMES, quality.features("One two two two.\n\nABC d1! $ x"), strict=True))
    assert np.isclose(f["log_words"], np.log1p(8)) and np.isclose(f["distinct_words"], 7 / 8) and np.isclose(f["top_word"], 2 / 8)
    assert np.isclose(f["next_equal"], 1 / 8) and np.isclose(f["longest_run"], np.log1p(2)) and np.isclose(f["upper"], 4 / 17)
    assert np.isclose(f["wordless_lines"], 1 / 3) and f["worst_upper"] == 0 and np.isclose(f["symbol"], 1 / 21)
    assert not quality.features(None).any() and not quality.features(" \n ").any()
    worst = dict(zip(quality.NAMES, quality.features("a b c d e f\nx x x x Y Y!"), strict=True))
    assert np.isclose(worst["worst_next_equal"], 3 / 6) and np.isclose(worst["worst_upper"], 2 / 6) and np.isclose(worst["worst_shout"], 1 / 6)


def steps_by_hand(g, h, n, least):
    """The best tree of depth two by trying all cuts."""
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)

    def cut(a, b):
        options = [(gain(a, c) + gain(c, b) - gain(a, b), -c) for c in range(a + 1, b) if min(n[a:c].sum(), n[c:b].sum()) >= least]
        best = max(options, default=(0, 0))
        return -best[1] if best[0] > 1e-9 else a

    root, out = cut(0, len(g)), np.zeros(len(g))
    for a, b in ((0, root), (root, len(g))):
        c = cut(a, b)
        for lo, hi in ((a, c), (c, b)):
            out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1) if hi > lo else 0
    return out


def test_trees_equal_all_cuts_tried():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 9, 30):
        g, n = rng.normal(size=size) * 5, rng.integers(0, 40, size).astype(float)
        h = n / 4
        assert np.allclose(quality.shallow_tree(g, h, n, 5), steps_by_hand(g, h, n, 5))
    g, n = rng.normal(size=(5, 4)) * 5, rng.integers(0, 40, (5, 4)).astype(float)
    h = n / 4

    def gain(i, j):
        parts = [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
        return sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts if n[p].sum() >= 9) - g.sum() ** 2 / (h.sum() + 1)

    want = max((gain(i, j), i, j) for i in range(1, 5) for j in range(1, 4))
    assert np.allclose(quality.best_cross(g, h, n, 9), want)


def test_tables_learn_sums_and_interactions():
    rng = np.random.default_rng(5)
    x = np.zeros((6000, len(quality.NAMES)))
    x[:, :3] = rng.uniform(-1, 1, (6000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    model = quality.train(x[:5000], y[:5000])
    assert {0, 1} in [{i, j} for i, j, _ in model.pairs]
    assert ((model.score(x[5000:]) > 0.5) == (y[5000:] == 1)).mean() > 0.95  # no sum of single tables is above chance here
    # a score is nothing but looked-up numbers added
    row, total = x[5001], model.base
    for k, (cuts, values) in enumerate(zip(model.cuts, model.tables, strict=True)):
        total += values[sum(c < row[k] for c in cuts)]
    for i, j, values in model.pairs:
        total += values[sum(c < row[i] for c in model.coarse[i]), sum(c < row[j] for c in model.coarse[j])]
    assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))
    assert quality.train(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    one = quality.train(x[:50], np.ones(50)).score(x[:50])
    assert len(set(one)) == 1 and one[0] > 0.9


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in quality.op12_quality_classifier(spark, SF).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    told = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    bad = [r.predicted for r, q in told if q == 0]
    good = [r.predicted for r, q in told if q == 1]
    assert len(bad) > 100 and np.mean(bad) < 0.05 and np.mean(good) > 0.99


@pytest.mark.parametrize("most", [3, 1000])
def test_edge_cases(spark, most):
    good, junk = "A plain line of words that reads well enough.", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"
    rows = [(i, good + f" {i}" if i % 2 else junk + f" {i}") for i in range(400)] + [(None, good), (None, None), (3, ""), (3, good), (900, "w " * 60_000)] + [(7, junk)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("x", "key", "quality", "quality_score")}).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (7, 0), (7, 1), (8, None), (5000, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels, most=most).collect()
    assert len(got) == len(rows) and got[0].x == got[0].key == got[0].quality == 5
    x, y = quality.sample(docs, labels, "text", "doc_id", most)
    ids = [i for i in [*range(300), 5000] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(x) == len(y) <= most and (most == 3 or len(x) == len([i for i in ids if i < 400]))
    if most == 1000:
        assert all((r.quality_score > 0.5) == (r.text[0] == "A") for r in got if r.doc_id is not None and 300 <= r.doc_id < 400)
    assert len({r.quality_score for r in got if r.text in (None, "")}) == 1
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert {r.quality_score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
