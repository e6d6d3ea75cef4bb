"""Windows, labels and the whole query against plain loops over single bytes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import language_id as li


def network(classes=3, seed=4):
    net = li.BiGru(classes, np.random.default_rng(seed))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def labels_by_hand(p, data):
    """Probabilities at every byte, one number at a time."""
    h, step = li.HIDDEN, lambda x: x / (1 + abs(x))
    states = {}
    for d in "fb":
        s, at = [0.0] * h, {}
        for i in range(len(data)) if d == "f" else reversed(range(len(data))):
            x = [sum(p["emb"][data[i]][e] * p[f"w{d}"][e][k] for e in range(li.EMBED)) + p[f"b{d}"][k] for k in range(3 * h)]
            a = [sum(s[j] * p[f"u{d}"][j][k] for j in range(h)) for k in range(3 * h)]
            z, r = ([(1 + step(x[k + o] + a[k + o])) / 2 for k in range(h)] for o in (0, h))
            new = [step(x[2 * h + k] + r[k] * a[2 * h + k]) for k in range(h)]
            s = [s[k] + z[k] * (new[k] - s[k]) for k in range(h)]
            at[i] = s
        states[d] = at
    out = []
    for i in range(len(data)):
        both = states["f"][i] + states["b"][i]
        logits = [sum(both[k] * p["out"][k][c] for k in range(2 * h)) + p["bias"][c] for c in range(len(p["bias"]))]
        total = sum(math.exp(v) for v in logits)
        out.append([math.exp(v) / total for v in logits])
    return np.array(out)


def test_labels_of_a_text_across_its_words():
    net, texts = network(), [li.bytes_of("Un œuf, two words\nand a TAIL  "), b"", li.bytes_of("x")]
    got = li.read(net, texts, 3)
    for t, sums in zip(texts, got, strict=True):
        want = labels_by_hand({k: v.tolist() for k, v in net.p.items()}, t).sum(axis=0) if t else np.zeros(3)
        assert sums == pytest.approx(want, abs=1e-5)


def test_each_byte_of_a_long_text_is_labelled_once_within_its_margins():
    net = network()
    for text in ("wörter und 文字 " * 60, "no" * 150, "文" * 200, "a" * li.CORE, "b" * (li.CORE + 1)):
        data = li.bytes_of(text)
        cuts = [*li.windows(np.frombuffer(data, np.uint8)).tolist(), len(data)]
        want = np.zeros(3)
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert data[a:b].decode() and b - a <= li.CORE + 3  # whole characters
            lo, hi = max(0, a - li.MARGIN), min(len(data), b + li.MARGIN)
            want += net.forward(li.padded([data[lo:hi]]))[a - lo : b - lo, 0].sum(axis=0)
        got = li.read(net, [data, b"zz"], 3)[0]
        assert got == pytest.approx(want, abs=1e-3) and got.sum() == pytest.approx(len(data))


def test_query_against_plain_reading(spark):
    """All rows of the query, from its own sample and training, by whole forward passes over each window."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages, weights = li.train(li.sample(docs, "text", "lang", "doc_id"))
    net = li.BiGru(len(languages), np.random.default_rng(0))
    net.p = weights
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in li.op2_language_id(spark, sf).collect():
        data = li.bytes_of(text[r.doc_id])
        if not li.has_letter(text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cuts = [*li.windows(np.frombuffer(data, np.uint8)).tolist(), len(data)]
        sums = np.zeros(len(languages))
        for a, b in zip(cuts, cuts[1:], strict=False):
            lo, hi = max(0, a - li.MARGIN), min(len(data), b + li.MARGIN)
            sums += net.forward(li.padded([data[lo:hi]]))[a - lo : b - lo, 0].sum(axis=0)
        share = sums / len(data)
        assert r.score == pytest.approx(share.max(), abs=1e-3) and share[languages.index(r.lang_pred)] == pytest.approx(share.max(), abs=1e-3)


def test_sample_is_bounded_and_the_same_again(spark):
    rows = [(i % 700, f"text {i % 700} " * 400, "ab"[i % 2]) for i in range(2800)] + [(None, "copy", "a")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once, again = (li.sample(docs.repartition(n), "text", "lang", "doc_id", 40) for n in (2, 7))
    assert once == again and max(len(t) for t, _ in once) <= li.PIECES * (li.PIECE_CHARS + 1)
    assert all(sum(lang == x for _, lang in once) == 40 for x in "ab") and sum(t == "copy" for t, _ in once) <= 1


def test_given_predictions_are_replaced(spark):
    docs = spark.createDataFrame([(1, "abc", "x", 3)], "doc_id long, text string, lang string, lang_pred long").withColumn("lang_score", F.lit("old"))
    (r,) = li.predict(docs).collect()
    assert (r.lang_pred, r.lang_score) == ("x", 1.0) and r.lang == "x"
