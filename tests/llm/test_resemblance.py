"""Near copies against all pairs by exact Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline
from lumenspan.llm import resemblance, simhash


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def family(rng, n, size, most):
    """A text of n words and copies with up to `most` words replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    return [" ".join(edited(rng, base, k * most // size)) for k in range(size)]


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def by_hand(texts):
    """For each text the smallest number that links of 0.8 reach."""
    shingles, name = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(shingles[i] & shingles[j])
            if name[i] != name[j] and 5 * shared >= 4 * len(shingles[i] | shingles[j]):
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return name


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    # similarity from 1 down to about 0.6; one family is large, and single edits at the limit are many
    out = [t for _ in range(12) for t in family(rng, 240, 12, 12)] + family(rng, 200, 150, 9)
    for k in range(1, 40):
        base = [f"v{rng.randrange(10**6)}" for _ in range(45 * k % 300 + 20)]
        out += [" ".join(base), " ".join(edited(rng, base, max(1, len(base) // 45)))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [resemblance.GROUP_ROWS, 20])
def test_groups_are_those_of_all_pairs(spark, texts, limit):
    want = by_hand(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in resemblance.similar_groups(df, limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in resemblance.without_copies(df, limit=limit).collect()} == set(want)


def test_rows_without_or_with_repeated_ids_stay(spark):
    rng = random.Random(3)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(9)]
    rows = [(None, t) for t in clean[:4]] + [(1, t) for t in clean[4:8]] + [(2, clean[8]), (None, clean[8]), (7, clean[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    want = [(7, clean[0])] + rows[1:9]
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted((d or 0, t) for d, t in want)


def test_near_dedup_takes_the_links_of_simhash(spark, monkeypatch):
    """Without any band in common, op 1's links alone bring near copies together; the exact similarity still decides."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)), " ".join(base).upper()]
    monkeypatch.setattr(resemblance, "candidates", lambda nodes: nodes.sparkSession.createDataFrame([], "u long, v long"))
    prints = [simhash.fingerprint(t.encode()) % 2**64 for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {0, 2}
