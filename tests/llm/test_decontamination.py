"""Findings against Smith-Waterman of all pairs of documents and items."""

import random

from lumenspan.llm import decontamination as d


def test_edited_copies_beside_exact_ones(spark):
    rng = random.Random(5)
    filler = lambda n: [f"f{rng.randrange(10**5)}" for _ in range(n)]
    items = [[f"i{k}x{j}" for j in range(30 + 6 * k)] for k in range(6)]
    items[5][3:9] = items[4][3:9]  # a phrase of two items
    rows = []
    for item in items:
        rows += [[*filler(20), *item, *filler(20)]] * 2
        for every in (3, 4, 5, 7):
            for at in range(every):
                for kept in (len(item), 2 * len(item) // 3, len(item) // 2):
                    rows.append([*filler(15), *[f"n{rng.randrange(10**5)}" if i % every == at else w for i, w in enumerate(item[:kept])], *filler(15)])
    whole = {(i, k): d.smith_waterman(*[_numbers(w, r + item) for w in (item, r)])[0] / (2 * len(item)) for i, r in enumerate(rows) for k, item in enumerate(items)}
    seeded = {(i, k) for i, k in whole if {*zip(items[k], items[k][1:], items[k][2:], strict=False)} & {*zip(rows[i], rows[i][1:], rows[i][2:], strict=False)}}
    want = {p: s for p, s in whole.items() if s >= d.SIMILARITY and p in seeded}
    # what is left out has no three words of the item in a row
    assert all(any(w.startswith("n") for w in rows[i]) for i, k in whole if whole[i, k] >= d.SIMILARITY and (i, k) not in seeded)
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in d.contaminated(docs, tests).collect()} == want


def _numbers(words, known):
    import numpy as np

    place = {w: i for i, w in enumerate(dict.fromkeys(known))}
    return np.array([place[w] for w in words])


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark):
    item = " ".join(f"i{j}" for j in range(30))
    rows = [(None, item), (None, "a clean text"), (1, f"lead {item}"), (1, "another clean text"), (2, "and one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {rows[1], rows[3], rows[4]} and got.columns == docs.columns


def test_items_without_an_id_are_items(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, f"lead {a}"), (2, f"{b} tail"), (3, "a clean text"), (4, f"{a} and {b}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, b), (7, b), (7, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()} == {(1, None), (2, None), (2, 7), (4, None), (4, 7)}
    assert [r.doc_id for r in d.decontaminated(docs, items).collect()] == [3]
