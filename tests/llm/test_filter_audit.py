"""The audit against filters that are applied one after the other to all documents."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import filter_audit

GOOD = " ".join(f"w{i}" for i in range(210))
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (3, GOOD, None), (4, GOOD + " $", ""), (5, None, "en"), (6, "", "de"), (7, " \n\t", "de"), (8, "A B C", "en"),
    (9, "same " * 250, "en"), (10, "SAME " * 250 + "#", "fr"), (11, GOOD.upper(), "fr"), (12, "word " * 100_000, "en"), (None, GOOD, "en"), (None, GOOD, "en"),
    (13, "x", "en"), (13, "x", "en"), (13, "y", "en"), (14, "y", "en"), (None, "alone", None), (15, "é É Ñ", "es"), (16, "a|b", "es"), (16, GOOD, "es"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 0), (8, 1, None), (9, 0, 1), (9, 1, 0), (12, None, 1), (13, 1, 1), (None, 1, 1), (99, 1, 1)]
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for d, text, lang in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": any((u or "") == t and e is not None and (d is None or e < d) for e, u, _ in rows),
        }
        docs.append((lang or "", {k for k, f in fails.items() if f}, d in good, d in toxic))
    out, removed = [], Counter()
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in docs if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                own = [x for x in docs if x[0] == part]
                removed[part, f] += len(gone)
                redundant = sum(f in x[1] for x in own) - len(gone)
                out.append((part, order, step, len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("hot", [4, 1024])
def test_equals_filters_applied_in_turn(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("k1", "salt", "digest", "part", "word", "mask", "copies")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_counts(filter_audit.failures(docs.repartition(3)), labels))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == by_hand(ROWS, LABELS)
    none = filter_audit.failures(docs.where("false"))
    assert filter_audit.audit(filter_audit.mask_counts(none, labels)).count() == 0
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.failures(docs.where("doc_id = 8")), labels.where("false"))).count() == 600


def test_equal_rows_are_dealt_out(spark):
    """A third of the rows equal in all: their words aren't one task's, and counts are each row's own."""
    rows = [(1, "a b a", "en")] * 300 + [(i, f"t {i} {i}", "en") for i in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    t, d, p = F.col("text"), F.col("doc_id"), F.col("lang")
    keyed = docs.select(*filter_audit._key(d, p, t), "text")
    counts = filter_audit.word_counts(keyed).collect()
    assert Counter((r.words, r.distinct_words) for r in counts) == Counter({(900, 2): 1, (3, 2): 598})
    tasks = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(filter_audit.SALTS))).where("text = 'a b a'").repartition(16, "k1", "k2", "salt")
    assert tasks.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60
