"""Fill-in-middle against a matcher that keeps all units, and its way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    rng = random.Random(7)
    pieces = ["a", "word", " ", "\n", "\t\t", "é", "𝒳yz", "\x0b", "<P", "P>", "S>", "<", ">", " ", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "   \n", "one", " one ", "<M>", "a <S> b", "x" * 50_000, "w " * 30_000 + "  ", "same", "same", "<S" * 9, "a<\n<" * 5]
    return list(enumerate(texts)) + [(None, "no id at all"), (None, None), (5, "twice"), (5, "twice")]


@pytest.mark.parametrize("rate", [50, 100])
def test_equals_a_matcher_that_keeps_all_units(spark, rate):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("cut", "row", "h1", "form", "n", "form__fim")}).repartition(3)
    out = fim.fill_in_middle(docs, rate=rate)
    got = out.withColumn("back", fim.restored(F.col("output__fim"), F.col("form__fim"))).collect()
    name = lambda r: (r["doc_id"], r["text"], *(r[c] for c in fim.ADDED))
    assert sorted(map(name, got), key=repr) == sorted(((d, t, *by_hand(d, t, rate=rate)) for d, t in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") and r["cut"] == r["row"] == r["n"] == 3 for r in got)
    assert {r["form__fim"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_passes_keep_no_unit():
    """Both passes in the memory of a single match, whatever the number of units."""
    import tracemalloc

    text = "unit " * 200_000
    tracemalloc.start()
    assert fim.count_units(text) == 200_001 and fim.ends(text, 3, 199_999) == (14, 999_994)
    assert tracemalloc.get_traced_memory()[1] < 50_000
    tracemalloc.stop()
    assert fim.count_units("") == 0 and fim.ends("", 0, 0) == (0, 0) and fim.ends("a b", 2, 2) == (3, 3) and fim.ends("a b", 0, 1) == (0, 1)
