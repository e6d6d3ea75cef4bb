"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are looked up in every document, map-side; the hits carry the stretch of the document around
them, so the texts are read once and never shuffled. Each stretch meets every item of which it holds an n-gram, however frequent: the
n-grams that an edit spares are often those that other copies make frequent. A pair is given up only if the item's words that the
stretch holds, all taken as matched, can't reach the score. The others are aligned word by word, by Smith-Waterman; an item is found in
a document if the best local alignment reaches `SIMILARITY` of the score of a perfect copy, so edited and paraphrased copies
count and shared phrases don't. A copy of which no `SEED_WORDS` words in a row are left isn't looked at.

The test items' n-grams are broadcast in blocks of at most `BLOCK` n-grams; more items mean more passes over the documents, never a
larger broadcast. Items of fewer than `SEED_WORDS` words are looked up as a whole. Null or empty items are never found. Null text
is empty and holds nothing. In `contaminated` a null doc_id is a value like any other, and rows that repeat a doc_id share their findings;
`decontaminated` takes each row by itself. An empty table gives an empty result. Further columns aren't looked at, and pass
through `decontaminated`, where the name `__row` is reserved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, release, table, tagged

SEED_WORDS = 3
SIMILARITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and ASCII white space only


def _grams(words: list[bytes], n: int) -> np.ndarray:
    """A hash for each n-gram."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    h = np.array([known[w] if w in known else known.setdefault(w, xxh64_intdigest(w)) for w in words], np.uint64)
    return roll(h, n)


def roll(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def seed_table(items: DataFrame, text: str = "text", item_id: str = "item_id", n: int = SEED_WORDS) -> DataFrame:
    """item_id, at, gram, n_words for each n-gram of an item (the whole item if it is shorter)."""
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"))
    schema = T.StructType([items.schema["item_id"], T.StructField("at", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n_words", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in enumerate(batch.column(1)):
                words = words_of(x.as_py() or b"")
                if words:
                    grams = _grams(words, min(n, len(words)))
                    ids = batch.column(0).take(pa.array([k] * len(grams)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(grams)), pa.int32()), pa.array(grams.view(np.int64)), pa.array([len(words)] * len(grams), pa.int32())], names=schema.names)

    return items.mapInArrow(run, schema)


class Seeds:
    """Sorted n-grams of one block, by their length in words."""

    def __init__(self, rows: list[tuple[int, int, int]], n: int) -> None:
        """rows: gram, words of the n-gram, longest item that has it."""
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({r[1] for r in rows}):
            some = sorted((g % 2**64, reach) for g, s, reach in rows if s == size)
            self.by[size] = (np.array([g for g, _ in some], np.uint64), np.array([x for _, x in some], np.int64))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, n-grams, reaches in a text's word hashes."""
        found = []
        for size, (grams, reach) in self.by.items():
            here = roll(h, size)
            if len(here) and len(grams):
                k = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
                at = np.flatnonzero(grams[k] == here)
                found.append((at, here[at], reach[k[at]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at, gram, reach = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], gram[order], reach[order]


def passages(docs: DataFrame, seeds: Seeds, text: str, doc_id: str) -> DataFrame:
    """doc_id, start, passage, grams: stretches of documents around n-grams of test items; those that touch are one."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("passage", T.StringType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known: dict[bytes, int] = {}
        for batch in batches:
            row, start, passage, grams = [], [], [], []
            for k, x in enumerate(batch.column(1)):
                words = words_of(x.as_py() or b"")
                if len(known) > 200_000:
                    known = {}
                h = np.array([known[w] if w in known else known.setdefault(w, xxh64_intdigest(w)) for w in words], np.uint64)
                at, gram, reach = shared.value.hits(h)
                if not len(at):
                    continue
                lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach, len(words))
                far = np.maximum.accumulate(hi)
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > far[:-1]]))
                for a, b in zip(first, np.append(first[1:], len(at)), strict=True):
                    row.append(k)
                    start.append(int(lo[a:b].min()))
                    passage.append(b" ".join(words[int(lo[a:b].min()) : int(far[b - 1])]).decode("utf-8", "replace"))
                    grams.append(np.unique(gram[a:b]).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(passage, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment of two sequences of numbers, and where in b it starts and ends. Row by row; gaps within a row
    by a running maximum."""
    slope = GAP * np.arange(len(b) + 1)
    h, begin = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    best, where = 0, (0, 0)
    for x in a:
        step = np.zeros(len(b) + 1, np.int64)
        diagonal = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        step[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.arange(len(b) + 1)
        origin[1:] = np.where(step[1:] == 0, origin[1:], np.where(diagonal >= up, begin[:-1], begin[1:]))
        left = step - slope
        peak = np.maximum.accumulate(left)
        source = np.maximum.accumulate(np.where(left == peak, np.arange(len(b) + 1), 0))
        h, begin = peak + slope, origin[source]
        k = int(h.argmax())
        if h[k] > best:
            best, where = int(h[k]), (int(begin[k]), k)
    return best, *where


def _align(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of at least that similarity, with it and the words of the document that the best alignment spans."""
    schema = T.StructType([f for f in pairs.schema.fields if f.name not in ("passage", "item")] + [T.StructField("similarity", T.DoubleType()), T.StructField("word_start", T.LongType()), T.StructField("word_end", T.LongType()), T.StructField("copied", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[bytes], Counter]] = {}
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out, kept = [], []
            for k, (start, passage, item) in enumerate(zip(cols["start"].to_pylist(), cols["passage"].to_pylist(), cols["item"].to_pylist(), strict=True)):
                if item not in known:
                    if len(known) > 10_000:
                        known = {}
                    words = words_of((item or "").encode())
                    known[item] = words, Counter(w.decode("utf-8", "replace") for w in words)
                a, count = known[item]
                b = passage.split(" ")
                # no alignment matches more than the item's words that the passage holds
                if sum(count[w] for w in count.keys() & set(b)) < least * len(a):
                    continue
                number: dict[bytes, int] = {}
                left = np.array([number.setdefault(w, len(number)) for w in a])
                right = np.array([number.get(w.encode(), -1) for w in b])
                score, lo, hi = smith_waterman(left, right)
                similarity = score / (MATCH * max(1, len(a)))
                if similarity >= least:
                    kept.append(k)
                    out.append((similarity, start + lo, start + hi, " ".join(b[lo:hi])))
            extra = list(zip(*out, strict=True)) if out else [[], [], [], []]
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*[cols[f.name].take(rows) for f in schema.fields[:-4]], pa.array(extra[0], pa.float64()), pa.array(extra[1], pa.int64()), pa.array(extra[2], pa.int64()), pa.array(extra[3], pa.string())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY, block: int = BLOCK, written: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, item_id, similarity, word_start, word_end, copied: the best alignment for each document and item found in it. Tables that the
    result reads are added to `written`."""
    # items are told apart by their rows, whatever their ids
    items = materialise(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("item"), F.monotonically_increasing_id().alias("item_row")), "items")
    seeds = materialise(seed_table(items, "item", "item_row").withColumnRenamed("item_id", "item_row"), "item-grams")
    size = F.least("n_words", F.lit(SEED_WORDS))
    distinct = seeds.groupBy("gram", size.alias("size")).agg(F.max("n_words").alias("reach"))
    # blocks of n-grams by hash; each is collected on its own and has about `block` rows
    blocks = max(1, -(-distinct.count() // block))
    numbered = distinct.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        rows = [(r["gram"], r["size"], r["reach"]) for r in numbered.where(F.col("block") == k).select("gram", "size", "reach").toLocalIterator()]
        row = F.concat_ws(".", F.lit(k), F.monotonically_increasing_id())  # written, so that both sides of the join below see the same
        some = materialise(passages(docs, Seeds(rows, SEED_WORDS), text, doc_id).withColumn("row", row), "passages")
        found = some if found is None else found.unionByName(some)
        if written is not None:
            written.append(some)
    pairs = found.select("row", F.explode("grams").alias("gram")).join(seeds.select("gram", "item_row").distinct(), "gram").select("row", "item_row").distinct()
    good = _align(found.drop("grams").join(pairs, "row").join(items, "item_row").select("doc_id", "item_id", "start", "passage", "item"), similarity)
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "word_start", "word_end", "copied"), F.struct("similarity", -F.col("word_start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the rows that hold a test item, each judged by its own text."""
    rows = tagged(docs)
    written: list[DataFrame] = []
    bad = contaminated(rows, items, text, "__row", written=written, **how).select(F.col("doc_id").alias("__row")).distinct()
    bad = materialise(bad, "contaminated")
    for table_ in written:
        discard(table_)
    release(docs.sparkSession)
    return rows.join(bad, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
